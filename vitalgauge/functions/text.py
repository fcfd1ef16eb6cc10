"""SQL text for string rules that follow Python where Spark's built-ins differ.

Every function takes and returns SQL text, so a rule costs one parsed expression however long it
is. Patterns are raw SQL literals.
"""

from __future__ import annotations

# Unicode white space that Python strips (fixed values).
_SPACE = (
    r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Line boundaries of Python text lines; CRLF counts once (fixed values).
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
_FLOAT = (
    r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
CANONICAL_INTEGER = r"^(0|-?[1-9][0-9]*)$"


def raw(pattern: str) -> str:
    """Raw SQL literal of a regular expression."""
    return f"r'{pattern}'"


def strip(text: str) -> str:
    """Remove leading and trailing Unicode white space."""
    return f"regexp_replace({text}, {raw(f'^{_SPACE}+|{_SPACE}+$')}, '')"


def lines(text: str) -> str:
    """Split at every line boundary Python knows, not only at newlines."""
    return f"split({text}, {raw(_LINE_BREAK)}, -1)"


def parse_double(text: str) -> str:
    """Finite double from text as Python reads it; null when it is not a finite number."""
    trimmed = strip(text)
    number = f"try_cast(replace({trimmed}, '_', '') AS double)"
    return f"if({trimmed} rlike {raw(_FLOAT)} AND abs({number}) < double('Infinity'), {number}, NULL)"


def parse_integer(text: str) -> str:
    """64-bit integer from canonical decimal text; null otherwise."""
    return f"if({text} rlike {raw(CANONICAL_INTEGER)}, try_cast({text} AS bigint), NULL)"


def json_string(text: str) -> str:
    """One JSON string literal, or null."""
    return f"trim(BOTH '[]' FROM to_json(array({text})))"


def python_double(number: str) -> str:
    """Text of a finite double as Python prints it: an exponent below 1e-4 and from 1e16, else plain digits.

    Java switches to an exponent at 1e-3 and 1e7 and writes it differently; the digits are the same.
    """
    split = (
        f"transform(array(cast({number} AS string)), t -> named_struct('t', t, 'm',"
        " replace(substring_index(t, 'E', 1) || '|', '.0|', '|'), 'n',"
        " cast(if(contains(t, 'E'), substring_index(t, 'E', -1), '0') AS int)))"
    )
    digits = "translate(p.m, '-.|', '')"
    sign = "if(startswith(p.t, '-'), '-', '')"
    return (
        f"element_at(transform({split}, p -> CASE WHEN NOT contains(p.t, 'E') THEN p.t"
        " WHEN p.n >= 16 OR p.n < -4 THEN concat(translate(p.m, '|', ''), 'e', if(p.n < 0, '-', '+'),"
        " if(abs(p.n) < 10, '0', ''), cast(abs(p.n) AS string))"
        f" WHEN p.n < 0 THEN concat({sign}, '0.', repeat('0', -p.n - 1), {digits})"
        f" WHEN length({digits}) <= p.n + 1 THEN concat({sign}, rpad({digits}, p.n + 1, '0'), '.0')"
        f" ELSE concat({sign}, left({digits}, p.n + 1), '.', substring({digits}, p.n + 2)) END), 1)"
    )


def lower_escapes(column: str) -> str:
    """JSON text of a column with lower-case control escapes, so hashes do not depend on the writer.

    Text without such an escape, which is nearly all of it, is returned as it is.
    """
    out = column
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F", "7F"):
        # An escaped backslash before the letter u is text, not an escape.
        pattern = raw(rf"(?<!\\)((?:\\\\)*)\\u00{code}")
        out = f"regexp_replace({out}, {pattern}, {raw(rf'$1\\u00{code.lower()}')})"
    return f"if(contains({column}, r'\\u00'), {out}, {column})"


def untrimmed(text: str) -> str:
    """True when the text starts or ends with Unicode white space."""
    return f"{text} rlike {raw(f'^{_SPACE}|{_SPACE}$')}"


def basename(path: str) -> str:
    """Last path component, accepting both separators."""
    return f"substring_index(replace({path}, r'\\', '/'), '/', -1)"
