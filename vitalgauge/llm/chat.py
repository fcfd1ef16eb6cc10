"""Chat formatting: a compiler for a small sandboxed template language.

Templates are text with ``{{ expression }}`` and the statements ``for x in list``, ``if`` / ``elif`` / ``else``,
``set x = expression`` and ``generation``, each closed by ``end...`` in ``{% %}``. Expressions have text, whole numbers, true, false and none,
names, ``a.b`` and ``a['b']`` (fields of messages and of ``loop`` only), ``+``, ``==``, ``!=``, ``and``, ``or``,
``not``, parentheses and the filters ``escape``, ``trim``, ``upper`` and ``lower``. There are no calls: a template
reaches nothing but the conversation. The text is parsed to a syntax tree, constant parts are folded, and the tree
becomes Python closures that write pieces, each with whether it lies inside ``generation``.

``escape`` puts one more bar after every ``<|`` of a text, so no control string ``<|name|>`` of the template can come
from a text, and taking one bar from every ``<||`` gives the text back.

Rows of a conversation are put together by sorting inside partitions, and stream through the template one turn at a
time, so a conversation of any length fits. Turns go in order of turn, then role, then text; null turns first. Null
roles and texts count as empty. Rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalgauge.llm.common import named

TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role|escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)

Emit = Callable[[str, bool], None]
Code = Callable[[dict, Emit, bool], None]
Value = Callable[[dict], Any]


class TemplateError(ValueError):
    """The template can't be compiled, or asks for something outside the sandbox."""


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
WORDS = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[+.|()\[\]=,])|(\S))")
CONSTANTS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _words(text: str) -> list[tuple[str, Any]]:
    found, at, text = [], 0, text.strip()
    while at < len(text):
        match = WORDS.match(text, at)
        at = match.end()
        number, name, quoted, sign, other = match.groups()
        if other:
            raise TemplateError(f"unexpected {other!r} in {text!r}")
        if number:
            found.append(("const", int(number)))
        elif name:
            found.append(("name", name))
        elif quoted:
            found.append(("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)))
        else:
            found.append(("sign", sign))
    return found


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, fields."""

    def __init__(self, text: str) -> None:
        self.words, self.at, self.text = _words(text), 0, text

    def peek(self) -> tuple[str, Any]:
        return self.words[self.at] if self.at < len(self.words) else ("end", None)

    def take(self, kind: str, value: Any = None) -> Any:
        got = self.peek()
        if got[0] != kind or value is not None and got[1] != value:
            raise TemplateError(f"expected {value or kind} in {self.text!r}")
        self.at += 1
        return got[1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return tree

    def _chain(self, word: tuple[str, str], below: Callable[[], tuple]) -> tuple:
        tree = below()
        while self.peek() == word:
            self.at += 1
            tree = (word[1], tree, below())
        return tree

    def either(self) -> tuple:
        return self._chain(("name", "or"), self.both)

    def both(self) -> tuple:
        return self._chain(("name", "and"), self.negated)

    def negated(self) -> tuple:
        if self.peek() == ("name", "not"):
            self.at += 1
            return ("not", self.negated())
        tree = self.sum()
        if self.peek() in (("sign", "=="), ("sign", "!=")):
            sign = self.take("sign")
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        return self._chain(("sign", "+"), self.filtered)

    def filtered(self) -> tuple:
        tree = self.atom()
        while True:
            if self.peek() == ("sign", "|"):
                self.at += 1
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            elif self.peek() == ("sign", "."):
                self.at += 1
                tree = ("field", tree, self.take("name"))
            elif self.peek() == ("sign", "["):
                self.at += 1
                tree = ("field", tree, self.take("const"))
                self.take("sign", "]")
            else:
                return tree

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name" and value in CONSTANTS:
            return ("const", CONSTANTS[value])
        if kind == "name":
            return ("name", value)
        if (kind, value) == ("sign", "("):
            tree = self.either()
            self.take("sign", ")")
            return tree
        raise TemplateError(f"unexpected {value!r} in {self.text!r}")


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template."""
    at, root = 0, []
    # open blocks: name, the list that their statements go to, their own node
    stack: list[tuple[str, list, Any]] = [("", root, None)]
    for found in PARTS.finditer(template):
        if found.start() > at:
            stack[-1][1].append(("text", template[at : found.start()]))
        at = found.end()
        if found[1] is not None:
            stack[-1][1].append(("print", _Expression(found[1]).whole()))
        elif found[2] is not None:
            _statement(found[2].strip().strip("-").strip(), stack)
    if at < len(template):
        stack[-1][1].append(("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def _statement(text: str, stack: list[tuple[str, list, Any]]) -> None:
    word, _, rest = text.partition(" ")
    name, body, node = stack[-1]
    if word == "for":
        match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
        if not match:
            raise TemplateError(f"for what, in {text!r}?")
        inner: list = []
        body.append(("for", match[1], _Expression(match[2]).whole(), inner))
        stack.append(("for", inner, None))
    elif word == "if":
        inner, branches = [], []
        branches.append((_Expression(rest).whole(), inner))
        body.append(("if", branches))
        stack.append(("if", inner, branches))
    elif word in ("elif", "else") and name == "if" and node[-1][0] != ("const", True):
        inner = []
        node.append((("const", True) if word == "else" else _Expression(rest).whole(), inner))
        stack[-1] = ("if", inner, node)
    elif word == "set":
        match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.*)", rest, re.S)
        if not match:
            raise TemplateError(f"set what, in {text!r}?")
        body.append(("set", match[1], _Expression(match[2]).whole()))
    elif word == "generation":
        inner = []
        body.append(("generation", inner))
        stack.append(("generation", inner, None))
    elif word == f"end{name}" and name:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {text!r}")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _add(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


BINARY: dict[str, Callable[[Any, Any], Any]] = {"+": _add, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def fold(tree: tuple) -> tuple:
    """The expression with its constant parts worked out."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        return ("const", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    if kind == "not":
        inner = fold(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold(tree[1]), fold(tree[2])
    if kind in ("and", "or") and a[0] == "const":
        return b if bool(a[1]) == (kind == "and") else a
    if kind in BINARY and a[0] == b[0] == "const":
        return ("const", BINARY[kind](a[1], b[1]))
    return (kind, a, b)


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with folded expressions, dead branches gone, and neighbouring constant text joined."""
    done: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and done and done[-1][0] == "text":
            done[-1] = ("text", done[-1][1] + node[1])
        elif node != ("text", ""):
            done.append(node)

    for node in body:
        if node[0] == "print":
            value = fold(node[1])
            put(("text", _text(value[1])) if value[0] == "const" else ("print", value))
        elif node[0] == "for":
            put(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif node[0] == "set":
            put(("set", node[1], fold(node[2])))
        elif node[0] == "generation":
            put(("generation", fold_body(node[1])))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] != "const" or test[1]:
                    branches.append((test, fold_body(inner)))
                if test[0] == "const" and test[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    put(inner)
            elif branches:
                put(("if", branches))
        else:
            put(node)
    return done


def value_of(tree: tuple) -> Value:
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda env: constant
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "field":
        inner, key = value_of(tree[1]), tree[2]

        def field(env: dict) -> Any:
            holder = inner(env)
            if holder is None:
                return None
            if type(holder) is not dict:
                raise TemplateError(f"no field {key!r} outside messages and loop")
            return holder.get(key)

        return field
    if kind == "filter":
        inner, run = value_of(tree[2]), FILTERS[tree[1]]
        return lambda env: run(_text(inner(env)))
    if kind == "not":
        inner = value_of(tree[1])
        return lambda env: not inner(env)
    a, b = value_of(tree[1]), value_of(tree[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    run2 = BINARY[kind]
    return lambda env: run2(a(env), b(env))


def code_of(body: list[tuple]) -> Code:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, emit: Emit, inside: bool) -> None:
        for step in steps:
            step(env, emit, inside)

    return run


def _step(node: tuple) -> Code:
    kind = node[0]
    if kind == "text":
        constant = node[1]
        return lambda env, emit, inside: emit(constant, inside)
    if kind == "print":
        value = value_of(node[1])
        return lambda env, emit, inside: emit(_text(value(env)), inside)
    if kind == "set":
        name, assigned = node[1], value_of(node[2])
        return lambda env, emit, inside: env.__setitem__(name, assigned(env))
    if kind == "generation":
        inner = code_of(node[1])

        def generation(env: dict, emit: Emit, inside: bool) -> None:
            inner(env, emit, True)
            emit("", False)  # the marker ends here, also where another begins at once

        return generation
    if kind == "if":
        branches = [(value_of(test), code_of(inner)) for test, inner in node[1]]

        def choose(env: dict, emit: Emit, inside: bool) -> None:
            for test, branch in branches:
                if test(env):
                    branch(env, emit, inside)
                    return

        return choose
    name, source, loop_body = node[1], value_of(node[2]), code_of(node[3])

    def loop(env: dict, emit: Emit, inside: bool) -> None:
        items = iter(source(env) or ())
        index, item = 0, next(items, None)
        outer = env.get("loop")
        while item is not None:
            after = next(items, None)
            index += 1
            env[name] = item
            env["loop"] = {"first": index == 1, "last": after is None, "index": index}
            loop_body(env, emit, inside)
            item = after
        env["loop"] = outer

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str) -> None:
        self.code = code_of(fold_body(parse(source)))

    def write(self, messages: Iterable[dict], emit: Emit) -> None:
        self.code({"messages": messages}, emit, False)

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans under the loss mask."""
        parts: list[str] = []
        spans: list[list[int]] = []
        at, open_ = 0, False

        def emit(piece: str, inside: bool) -> None:
            nonlocal at, open_
            if inside and not open_:
                spans.append([at, at])
            parts.append(piece)
            at += len(piece)
            if inside:
                spans[-1][1] = at
            open_ = inside

        self.write(messages, emit)
        return "".join(parts), [(a, b) for a, b in spans]


class ReadBack:
    """Reads a formatted stream of the default form again, turn by turn, and keeps digests of what it holds."""

    START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.buffer: list[str] = []
        self.masked: list[str] = []

    def emit(self, piece: str, inside: bool) -> None:
        self.chars += len(piece)
        if inside:
            self.masked.append(piece)
        elif self.masked:
            text = unescape("".join(self.masked))
            self.masked = []
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())
        self.buffer.append(piece)
        if "|>\n" in piece:
            self._turns()

    def _turns(self) -> None:
        held = "".join(self.buffer)
        *whole, rest = held.split(self.END)
        for turn in whole:
            if not turn.startswith(self.START):
                raise TemplateError("the output can't be read back")
            role, _, text = turn[len(self.START) :].partition(self.SEPARATOR)
            self.turns += 1
            self.turn_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self.buffer = [rest] if rest else []

    def row(self) -> tuple:
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _streamed(
    df: DataFrame, schema: str, finish: Callable[[Any, Iterator[dict]], Iterator[tuple]], conv: str, turn: str, role: str, text: str
) -> DataFrame:
    """Sort the turns of each conversation together and hand each to ``finish`` as a stream."""
    columns = StructType.fromDDL(schema).fieldNames()

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["conv_id"]]
            yield from zip(ids, batch["role"], batch["text"], strict=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for conv_id, group in groupby(turns(batches), key=lambda t: t[0]):
            rows += finish(conv_id, ({"role": r, "text": t} for _, r, t in group))
            if len(rows) >= 1000:
                yield _frame(rows, columns)
                rows = []
        yield _frame(rows, columns)

    empty = F.lit("")
    rows = named(df, conv_id=conv, turn=turn, role=role, text=text).select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, schema)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns, dtype=object)
    return frame.astype({"conv_id": "Int64"})


def format_conversations(
    df: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a conversation: conv_id, formatted, spans (start, stop) under the loss mask, in characters."""
    Template(template)  # errors show here, not in a task

    def finish(conv_id: Any, messages: Iterator[dict]) -> Iterator[tuple]:
        formatted, spans = Template(template).render(messages)
        yield conv_id, formatted, [{"start": a, "stop": b} for a, b in spans]

    schema = "conv_id bigint, formatted string, spans array<struct<start: bigint, stop: bigint>>"
    return _streamed(df, schema, finish, conv, turn, role, text)


def digests(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a conversation: what reading its formatted stream again gives, as counts and digests."""
    compiled = []

    def finish(conv_id: Any, messages: Iterator[dict]) -> Iterator[tuple]:
        if not compiled:
            compiled.append(Template(TEMPLATE))
        reader = ReadBack()
        compiled[0].write(messages, reader.emit)
        yield conv_id, *reader.row()

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _streamed(df, schema, finish, conv, turn, role, text)
