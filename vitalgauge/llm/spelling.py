"""Spelling variants: words at one edit from each other, found by composing acceptors with a one-edit transducer.

The vocabulary acceptor V (minimised, deterministic) is composed with a transducer E that replaces, inserts or deletes
exactly one letter, and with V again: V o E o V accepts the pairs of words that differ by one edit. Its paths are dealt
out by their first states. A pair of lengths s and s or s + 1 has its edit behind the first s // 2 letters or before the
last s - s // 2 ones; so the machine that has read those letters without an edit is one initial state, in the machine
or in the reversed machine. Each word takes part in at most four initial states. An initial state's words make a small
acceptor of their own; states of different keys never meet, so the whole is never built in one place.

Of a path only what its word needs leaves a task: how many words are near and the best of them. Which pairs there are
doesn't depend on partitions. A word has a bounded number of neighbours (letters times length), so paths are linear in
the words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import named, saved, slices, text_of

LETTERS = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0xC0)
LOWERED = bytes((b + 32 if 65 <= b <= 90 else b) if b in LETTERS else 32 for b in range(256))
FLUSHED = 200_000  # distinct words that a task counts before it hands the counts on
NOISE = 199  # one in so many runs loses a letter

Node = tuple[bool, tuple[tuple[str, int], ...]]


class Acceptor:
    """Minimised deterministic acceptor of sorted distinct words: equal right languages share one state."""

    def __init__(self, words: list[str]) -> None:
        self.nodes: list[Node] = []
        self._known: dict[Node, int] = {}
        # open states along the last word: whether it ends there, and its finished arcs
        ends, arcs, last = [False], [[]], ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._close(ends, arcs, last, same)
            for _ in word[same:]:
                ends.append(False)
                arcs.append([])
            ends[-1], last = True, word
        self._close(ends, arcs, last, 0)
        self.start = self._state(ends[0], arcs[0])

    def _state(self, end: bool, arcs: list[tuple[str, int]]) -> int:
        node = (end, tuple(arcs))
        found = self._known.get(node)
        if found is None:
            found = self._known[node] = len(self.nodes)
            self.nodes.append(node)
        return found

    def _close(self, ends: list[bool], arcs: list[list], last: str, keep: int) -> None:
        while len(ends) > keep + 1:
            state = self._state(ends.pop(), arcs.pop())
            arcs[-1].append((last[len(ends) - 1], state))

    def common(self, one: int, other: int, but: str = "") -> Iterator[str]:
        """Words that both states accept; ``but``: the first state must not read this letter first."""
        todo = [(one, other, "")]
        while todo:
            one, other, read = todo.pop()
            (end, arcs), (other_end, other_arcs) = self.nodes[one], self.nodes[other]
            if end and other_end:
                yield read
            following = dict(other_arcs)
            for letter, state in arcs:
                if letter in following and (read or letter != but):
                    todo.append((state, following[letter], read + letter))

    def one_edit_pairs(self) -> Iterator[tuple[str, str]]:
        """The paths of V o E o V, each pair once: the shorter word first, of equal lengths the smaller one.

        A letter is inserted only where the shorter word goes on with another one, so one pair has one path.
        """
        todo = [(self.start, "")]
        dead: set[tuple[int, int, str]] = set()  # composed states that accept nothing

        def rests(one: int, other: int, but: str = "") -> Iterator[str]:
            if (one, other, but) not in dead:
                found = False
                for rest in self.common(one, other, but):
                    found = True
                    yield rest
                if not found:
                    dead.add((one, other, but))

        while todo:
            state, read = todo.pop()
            arcs = self.nodes[state][1]
            for i, (letter, to) in enumerate(arcs):
                todo.append((to, read + letter))
                for other, other_to in arcs[i + 1 :]:  # replaced
                    for rest in rests(to, other_to):
                        yield read + letter + rest, read + other + rest
                for rest in rests(state, to, letter):  # inserted
                    yield read + rest, read + letter + rest


def _shared(one: str, other: str) -> int:
    n = 0
    for a, b in zip(one, other):
        if a != b:
            break
        n += 1
    return n


def count_words(df: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = None, min_length: int = 1) -> DataFrame:
    """Lower-cased runs of Latin letters with their number of occurrences, of at least ``min_length`` letters.

    Only A-Z are lower-cased. With ``noise``, a run whose crc32 of ``<key>:<run>`` is divisible by it loses the letter at
    crc32 % length. Null and empty texts have no words; a null key counts as the text ``null``; repeated rows all count.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
            total.clear()
            return frame

        for batch in slices(batches):
            for k, body in zip(batch["id"], batch["body"], strict=True):
                lead = zlib.crc32(f"{k}:".encode())
                # one byte a character: letters of the runs are all within Latin-1
                runs = Counter(body.encode("latin-1", "replace").translate(LOWERED).split())
                for raw, n in runs.items():
                    if len(raw) < min_length:
                        continue
                    word = raw.decode("latin-1")
                    if noise:
                        h = zlib.crc32(raw if raw.isascii() else word.encode(), lead)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length or not word:
                                continue
                    total[word] += n
                if len(total) >= FLUSHED:
                    yield out()
        if total:
            yield out()

    rows = named(df, id=key, body=text).select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), text_of("body").alias("body")
    )
    return rows.mapInPandas(scan, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def initial_states(words: DataFrame) -> DataFrame:
    """Each word once for every initial state that it can pass: direction, shorter length, letters read without an edit."""
    length = F.char_length("word")
    takes = F.explode(F.array(*[F.struct(F.lit(back).alias("back"), (length - d).alias("size")) for back in (False, True) for d in (0, 1)]))
    half = F.floor(F.col("size") / 2).cast("int")
    letters = F.when(F.col("back"), F.col("size") - half).otherwise(half)
    word = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    return (
        words.select("word", "n", takes.alias("take"))
        .select("word", "n", "take.*")
        .where("size >= 1")
        .select("back", "size", F.substring(word, F.lit(1), letters).alias("read"), word.alias("spelt"), "n")
    )


def _compose(back: bool, size: int, read: str, counts: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Pairs of one initial state, in the spelling of the machine (reversed if ``back``)."""
    if len(counts) < 2:
        return
    acceptor = Acceptor(sorted(word[len(read) :] for word in counts))
    for one, other in acceptor.one_edit_pairs():
        # Pairs of two longer words belong to the next size.
        if min(len(one), len(other)) + len(read) != size:
            continue
        one, other = read + one, read + other
        # A pair with enough first letters alike is found by the machine that reads forward.
        if back and _shared(one[::-1], other[::-1]) >= size // 2:
            continue
        yield one, other


def near_words(words: DataFrame) -> DataFrame:
    """For each word with a near word: n_near, and the near word of largest n (ties: smallest in code-point order).

    ``words``: distinct words and their n. Words without near words have no row.
    """

    def enumerate_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, counts = None, {}

        def settle() -> pd.DataFrame | None:
            if state is None:
                return None
            back = state[0]
            near: dict[str, list] = {}
            for pair in _compose(*state, counts):
                for word, other in (pair, pair[::-1]):
                    rank = (-counts[other], other[::-1] if back else other)
                    entry = near.setdefault(word, [0, rank])
                    entry[0] += 1
                    if rank < entry[1]:
                        entry[1] = rank
            if not near:
                return None
            return pd.DataFrame(
                [(w[::-1] if back else w, n, r[1], -r[0]) for w, (n, r) in near.items()],
                columns=["word", "n_near", "best", "best_n"],
            )

        for batch in batches:
            found = []
            for back, size, read, spelt, n in batch.itertuples(index=False, name=None):
                if state != (back, size, read):
                    found.append(settle())
                    state, counts = (back, size, read), {}
                counts[spelt] = n
            found = [f for f in found if f is not None]
            if found:
                yield pd.concat(found)
        last = settle()
        if last is not None:
            yield last

    dealt = initial_states(words).repartition("back", "size", "read").sortWithinPartitions("back", "size", "read")
    pairs = dealt.mapInPandas(enumerate_pairs, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best"), F.col("best_n")))
    return (
        pairs.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("top"))
        .select("word", "n_near", F.col("top.best").alias("best"), F.col("top.best_n").alias("best_n"))
    )


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Every word with its form (the near word of largest n, if that n >= ratio * n) and root (follow forms to the last).

    ``words``: columns word (distinct) and n. Columns: word, form, root, n, n_near, form_n. ``ratio`` is at least 2, so
    n grows along forms and there is no cycle; pointers double each round, so rounds are few (n is a 64-bit number).
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    near = near_words(words)
    takes = F.col("best_n") >= F.lit(ratio) * F.col("n")
    report = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"),
        F.when(takes, F.col("best_n")).alias("form_n"),
    )
    report = saved(report, "spelling-forms")
    links = report.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        nexts = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = saved(
            links.join(nexts, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        moved = not links.where("moved").isEmpty()
        links = links.select("word", "root")
        if not moved:
            break
    return report.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    df: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = None,
    min_length: int = 6, min_count: int = 5, ratio: int = 5,
) -> DataFrame:
    """Spelling variants among the words of whole texts; see ``count_words`` and ``variants``."""
    words = count_words(df, key, text, noise, min_length).where(F.col("n") >= min_count)
    return variants(saved(words, "spelling-words"), ratio)
