"""Benchmark decontamination: pigeonhole edit matching.

An item of n characters may occur with up to ``floor(rate * n)`` edits. It is cut into one piece more than that, so
every such occurrence holds at least one piece unchanged. Pieces are found with an Aho-Corasick automaton in whole
documents; each hit (hits at nearly the same place count as one) is verified with Myers' bit-parallel distance
between the item and the best-fitting part of the text around the hit.

Both sides are lower-cased and each run of white space becomes one space. Null and empty items, and items under
``min_chars`` characters after that, match nothing; null and empty texts hold nothing. Items with equal texts are all
reported. The items are the query set: they are read in blocks of ``block_chars`` characters, each block is searched
in all documents, and only one block at a time is shipped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import named, only

RATE = 0.05
MIN_CHARS = 40
BLOCK_CHARS = 4_000_000
HIT_SCHEMA = "doc_id bigint, item_id bigint, distance int, start bigint, stop bigint"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """Offsets and texts of the budget-plus-one pieces of an item."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        masks[char] |= 1 << i
    return dict(masks)


def best_end(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Myers: least distance of the pattern to any part of ``text``, and where the first such part ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, at = size, 0
    for i, char in enumerate(text, 1):
        eq = masks.get(char, 0)
        carry = eq | minus
        diagonal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(carry | up))
        minus = up & carry
        if score < best:
            best, at = score, i
    return best, at


class Matcher:
    """The items of one block, with the automaton over all their pieces."""

    def __init__(self, items: Iterable[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS) -> None:
        self.rate = rate
        by_text: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            body = normal(text or "")
            if len(body) >= min_chars:
                by_text[body].append(item_id)
        self.texts = list(by_text)
        self.ids = list(by_text.values())
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, body in enumerate(self.texts):
            for at, piece in pieces(body, rate):
                owners[piece].append((k, at))
        self.masks = [(pattern_masks(t), pattern_masks(t[::-1])) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of the best occurrence of each item; places count in the normal text."""
        if not text or self.empty:
            return []
        body = normal(text)
        # where an item would begin, by item
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, who) in self.automaton.iter(body):
            for k, at in who:
                begins[k].add(end + 1 - size - at)
        found = []
        for k, places in begins.items():
            item = self.texts[k]
            budget = int(self.rate * len(item))
            best: tuple[int, int, int] | None = None
            covered = None
            for place in sorted(places):
                # an occurrence with this piece begins at most ``budget`` from here
                if covered is not None and place <= covered:
                    continue
                if body.startswith(item, place) and place >= 0:
                    best = (0, place, place + len(item))
                    break
                covered = place + budget
                low, high = max(0, place - budget), place + len(item) + 3 * budget
                window = body[low:high]
                distance, end = best_end(self.masks[k][0], len(item), window)
                if distance <= budget and (best is None or distance < best[0]):
                    _, length = best_end(self.masks[k][1], len(item), window[:end][::-1])
                    best = (distance, low + end - length, low + end)
            if best is not None:
                found += [(item_id, *best) for item_id in self.ids[k]]
        return found


def item_blocks(items: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed one partition at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in named(items, id=key, body=text).where(F.col("body").isNotNull()).toLocalIterator():
        block.append((row["id"], row["body"]))
        size += len(row["body"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, distance, start, stop (in the normal text).

    Rows with a null doc_id are searched as well.
    """
    spark = documents.sparkSession
    texts = named(documents, doc_id=doc_key, body=doc_text).where(F.col("body").isNotNull())

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            only("decontaminate")
            matcher = Matcher(shipped.value, rate, min_chars)
            for batch in batches:
                rows = [(d, *hit) for d, body in zip(batch["doc_id"], batch["body"], strict=True) for hit in matcher.find(body)]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "stop"], dtype=object)
                yield frame.where(frame.notna(), None)

        return texts.mapInPandas(run, HIT_SCHEMA)

    found = [search(block) for block in item_blocks(items, item_key, item_text, block_chars)]
    if not found:
        return spark.createDataFrame([], HIT_SCHEMA)
    return reduce(DataFrame.unionAll, found)


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    out: str = "contaminated",
    rate: float = RATE,
    min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Add ``out``: whether the text holds any item. Keeps all rows and columns; a column named ``out`` is replaced."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(f"`{doc_text}`").cast("string"), F.lit(""))

    def holds(block: list[tuple[int, str]]):
        shipped = spark.sparkContext.broadcast(block)

        @F.pandas_udf("boolean")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            only("decontaminate")
            matcher = Matcher(shipped.value, rate, min_chars)
            for texts in batches:
                yield texts.map(lambda t: bool(matcher.find(t))).astype(bool)

        return run(body)

    blocks = item_blocks(items, item_key, item_text, block_chars)
    return documents.withColumn(out, reduce(lambda a, b: a | b, map(holds, blocks), F.lit(False)))
