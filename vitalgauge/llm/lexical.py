"""Ranked lexical search: term-partitioned postings, visited one owner after another by bundles of items.

Documents are read once. Each task cuts its documents into blocks and writes one row for each (block, term): places of
the documents in the block and occurrences, packed. Terms are dealt to owners by how common they are; the rarest come
first. A bundle holds the items of one item block and their sparse accumulators over one document block: (item, place,
score). At each owner's stage a cogroup by (item block, document block) brings the bundle and that owner's postings
together and adds whole-number contributions. Behind the last owner the best documents of each bundle are read off, and a
window picks the best of each item.

Accumulators stay sparse without loss: a document is dropped from a bundle only if its score so far and all that the
owners still to come can add stay below what the k-th best document of the bundle has already.

Blocks hold at most BLOCK_DOCS documents and about BLOCK_POSTINGS postings, and item blocks about ITEM_BLOCK items, so a
cogroup's size is bounded; very common terms fall apart into one row for each block. The only broadcast of this module's
own is a bitmap of fixed size that says which terms may be in items; others aren't written at all.

Terms are maximal runs of digits, ASCII letters and all characters above 0x7F; only A-Z are lower-cased. Null and empty texts
have no terms. Each row of documents is a document, also with an id that another has; null ids come first among equal
scores. Items with one id are one item with the terms of all its rows. Without documents, items or common terms there are no rows.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgauge.llm.common import named, saved, slices, text_of

BLOCK_DOCS = 8_192
BLOCK_POSTINGS = 2_000_000
ITEM_BLOCK = 256
BITMAP_BITS = 23
SCALE = 1_000_000_000
# An owner has the terms that fewer than 1 of so many documents hold; the last one has the rest.
OWNERS = (512, 32, 4)
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
CACHED_TERMS = 400_000


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode().translate(TERM_BYTES).split()


def slot(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & ((1 << BITMAP_BITS) - 1)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term, slot); the item's key as text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = batch.assign(term=[list(set(terms(t))) for t in batch["body"]]).explode("term").dropna(subset="term")
            yield pd.DataFrame({"item": rows["item"], "term": rows["term"], "slot": [slot(t) for t in rows["term"]]})

    rows = named(items, item=key, body=text).select(F.col("item").cast("string").alias("item"), text_of("body").alias("body"))
    return rows.mapInPandas(scan, "item string, term binary, slot int").distinct()


def bitmap(wanted: DataFrame) -> np.ndarray:
    """One bit for each slot that a term of the items has: at most 2^BITMAP_BITS / 8 bytes, whatever the items."""
    words = wanted.select(F.shiftright("slot", 5).alias("at"), F.expr("1L << (slot & 31)").alias("bit"))
    packed = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    bits[packed["at"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits


def index(documents: DataFrame, bits: np.ndarray, key: str, text: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings of the terms that the bitmap has, one row for each (block, term), and one row without a term for each block.

    Posting rows: packed has places and then occurrences, n how many; most is the largest number of occurrences, least the
    length (all terms) of the shortest document. Block rows: packed has the lengths of the documents, n how many, total
    their sum, ids the documents' ids as text.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shipped.value
        known: dict[bytes, bool] = {}
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, lengths, held = [], array("i"), 0
        postings: dict[bytes, tuple[array, array]] = {}

        def packed_block() -> pd.DataFrame:
            n = np.array(lengths, np.int32)
            rows = [(first + made, None, n.tobytes(), len(ids), None, None, int(n.sum(dtype=np.int64)), ids)]
            for term, (places, tfs) in postings.items():
                least = int(n[np.frombuffer(places, np.int32)].min())
                rows.append((first + made, term, places.tobytes() + tfs.tobytes(), len(places), max(tfs), least, None, None))
            return pd.DataFrame(rows, columns=["block", "term", "packed", "n", "most", "least", "total", "ids"]).astype(
                {c: "Int64" for c in ("most", "least", "total")}
            )

        for batch in slices(batches):
            for name, body in zip(batch["id"], batch["body"], strict=True):
                found = terms(body)
                if not found:
                    continue
                place = len(ids)
                ids.append(name)
                lengths.append(len(found))
                for term, tf in Counter(found).items():
                    wanted = known.get(term)
                    if wanted is None:
                        if len(known) >= CACHED_TERMS:
                            known.clear()
                        s = slot(term)
                        wanted = known[term] = bool(bits[s >> 5] >> np.uint32(s & 31) & np.uint32(1))
                    if wanted:
                        if term not in postings:
                            postings[term] = (array("i"), array("i"))
                        places, tfs = postings[term]
                        places.append(place)
                        tfs.append(tf)
                        held += 1
                if len(ids) >= block_docs or held >= BLOCK_POSTINGS:
                    yield packed_block()
                    ids, lengths, held, made = [], array("i"), 0, made + 1
                    postings = {}
        if ids:
            yield packed_block()

    rows = named(documents, id=key, body=text).select(F.col("id").cast("string").alias("id"), text_of("body").alias("body"))
    return rows.mapInPandas(
        scan, "block bigint, term binary, packed binary, n bigint, most bigint, least bigint, total bigint, ids array<string>"
    )


def contribution(tf, length_factor):
    """What one term adds to a document's score for each unit of its weight, in whole numbers; ``length_factor``: m."""
    return SCALE * tf // (1000 * tf + 20 * length_factor)


def weighted_terms(postings: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(item, term, weight, owner, bound): bound is the most that the term can add to any document."""
    held = postings.where("term IS NOT NULL").groupBy("term").agg(
        F.sum("n").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")
    )
    factor = F.expr(f"50 + (50 * least * {n_docs}L) div {max(1, n_terms)}L")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("bigint")
    owner = sum((F.col("df") * share >= n_docs).cast("int") for share in OWNERS)
    return (
        wanted.join(held, "term")
        .select("item", "term", weight.alias("weight"), owner.alias("owner"), "most", factor.alias("factor"))
        .withColumn("bound", F.expr(f"weight * (({SCALE}L * most) div (1000 * most + 20 * factor))"))
        .drop("most", "factor")
    )


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _visit(bundle: pd.Series, rows: pd.DataFrame, k: int) -> dict:
    """Add one owner's postings to a bundle, then drop what can't come among the k best of this block."""
    m = _unpack(bundle["m"], np.int64)
    rests = dict(zip(bundle["items"], bundle["rests"], strict=True))  # keeps the items' order
    for items, left in zip(rows["items"], rows["rests"], strict=True):
        rests.update(zip(items, left, strict=True))
    at_row = {item: i for i, item in enumerate(rests)}
    scores = np.zeros((len(rests), len(m)), np.int64)
    scores[_unpack(bundle["who"], np.int32), _unpack(bundle["place"], np.int32)] = _unpack(bundle["score"], np.int64)
    for packed, items, weights in zip(rows["packed"], rows["items"], rows["weights"], strict=True):
        places, tfs = np.split(_unpack(packed, np.int32), 2)
        adds = contribution(tfs.astype(np.int64), m[places])
        for item, weight in zip(items, weights, strict=True):
            scores[at_row[item], places] += weight * adds
    who, place = [], []
    for i, rest in enumerate(rests.values()):
        row = scores[i]
        least = np.partition(row, len(row) - k)[-k] if len(row) > k else 0
        at = np.flatnonzero((row > 0) & (row + rest >= least))
        who.append(np.full(len(at), i, np.int32))
        place.append(at.astype(np.int32))
    who, place = np.concatenate(who), np.concatenate(place)
    return {
        "item_block": bundle["item_block"], "block": bundle["block"], "ids": bundle["ids"], "m": bundle["m"],
        "items": list(rests), "rests": list(rests.values()),
        "who": who.tobytes(), "place": place.tobytes(), "score": scores[who, place].tobytes(),
    }


BUNDLE = (
    "item_block int, block bigint, ids array<string>, m binary, items array<string>, rests array<bigint>,"
    " who binary, place binary, score binary"
)


def search(
    documents: DataFrame, items: DataFrame, k: int = 50,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block_docs: int = BLOCK_DOCS, items_together: int = ITEM_BLOCK,
) -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item_id, rank, doc_id, score.

    Rank is from 1; equal scores go by ascending id. See the module's text for terms, ties and nulls.
    """
    wanted = saved(item_terms(items, item_key, item_text), "search-terms")
    postings = saved(index(documents, bitmap(wanted), key, text, block_docs), "search-postings")
    heads = postings.where("term IS NULL")
    held = heads.agg(F.sum("n"), F.sum("total")).first()
    n_docs, n_terms = held[0] or 0, max(1, held[1] or 0)
    n_item_blocks = -(-max(1, wanted.select("item").distinct().count()) // items_together)

    weights = saved(weighted_terms(postings, wanted, n_docs, n_terms), "search-weights")
    # rest: what the owners behind this one can still add to the item
    own = Window.partitionBy("item", "owner")
    from_here = Window.partitionBy("item").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    takers = (
        weights.withColumn("rest", F.sum("bound").over(from_here) - F.sum("bound").over(own))
        .withColumn("item_block", F.pmod(F.xxhash64("item"), F.lit(n_item_blocks)).cast("int"))
        .groupBy("term", "owner", "item_block")
        .agg(F.collect_list(F.struct("item", "weight", "rest")).alias("taker"))
        .select(
            "term", "owner", "item_block", F.col("taker.item").alias("items"), F.col("taker.weight").alias("weights"),
            F.col("taker.rest").alias("rests"),
        )
    )

    def factors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = [_unpack(raw, np.int32).astype(np.int64) for raw in batch["m"]]
            yield batch.assign(m=[(50 + 50 * n * n_docs // n_terms).tobytes() for n in lengths])

    def visit(bundles: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return bundles if bundles.empty or rows.empty else pd.DataFrame([_visit(bundles.iloc[0], rows, k)])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples(index=False):
                who, place, score = _unpack(one.who, np.int32), _unpack(one.place, np.int32), _unpack(one.score, np.int64)
                chosen = []
                for i in np.unique(who):
                    mine = np.flatnonzero(who == i)
                    got = score[mine]
                    # all that tie with the k-th: their ids decide later
                    least = np.partition(got, len(got) - k)[-k] if len(got) > k else 0
                    chosen.append(mine[got >= least])
                if chosen:
                    at = np.concatenate(chosen)
                    yield pd.DataFrame({"item": [one.items[i] for i in who[at]], "id": [one.ids[p] for p in place[at]], "score": score[at]})

    bundles = heads.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_item_blocks - 1))).alias("item_block"), "block", "ids", F.col("packed").alias("m"),
        F.expr("cast(array() AS array<string>)").alias("items"), F.expr("cast(array() AS array<bigint>)").alias("rests"),
        *[F.lit(bytearray()).alias(c) for c in ("who", "place", "score")],
    ).mapInPandas(factors, BUNDLE)
    rows = postings.where("term IS NOT NULL").select("block", "term", "packed")
    for owner in range(len(OWNERS) + 1):
        owned = rows.join(takers.where(F.col("owner") == owner), "term").drop("term", "owner")
        bundles = (
            bundles.groupBy("item_block", "block").cogroup(owned.groupBy("item_block", "block")).applyInPandas(visit, BUNDLE)
        )
    found = bundles.mapInPandas(best, "item string, id string, score bigint").select(
        F.col("item").cast(items.schema[item_key].dataType).alias("item_id"),
        F.col("id").cast(documents.schema[key].dataType).alias("doc_id"),
        "score",
    )
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
