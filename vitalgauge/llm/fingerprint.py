"""Document fingerprints: 128-bit SimHash, and permuted block tables for near fingerprints.

Terms are a text's three-word shingles (A-Z lower-cased; a shorter text is one term); a term weighs 1 + log2 of how
often it occurs. Each term's hash votes on every bit with its weight; a bit is set where the sum is positive. Equal texts have
equal fingerprints; a text without words has fingerprint 0. A fingerprint is written as 32 hexadecimal digits.

Near search: a fingerprint is cut into radius + 1 blocks; two within the radius agree on one block entirely, and
within the other bits on one of radius + 1 sub-blocks. One table for each (block, sub-block) brings together those that
agree, equal fingerprints counting as one, and every met pair is verified by its Hamming distance. All pairs within the
radius are found, but three bits reach hardly beyond exact copies: texts of Jaccard similarity 0.8 differ in more (README).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import named, saved

BITS = 128
WIDTH = 3
RADIUS = 3
CACHED_WORDS = 200_000
ROWS_AT_ONCE = 4096
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 40:
            self[word] = value
        return value


_HASHES = _Hashes()


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their counts."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    span = min(WIDTH, len(codes))
    n = len(codes) - span + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, span, np.uint64)
        for k in range(span):
            mixed = (mixed ^ codes[k : k + n]) * MIX[0]
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed, return_counts=True)


def simhash(text: str) -> bytes:
    """16 bytes: the signs of the weighted votes of all terms."""
    hashes, counts = terms(text)
    if not len(hashes):
        return bytes(BITS // 8)
    votes, total = np.zeros(BITS), 0.0
    weights = (1 + np.log2(counts)).astype(np.float32)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        part, weight = hashes[at : at + ROWS_AT_ONCE], weights[at : at + ROWS_AT_ONCE]
        with np.errstate(over="ignore"):
            wide = np.empty((len(part), 2), np.uint64)
            for k in (0, 1):
                mixed = part * MIX[1 + k]
                wide[:, k] = (mixed ^ (mixed >> np.uint64(32))) * MIX[0]
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        votes += weight @ bits.astype(np.float32)
        total += float(weight.sum())
    return np.packbits(2 * votes > total).tobytes()


def distance(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - distance(a, b) / BITS


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: the fingerprint; null counts as empty. Keeps all rows and columns; a column named ``out`` is replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: simhash(t).hex())

    return df.withColumn(out, run(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def _blocks(digits: int, radius: int) -> list[tuple[int, int]]:
    """(start, length) of radius + 1 runs of hexadecimal digits."""
    cuts = [digits * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _hamming(a: str, b: str) -> Column:
    """Differing bits of two fingerprints of 32 digits."""

    def half(at: int) -> Column:
        sides = [F.conv(F.substring(c, at, 8), 16, 10).cast("bigint") for c in (a, b)]
        return F.bit_count(sides[0].bitwiseXOR(sides[1]))

    return sum((half(at) for at in (9, 17, 25)), half(1))


def near_pairs(df: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """(a, b, bits): all pairs of different fingerprints in ``df`` that differ in at most ``radius`` bits, a < b."""
    digits = BITS // 4
    if not 0 <= radius < digits // 2:
        raise ValueError(f"radius from 0 to {digits // 2 - 1}")
    distinct = named(df, fp=fingerprint).where(F.col("fp").isNotNull()).distinct()
    keys = []
    for number, (start, size) in enumerate(_blocks(digits, radius)):
        # the permuted fingerprint: this block first, then the others
        rest = F.concat(F.substring("fp", 1, start), F.substring("fp", start + size + 1, digits))
        for sub, (at, length) in enumerate(_blocks(digits - size, radius)):
            keys.append(F.concat(F.lit(f"{number}.{sub}."), F.substring("fp", start + 1, size), F.substring(rest, at + 1, length)))
    tables = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = tables.groupBy("key").count().where("count > 1").select("key")
    sides = tables.join(shared, "key")
    one, other = sides.select("key", F.col("fp").alias("a")), sides.select("key", F.col("fp").alias("b"))
    bits = _hamming("a", "b")
    return (
        one.join(other, (one["key"] == other["key"]) & (F.col("a") < F.col("b")) & (bits <= radius))
        .select("a", "b", bits.alias("bits"))
        .distinct()
    )


def near_counts(df: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): how many other rows of ``df`` have a fingerprint within the radius. Rows with equal
    fingerprints are counted before pairs are looked for, so a group of copies costs as much as one."""
    groups = named(df, fp=fingerprint).where(F.col("fp").isNotNull()).groupBy("fp").agg(F.count("*").alias("n"))
    pairs = near_pairs(groups, "fp", radius)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    around = both.join(groups, F.col("b") == F.col("fp")).groupBy("a").agg(F.sum("n").alias("others"))
    return groups.join(around, F.col("fp") == F.col("a"), "left").select(
        F.col("fp").alias("fingerprint"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")
    )


ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text: the last quarter of its characters replaced by as many of the
    first of the next document in ascending key (after the last: the first; rows with equal keys go by text, null
    keys come first).

    Rows go to ranges of keys, and each range also gets the first row of the range after it. A task then reads its range in
    order and holds two rows at a time.
    """
    spark = df.sparkSession
    low = -(1 << 63)
    rows = named(df, doc_id=key, body=text).select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(low)).alias("place"),
    )
    n = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = rows.select(F.col("place").cast("double").alias("place")).approxQuantile("place", [k / n for k in range(1, n)], 0.5 / n)
    marks = sorted({int(m) for m in marks})
    # the number of marks at or below a key is its range
    bucket = F.aggregate(F.array(*map(F.lit, marks)) if marks else F.array().cast("array<bigint>"), F.lit(0), lambda a, m: a + (F.col("place") >= m).cast("int"))
    rows = rows.withColumn("range", bucket)
    firsts = sorted((r["range"], r["first"]) for r in rows.groupBy("range").agg(F.min("place").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], ROW)
    # for each range's first key: the range before it, which for the first range is the last
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    guests = spark.createDataFrame([(k, r) for k, r in before.items()], "first bigint, host int")
    hosted = rows.join(F.broadcast(guests), F.col("place") == F.col("first"))
    both = rows.select("range", F.lit(0).alias("guest"), "place", "doc_id", "body").union(
        hosted.select("host", F.lit(1), "place", "doc_id", "body")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # range, doc_id, body, fingerprint of the row that waits for its next
        out: list[tuple] = []
        for batch in batches:
            for bucket, guest, missing, doc_id, body in zip(
                batch["range"], batch["guest"], batch["doc_id"].isna(), batch["doc_id"], batch["body"], strict=True
            ):
                if guest and (held is None or held[0] != bucket):
                    continue
                own = simhash(body)
                if held is not None and held[0] == bucket:
                    out.append(_row(*held[1:], body, own))
                held = None if guest else (bucket, None if missing else int(doc_id), body, own)
            yield _table(out)
            out = []
        yield _table(out)

    return both.repartition("range").sortWithinPartitions("range", "guest", "place", "body").mapInPandas(run, ROW)


def _row(doc_id: int | None, body: str, own: bytes, following: str, next_own: bytes) -> tuple:
    quarter = len(body) // 4
    changed = body[: len(body) - quarter] + following[:quarter]
    other = simhash(changed) if changed != body else own
    sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
    return doc_id, len(body), sha, own.hex(), other.hex(), likeness(own, other), likeness(own, next_own)


def _table(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
    return frame.astype({"doc_id": "Int64"})


def report(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``edited`` with n_near, the number of other documents within the radius of the fingerprint."""
    rows = saved(edited(df, key, text), "fingerprints")
    return rows.join(near_counts(rows, radius=radius), "fingerprint").select(*rows.columns, "n_near")
