"""N-gram Jaccard join: grouped prefix join over sets of word shingles, with the classes that its links make.

A text's words are runs of anything but ASCII white space, A-Z lower-cased; its set is that of its distinct
``width``-word shingles (a shorter text is one shingle; without words the set is empty and links with nothing). Two
documents link when intersection >= ``percent`` / 100 of union; a class is whatever links connect.

1. Documents with equal sets make one node, whatever their number.
2. Shingles are ordered: the common ones (found by counting over all documents, with a bound on the error that lossy
   counting guarantees) come last, by frequency; the rest by hash. Two linked sets share at least k shingles in the
   first size - ceil(percent * size) + k of that order: their prefixes. k is a 32nd of what they must share, at least
   three (fewer if they must share fewer in all).
3. Nodes with identical prefix and size make a group; groups, not nodes, stand in the inverted lists. A group with fewer
   than k prefix shingles that any other set of fitting size may share drops out; the others stand in all but their
   k - 3 longest lists, in which linked ones still meet three times.
4. Star rounds: in each inverted list and size band one node is verified against those that aren't connected with it
   yet and share enough lists with it. That is linear in the list, and a family of near copies falls into one class
   without its pairs.
5. All group pairs that share a list, fit in size, position and sketch, and lie in different classes are
   expanded to members and verified. Only pairs already known to be in one class are left out, so no class is missed.
   Of each group's lists the two longest stay out here, which leaves linked sets one in common, and a pair that meets
   on a list just before is passed over.

Verification: a set's parity bitmap has about as many bits as the set has shingles, each bit telling whether an odd
number of them fall on it. Two bitmaps differ in at most as many bits as the sets do in shingles, so pairs whose
bitmaps differ too much can't link and their sets aren't fetched; of the others the whole sorted sets are
intersected. A sketch is such a bitmap of fixed length, short enough to stand in the lists. Classes come from label propagation with pointer jumping; each round's
labels are a table in the shared folder. Classes are of texts: rows with equal doc_ids share one only
if their texts link. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm import common as shared_folder
from vitalgauge.llm.common import arrow_rows, named, only, slices, worker_cache

CACHED_WORDS = 100_000
BATCH_ROWS = 1000  # texts or sets that pass to Python at a time
LISTS_SHARED = 3  # inverted lists that two linked sets share, if the sets are that large
SHARED_PART = 32  # the prefixes share one in so many of the shingles that linked sets must share
SKETCH = [f"sketch{k}" for k in range(4)]  # words of 64 bits
BEFORE = [f"before{k}" for k in range(2)]  # lists that a group is on just before this one
FILTER_BITS = 24
COMMON_BITS = 22  # shingles with over 1 / 2**(COMMON_BITS + 1) of all occurrences are common: that bounds their number
COUNT_AT_ONCE = 1 << 21
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class JoinSpec:
    width: int = 5
    percent: int = 80

    def least(self, size: int) -> int:
        """How many shingles a set of this size shares with any that it links with."""
        return -(-self.percent * size // 100)

    def common(self, size: int) -> int:
        """How many of them must lie in both prefixes. From one size to the next it grows no more than ``least``; so a
        set shares its own number also with a smaller one."""
        return min(max(LISTS_SHARED, self.least(size) // SHARED_PART), self.least(size))

    def prefix(self, size: int) -> int:
        return size - self.least(size) + self.common(size)

    def linked(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 40:
            self[word] = value
        return value


_HASHES = worker_cache("near_join", _Hashes())


def saved(df: DataFrame, label: str) -> DataFrame:
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        return shared_folder.saved(df, label)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    span = min(width, len(codes))
    n = len(codes) - span + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, span, np.uint64)
        for k in range(span):
            mixed = (mixed ^ codes[k : k + n]) * MIX_A
            mixed ^= mixed >> np.uint64(29)
        mixed *= MIX_B
        mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    if n > 1:
        mixed = mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]
    return mixed


def _signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _parity(shingles: np.ndarray, bits: int = 0) -> bytes:
    """The set's parity bitmap: a power of two of bits, at least as many as shingles unless ``bits`` is given."""
    bits = bits or max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(one: bytes, other: bytes, a: int, b: int, spec: JoinSpec) -> bool:
    """Whether sets of sizes ``a`` and ``b`` with these bitmaps can link. The longer bitmap is folded onto the shorter."""
    if len(one) > len(other):
        one, other = other, one
    short = np.frombuffer(one, np.uint8)
    folded = np.bitwise_xor.reduce(np.frombuffer(other, np.uint8).reshape(-1, len(short)), axis=0)
    apart = int(np.bitwise_count(short ^ folded).sum())
    return spec.linked((a + b - apart) // 2, a, b)


def _first_pass(texts: DataFrame, spec: JoinSpec) -> DataFrame:
    """Two kinds of rows from one look at each text: (doc_id, set_key, size) of the row, equal sets having equal keys;
    and (shingle, n, every), counts of shingles that are frequent among the last some millions, of ``every`` seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("near_join")
        held: list[np.ndarray] = []
        size = 0
        for part in slices(batches):
            sets = [shingle_set(t, spec.width) for t in part["body"]]
            yield _rows(part["doc_id"], part["key"], [_signature(s) for s in sets], [len(s) for s in sets])
            for own in sets:
                held.append(own)
                size += len(own)
                if size >= COUNT_AT_ONCE:
                    yield _counts(held)
                    held, size = [], 0
        if size:
            yield _counts(held)

    return texts.mapInPandas(
        run, "doc_id bigint, key bigint, set_key binary, size bigint, shingle bigint, n bigint, every bigint"
    )


def _rows(ids: pd.Series, keys: pd.Series, signatures: list[bytes], sizes: list[int]) -> pd.DataFrame:
    blank = pd.array([None] * len(ids), "Int64")
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, "Int64"),
            "key": keys.to_numpy(),
            "set_key": signatures,
            "size": sizes,
            "shingle": blank,
            "n": blank,
            "every": blank,
        }
    )


def _counts(held: list[np.ndarray]) -> pd.DataFrame:
    together = np.concatenate(held)
    held.clear()
    together.sort()
    starts = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]]))
    counts = np.diff(np.append(starts, len(together)))
    kept = counts >= max(2, len(together) >> (COMMON_BITS + 1))
    hashes, n = together[starts[kept]].view(np.int64), counts[kept]
    every = np.zeros(len(n) + 1, np.int64)
    every[-1] = len(together)
    blank = pd.array([None] * len(every), "Int64")
    return pd.DataFrame(
        {
            "doc_id": blank,
            "key": blank,
            "set_key": [None] * len(every),
            "size": blank,
            "shingle": np.append(hashes, 0),
            "n": np.append(n, 0),
            "every": every,
        }
    )


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with over 1 / 2**(COMMON_BITS + 1) of all occurrences, sorted by hash, and their ranks by frequency.

    A task passes on what has over that share (and at least two) of the millions that it counts at a time; a shingle
    with such a share of all passes in at least one count. There are at most 2**(COMMON_BITS + 1).
    """
    totals = saved(
        counts.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("every").alias("every")),
        "near-counts",
    )
    every = totals.agg(F.sum("every")).first()[0] or 0
    rows = totals.where(F.col("n") >= max(3, every >> (COMMON_BITS + 1))).select("shingle", "n").toArrow()
    hashes = rows["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, rows["n"].to_numpy()))] = np.arange(len(hashes))
    by_hash = np.argsort(hashes)
    return hashes[by_hash], ranks[by_hash]


def _ordered(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the global order: uncommon by hash, then common by frequency."""
    if not len(common):
        return shingles
    at = np.searchsorted(common, shingles)
    at[at == len(common)] = 0
    hit = common[at] == shingles
    return np.concatenate([shingles[~hit], shingles[hit][np.argsort(ranks[at[hit]])]])


def _prefixes(texts: DataFrame, spec: JoinSpec, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(set_key, size, family, prefix, bits, *SKETCH), one row a set; ``family`` is equal for equal prefix and size."""
    columns = ["set_key", "size", "family", "prefix", "bits", *SKETCH]
    shipped = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, ranks = shipped.value
        for part in slices(batches):
            rows = []
            for body in part["body"]:
                own = shingle_set(body, spec.width)
                if len(own):
                    front = _ordered(own, hashes, ranks)[: spec.prefix(len(own))]
                    family = xxhash.xxh3_64_intdigest(front.tobytes() + len(own).to_bytes(8, "little")) - (1 << 63)
                    sketch = np.frombuffer(_parity(own, 64 * len(SKETCH)), "<i8")
                    rows.append((_signature(own), len(own), family, front.view(np.int64), _parity(own), *sketch))
            yield pd.DataFrame(rows, columns=columns)

    return (
        texts.select("body")
        .mapInPandas(
            run,
            "set_key binary, size bigint, family bigint, prefix array<bigint>, bits binary, "
            + ", ".join(f"{c} bigint" for c in SKETCH),
        )
        .groupBy("set_key")
        .agg(*(F.any_value(c).alias(c) for c in columns[1:]))
    )


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class): smallest node that links (a, b) connect with each of ``nodes`` (node, class), which start with
    the classes they have. Each round takes the smallest class among the neighbours and then the class's own class."""
    labels = nodes.select("node", "class")
    # links between classes, each once, are all that matters
    edges = (
        links.join(labels.select(F.col("node").alias("a"), F.col("class").alias("u")), "a")
        .join(labels.select(F.col("node").alias("b"), F.col("class").alias("v")), "b")
        .where("u <> v")
        .select("u", "v")
        .distinct()
    )
    edges = saved(edges.union(edges.select("v", "u")), "class-links")
    roots = saved(edges.select(F.col("u").alias("root")).distinct().withColumn("label", F.col("root")), "class-roots")
    while True:
        near = edges.join(roots, edges["v"] == roots["root"]).groupBy("u").agg(F.min("label").alias("least"))
        moved = roots.join(near, roots["root"] == near["u"], "left").select(
            "root", F.col("label").alias("before"), F.least("label", F.coalesce("least", "label")).alias("label")
        )
        # the label's own label
        jump = moved.select(F.col("root").alias("at"), F.col("label").alias("further"))
        moved = saved(
            moved.join(jump, moved["label"] == jump["at"], "left").select(
                "root", "before", F.least("label", F.coalesce("further", "label")).alias("label")
            ),
            "class-roots",
        )
        roots = moved.select("root", "label")
        if moved.where("before <> label").isEmpty():
            break
    return labels.join(roots, labels["class"] == roots["root"], "left").select(
        "node", F.coalesce("label", "class").alias("class")
    )


def _perhaps(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of ``df`` whose key may be wanted: a bit map of 2**FILTER_BITS hashes, broadcast (at most 2**(FILTER_BITS
    - 6) rows), lets through every wanted key and few others, so that a join shuffles little. It drops no match."""
    slot = F.xxhash64(F.col(wanted_key)).bitwiseAND((1 << FILTER_BITS) - 1)
    words = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("_bits"))
    )
    own = F.xxhash64(F.col(key)).bitwiseAND((1 << FILTER_BITS) - 1)
    held = df.withColumn("_slot", own).withColumn("_at", F.shiftright("_slot", 6))
    return (
        held.join(F.broadcast(words), F.col("_at") == F.col("_word"))
        .where(F.expr("(_bits & shiftleft(1L, cast(_slot & 63 as int))) <> 0"))
        .select(df.columns)
    )


def _sets(texts: DataFrame, wanted: DataFrame, spec: JoinSpec) -> DataFrame:
    """(node, own): the whole sorted set of each wanted node (node, set_key, first), one row a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches):
            sets = [shingle_set(t, spec.width) for t in part["body"]]
            right = np.array([_signature(s) == bytes(k) for s, k in zip(sets, part["set_key"], strict=True)], bool)
            yield pd.DataFrame({"node": part["node"], "own": [s.tobytes() for s in sets]})[right]

    bodies = (
        _perhaps(texts, "key", wanted, "first")
        .join(wanted, F.col("key") == F.col("first"))
        .groupBy("key", "node", "set_key", F.xxhash64("body").alias("_content"))
        .agg(F.any_value("body").alias("body"))
    )
    return bodies.mapInPandas(run, "node bigint, own binary")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, bitmaps: DataFrame, spec: JoinSpec) -> DataFrame:
    """Of the distinct node pairs (a, b) those that link: bitmaps (node, size, bits) first, then the whole sets."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches):
            sides = zip(part["bits_a"], part["bits_b"], part["size_a"], part["size_b"], strict=True)
            yield part.loc[np.array([_may_link(*side, spec) for side in sides], bool), ["a", "b"]]

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches):
            keep = []
            for one, other in zip(part["own_a"], part["own_b"], strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
                keep.append(spec.linked(_shared(x, y), len(x), len(y)))
            yield part.loc[np.array(keep, bool), ["a", "b"]]

    for side in ("a", "b"):
        own = bitmaps.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(own, side)
    pairs = saved(pairs.mapInPandas(sift, "a bigint, b bigint"), "near-pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = saved(_sets(texts, nodes.select("node", "set_key", "first").join(met, "node"), spec), "near-sets")
    found = (
        pairs.join(_perhaps(sets, "node", pairs, "a").select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
        .join(_perhaps(sets, "node", pairs, "b").select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
        .mapInPandas(test, "a bigint, b bigint")
    )
    return saved(found, "near-links")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _band(spec: JoinSpec, shift: float) -> Column:
    """Sizes in one band may link; the bands of shift 0.5 lie across those of shift 0."""
    return F.floor(F.log(F.col("size").cast("double")) / -np.log(spec.percent / 100) + shift)


def _star(listed: DataFrame, state: DataFrame, spec: JoinSpec, shift: float, draw: int) -> DataFrame:
    """Pairs of one group of each inverted list and band, drawn by a hash, with those of the list's groups that lie in
    other classes and share enough lists with that class."""
    leads = state.where("node = lead").select("family", "node", "class")
    rows = listed.join(leads, "family").select("shingle", _band(spec, shift).alias("band"), "node", "class", "size")
    # without a draw the lists of a family agree on its smallest node; with one each list draws its own
    rank = F.xxhash64("node", "shingle", F.lit(draw)) if draw else F.col("node")
    heads = (
        rows.groupBy("shingle", "band")
        .agg(F.min(F.struct(rank.alias("rank"), "node", "class")).alias("head"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("low <> high")
        .select("shingle", "band", F.col("head.node").alias("a"), F.col("head.class").alias("head_class"))
    )
    return (
        rows.join(heads, ["shingle", "band"])
        .where("class <> head_class")
        .groupBy(F.col("node").alias("b"), "head_class")
        .agg(F.count("*").alias("lists"), F.min("size").alias("size"), F.collect_set("a").alias("heads"))
        .where(F.col("lists") >= _lists_shared(spec, F.col("size")))
        .select(F.explode("heads").alias("a"), "b")
    )


def _least(spec: JoinSpec, size: Column) -> Column:
    """How many shingles a set of this size shares with any that it links with."""
    return F.ceil(size * spec.percent / 100)


def _needed(spec: JoinSpec, size: Column) -> Column:
    """How many of them lie in both prefixes."""
    return F.least(F.greatest(F.lit(LISTS_SHARED), F.floor(_least(spec, size) / SHARED_PART)), _least(spec, size))


def _lists_shared(spec: JoinSpec, size: Column) -> Column:
    """How many inverted lists it is on with any that it links with."""
    return F.least(F.lit(LISTS_SHARED), _least(spec, size))


def _inverted(groups: DataFrame, spec: JoinSpec) -> DataFrame:
    """The inverted lists (family, size, free, shingle, place, early, *BEFORE) of groups (family, size, members, prefix).

    Prefix shingles of one group alone are in no set that may link: ``free`` is what can be shared at most. Linked sets
    share at least ``_needed`` of the other ones, so a group with fewer drops out, and of those in order of holders
    all but the last ``_needed`` - LISTS_SHARED are enough to meet on LISTS_SHARED lists: the long lists stay out. The
    ``early`` ones are enough to meet on one. ``BEFORE`` are the group's lists that precede in that order.
    """
    entries = groups.select("family", "size", "members", F.posexplode("prefix").alias("place", "shingle"))
    # lists of one node, and of two that can't fit, make no pair
    several = (
        entries.groupBy("shingle")
        .agg(F.sum("members").alias("holders"), F.min("size").alias("small"), F.max("size").alias("large"))
        .where((F.col("holders") > 2) | ((F.col("holders") == 2) & (100 * F.col("small") >= spec.percent * F.col("large"))))
        .select("shingle", "holders")
    )
    size, needed = F.col("size"), _needed(spec, F.col("size"))
    before = [f"if(i > {k}, met[i - {k + 1}].shingle, null) as {name}" for k, name in enumerate(BEFORE)]
    lists = F.expr(f"transform(met, (e, i) -> struct(e.shingle, e.place, i <= last as early, {', '.join(before)}))")
    return (
        entries.drop("members")
        .join(several, "shingle")
        .groupBy("family", "size")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "shingle", "place"))).alias("met"))
        .where(F.size("met") >= needed)
        .withColumn("last", F.size("met") - needed)
        .withColumn("free", _least(spec, size) + F.col("last"))
        .withColumn("met", F.slice("met", F.lit(1), (F.col("last") + _lists_shared(spec, size)).cast("int")))
        .select("family", "size", "free", F.explode(lists).alias("entry"))
        .select("family", "size", "free", "entry.*")
    )


def _apart(x: str, y: str) -> Column:
    """In how many shingles any member of one side differs from any of the other, at least: bits of the sketch that all
    members of one have and none of the other."""
    bits = [f"bit_count({a}.all_{c} & ~{b}.any_{c})" for c in SKETCH for a, b in ((x, y), (y, x))]
    return F.expr(" + ".join(bits))


def _rest(listed: DataFrame, state: DataFrame, sketches: DataFrame, spec: JoinSpec) -> DataFrame:
    """All pairs of members of group pairs that share an early list, fit in size, position and sketch, and differ in class."""
    sides = state.join(sketches, "node").groupBy("family", "class")
    sides = sides.agg(*(f(c).alias(f"{name}_{c}") for c in SKETCH for name, f in (("all", F.bit_and), ("any", F.bit_or))))
    sides = listed.where("early").drop("early").join(sides, "family")
    mixed = sides.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    sides = sides.join(mixed.select("shingle"), "shingle", "left_semi")
    x, y = sides.alias("x"), sides.alias("y")
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    both = F.col("x.size") + F.col("y.size")
    # at most what stands before in both prefixes, this shingle, and what follows in both
    reach = F.least("x.place", "y.place") + 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) - 1
    reach = F.least(reach, "x.free", "y.free")
    fits = 100 * reach >= spec.percent * (both - reach)
    # the first list that two groups share has none before it
    met_before = [F.coalesce(F.col(f"x.{a}") == F.col(f"y.{b}"), F.lit(False)) for a in BEFORE for b in BEFORE]
    first = ~reduce(Column.__or__, met_before)
    # the sets share at most half of what is not apart
    shared = F.floor((both - _apart("x", "y")) / 2)
    near = 100 * shared >= spec.percent * (both - shared)
    groups = (
        x.join(
            y,
            (F.col("x.shingle") == F.col("y.shingle"))
            & (F.col("x.class") < F.col("y.class"))
            & (100 * small >= spec.percent * large)
            & fits
            & first
            & near,
        )
        .select(F.col("x.family").alias("fx"), F.col("x.class").alias("cx"), F.col("y.family").alias("fy"), F.col("y.class").alias("cy"))
        .distinct()
    )
    one = state.select(F.col("family").alias("fx"), F.col("class").alias("cx"), F.col("node").alias("a"))
    other = state.select(F.col("family").alias("fy"), F.col("class").alias("cy"), F.col("node").alias("b"))
    return groups.join(one, ["fx", "cx"]).join(other, ["fy", "cy"]).select("a", "b").distinct()


def classes(df: DataFrame, doc_key: str = "doc_id", text: str = "text", spec: JoinSpec = JoinSpec()) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id.

    A null doc_id has its class's id, null if the class has no other.
    """
    body = F.coalesce(F.col("body").cast("string"), F.lit(""))
    texts = (
        named(df, doc_id=doc_key, body=text)
        .select(F.col("doc_id").cast("bigint"), body.alias("body"))
        .withColumn("key", F.coalesce("doc_id", -F.abs(F.xxhash64("body") / 2).cast("bigint") - 2))
    )
    first_pass = saved(_first_pass(texts, spec), "near-first-pass")
    documents = first_pass.where("set_key is not null").select("doc_id", "key", "set_key", "size")
    firsts = saved(
        documents.where("size > 0").groupBy("set_key").agg(F.min("key").alias("first"), F.min("doc_id").alias("smallest")),
        "near-firsts",
    )
    # the smallest key names a set; where one doc_id has several texts, a hash does
    shared = firsts.groupBy("first").count().where("count > 1").select("first", F.lit(True).alias("shared"))
    nodes = firsts.join(shared, "first", "left").select(
        "set_key",
        "first",
        "smallest",
        F.when(F.col("shared"), -F.abs(F.xxhash64("set_key") / 2).cast("bigint") - 2).otherwise(F.col("first")).alias("node"),
    )
    prefixes = saved(_prefixes(texts, spec, _common(first_pass)).join(nodes, "set_key"), "near-prefixes")
    groups = prefixes.groupBy("family", "size").agg(
        F.min("node").alias("lead"), F.count("*").alias("members"), F.any_value("prefix").alias("prefix")
    )
    listed = saved(_inverted(groups, spec), "near-lists")
    state = saved(
        prefixes.join(groups.select("family", "size", "lead"), ["family", "size"])
        .join(listed.select("family").distinct(), "family", "left_semi")
        .select("node", "first", "smallest", "set_key", "family", "size", "lead", F.col("node").alias("class"), "bits", *SKETCH),
        "near-state",
    )
    bitmaps, sketches = state.select("node", "size", "bits"), state.select("node", *SKETCH)
    state = state.drop("bits", *SKETCH)
    rounds = [
        lambda s: s.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).union(_star(listed, s, spec, 0.0, 0)).distinct(),
        lambda s: _star(listed, s, spec, 0.5, 1),
        lambda s: _star(listed, s, spec, 0.0, 2),
        lambda s: _rest(listed, s, sketches, spec),
    ]
    for pairs in rounds:
        links = _verified(pairs(state), texts, state, bitmaps, spec)
        if not links.isEmpty():
            found = connected(links, state)
            state = saved(state.drop("class").join(found, "node"), "near-state")
    class_ids = state.groupBy("class").agg(F.min("smallest").alias("component_id"))
    class_ids = state.join(class_ids, "class").select("set_key", "component_id")
    named_sets = firsts.join(class_ids, "set_key", "left").select(
        "set_key", F.coalesce("component_id", "smallest").alias("component_id")
    )
    return documents.join(named_sets, "set_key", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(df: DataFrame, doc_key: str = "doc_id", text: str = "text", spec: JoinSpec = JoinSpec()) -> DataFrame:
    """The rows of ``df`` whose doc_id names their class, once each; all columns stay.

    Rows with a null doc_id stay as they are: no class can be named after them.
    """
    winners = (
        classes(df, doc_key, text, spec)
        .where("doc_id = component_id")
        .select(F.col("doc_id").alias("_winner"))
        .distinct()
    )
    known, unknown = F.col(f"`{doc_key}`").isNotNull(), F.col(f"`{doc_key}`").isNull()
    kept = df.where(known).join(winners, F.col(f"`{doc_key}`").cast("bigint") == F.col("_winner"), "left_semi")
    return kept.dropDuplicates([doc_key, text]).unionByName(df.where(unknown))
