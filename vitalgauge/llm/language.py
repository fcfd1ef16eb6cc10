"""Language identification: interpolated Kneser-Ney character models of order five, in sorted arrays of hashed n-grams.

Texts are lower-cased; symbols are the letters of any script as they are, and one boundary for each run of anything
else. Four boundaries stand before a text. Counts come from every training text, so the model grows with them:

1. Tasks count the five-grams of their texts; Spark adds them up by language and symbols.
2. A gram of a lower order counts its distinct left neighbours. Each order has its own absolute discount
   n1 / (n1 + 2 n2). Probabilities come order by order, by joins on the context and on the shorter gram.
   Five-grams that occur fewer than ``least`` times are left out; their mass goes to the shorter grams.
3. Each language's log probabilities, and the log weights of its contexts, are sorted by 64-bit hash and written as
   flat files in the shared folder: 16 pairs of ``.keys`` and ``.values`` by the top bits of the hash. Executors map
   them to memory (a folder that isn't mounted is read whole). Nothing but file names, and a few numbers a language
   and order, comes to the driver or is broadcast.

A text goes to the language with the lowest mean cross-entropy per symbol; ties go to the first by name. It is rejected
when that cross-entropy lies nearer to what unordered letters would cost than to what the language's training text
costs (each occurrence priced as if it were not in the counts), with an allowance for short texts. A null text, or one
without a letter, is ``und`` with score 0 and rejected. With no training text every text is ``und``. Repeated rows
count as often as they stand in the table; rows without a language or without a letter train nothing. Very long texts
are cut between words every million characters, and each piece begins anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import arrow_rows, named, only, saved, shared_path, text_of, worker_cache
from vitalgauge.llm.token_files import _filesystem

UNDETERMINED = "und"
ORDER = 5
SYMBOLS = [f"c{k}" for k in range(1, ORDER + 1)]
CHUNK = 1 << 20
AT_ONCE = 1 << 19  # symbols that a task looks at together
GRAMS_HELD = 1 << 18  # distinct grams whose counts a task adds up before it passes them on
ROWS_OUT = 1 << 15
TEXTS = 1000  # texts that pass to Python at a time in training
SECTION_BITS = 4
DRAWN = 1 << 15  # unordered letters that are priced to find what they cost
REMEMBERED = 1 << 22  # prices of grams that a worker keeps; the others are looked up again
CONTEXT = -1  # no symbol: marks the hash of a context
XX1, XX2, XX3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
XX5, SEED = np.uint64(0x27D4EB2F165667C5), np.uint64(42)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


def symbols_of(text: str) -> np.ndarray:
    """Letters as code points, 0 after each run of them; empty if the text has none."""
    points = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(0))[keep]


def chunks(text: str) -> Iterator[str]:
    """A very long text in pieces that end between words where they can."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            space = text.rfind(" ", at, end)
            end = space if space > at else end
        yield text[at:end]
        at = end


@dataclass
class Grams:
    """The five-grams of some pieces: the distinct ones, and for every place the distinct one that ends there."""

    keys: np.ndarray
    symbols: np.ndarray  # one row a distinct gram
    places: np.ndarray
    counts: np.ndarray

    def added(self, other: Grams) -> Grams:
        """The distinct grams of both with the sums of their counts, without places."""
        every, first, rows = np.unique(np.concatenate([self.keys, other.keys]), return_index=True, return_inverse=True)
        counts = np.zeros(len(every), np.int64)
        np.add.at(counts, rows, np.concatenate([self.counts, other.counts]))
        return Grams(every, np.concatenate([self.symbols, other.symbols])[first], self.places[:0], counts)


def five_grams(pieces: list[np.ndarray]) -> Grams:
    """Of pieces that are not empty, each after four boundaries of its own."""
    pad = np.zeros(ORDER - 1, np.uint32)
    line = np.concatenate([x for piece in pieces for x in (pad, piece)]).astype(np.uint64)
    inside = np.ones(len(line), bool)
    starts = np.cumsum([0, *(len(piece) + len(pad) for piece in pieces[:-1])])
    for k in range(len(pad)):
        inside[starts + k] = False
    ends = np.flatnonzero(inside)
    shift, wide = np.uint64(21), np.uint64(42)
    with np.errstate(over="ignore"):
        front = ((line[:-4] << wide) | (line[1:-3] << shift) | line[2:-2]) * XX1
        front ^= front >> np.uint64(29)
        front = (front * XX2) ^ ((line[3:-1] << shift) | line[4:])
        front *= XX3
        front ^= front >> np.uint64(32)
    keys, first, places, counts = np.unique(front[ends - 4], return_index=True, return_inverse=True, return_counts=True)
    at = ends[first][:, None] + np.arange(1 - ORDER, 1)
    return Grams(keys, line[at].astype(np.int32), places, counts)


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    """What ``xxhash64`` of Spark gives for these integer columns."""
    value = np.full(len(columns[0]), SEED, np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            value = (value + XX5 + np.uint64(4)) ^ (column.astype(np.int32).view(np.uint32).astype(np.uint64) * XX1)
            value = ((value << np.uint64(23)) | (value >> np.uint64(41))) * XX2 + XX3
            value = (value ^ (value >> np.uint64(33))) * XX2
            value = (value ^ (value >> np.uint64(29))) * XX3
            value ^= value >> np.uint64(32)
    return value.view(np.int64)


@dataclass
class LanguageModel:
    """Names in order, the files of each (by section), and what texts cost there."""

    names: list[str]
    folder: str = ""
    files: list[dict[int, tuple[str, str]]] = field(default_factory=list)
    own: np.ndarray = field(default_factory=lambda: np.empty(0))  # mean cost of the language's own text
    spread: np.ndarray = field(default_factory=lambda: np.empty(0))
    loose: np.ndarray = field(default_factory=lambda: np.empty(0))  # mean cost of unordered letters
    alphabet: int = 1  # symbols of all languages, and one for all others

    def reader(self) -> Reader:
        only("language")
        if self.folder not in _READERS:
            _READERS.clear()
            _READERS[self.folder] = Reader(self)
        return _READERS[self.folder]

    def judge(self, costs: np.ndarray, n: int) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, whether it is accepted; of a text of ``n`` symbols with these costs."""
        if not n or not self.names:
            return UNDETERMINED, 0.0, False
        mean = costs / n
        best = int(mean.argmin())
        share = 1.0 / np.exp(np.clip(-(mean - mean[best]) * np.sqrt(n), -700, 0)).sum()
        limit = (self.own[best] + self.loose[best]) / 2 + 2 * self.spread[best] / np.sqrt(n)
        width = max((self.loose[best] - self.own[best]) / 8, 1e-6)
        accepted = 1.0 / (1.0 + np.exp(np.clip((mean[best] - limit) / width, -500, 500)))
        return self.names[best], float(share * accepted), bool(mean[best] <= limit)


class Reader:
    """Looks grams up in the sorted arrays of a model and remembers their prices."""

    def __init__(self, model: LanguageModel) -> None:
        self.alphabet = model.alphabet
        self.arrays = [{s: (_mapped(k, "<i8"), _mapped(v, "<f4")) for s, (k, v) in own.items()} for own in model.files]
        self.keys = np.empty(0, np.uint64)
        self.prices = np.empty((0, len(model.names)), np.float32)

    def _find(self, language: int, columns: list[np.ndarray]) -> np.ndarray:
        """Stored values by hash, NaN where there is none."""
        wanted = hashed(columns)
        out = np.full(len(wanted), np.nan, np.float32)
        section = wanted >> np.int64(64 - SECTION_BITS)
        for s, (keys, values) in self.arrays[language].items():
            here = np.flatnonzero(section == s)
            at = np.searchsorted(keys, wanted[here])
            at[at == len(keys)] = 0
            hit = keys[at] == wanted[here]
            out[here[hit]] = values[at[hit]]
        return out

    def logp(self, language: int, symbols: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each row after the others."""
        out = np.zeros(len(symbols))
        left = np.arange(len(symbols))
        for order in range(ORDER, 0, -1):
            columns = [symbols[left, k] for k in range(ORDER - order, ORDER)]
            value = self._find(language, columns)
            known = ~np.isnan(value)
            out[left[known]] += value[known]
            left = left[~known]
            if not len(left):
                return out
            context = [column[~known] for column in columns[:-1]]
            weight = self._find(language, [*context, np.full(len(left), CONTEXT)])
            out[left] += np.nan_to_num(weight, nan=0.0)
        out[left] -= np.log(self.alphabet)
        return out

    def price(self, grams: Grams) -> np.ndarray:
        """Costs of the distinct grams in every language."""
        at = np.searchsorted(self.keys, grams.keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == grams.keys if len(self.keys) else np.zeros(len(at), bool)
        out = np.empty((len(at), len(self.arrays)), np.float32)
        out[hit] = self.prices[at[hit]]
        fresh = ~hit
        for j in range(len(self.arrays)):
            out[fresh, j] = -self.logp(j, grams.symbols[fresh])
        if fresh.any() and (len(self.keys) + fresh.sum()) * len(self.arrays) <= REMEMBERED:
            keys = np.concatenate([self.keys, grams.keys[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.prices = keys[order], np.concatenate([self.prices, out[fresh]])[order]
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed costs of each text in every language, and its symbols."""
        total, n = np.zeros((len(texts), len(self.arrays))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owner: list[int] = []

        def settle() -> None:
            grams = five_grams(held)
            prices = self.price(grams)
            starts = np.cumsum([0, *(len(piece) for piece in held[:-1])])
            for j in range(len(self.arrays)):
                sums = np.add.reduceat(prices[:, j][grams.places], starts, dtype=float)
                np.add.at(total[:, j], owner, sums)
            held.clear()
            owner.clear()

        size = 0
        for k, text in enumerate(texts):
            for piece in map(symbols_of, chunks(text)):
                if len(piece):
                    held.append(piece)
                    owner.append(k)
                    n[k] += len(piece)
                    size += len(piece)
                if size >= AT_ONCE:
                    settle()
                    size = 0
        if held:
            settle()
        return total, n


_READERS: dict[str, Reader] = worker_cache("language", {})


def _mapped(path: str, kind: str) -> np.ndarray:
    from pyarrow import fs

    files, base = _filesystem(path)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(base, np.dtype(kind), "r")
    return np.frombuffer(files.open_input_file(base).read_buffer(), np.dtype(kind))


def count_grams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, c1 .. c5, n) over all texts with a language; tasks add up their own before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("language")
        held: dict[str, list[np.ndarray]] = {}
        found: dict[str, Grams] = {}
        size = 0

        def gather() -> None:
            for name, pieces in held.items():
                grams = five_grams(pieces)
                found[name] = found[name].added(grams) if name in found else grams
            held.clear()

        def flush() -> Iterator[pd.DataFrame]:
            for name, grams in found.items():
                for at in range(0, len(grams.keys), ROWS_OUT):
                    own = pd.DataFrame(grams.symbols[at : at + ROWS_OUT], columns=SYMBOLS)
                    own.insert(0, "lang", name)
                    own["n"] = grams.counts[at : at + ROWS_OUT]
                    yield own
            found.clear()

        for batch in batches:
            for name, body in zip(batch["lang"], batch["body"], strict=True):
                for piece in map(symbols_of, chunks(body)):
                    if len(piece):
                        held.setdefault(name, []).append(piece)
                        size += len(piece)
                    if size >= AT_ONCE:
                        gather()
                        size = 0
                        if sum(len(grams.keys) for grams in found.values()) >= GRAMS_HELD:
                            yield from flush()
        gather()
        yield from flush()

    return (
        named(df, lang=lang, body=text)
        .select(F.col("lang").cast("string").alias("lang"), F.col("body").cast("string").alias("body"))
        .where("lang is not null and body is not null")
        .mapInPandas(count, "lang string, " + ", ".join(f"{c} int" for c in SYMBOLS) + ", n bigint")
        .groupBy("lang", *SYMBOLS)
        .agg(F.sum("n").alias("n"))
    )


def _orders(grams: DataFrame) -> dict[int, DataFrame]:
    """Counts by order: the highest has occurrences, the others distinct left neighbours."""
    tables = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        own = tables[order + 1].groupBy("lang", *SYMBOLS[ORDER - order :]).agg(F.count("*").alias("n"))
        tables[order] = saved(own, "language-counts")
    return tables


def _discounts(tables: dict[int, DataFrame]) -> DataFrame:
    """(lang, order, discount): as many rows as languages times orders."""
    found = None
    for order, table in tables.items():
        own = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        own = own.withColumn("order", F.lit(order))
        found = own if found is None else found.unionByName(own)
    share = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))
    return found.select("lang", "order", F.when(F.col("n1") > 0, share).otherwise(0.5).alias("discount"))


def _order_rows(table: DataFrame, shorter: DataFrame | None, discounts: DataFrame, order: int, least: int, alphabet: int) -> tuple[DataFrame, DataFrame]:
    """Grams of one order (lang, symbols, n, kept, p, without) and the weights of their contexts (lang, symbols,
    weight). ``without`` is the probability of an occurrence that is left out of the counts."""
    symbols = SYMBOLS[ORDER - order :]
    context, rest = symbols[:-1], symbols[1:]
    own = discounts.where(F.col("order") == order).select("lang", "discount")
    rows = table.join(F.broadcast(own), "lang").withColumn("kept", F.col("n") >= (least if order == ORDER else 1))
    mass = F.when(F.col("kept"), F.col("n") - F.col("discount")).otherwise(0.0)
    totals = rows.groupBy("lang", *context).agg(F.sum("n").alias("every"), F.sum(mass).alias("mass"))
    totals = totals.select("lang", *context, "every", (1 - F.col("mass") / F.col("every")).alias("weight"))
    rows = rows.join(totals, ["lang", *context])
    if shorter is None:
        rows = rows.withColumn("p_rest", F.lit(1.0 / alphabet)).withColumn("without_rest", F.lit(1.0 / alphabet))
    else:
        rows = rows.join(shorter.select("lang", *rest, F.col("p").alias("p_rest"), F.col("without").alias("without_rest")), ["lang", *rest])
    less = F.greatest(F.col("n") - 1 - F.col("discount"), F.lit(0.0)) / F.greatest(F.col("every") - 1, F.lit(1))
    grams = rows.select(
        "lang",
        *symbols,
        "n",
        "kept",
        (mass / F.col("every") + F.col("weight") * F.col("p_rest")).alias("p"),
        F.when(F.col("n") == 1, F.col("weight") * F.col("without_rest")).otherwise(less + F.col("weight") * F.col("p_rest")).alias("without"),
    )
    return grams, totals.select("lang", *context, "weight")


FILES = "lang string, section int, keys string, values string"


def _write(rows: DataFrame, folder: str) -> DataFrame:
    """Write (lang, hash, value) as sorted files and return their names (``FILES``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        current, streams, paths = None, (), ()
        for batch in batches:
            for (lang, section), part in batch.groupby(["lang", "section"], sort=False):
                if (lang, section) != current:
                    for stream in streams:
                        stream.close()
                    current, name = (lang, section), uuid.uuid4().hex
                    paths = (f"{folder}/{name}.keys", f"{folder}/{name}.values")
                    streams = tuple(files.open_output_stream(f"{base}/{name}{kind}") for kind in (".keys", ".values"))
                    yield pd.DataFrame([(lang, section, *paths)], columns=["lang", "section", "keys", "values"])
                streams[0].write(part["hash"].to_numpy("<i8").tobytes())
                streams[1].write(part["value"].to_numpy("<f4").tobytes())
        for stream in streams:
            stream.close()

    section = F.shiftright("hash", 64 - SECTION_BITS).cast("int")
    return (
        rows.withColumn("section", section)
        .repartition("lang", "section")
        .sortWithinPartitions("lang", "section", "hash")
        .mapInPandas(run, FILES)
    )


def _hash(symbols: list[str], *marks: Column) -> Column:
    return F.xxhash64(*symbols, *marks)


def train(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 2) -> LanguageModel:
    """Fit on every row with a text and a language. Five-grams with fewer than ``least`` occurrences are pruned."""
    spark = df.sparkSession
    with arrow_rows(spark, TEXTS):
        counts = saved(count_grams(df, text, lang), "language-counts")
    tables = _orders(counts)
    discounts = saved(_discounts(tables), "language-discounts")
    alphabet = tables[1].select("c5").distinct().count() + 1
    shorter, rows = None, None
    for order in range(1, ORDER + 1):
        symbols = SYMBOLS[ORDER - order :]
        grams, contexts = _order_rows(tables[order], shorter, discounts, order, least, alphabet)
        shorter = saved(grams, "language-grams")
        for own in (
            shorter.where("kept").select("lang", _hash(symbols).alias("hash"), F.log("p").alias("value")),
            contexts.select("lang", _hash(symbols[:-1], F.lit(CONTEXT)).alias("hash"), F.log("weight").alias("value")),
        ):
            rows = own if rows is None else rows.unionByName(own)
    folder = shared_path(spark, "language-model")
    written = _write(rows.withColumn("value", F.col("value").cast("float")), folder).collect()
    cost = -F.log("without")
    stats = (
        shorter.groupBy("lang")
        .agg(F.sum("n").alias("every"), F.sum(F.col("n") * cost).alias("once"), F.sum(F.col("n") * cost * cost).alias("twice"))
        .orderBy("lang")
        .collect()
    )
    names = sorted(r["lang"] for r in stats)
    if not names:
        return LanguageModel([])
    by_name = {r["lang"]: r for r in stats}
    files: list[dict[int, tuple[str, str]]] = [{} for _ in names]
    place = {name: j for j, name in enumerate(names)}
    for r in written:
        files[place[r["lang"]]][r["section"]] = (r["keys"], r["values"])
    own = np.array([by_name[name]["once"] / by_name[name]["every"] for name in names])
    square = np.array([by_name[name]["twice"] / by_name[name]["every"] for name in names])
    model = LanguageModel(names, folder, files, own, np.sqrt(np.maximum(square - own**2, 0)), np.zeros(len(names)), alphabet)
    model.loose = _loose(counts, model, place)
    return model


def _loose(counts: DataFrame, model: LanguageModel, place: dict[str, int]) -> np.ndarray:
    """What letters cost in each language that come as often as there, but in no order. One task a language, with one
    row a symbol."""

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        j = place[key[0]]
        rows = rows.sort_values("c5")
        share = rows["n"].to_numpy(float) / rows["n"].sum()
        drawn = np.random.default_rng(0).choice(rows["c5"].to_numpy(np.uint32), DRAWN, p=share)
        drawn = drawn[np.concatenate([drawn[:1] != 0, (drawn[1:] != 0) | (drawn[:-1] != 0)])]
        grams = five_grams([drawn])
        cost = -model.reader().logp(j, grams.symbols)
        return pd.DataFrame({"lang": [key[0]], "cost": [float((cost * grams.counts).sum() / grams.counts.sum())]})

    symbols = counts.groupBy("lang", "c5").agg(F.sum("n").alias("n"))
    found = {r["lang"]: r["cost"] for r in symbols.groupBy("lang").applyInPandas(draw, "lang string, cost double").collect()}
    return np.array([found[name] for name in model.names])


def identify(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct of lang, score, accepted. Keeps all rows and columns; a column named ``out`` is replaced."""

    @F.pandas_udf("lang string, score double, accepted boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            costs, n = model.reader().costs(list(texts)) if model.names else (np.empty((len(texts), 0)), [0] * len(texts))
            yield pd.DataFrame([model.judge(c, k) for c, k in zip(costs, n, strict=True)], columns=["lang", "score", "accepted"])

    return df.withColumn(out, judge(text_of(text)))
