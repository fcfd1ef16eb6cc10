"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x). All grades share the weights w of the hashed features; only the ordered
thresholds differ. Features of a text (each counts once): its distinct lower-cased words, their first four letters, and
ten-step bins of a few ratios (capitals, punctuation, digits, distinct words), all hashed to ``bits`` bits.

The model is fitted on a bounded sample of the rated rows: those with the ``max_rated`` smallest hashes of their id, as far
as their slots, added up in that order, stay within ``max_slots``. Every document is scored over its whole text. Null, empty and wordless texts get grade 0 and tail
probabilities 0. With no ratings, or ratings of one grade only, the thresholds alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgauge.llm.common import named, only, text_of

BITS = 19
MAX_RATED = 12_000
MAX_SLOTS = 16_000_000
PREFIX = 4
CACHED_WORDS = 400_000
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
EPOCHS, RATE, RIDGE = 120, 0.15, 1e-6
TOGETHER = 1 << 21  # slots whose scores or gradients are worked out at a time


def word_slots(word: str, bits: int) -> tuple[int, int]:
    mask = (1 << bits) - 1
    return (
        xxhash.xxh3_64_intdigest(word.encode()) & mask,
        xxhash.xxh3_64_intdigest(b"^" + word[:PREFIX].encode()) & mask,
    )


def style_slots(text: str, n_words: int, n_distinct: int, bits: int) -> list[int]:
    """Bins of ratios that hold for a text of any length."""
    raw = text.encode()
    size = max(1, len(raw))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    bins = (
        ("upper", int(10 * share(UPPER))),
        ("digit", int(10 * share(DIGITS))),
        ("mark", int(20 * share(PUNCTUATION))),
        ("new", int(10 * (n_distinct / max(1, n_words)) * min(1.0, n_words / 50))),
        ("words", min(12, n_words.bit_length())),
    )
    mask = (1 << bits) - 1
    return [xxhash.xxh3_64_intdigest(f"\0{name}:{value}".encode()) & mask for name, value in bins]


def slots(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature slots of a whole text; empty for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int32)
    distinct = set(words)
    found = set(style_slots(text, len(words), len(distinct), bits))
    for word in distinct:
        found.update(word_slots(word, bits))
    return np.array(sorted(found), np.int32)


@dataclass
class OrdinalModel:
    """Weights shared by all grades, and one threshold less than there are grades, ascending."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, as columns."""
        gap = np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)
        return 1.0 / (1.0 + np.exp(-gap))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS) -> OrdinalModel:
    """``fit_columns`` of rows of slots."""
    lengths = np.array([len(r) for r in rows], np.int64)
    return fit_columns(np.concatenate([np.empty(0, np.int32), *rows], dtype=np.int32), lengths, grades, n_grades, bits)


def fit_columns(columns: np.ndarray, lengths: np.ndarray, grades: np.ndarray, n_grades: int, bits: int = BITS) -> OrdinalModel:
    """Maximum likelihood with a small ridge by full-batch Adam; thresholds stay ordered by positive steps.

    ``columns`` has the 32-bit slots of one row after the other and is written over; the work goes on TOGETHER of them
    (or one row) at a time.
    """
    counts = np.bincount(grades, minlength=n_grades).astype(float) if len(grades) else np.zeros(n_grades)
    below = np.cumsum(counts + 0.5)[:-1] / (counts.sum() + 0.5 * n_grades)
    start = np.log(below / (1 - below))
    weights = np.zeros(1 << bits)
    if not len(lengths) or (counts > 0).sum() < 2:
        return OrdinalModel(weights.astype(np.float32), start, bits)
    ends = np.cumsum(lengths)
    present = np.zeros(1 << bits, bool)
    present[columns] = True
    used = np.flatnonzero(present)
    numbers = np.cumsum(present, dtype=np.int32) - 1
    cuts_at = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], TOGETHER), side="right"))
    spans = [(a, b, a and ends[a - 1], ends[b - 1]) for a, b in zip(cuts_at, [*cuts_at[1:], len(lengths)], strict=True) if a < b]
    for *_, i, j in spans:
        columns[i:j] = numbers[columns[i:j]]
    # theta: weights of the used slots, the first threshold, logs of the steps between thresholds
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n, k = len(lengths), n_grades - 1
    for step in range(1, EPOCHS + 1):
        grad = gradient(theta, columns, lengths, spans, grades, k) / n
        grad[: len(used)] += RIDGE * theta[: len(used)]
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-7)
    weights[used] = theta[: len(used)]
    return OrdinalModel(weights.astype(np.float32), _cuts(theta[len(used) :]), bits)


def _cuts(tail: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logs of the steps."""
    return tail[0] + np.concatenate([[0.0], np.cumsum(np.exp(tail[1:]))])


def _scores(weights: np.ndarray, columns: np.ndarray, lengths: np.ndarray, spans: list[tuple]) -> np.ndarray:
    score = np.zeros(len(lengths))
    for a, b, i, j in spans:
        owner = np.repeat(np.arange(b - a), lengths[a:b])
        score[a:b] = np.bincount(owner, weights=weights[columns[i:j]], minlength=b - a)
    return score


def loss(theta: np.ndarray, columns: np.ndarray, lengths: np.ndarray, spans: list[tuple], grades: np.ndarray, k: int) -> float:
    """Negative log likelihood of the grades; ``k`` thresholds, the weights in front of them in ``theta``."""
    cuts = _cuts(theta[len(theta) - k :])
    score = _scores(theta[: len(theta) - k], columns, lengths, spans)
    hi = np.where(grades == k, 1.0, _sigmoid(cuts[np.minimum(grades, k - 1)] - score))
    lo = np.where(grades == 0, 0.0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - score))
    return float(-np.log(np.maximum(hi - lo, 1e-9)).sum())


def gradient(theta: np.ndarray, columns: np.ndarray, lengths: np.ndarray, spans: list[tuple], grades: np.ndarray, k: int) -> np.ndarray:
    """Gradient of ``loss`` by theta; spans: (first row, row behind the last, first slot, slot behind the last)."""
    weights, tail = theta[: len(theta) - k], theta[len(theta) - k :]
    cuts, steps = _cuts(tail), np.exp(tail[1:])
    score = _scores(weights, columns, lengths, spans)
    top, bottom = grades == k, grades == 0
    # P(grade) = F(cut_g - s) - F(cut_{g-1} - s)
    hi = np.where(top, 1.0, _sigmoid(cuts[np.minimum(grades, k - 1)] - score))
    lo = np.where(bottom, 0.0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - score))
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    d_score = d_hi - d_lo
    d_cut = np.bincount(np.minimum(grades, k - 1), weights=np.where(top, 0, -d_hi), minlength=k)
    d_cut += np.bincount(np.maximum(grades - 1, 0), weights=np.where(bottom, 0, d_lo), minlength=k)
    d_weights = np.zeros(len(weights))
    for a, b, i, j in spans:
        d_weights += np.bincount(columns[i:j], weights=np.repeat(d_score[a:b], lengths[a:b]), minlength=len(weights))
    return np.concatenate([d_weights, [d_cut.sum()], steps * np.cumsum(d_cut[::-1])[::-1][1:]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


class _Weights(dict):
    """Weights by word, worked out when first asked for; the table is emptied when it is full."""

    def __init__(self, work_out):
        self.work_out = work_out
        self.of = self.__getitem__

    def __missing__(self, word: str) -> float:
        value = float(self.work_out(word))
        if len(word) <= 40:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def train(
    documents: DataFrame,
    ratings: DataFrame,
    n_grades: int,
    key: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    max_rated: int = MAX_RATED,
    bits: int = BITS,
    max_slots: int = MAX_SLOTS,
) -> OrdinalModel:
    """Fit on at most ``max_rated`` rated documents with at most ``max_slots`` slots together.

    Rated documents are taken by ascending hash of their key (equal hashes: by key), so the sample is the same for all
    partitionings and on every run. Only the drawn keys (bounded, so broadcast) meet the texts. The driver holds four
    bytes a slot, twice while they arrive. Null keys and texts and grades outside 0..n_grades-1 are left out; of rows
    with equal keys one counts.
    """

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        only("quality")
        return texts.map(lambda t: slots(t, bits).tobytes())

    order = [F.xxhash64("id"), "id"]
    valid = named(ratings, id=key, grade=grade).where(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    drawn = valid.groupBy("id").agg(F.min("grade").cast("int").alias("grade")).orderBy(*order).limit(max_rated)
    sample = (
        named(documents, id=key, body=text)
        .where(F.col("body").isNotNull())
        .join(F.broadcast(drawn), "id")
        .select("id", "grade", features(F.col("body").cast("string")).alias("slots"))
        .groupBy("id")
        .agg(F.min(F.struct("slots", "grade")).alias("row"))
    )
    # at most max_rated rows, so one window over all of them is small
    so_far = F.sum(F.length("row.slots")).over(Window.orderBy(*order))
    taken = sample.withColumn("so_far", so_far).where(F.col("so_far") <= 4 * max_slots).orderBy("id").select("row.*").toArrow()
    grades = taken["grade"].to_numpy().astype(int)
    columns, lengths = _flat(taken["slots"])
    del taken
    return fit_columns(columns, lengths, grades, n_grades, bits)


def _flat(binaries: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers in binaries, one after the other, and how many each has; without an object for each."""
    parts, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for chunk in binaries.cast(pa.large_binary()).chunks:
        if len(chunk):
            _, ends, raw = chunk.buffers()
            ends = np.frombuffer(ends, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(raw or b"", np.int32, (ends[-1] - ends[0]) // 4, ends[0]))
            lengths.append(np.diff(ends) // 4)
    return np.concatenate(parts), np.concatenate(lengths)


def score(df: DataFrame, model: OrdinalModel, text: str = "text", out: str = "quality") -> DataFrame:
    """Add ``out``: struct of expected grade and the tail probabilities P(grade >= 1), P(grade >= 2), ...

    Keeps all rows and columns; a column named ``out`` is replaced.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tails array<double>")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only("quality")
        model = shipped.value
        weights, bits = model.weights.astype(float), model.bits
        whole, heads = _Weights(lambda w: weights[word_slots(w, bits)[0]]), _Weights(lambda w: weights[word_slots(w, bits)[1]])

        for texts in batches:
            scores, known = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, body in enumerate(texts):
                words = body.lower().split()
                if words:
                    distinct = set(words)
                    style = sum(weights[s] for s in style_slots(body, len(words), len(distinct), bits))
                    scores[i] = sum(map(whole.of, distinct)) + sum(map(heads.of, {w[:PREFIX] for w in distinct})) + style
                    known[i] = True
            tails = model.tails(scores) * known[:, None]
            yield pd.DataFrame({"expected": tails.sum(1), "tails": list(tails)})

    return df.withColumn(out, rate(text_of(text)))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 poor, 1 good but toxic, 2 good. One row per doc_id: the lowest grade."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select(
            "doc_id",
            F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2).alias("grade"),
        )
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
