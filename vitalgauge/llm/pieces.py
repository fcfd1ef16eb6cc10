"""SentencePiece encoding and decoding: N-best segmentation by forward Viterbi and backward A*.

Spaces become the mark U+2581, with one before the text. The lattice of a text holds every vocabulary piece at every
place where it matches; a character that no piece has is spelled in byte pieces. The forward pass gives the best score
up to each place; going backward from the end, these scores are the exact rest cost, so A* yields the segmentations in
order of score and expands nothing in vain; equal totals go depth first. New words of up to LONGEST_CACHED characters
take the steps of both passes together, as rows of arrays; longer ones go one by one. Byte-pair vocabularies rank their pieces instead of weighing them; a
piece then scores -log(rank + 2) (Zipf's law). Scores are whole numbers (micro-nats), so sums are exact.

No piece spans a place between two characters that stand side by side in no piece, so the lattice falls apart
there: segments are solved once and kept, and the N best of a text are the N best combinations of its segments'.
Decoding is exact for every text: marks that stand in the text itself are spelled in bytes. Null counts as empty;
the empty text has no pieces, score 0 and no runner-up.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import give_back, named, only, text_of, worker_cache

MARK = "▁"
OWN_MARK = "\ud800"  # stands for a mark in the text while the lattice is built; no text and no piece has it
CACHED = 150_000  # words kept; the first ones seen are the common ones
LONGEST_CACHED = 48
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
TOGETHER = 200_000  # characters of texts whose new words are solved together
ROWS = 500  # texts whose results a task holds at a time
MICRO = 1_000_000
BYTE_PENALTY = 4 * MICRO

NO_GAP = 1 << 62

Segmentation = tuple[int, tuple[int, ...]]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _rolled(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hash of each string with one more character."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (points.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(31))


class Pieces:
    """A vocabulary with scores, and the tables that segmentation and decoding need."""

    def __init__(self, entries: dict[str, tuple[tuple[int], int]], byte_ids: list[int], byte_score: int, size: int) -> None:
        self.entries = entries
        self.byte_ids, self.byte_score = byte_ids, byte_score
        # every beginning of a piece: the piece's id and score if it is one, else None
        self.heads = {p[:k]: None for p in entries for k in range(1, len(p) + 1)} | entries
        self.joined = {p[k : k + 2] for p in entries for k in range(len(p) - 1)}
        # units between spaces can be solved alone if no piece has a mark after another character
        self.by_words = not any(pair[1] == MARK != pair[0] for pair in self.joined)
        self.raw = [b""] * size
        for piece, (ids, _) in entries.items():
            self.raw[ids[0]] = piece.replace(MARK, " ").encode()
        for value, i in enumerate(byte_ids):
            self.raw[i] = bytes([value])
        self.by_length = self._tables()
        self.kept: dict[tuple[str, int], tuple[Segmentation, ...]] = {}

    @classmethod
    def load(cls, model: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in plain]
        ranked = all(s == int(s) for s in scores)  # byte-pair models number their merges
        values = [-math.log(2 - s) if ranked else s for s in scores]
        entries = {sp.id_to_piece(i): ((i,), round(MICRO * v)) for i, v in zip(plain, values, strict=True)}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        lowest = min((s for _, s in entries.values()), default=0)
        return cls(entries, byte_ids, lowest - BYTE_PENALTY, size)

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: sorted hashes of the beginnings of pieces, the id of each that is a piece (else -1), score."""
        grouped: dict[int, list[str]] = {}
        for head in self.heads:
            grouped.setdefault(len(head), []).append(head)
        tables = []
        for size in range(1, max(grouped, default=0) + 1):
            heads = grouped[size]
            points = np.frombuffer("".join(heads).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
            hashes = np.zeros(len(heads), np.uint64)
            for k in range(size):
                hashes = _rolled(hashes, points[:, k])
            order = np.argsort(hashes)
            hits = [self.heads[h] or ((-1,), 0) for h in heads]
            ids, scores = np.array([h[0][0] for h in hits], np.int32), np.array([h[1] for h in hits], np.int64)
            tables.append((hashes[order], ids[order], scores[order]))
        return tables

    def solve(self, units: list[str]) -> dict[str, tuple[bytes, int, int]]:
        """Best ids, score and distance to the runner-up of many units at once, from the two best paths that A* finds.
        Long units are cut into segments and searched one by one; both ways give the same: of equal scores the longer
        last piece wins."""
        done: dict[str, tuple[bytes, int, int]] = {}
        short = [unit for unit in units if len(unit) <= LONGEST_CACHED]
        if short:
            found = TwoBest(self, short)
            gaps = np.where(found.paths[1] < 0, NO_GAP, found.totals[0] - found.totals[1]).tolist()
            done = dict(zip(short, zip(found.ids(0), found.totals[0].tolist(), gaps, strict=True), strict=True))
        for unit in units:
            if len(unit) > LONGEST_CACHED:
                best = self.unit_best(unit, 2)
                gap = best[0][0] - best[1][0] if len(best) > 1 else NO_GAP
                done[unit] = (np.array(best[0][1], np.int32).tobytes(), best[0][0], gap)
        return done

    def lattice(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id, score) of the edges of many units: ``points`` are their characters one after the other,
        ``left`` says how many of its unit follow from each on. Byte-spelled characters have the id -2 - character."""
        edges = []
        at, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        for k, (heads, ids, scores) in enumerate(self.by_length):
            inside = left[at] > k
            at, hashes = at[inside], hashes[inside]
            hashes = _rolled(hashes, points[at + k])
            row = np.searchsorted(heads, hashes)
            row[row == len(heads)] = 0
            known = heads[row] == hashes
            whole = known & (ids[row] >= 0)
            if k == 0:
                # no piece has this character alone
                bare = at[~whole]
                chars, which = np.unique(points[bare], return_inverse=True)
                costs = np.array([self.byte_score * len(self.spelled(chr(c))) for c in chars.tolist()], np.int64)
                edges.append((bare, np.ones(len(bare), np.int64), -2 - points[bare].astype(np.int64), costs[which]))
            row_whole = row[whole]
            edges.append((at[whole], np.full(len(row_whole), k + 1), ids[row_whole].astype(np.int64), scores[row_whole]))
            at, hashes = at[known], hashes[known]
            if not len(at):
                break
        return tuple(np.concatenate(column) for column in zip(*edges, strict=True))

    def spelled(self, char: str) -> list[int]:
        """Byte pieces of a character."""
        return [self.byte_ids[b] for b in (MARK if char == OWN_MARK else char).encode()]

    def best_scores(self, text: str) -> list[int]:
        """Viterbi: the best score up to each place of the lattice."""
        entries, heads, size = self.entries, self.heads, len(text)
        best: list[int] = [-NO_GAP] * (size + 1)
        best[0] = 0
        for i in range(size):
            here = best[i]
            if text[i] not in entries:
                score = here + self.byte_score * len(self.spelled(text[i]))
                if score > best[i + 1]:
                    best[i + 1] = score
            for j in range(i + 1, size + 1):
                hit = heads.get(text[i:j], 0)
                if hit:
                    if here + hit[1] > best[j]:
                        best[j] = here + hit[1]
                elif hit == 0:
                    break
        return best

    def edges(self, text: str, place: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(start, ids, score) of the lattice's edges that end at a place, the longest first."""
        for start in range(max(0, place - len(self.by_length)), place):
            if hit := self.entries.get(text[start:place]):
                yield start, *hit
        if text[place - 1] not in self.entries:
            ids = tuple(self.spelled(text[place - 1]))
            yield place - 1, ids, self.byte_score * len(ids)

    def n_best(self, text: str, n: int) -> tuple[Segmentation, ...]:
        """The n best segmentations of a text whose spaces are marks; of equal scores the one whose last pieces are
        longer goes first, as in ``solve``.

        Of equal totals the state nearest to the beginning goes on, so a state is finished before one behind it is
        opened. Each waiting state thus gives a segmentation before any later one does, and only as many are
        kept as are still wanted.
        """
        best = self.best_scores(text)
        waiting: list[tuple] = [(-best[-1], len(text), 0, 0, None)]
        made, found = 0, []
        while waiting:
            _, place, _, gone, path = waiting.pop(0)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((gone, tuple(ids)))
                if len(found) == n:
                    break
                continue
            for start, step, score in self.edges(text, place):
                made += 1
                score += gone
                waiting.append((-best[start] - score, start, made, score, (step, path)))
            waiting.sort(key=itemgetter(0, 1, 2))
            del waiting[n - len(found) :]
        return tuple(found)

    def segments(self, unit: str) -> list[str]:
        """The unit cut where no piece can span."""
        joined = self.joined
        cuts = [0, *(k + 1 for k in range(len(unit) - 1) if unit[k : k + 2] not in joined), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def segment_best(self, segment: str, n: int) -> tuple[Segmentation, ...]:
        key = (segment, n)
        if (known := self.kept.get(key)) is None:
            known = self.n_best(segment, n)
            if len(segment) <= LONGEST_CACHED and len(self.kept) < CACHED:
                self.kept[key] = known
        return known

    def unit_best(self, unit: str, n: int) -> Sequence[Segmentation]:
        return combined([self.segment_best(s, n) for s in self.segments(unit)], n)


class TwoBest:
    """The two best segmentations of each of many units: one forward Viterbi pass and one backward A* for each unit, all
    units taking their steps together.

    ``totals`` and ``paths`` have a row for the best and one for the runner-up; a path below 0 says there is none. Order
    and ties are those of ``Pieces.n_best``.
    """

    def __init__(self, pieces: Pieces, units: list[str]) -> None:
        self.pieces = pieces
        sizes = np.array([len(u) for u in units])
        # a unit's places are its characters and its end
        self.base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.end = self.base + sizes
        points = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.append(points, np.uint32(0))
        left = np.repeat(self.end, sizes + 1) - np.arange(len(points))
        inner = np.flatnonzero(left)
        start, length, ids, scores = pieces.lattice(points[inner], left[inner])
        start = inner[start]
        self.best = self._forward(start, length, scores, np.repeat(self.base, sizes + 1))
        # edges by the place where they end, the longest first
        order = np.argsort((start + length) * 256 - length)
        self.start, self.ids_of, self.scores = start[order], ids[order], scores[order]
        self.first = np.searchsorted((start + length)[order], np.arange(len(points) + 1))
        self.totals, self.paths = self._backward(len(units))

    @staticmethod
    def _forward(start: np.ndarray, length: np.ndarray, scores: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Viterbi: the best score up to each place."""
        best = np.full(len(base), -NO_GAP)
        best[np.unique(base)] = 0
        offset = (start - base[start]).astype(np.uint16)
        order = np.argsort(offset, kind="stable")
        bounds = np.searchsorted(offset[order], np.arange(int(offset.max()) + 2))
        for a, b in zip(bounds, bounds[1:], strict=False):
            edges = order[a:b]  # of one length from one place of a unit there is one edge at most: all ends differ
            ends = start[edges] + length[edges]
            best[ends] = np.maximum(best[ends], best[start[edges]] + scores[edges])
        return best

    def _backward(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A* from the ends: of each unit the waiting state of the largest total goes on; as many are kept as can still
        be among the two best. A state is (total, place, score from there to the end, path)."""
        totals, paths, found = np.full((2, n), -NO_GAP), np.full((2, n), -1), np.zeros(n, np.int64)
        self.edge, self.parent, made = [], [], 0
        active = np.flatnonzero(self.end > self.base)
        empty = np.flatnonzero(self.end == self.base)
        totals[0, empty], paths[0, empty] = 0, 0
        none = np.full(len(active), -1)
        top = (self.best[self.end[active]], self.end[active], np.zeros(len(active), np.int64), none)
        other = (np.full(len(active), -NO_GAP), none, none, none)
        while len(active):
            at_start = top[1] == self.base[active]
            if at_start.any():
                units = active[at_start]
                totals[found[units], units], paths[found[units], units] = top[2][at_start], top[3][at_start]
                found[units] += 1
                top = tuple(np.where(at_start, o, t) for o, t in zip(other, top, strict=True))
                other = (np.where(at_start, -NO_GAP, other[0]), *other[1:])
                go = (found[active] < 2) & (top[0] > -NO_GAP)
                active, top, other = active[go], tuple(c[go] for c in top), tuple(c[go] for c in other)
                if not len(active):
                    break
                if (top[1] == self.base[active]).any():
                    continue
            _, place, gone, path = top
            first = self.first[place]
            count = self.first[place + 1] - first
            begin = np.cumsum(count) - count
            edges = np.repeat(first - begin, count) + np.arange(int(count.sum()))
            value = self.best[self.start[edges]] + self.scores[edges] + np.repeat(gone, count)
            children = []
            for _ in range(2):
                most = np.maximum.reduceat(value, begin)
                hits = np.flatnonzero(value == np.repeat(most, count))
                at = hits[np.searchsorted(hits, begin)]  # the longest edge of equal ones
                edge = edges[at]
                children.append((most, self.start[edge], gone + self.scores[edge], np.arange(made, made + len(edge))))
                self.edge.append(edge)
                self.parent.append(path)
                made += len(edge)
                value[at] = -NO_GAP
            one, two = children
            # of equal totals the state nearest to the beginning, then the older one
            kept_first = (other[0] > one[0]) | ((other[0] == one[0]) & (other[1] <= one[1]))
            kept_second = (other[0] > two[0]) | ((other[0] == two[0]) & (other[1] <= two[1]))
            top = tuple(np.where(kept_first, o, a) for o, a in zip(other, one, strict=True))
            other = tuple(
                np.where(kept_first, a, np.where(kept_second, o, b)) for o, a, b in zip(other, one, two, strict=True)
            )
            other = (np.where(found[active] > 0, -NO_GAP, other[0]), *other[1:])
        self.edge = np.concatenate(self.edge) if self.edge else np.empty(0, np.int64)
        self.parent = np.concatenate(self.parent) if self.parent else np.empty(0, np.int64)
        return totals, paths

    def ids(self, rank: int) -> list[bytes]:
        """Each unit's ids on its path of this rank (0 or 1), as little-endian 32-bit integers."""
        at = np.where(self.end > self.base, self.paths[rank], -1)
        columns = []
        while (on := at >= 0).any():
            columns.append(np.where(on, self.ids_of[self.edge[at]], -1))
            at = np.where(on, self.parent[at], -1)
        if not columns:
            return [b""] * len(at)
        path = np.stack(columns, 1)
        raw, width = path.astype("<i4").tobytes(), 4 * path.shape[1]
        ends = (4 * (path != -1).sum(1)).tolist()
        out = [raw[k * width : k * width + end] for k, end in enumerate(ends)]
        for k in np.flatnonzero((path < -1).any(1)).tolist():
            flat: list[int] = []
            for i in path[k].tolist():
                flat += [i] if i >= 0 else [] if i == -1 else self.pieces.spelled(chr(-2 - i))
            out[k] = np.array(flat, "<i4").tobytes()
        return out


def combined(parts: Sequence[Sequence[Segmentation]], n: int) -> list[Segmentation]:
    """The n best of a sequence of independent parts: only the n-1 parts with the nearest runners-up can vary."""
    near = heapq.nsmallest(n - 1, ((p[0][0] - p[1][0], k) for k, p in enumerate(parts) if len(p) > 1))
    choices: list[tuple[int, dict[int, int]]] = [(0, {})]
    for _, k in sorted(near, key=lambda x: x[1]):
        grown = [(lost + parts[k][0][0] - s[0], {**chosen, k: c}) for lost, chosen in choices for c, s in enumerate(parts[k])]
        choices = heapq.nsmallest(n, grown, key=lambda x: x[0])
    total = sum(p[0][0] for p in parts)
    return [
        (total - lost, tuple(i for k, p in enumerate(parts) for i in p[chosen.get(k, 0)][1])) for lost, chosen in choices
    ]


class Encoder:
    """Encodes whole texts; keeps the best segmentation of words that come again, up to a fixed number."""

    def __init__(self, pieces: Pieces, n_best: int = 2) -> None:
        self.pieces, self.n = pieces, max(1, n_best)
        self.known: dict[str, tuple[bytes, int, int]] = {}

    def units_of(self, text: str) -> list[str]:
        """Words with the mark before them; the text falls apart between them."""
        if not text:
            return []
        body = text.replace(MARK, OWN_MARK) if MARK in text else text
        if not self.pieces.by_words:
            return [MARK + body.replace(" ", MARK)]
        if "  " in body or body[0] == " " or body[-1] == " ":
            return UNIT.findall(MARK + body.replace(" ", MARK))
        return [MARK + w for w in body.split(" ")]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, int | None]]:
        """For each text: ids of the best segmentation, its score, and the runner-up's score."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            split = [self.units_of(t) for t in texts[at:end]]
            known = self.known
            new = [u for u in set().union(*split) if u not in known]
            known.update(self.pieces.solve(new))
            for units in split:
                yield self._encoded(units)
            if len(self.known) > CACHED:
                for unit in new:
                    del self.known[unit]
            at = end

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, int, int | None]:
        entries = list(map(self.known.__getitem__, units))
        ids = np.frombuffer(b"".join([e[0] for e in entries]), "<i4")
        score = sum([e[1] for e in entries])
        gaps = [e[2] for e in entries]
        least = min(gaps, default=NO_GAP)
        if least == NO_GAP:
            return ids, score, None
        # the whole text's runner-up deviates in the one unit that loses least by it
        return ids, score, score - least

    def encode(self, text: str) -> tuple[np.ndarray, int, int | None]:
        return next(self.encode_all([text]))

    def encode_n(self, text: str) -> list[Segmentation]:
        """The n best segmentations of the text with their scores."""
        units = self.units_of(text)
        return combined([self.pieces.unit_best(u, self.n) for u in units], self.n) if units else [(0, ())]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_ENCODERS: dict[tuple[str, int], Encoder] = worker_cache("pieces", {})


def encoder_for(model: str, n_best: int) -> Encoder:
    """One encoder for each Python worker, so that later tasks find the words of earlier ones."""
    only("pieces")
    key = (model, n_best)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Pieces.load(model), n_best)
    return _ENCODERS[key]



def encode(
    df: DataFrame, text: str = "text", out: str = "encoded", model: str | None = None
) -> DataFrame:
    """Add ``out``: struct of ids, n_pieces, score and runner_up (the second best score; null if there is none).

    ``model`` is a path that every executor can read. Keeps all rows and columns; a column named ``out`` is replaced.
    """
    path = model or default_model()

    # Arrow in and out: only ROWS texts at a time become Python's
    @F.arrow_udf("ids array<int>, n_pieces bigint, score bigint, runner_up bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(path, 2)
        for texts in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            ids, scores, runners_up = zip(*encoder.encode_all(texts.to_pylist()), strict=True)
            sizes = np.array([len(i) for i in ids], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = {
                "ids": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32())),
                "n_pieces": pa.array(sizes),
                "score": pa.array(scores, pa.int64()),
                "runner_up": pa.array(runners_up, pa.int64()),
            }
            yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
            give_back()

    return df.withColumn(out, run(text_of(text)))


def segmentations(df: DataFrame, n: int, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """The ``n`` best segmentations of each text: doc_id, rank from 1, score, ids. Fewer if the text has fewer."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path, n)
        for batch in batches:
            for doc_id, body in zip(batch["doc_id"], batch["body"], strict=True):
                best = encoder.encode_n(body)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([doc_id] * len(best), "Int64"),
                        "rank": range(1, len(best) + 1),
                        "score": [s for s, _ in best],
                        "ids": [list(ids) for _, ids in best],
                    }
                )

    rows = named(df, doc_id=key, body=text).select(F.col("doc_id").cast("bigint"), text_of("body").alias("body"))
    return rows.mapInPandas(run, "doc_id bigint, rank int, score bigint, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """Add ``out``: the text that the ids spell; null for null ids."""
    path = model or default_model()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_for(path, 1)
        for rows in batches:
            yield rows.map(lambda r: None if r is None else encoder.decode(np.asarray(r, np.int64)))

    return df.withColumn(out, run(F.col(ids)))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), score, runner_up,
    restored (whether the ids decode to the text). The ids stay in the task."""
    path = model or default_model()

    @F.pandas_udf("n_pieces bigint, ids_crc32 bigint, score bigint, runner_up bigint, restored boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path, 2)
        for texts in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            rows = []
            bodies = list(texts)
            for body, (ids, score, runner_up) in zip(bodies, encoder.encode_all(bodies), strict=True):
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score, runner_up, encoder.decode(ids) == body))
            frame = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "score", "runner_up", "restored"], dtype=object)
            yield frame.astype({"n_pieces": "int64", "ids_crc32": "int64", "score": "int64", "runner_up": "Int64", "restored": bool})

    return named(df, doc_id=key, body=text).select("doc_id", run(text_of("body")).alias("d")).select("doc_id", "d.*")
