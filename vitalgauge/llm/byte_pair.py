"""Byte-level BPE encoding and decoding by rank files, in linear time and equal to merging by rank.

A text is cut by the tokenizer's pattern. Inside a piece, a sequence of tokens is what merging gives exactly if every two
neighbours stay apart when merged alone (the pattern must leave no character out). So the encoder walks from the left, takes the longest token at each place that
stays apart from the token before it, and steps back where no token does; places proved hopeless are never entered again.
Longest tokens come from an Aho-Corasick automaton over reversed tokens, with bytes as Latin-1 letters. Whether two tokens
stay apart is worked out by undoing their merges along the seam, and remembered.

A piece that is itself in the ranks is that token, even if merging can't reach it. Null and empty texts have no ids. Ids
outside the ranks decode to null, null ids to empty bytes. Rows and other columns are kept as they are; a column with the
name of the result is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgauge.llm.common import text_of

CACHED_PIECES = 400_000
CACHED_LENGTH = 64
KNOWN_SEAMS = 2_000_000
BLOCK = 1 << 20  # characters that are cut into pieces together
SEEN_AHEAD = 16  # characters behind a piece, at most, that the pattern looks at
ROWS = 1_000  # texts that a task holds the results of at a time


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, file)))}


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: merge the neighbours whose joined bytes rank lowest, leftmost first, till no pair is in the ranks."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        found = [(ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class BytePairModel:
    """Tables of one rank file: halves of each token, the next shorter token, the automaton, and the seams known so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing[:5]}")
        if max(ranks.values()) >= 1 << 31:
            raise ValueError("ranks must fit 31 bits")
        self.ranks, self.cutter = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = [len(token or b"") for token in self.bytes_of]
        # halves and birth of the tokens that merging reaches; single bytes are born before all merges
        self.left, self.right, self.birth = [-1] * size, [-1] * size, [-1] * size
        # both by left * size + right: whole numbers as keys spare the garbage collector
        self.joined: dict[int, int] = {}
        self.seams: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._learn(token, rank)
        reached = [t for t, r in ranks.items() if len(t) == 1 or self.birth[r] >= 0]
        self.shorter = [-1] * size
        among = set(reached)
        self.automaton = ahocorasick.Automaton()
        for token in reached:
            self.automaton.add_word(token[::-1].decode("latin-1"), ranks[token])
            head = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in among), None)
            if head is not None:
                self.shorter[ranks[token]] = ranks[head]
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}

    def _learn(self, token: bytes, rank: int) -> None:
        """Find the two tokens of lower rank whose merge is this token, if merging its bytes ends with it."""
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], -1), self.ranks.get(token[k:], -1)
            known = all(x >= 0 and (self.birth[x] >= 0 or self.length[x] == 1) for x in (a, b))
            if known and self.birth[a] < rank and self.birth[b] < rank and self._stay_apart(a, b):
                self.left[rank], self.right[rank], self.birth[rank] = a, b, rank
                self.joined[a * len(self.birth) + b] = rank
                return
        if len(merged(token, self.ranks)) == 1:
            raise ValueError(f"{token!r} ranks before a token that it is merged from")

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges next to the seam, latest first; before each, the tokens there must not have had an earlier merge.

        Of equal merges the left one comes first: on the right side a merge of the same rank across the seam precedes.
        """
        birth, size = self.birth, len(self.birth)
        limit = size
        while True:
            across = self.joined.get(left * size + right)
            if across is not None and across < limit:
                return False
            if birth[left] > birth[right]:
                limit, left = left, self.right[left]
            elif birth[right] >= 0:
                limit, right = right + 1, self.left[right]
            else:
                return True

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece of at least one byte."""
        size, tokens = len(raw), len(self.birth)
        length, seams, shorter = self.length, self.seams, self.shorter
        # Matches that end at one place come longest first, so from the back the longest is written last.
        longest = dict(reversed([*self.automaton.iter(raw[::-1].decode("latin-1"))]))
        hopeful = bytearray(b"\1") * (size + 1)
        ids: list[int] = []
        place, token = 0, longest[size - 1]
        while place < size:
            end = place + length[token]
            fits = hopeful[end]
            if fits and ids:
                seam = ids[-1] * tokens + token
                fits = seams.get(seam)
                if fits is None:
                    if len(seams) >= KNOWN_SEAMS:
                        seams.clear()
                    fits = seams[seam] = self._stay_apart(ids[-1], token)
            if fits:
                ids.append(token)
                place = end
                token = longest.get(size - 1 - place, -1)
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                hopeful[place] = 0
                token = ids.pop()
                place -= length[token]
        return ids

    def _packed(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            known = array("i", self.merge(raw) if whole is None else [whole]).tobytes()
            if len(piece) <= CACHED_LENGTH:
                if len(self.pieces) >= CACHED_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time. Pieces near a block's end may turn out otherwise, so they are cut again."""
        at, step = 0, BLOCK
        while at < len(text):
            found = self.cutter.findall(text[at : at + step])
            if at + step >= len(text):
                yield found
                return
            kept = step
            while found and kept > step - SEEN_AHEAD:
                kept -= len(found.pop())
            if found:
                at, step = at + kept, BLOCK
                yield found
            else:
                step *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        packed = self._packed
        return b"".join([b"".join(map(packed, pieces)) for pieces in self.cut(text)])


class Decoder:
    """Bytes by id; an id that the ranks don't have stands behind the last one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.unknown = max(ranks.values()) + 1
        self.bytes_of = [b""] * (self.unknown + 1)
        self.length = np.full(self.unknown + 1, -1, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank], self.length[rank] = token, len(token)

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of each list; null for a list with an unknown id."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        ids = lists.flatten().fill_null(-1).to_numpy()
        ids = np.where((ids < 0) | (ids > self.unknown), self.unknown, ids)
        length = self.length[ids]
        wrong = np.concatenate([[0], np.cumsum(length < 0)])[offsets]
        ends = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])[offsets].astype(np.int32)
        whole = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        known = pa.array(np.diff(wrong) == 0)
        found = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(whole)])
        return pc.if_else(known, found, pa.scalar(None, pa.binary())) if wrong[-1] else found


_MODELS: dict[tuple[str, str], BytePairModel] = {}


def model_for(path: str, pattern: str) -> BytePairModel:
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = BytePairModel(read_ranks(path), pattern)
    return _MODELS[path, pattern]


def encode(df: DataFrame, text: str = "text", out: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``out``, array<int>: the ids of the whole text."""
    path, cutting = ranks or default_ranks(), pattern or default_pattern()

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_for(path, cutting)
        for texts in batches:
            chunks = []
            for at in range(0, len(texts), ROWS):
                packed = [model.encode(t) for t in texts.slice(at, ROWS).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
                chunks.append(pa.ListArray.from_arrays(pa.array(offsets), values))
            yield pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(out, ids_of(text_of(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Add ``out``, binary: the bytes of the ids."""
    path = ranks or default_ranks()

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(read_ranks(path))
        for lists in batches:
            chunks = [decoder.decode_all(lists.slice(at, ROWS)) for at in range(0, len(lists), ROWS)]
            yield pa.concat_arrays(chunks) if chunks else pa.array([], pa.binary())

    given = F.col(f"`{ids}`").cast("array<int>")
    return df.withColumn(out, bytes_of(F.coalesce(given, F.array().cast("array<int>"))))
