"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

Documents are dealt by ranges of ascending doc_id; each task writes one part:

- ``part-N-*.bin``: the ids of its documents one after another, little-endian unsigned, 16 bits if the vocabulary fits,
  else 32;
- ``part-N-*.idx``: little-endian signed 64-bit numbers: how many documents, then their offsets in ids from the part's
  start (one more than there are documents), then their doc_ids.

A part's name is new for each attempt, and only the names that Spark's own result holds are read: a task that is lost
or runs twice does no harm. The place of a part in the whole is the sum of the parts before it (``manifest``). The folder
must be one that all executors reach (by default under spark.checkpoint.dir); local and mounted folders are memory-mapped.

Null and empty texts have the end id alone. Rows with equal doc_ids are all kept, by text; null doc_ids come first and
are written as the smallest 64-bit number.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.llm.common import named, shared_path

END_ID = 0
NO_ID = -(1 << 63)
CACHED_WORDS = 600_000
OTHER_SPACES = r"\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = rf"{OTHER_SPACES}\n "
# One space may lead a run of other characters; of the white space before a run all but the last stands alone.
UNITS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
ODD = re.compile(f"[{OTHER_SPACES}]")


def unusual(text: str) -> bool:
    """Whether the text has white space other than single spaces and line ends between words."""
    return (
        "  " in text
        or "\n\n" in text
        or "\n " in text
        or " \n" in text
        or text[:1] in (" ", "\n")
        or text[-1:] in (" ", "\n")
        or ODD.search(text) is not None
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """A byte-level BPE tokenizer that keeps the ids of words that come again.

    Such tokenizers never join characters across the start of a run of white space, so the parts of a text between these
    places are encoded alone. Texts with added tokens in them go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # pieces that begin with a space
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = True
        self.spaced, self.plain = _Words(), _Words()  # ids of a space and the word; of the word alone
        pre = self.tokenizer.pre_tokenizer
        self.by_words = self.tokenizer.normalizer is None and "ByteLevel(add_prefix_space=False" in str(pre) and "use_regex=True" in str(pre)

    def _fill(self) -> None:
        """Work out the ids of the words that were asked for and aren't known yet."""
        code = "H" if self.dtype.itemsize == 2 else "I"
        fresh = list(self.spaced.fresh.items())
        runs = [fresh[k : k + 64] for k in range(0, len(fresh), 64)]
        joined = self.tokenizer.encode_batch_fast([" " + " ".join([u for u, _ in run]) for run in runs], add_special_tokens=False)
        alone = [("", u, ids) for u, ids in self.plain.fresh.items()]
        for run, encoded in zip(runs, joined, strict=True):
            ids = np.array(encoded.ids, self.dtype)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(run) and starts[0] == 0:
                raw, cuts = ids.tobytes(), [*(starts * self.dtype.itemsize).tolist(), None]
                for (_, known), a, b in zip(run, cuts, cuts[1:], strict=False):
                    known += raw[a:b]
            else:
                alone += [(" ", u, known) for u, known in run]
        found = self.tokenizer.encode_batch_fast([lead + u for lead, u, _ in alone], add_special_tokens=False)
        for (_, _, known), encoded in zip(alone, found, strict=True):
            known += array(code, encoded.ids).tobytes()
        self.spaced.settle()
        self.plain.settle()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        spaced, plain = self.spaced.__getitem__, self.plain.__getitem__
        parts_of: list[list[bytearray] | bytes] = []
        for text in texts:
            if not self.by_words or (self.added is not None and self.added.search(text)):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                parts_of.append(np.array(ids, self.dtype).tobytes())
            elif text and unusual(text):
                parts_of.append(list(map(plain, UNITS.findall(text))))
            else:
                parts: list[bytearray] = []
                for line in text.split("\n") if text else ():
                    first, *others = line.split(" ")
                    if parts:
                        parts.append(plain("\n"))
                    parts.append(plain(first))
                    parts += map(spaced, others)
                parts_of.append(parts)
        self._fill()
        return [parts if isinstance(parts, bytes) else b"".join(parts) for parts in parts_of]


class _Words(dict):
    """Ids by word. A word that isn't known gets an empty entry, which is filled before it is read."""

    def __init__(self) -> None:
        self.fresh: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        if word in self.fresh:
            return self.fresh[word]
        entry = self.fresh[word] = bytearray()
        return entry

    def settle(self) -> None:
        """Keep the new words while there is room: the first ones seen are the common ones."""
        if len(self) < CACHED_WORDS:
            self.update(self.fresh)
        self.fresh = {}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


PART = "part int, bin string, idx string, width int, n_docs bigint, n_ids bigint"


def write_token_files(
    df: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Write all documents and return one row a part (``PART``). The folder must be new or empty."""
    spark = df.sparkSession
    target, path = folder or shared_path(spark, "token-ids"), tokenizer or default_tokenizer()
    rows = named(df, doc_id=key, body=text).select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path)
        files, base = _filesystem(target)
        files.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], encoder.dtype).tobytes()
        ids, lengths = [], []
        with files.open_output_stream(f"{base}/{name}.bin") as out:
            for batch in batches:
                bodies = list(batch["body"])
                ids.append(batch["doc_id"].to_numpy(np.int64))
                for at in range(0, len(bodies), 256):
                    packed = encoder.encode_all(bodies[at : at + 256])
                    lengths += [len(p) // encoder.dtype.itemsize + 1 for p in packed]
                    out.write(b"".join([x for p in packed for x in (p, end)]))
        if lengths:
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
            with files.open_output_stream(f"{base}/{name}.idx") as out:
                out.write(np.array([len(lengths)], "<i8").tobytes() + offsets.tobytes() + np.concatenate(ids).astype("<i8").tobytes())
            yield pd.DataFrame(
                [(number, f"{base}/{name}.bin", f"{base}/{name}.idx", encoder.dtype.itemsize, len(lengths), int(offsets[-1]))],
                columns=["part", "bin", "idx", "width", "n_docs", "n_ids"],
            )
        else:
            files.delete_file(f"{base}/{name}.bin")

    parts = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "body").mapInPandas(run, PART).collect()
    return spark.createDataFrame(manifest(parts), f"{PART}, first_doc bigint, base bigint").withColumn("folder", F.lit(target))


def manifest(parts: list) -> list[tuple]:
    """The parts in order, each with how many documents and ids lie before it."""
    docs = ids = 0
    rows = []
    for part in sorted(parts, key=lambda p: p["part"]):
        rows.append((*part, docs, ids))
        docs += part["n_docs"]
        ids += part["n_ids"]
    return rows


def read_token_files(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """One row a document, read from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples():
                ids, offsets, docs = open_part(part.folder, part.bin, part.idx, part.width)
                for at in range(0, len(docs), 2000):
                    spans = offsets[at : at + 2001]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(spans, spans[1:], strict=False)]
                    names = docs[at : at + 2000]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(names, "Int64").copy() if not (names == NO_ID).any() else pd.array([None if d == NO_ID else d for d in names], "Int64"),
                            "start": part.base + spans[:-1],
                            "n_tokens": np.diff(spans),
                            "ids_crc32": sums,
                        }
                    )

    files = parts.select("folder", "bin", "idx", "width", "base")
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bin").mapInPandas(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def open_part(folder: str, bin_path: str, idx_path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and doc_ids of a part; the ids are mapped, not read, where the folder is a mounted one."""
    from pyarrow import fs

    files, _ = _filesystem(folder)
    dtype = np.dtype(f"<u{width}")
    if isinstance(files, fs.LocalFileSystem):
        ids = np.memmap(bin_path, dtype, "r")
        index = np.fromfile(idx_path, "<i8")
    else:
        ids = np.frombuffer(files.open_input_file(bin_path).read_buffer(), dtype)
        index = np.frombuffer(files.open_input_file(idx_path).read_buffer(), "<i8")
    n = int(index[0])
    return ids, index[1 : n + 2], index[n + 2 :]
