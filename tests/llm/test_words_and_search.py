"""Byte-level BPE against tiktoken, ranked search and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from vitalgauge.llm import byte_pair, lexical, spelling


@pytest.fixture(scope="module")
def model():
    return byte_pair.model_for(byte_pair.default_ranks(), byte_pair.default_pattern())


@pytest.fixture(scope="module")
def reference(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def ids_of(model, text):
    return array("i", model.encode(text)).tolist()


def test_encoding_equals_merging_by_rank(model, reference):
    rng = random.Random(5)
    parts = ["a", "e", " ", "\n", "'s", "é", "ж", "中", "1", "!", "==", "\x1c", "\x85", "​", "the", "ing", "\U0001f600", " t"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.randint(1, 0xD7FF)) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text in texts:
        assert ids_of(model, text) == reference.encode_ordinary(text), text


def test_every_token_and_random_bytes_merge_as_defined(model):
    rng = random.Random(6)
    tokens = list(model.ranks)
    for raw in rng.sample(tokens, 400):
        assert model.merge(raw) == [model.ranks[t] for t in byte_pair.merged(raw, model.ranks)]
    for _ in range(300):
        raw = b"".join(rng.choices(tokens, k=rng.randint(1, 5)))
        assert model.merge(raw) == [model.ranks[t] for t in byte_pair.merged(raw, model.ranks)]


def test_letter_classes_of_the_pattern(model, reference):
    for code in [*range(1, 0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 11)]:
        text = f"a{chr(code)}1{chr(code)}!{chr(code)} {chr(code)}"
        assert ids_of(model, text) == reference.encode_ordinary(text), hex(code)


def test_ranks_out_of_merge_order_and_unreachable_tokens():
    single = {bytes([b]): b for b in range(256)}
    odd = byte_pair.BytePairModel(single | {b"ab": 256, b"bc": 257, b"xyz": 300}, public_tokenizers.PATTERN)
    assert ids_of(odd, "xyz") == [300]  # a whole piece in the ranks
    assert ids_of(odd, "xyza") == [120, 121, 122, 97]  # merging can't reach it
    assert ids_of(odd, "abc") == [256, 99]
    with pytest.raises(ValueError, match="ranks before"):
        byte_pair.BytePairModel(single | {b"abc": 256, b"ab": 257}, public_tokenizers.PATTERN)
    with pytest.raises(ValueError, match="without a rank"):
        byte_pair.BytePairModel({b"a": 0}, public_tokenizers.PATTERN)


def test_long_runs_and_blocks(model, reference, monkeypatch):
    for text in ("a" * 60_000, "ab" * 30_000, " " * 60_000, "=" * 60_000):
        assert ids_of(model, text) == reference.encode_ordinary(text)
    monkeypatch.setattr(byte_pair, "BLOCK", 40)
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choices(["a", "bc", " ", "  ", "\n", "'ll", "12", "?!", "aaaaaaaaaaaaaaaaaaaaaa"], k=90))
        assert ids_of(model, text) == reference.encode_ordinary(text)


def test_encode_and_decode_odd_documents(odd_documents, no_documents, reference):
    clashing = odd_documents.withColumn("ids", F.lit("other"))
    rows = byte_pair.decode(byte_pair.encode(clashing)).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() >= {"quality", "source"}
    for row in rows:
        assert list(row.ids) == reference.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_pair.decode(byte_pair.encode(no_documents)).count() == 0


def test_decode_of_unknown_ids(spark):
    lists = spark.createDataFrame([([64, 65],), ([999_999],), ([-1],), ([None],), ([],), (None,)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in byte_pair.decode(lists).collect()] == [b"ab", None, None, None, b"", b""]


def test_bpe_query(spark, reference):
    from vitalgauge.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for row in docs:
        ids = reference.encode_ordinary(row.text or "")
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k):
    texts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    texts = [(i, c, c.total()) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    found = []
    for item, terms in wanted.items():
        scored = []
        for i, c, n in texts:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scored.append((-score, (i is not None, i or 0), i))
        found += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return Counter(found)


DOCS = "doc_id bigint, text string, item_id string, score string, block string, term string"


def searched(spark, docs, items, k, **sizes):
    left = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS weight")
    return Counter(tuple(r) for r in lexical.search(left, right, k, **sizes).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 7, "items_together": 3}])
def test_search_equals_brute_force(spark, sizes):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "ü9", "中文", "A1", " b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(300, 340)]  # ties
    docs += [(5, "w1 w2 w2"), (5, "w1 w2 w2"), (None, "w1, W2!w3"), (None, None), (400, ""), (401, "w7 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(3, "w5 w6"), (None, "w1 w9"), (50, None), (51, "nowhere"), (52, "")]
    assert searched(spark, docs, items, 10, **sizes) == brute_search(docs, items, 10)


def test_search_in_nothing(spark):
    assert not searched(spark, [], [(1, "a")], 5)
    assert not searched(spark, [(1, "a")], [], 5)
    assert not searched(spark, [(1, None)], [(1, "a")], 5)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs, noise, min_length):
    total = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= min_length:
                total[run] += 1
    return total


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return rows


def test_composition_equals_all_pairs():
    rng = random.Random(9)
    for trial in range(60):
        words = sorted({"".join(rng.choices("ab" if trial % 2 else "abcé", k=rng.randint(1, 8))) for _ in range(50)})
        want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
        got = list(spelling.Acceptor(words).one_edit_pairs())
        assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_acceptor_is_minimal():
    assert len(spelling.Acceptor(["tap", "taps", "top", "tops"]).nodes) == 5


def test_variants_equal_brute_force(spark):
    rng = random.Random(10)
    counts = {}
    while len(counts) < 400:
        counts["".join(rng.choices("abç", k=rng.randint(1, 8)))] = rng.choice([5, 6, 30, 200, 1500, 9000, 60_000])
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(words).collect()}
    assert got == brute_variants(counts, 5)
    assert spelling.variants(words.limit(0)).count() == 0


def test_words_of_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rows += [(n, "Straße ÀÉ× don't naïvetéĀx \U0001f600 " + "Variant variants VARIANTES " * n) for n in range(60)]
    extra = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id bigint, text string, word string, n int")
    for noise in (None, 3):
        got = {r.word: r.n for r in spelling.count_words(extra, noise=noise, min_length=2).collect()}
        assert got == brute_words(rows, noise, 2)
    assert spelling.spelling_variants(no_documents).count() == 0


def test_spelling_query(spark):
    from vitalgauge.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in brute_words(docs, 199, 6).items() if n >= 5}
    got = {
        tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
        for r in QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001").collect()
    }
    assert got == brute_variants(counts, 5)
