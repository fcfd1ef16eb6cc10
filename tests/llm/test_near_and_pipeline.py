"""The Jaccard join against all pairs, and the pipeline's stages."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from vitalgauge.llm import common, language, near_join, pieces
from vitalgauge.llm.near_join import JoinSpec


def brute(rows, spec):
    """Class by row number: all pairs of sets."""
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = spec.width
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= spec.percent * len(a | b):
                parent[top(i)] = top(j)
    return sets, [top(i) for i in range(len(rows))]


@pytest.mark.parametrize("spec", [JoinSpec(3, 90), JoinSpec(5, 80)])
def test_classes_equal_all_pairs(spark, spec):
    draw = random.Random(spec.width)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(draw.choices(words, k=25))
    rows = []
    for base in range(12):
        text = draw.choices(words, k=draw.choice((2, 4, 8, 60, 120)))
        for _ in range(12):
            copy = list(text)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            body = " ".join(copy)
            rows.append((len(rows), f"{passage} {body}" if base % 3 == 0 else body.title()))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, rows[0][1].upper()), (904, rows[0][1].replace(" ", "\u00a0"))]
    sets, tops = brute(rows, spec)
    smallest = {}
    for (doc_id, _), own, top in zip(rows, sets, tops, strict=True):
        if own:
            smallest[top] = min(doc_id, smallest.get(top, doc_id))
    want = {d: (len(own), smallest[top] if own else d) for (d, _), own, top in zip(rows, sets, tops, strict=True)}
    table = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id bigint, text string, node int, size string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.classes(table, spec=spec).collect()}
    assert got == want


def test_sets_that_share_a_passage_only_stand_in_no_list(spark, monkeypatch):
    """Long texts, each with a passage of the one before: too few of their prefix shingles are met again."""
    held = {}

    def watched(df, label, save=near_join.saved):
        out = save(df, label)
        held.setdefault(label, out.count())
        return out

    monkeypatch.setattr(near_join, "saved", watched)
    spec = JoinSpec(3, 90)
    texts = [[f"d{k}w{i}" for i in range(600)] for k in range(30)]
    for k in range(1, 30):
        texts[k][100:130] = texts[k - 1][300:330]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = near_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), spec=spec).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k for k in range(30)}
    assert held["near-lists"] == 0


def test_long_sets_near_the_bound_equal_all_pairs(spark):
    draw = random.Random(21)
    rows = []
    for spec in (JoinSpec(3, 90), JoinSpec(5, 80)):
        rows.clear()
        for base in range(4):
            text = [f"b{base}w{draw.randrange(5000)}" for _ in range(draw.choice((150, 400, 700)))]
            for _ in range(12):
                # each changed word changes about ``width`` shingles; the counts lie about the bound
                copy = list(text)
                share = draw.uniform(0.1, 0.9) * (100 - spec.percent) / (100 + spec.percent) / spec.width
                for at in draw.sample(range(len(copy)), round(share * len(copy))):
                    copy[at] = f"x{draw.randrange(10**9)}"
                cut = draw.randint(0, len(copy) // 100)
                rows.append((len(rows), " ".join(copy[cut:])))
        sets, tops = brute(rows, spec)
        smallest = {}
        for (doc_id, _), top in zip(rows, tops, strict=True):
            smallest[top] = min(doc_id, smallest.get(top, doc_id))
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.classes(table, spec=spec).collect()}
        assert got == {d: (len(own), smallest[top]) for (d, _), own, top in zip(rows, sets, tops, strict=True)}
        assert 4 < len(set(tops)) < len(rows)


def rows_of_joins(df):
    """Rows that the largest join makes when ``df`` runs."""
    df.collect()
    found, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif "QueryStageExec" in node.getClass().getSimpleName():
            left.append(node.plan())
        elif "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        left += [children.apply(k) for k in range(children.length())]
    return max(found)


def test_many_copies_just_under_the_bound_make_few_rows(spark, monkeypatch):
    """A text, copied with so many changes that few copies link: nearly all pairs meet on long lists."""
    length, edits = 300, 6
    draw = random.Random(length)
    spec, copies = JoinSpec(3, 90), 150
    words = [f"w{k}" for k in range(length)]
    rows = []
    for k in range(copies):
        copy = list(words)
        for at in draw.sample(range(length), edits):
            copy[at] = f"x{draw.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    made, rest = [], near_join._rest

    def watched(*given):
        out = rest(*given)
        made.append(rows_of_joins(out))
        return out

    monkeypatch.setattr(near_join, "_rest", watched)
    sets, tops = brute(rows, spec)
    smallest = {}
    for (doc_id, _), top in zip(rows, tops, strict=True):
        smallest[top] = min(doc_id, smallest.get(top, doc_id))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.classes(table, spec=spec).collect()}
    assert got == {d: (len(own), smallest[top]) for (d, _), own, top in zip(rows, sets, tops, strict=True)}
    assert len(set(tops)) > copies / 2
    assert made[0] < 10 * copies


def test_bitmaps_keep_every_link():
    draw = random.Random(1)
    spec, kept = JoinSpec(1, 80), 0
    for size in (1, 2, 9, 64, 65, 500, 3000):
        for edits in (0, 0.05, 0.12, 0.5, 1):
            a = [f"w{draw.random()}" for _ in range(size)]
            b = [w if draw.random() >= edits else f"v{draw.random()}" for w in a] + ["x"] * draw.randint(0, 2)
            x, y = (near_join.shingle_set(" ".join(t), 1) for t in (a, b))
            may = near_join._may_link(near_join._parity(x), near_join._parity(y), len(x), len(y), spec)
            assert may or not spec.linked(near_join._shared(x, y), len(x), len(y))
            kept += may and edits == 1 and size >= 64
    assert kept == 0


def test_classes_of_odd_tables(odd_documents, no_documents):
    rows = near_join.classes(odd_documents).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.n_shingles == 10 and r.doc_id in (1, None)} == {1}
    assert near_join.classes(no_documents).count() == 0
    kept = near_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]


def test_each_stage_keeps_the_columns_and_drops_what_it_should(spark, tmp_path):
    draw = random.Random(9)
    words = {"en": ["the", "river", "house", "and", "with", "under", "stone"], "de": ["der", "Fluss", "und", "über", "Häuser", "mit", "steinern"]}
    rows, labels = [], []
    for k in range(300):
        lang = ("en", "de")[k % 2]
        body = " ".join(draw.choices(words[lang], k=40)) + f" {lang}mark{k} " + " ".join(draw.choices(words[lang], k=40))
        toxic = k % 5 == 0
        rows.append((k, body + (" vilestuff" if toxic else ""), lang, "s", len(body)))
        labels.append((k, 1, int(toxic)))
    item = "a benchmark item of some length, which no clean document should ever hold inside"
    rows += [(1001, rows[1][1], "en", "s", 1), (1002, f"{rows[2][1]} extra words here {item} and on", "de", "s", 1), (1003, None, None, None, None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    good = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, folder).collect()}
    assert not good & {k for k in range(0, 300, 5)} and len(good & set(range(300))) >= 230
    assert 1002 not in {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect()}
    assert 1001 not in {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()}
    assert 1003 not in {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, folder).collect()}
    out = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert out <= good and 1001 not in out and len(out) >= 225


def test_a_worker_keeps_the_caches_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_WORKER_CACHES", dict(common._WORKER_CACHES))
    for owner in ("pieces", "language", "near_join"):
        assert common.worker_cache(owner, {}) is common._WORKER_CACHES[owner]
    language.LanguageModel(["xx"], "none", files=[{}]).reader()
    near_join.shingle_set("some words", 3)
    assert language._READERS and near_join._HASHES
    common.only("near_join")
    assert near_join._HASHES and not language._READERS and not pieces._ENCODERS
    common.only("quality")
    assert not near_join._HASHES


def test_free_memory_goes_back_to_the_system():
    def anonymous():
        rows = dict(line.split(":") for line in Path("/proc/self/smaps_rollup").read_text().splitlines()[1:])
        return int(rows["Anonymous"].split()[0]) // 1024

    words = [f"{k:050d}" for k in range(1_000_000)]
    held = [words[k] + "." for k in range(0, len(words), 2)]
    sets = [np.arange(2_000, dtype=np.uint64) for _ in range(6_000)]
    guard = np.arange(2_000, dtype=np.uint64)  # what stands above keeps malloc from giving back what is free below
    before = anonymous()
    del sets
    common.only("near_join")
    assert before - anonymous() >= 60
    assert len(held) and len(guard)


def test_jobs_with_small_batches_also_read_few_rows_at_a_time(spark):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(key) for key in keys]
    with pytest.raises(ZeroDivisionError), common.arrow_rows(spark, 77):
        assert [spark.conf.get(key) for key in keys] == ["77", "77"]
        raise ZeroDivisionError
    assert [spark.conf.get(key) for key in keys] == before


def test_the_encoder_holds_few_texts_as_objects(spark, monkeypatch):
    texts = [f"word{k} and “marks” ▁ {k * k}" if k % 7 else "" for k in range(1201)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(pieces.F, "pandas_udf", None)  # it would make an object of every text of an Arrow batch
    encoder = pieces.Encoder(pieces.Pieces.load(pieces.default_model()))
    for row in pieces.encode(docs).select("doc_id", "encoded.*").collect():
        ids, score, runner_up = encoder.encode(texts[row.doc_id])
        assert (row.ids, row.n_pieces, row.score, row.runner_up) == (ids.tolist(), len(ids), score, runner_up)
