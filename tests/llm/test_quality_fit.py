"""The ordinal regression: gradient against finite differences, a draw that doesn't depend on partitions, bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from vitalgauge.llm import quality


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    rows = [rng.choice(30, rng.integers(0, 9), replace=False).astype(np.int32) for _ in range(40)]
    lengths = np.array([len(r) for r in rows])
    columns, grades, k = np.concatenate(rows), rng.integers(0, 4, 40), 3
    cut = int(lengths[:17].sum())
    spans = [(0, 17, 0, cut), (17, 40, cut, len(columns))]
    theta = np.concatenate([rng.normal(0, 0.5, 30), [-0.4, -0.2, 0.3]])
    given = quality.gradient(theta, columns, lengths, spans, grades, k)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up, down = (quality.loss(theta + s, columns, lengths, spans, grades, k) for s in (step, -step))
        assert given[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_blocks_of_slots_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << 10, rng.integers(0, 40))).astype(np.int32) for _ in range(200)]
    grades = rng.integers(0, 3, 200)
    whole = quality.fit_ordinal(rows, grades, 3, bits=10)
    monkeypatch.setattr(quality, "TOGETHER", 64)
    parts = quality.fit_ordinal(rows, grades, 3, bits=10)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.thresholds, parts.thresholds, atol=1e-4)


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(300)]
    return spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(
        [(i, i % 3) for i in range(300)], "doc_id bigint, grade int"
    )


@pytest.mark.parametrize("bounds", [{}, {"max_rated": 50}, {"max_slots": 900}])
def test_same_model_over_all_partitionings(rated, bounds):
    docs, marks = rated
    first, second = (quality.train(docs.repartition(n), marks.repartition(m), 3, **bounds) for n, m in ((1, 7), (6, 2)))
    assert np.array_equal(first.weights, second.weights) and np.array_equal(first.thresholds, second.thresholds)
    if not bounds:
        assert len(np.flatnonzero(first.weights)) > 400
    else:
        whole = quality.train(docs, marks, 3)
        assert not np.array_equal(first.weights, whole.weights)


def test_slots_come_out_of_arrow_in_one_piece():
    draw = np.random.default_rng(5)
    rows = [draw.integers(0, 1 << 10, k).astype(np.int32) for k in (3, 0, 7, 1, 0, 5)]
    raw = [r.tobytes() for r in rows]
    for chunks in ([raw], [raw[:2], [], raw[2:]], [[b""]], []):
        table = pa.chunked_array([pa.array(c, pa.binary()) for c in chunks], pa.binary())
        columns, lengths = quality._flat(table)
        flat = [x for c in chunks for x in c]
        assert columns.dtype == np.int32 and columns.tobytes() == b"".join(flat)
        assert lengths.tolist() == [len(x) // 4 for x in flat]
    sliced = pa.chunked_array([pa.array(raw, pa.binary()).slice(1, 4)])
    assert quality._flat(sliced)[0].tobytes() == b"".join(raw[1:5])
