from __future__ import annotations

import math

import numpy as np
import pytest

from gleaner.llm import queries, whitening


def brute(rows, components=32):
    """{(vec_id, component): (deviation, whitened, explained)} of (vec_id, vector) rows, and n."""
    rows = [(i, v) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(rows), x.sum(0)
    centred = np.array([[float(v) for v in r] for r in (x * n - s)]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    w = centred @ vectors[:, order] / np.sqrt(values[order])
    dev = ((x * n - s) ** 2).sum(1)
    return {(i, k + 1): (int(dev[r]), w[r, k], values[order[k]] / values.sum()) for r, (i, _) in enumerate(rows) for k in range(len(order))}, n


def same(found, want, n):
    assert {(r.vec_id, r.component) for r in found} == set(want) and len(found) == len(want)
    signs = {}
    for r in found:
        dev, w, share = want[r.vec_id, r.component]
        if abs(w) > 0.1:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert r.deviation == dev and r.n == n and abs(abs(r.whitened) - abs(w)) < 1e-6 and abs(r.explained - share) <= 1e-8 * share
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-8


def test_whole_table_against_brute_force(spark, middle_dir):
    want, n = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{middle_dir}/embeddings.parquet").collect()])
    same(queries.op13_whitening(spark, middle_dir).collect(), want, n)


def test_nulls_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3) * (5, 3, 1)]) for i in range(40)]
    rows += [rows[3], (100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 7, "z") for i, v in rows] + [(104, [], 0, ""), (105, [1.0], 0, ""), (106, [1e30, 0.0, 0.0], 0, "")], "vec_id long, embedding array<double>, x int, w string")
    found = whitening.whiten(frame).collect()
    want, n = brute(rows)
    assert n == 41 and sum(r.vec_id == 3 for r in found) == 6
    same([r for r in found if r.vec_id != 3], {k: v for k, v in want.items() if k[0] != 3}, 41)


def test_triangle_in_several_aggregations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    frame = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double, e double")
    for most in (4, 100):
        assert np.allclose(whitening.triangle(frame, list("abcde"), most), x.T @ x)


def test_one_aggregation_has_every_pair(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    seen = []
    real = type(rows).agg
    try:
        type(rows).agg = lambda self, *a: seen.append(len(a)) or real(self, *a)
        whitening.fit(whitening.whole_entries(rows))
    finally:
        type(rows).agg = real
    assert 64 * 65 // 2 in seen


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_flat_dimensions_are_left_out(spark):
    rows = [(i, [float(i), 3.0, float(i) * 2]) for i in range(10)]  # rank 1
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1} and len(found) == 10 and found[0].identity_error < 1e-9


def test_deviation_is_exact_or_null():
    model = whitening.Whitener(3, [10**18, 0], np.zeros((2, 0)), np.zeros(0))
    assert model.deviation(np.array([[333_333_333_333_333_333, 0], [10**18, 0]])) == [1, None]
    small = whitening.Whitener(2, [3, 5], np.zeros((2, 0)), np.zeros(0))
    assert small.deviation(np.array([[1, 3], [2, 2]])) == [2, 2]
