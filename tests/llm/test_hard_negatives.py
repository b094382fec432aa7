from __future__ import annotations

import math

import numpy as np
import oracle
import pytest

from gleaner.llm import hard_negatives as hn
from gleaner.llm import queries


def brute(rows, anchor, positives=5, negatives=5, low=80, scale=256):
    """rows: (vec_id, label, vector). All results by comparing every anchor with every row."""
    by_id = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(scale * float(c)) for c in v]
        while x and x[-1] == 0:
            x.pop()
        kind = (label, np.array(x, "<i8").tobytes(), x)
        by_id[i] = min(by_id.get(i, kind), kind, key=lambda k: k[:2])
    out = set()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    for a in filter(anchor, by_id):
        scored = sorted((-dot(by_id[a][2], by_id[b][2]), b) for b in by_id if b != a)
        own = [(-s, b) for s, b in scored if by_id[b][0] == by_id[a][0]][:positives]
        for s, p in own:
            hard = [(-t, b) for t, b in scored if by_id[b][0] != by_id[a][0] and low * s <= -100 * t <= 100 * s][:negatives]
            out |= {(a, p, k + 1, b, s, t) for k, (t, b) in enumerate(hard)}
    return out


def found(rows, spark, anchor=None, **options):
    frame = spark.createDataFrame([(*r, 1, "x", [0.5]) for r in rows], "vec_id long, label int, embedding array<double>, rank int, raw string, far array<double>")
    out = hn.hard_negatives(frame, anchor, **options).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_same_rows_as_sql(spark, sf_dir):
    assert oracle.check(spark, sf_dir, queries.op11_hard_negatives, queries.ORACLE_SQL["op11_hard_negatives"]) > 0


@pytest.mark.parametrize("block, part", [(7, 3), (40, 1000), (4096, 8192)])
def test_blocks_of_any_size_against_brute_force(spark, block, part):
    """Small integers give many ties of score; a third of all rows is one vector, in several labels."""
    rng = np.random.default_rng(block)
    rows = [(i, int(rng.integers(0, 3)), [1.0, 1.0, 0.0] if i % 3 == 0 else [float(v) for v in rng.integers(-2, 4, 3)]) for i in range(150)]
    from pyspark.sql import functions as F

    got = found(rows, spark, F.col("vec_id") % 5 == 0, scale=1, block=block, part=part, pivots=5)
    assert got == brute(rows, lambda i: i % 5 == 0, scale=1) and got


def test_real_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(i, i % 4, [float(v) for v in centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)]) for i in range(300)]
    got = found(rows, spark, block=16, part=50, pivots=4)
    assert got == brute(rows, lambda i: True) and len(got) > 300


def test_nulls_repeats_and_odd_vectors(spark):
    rows = [
        (1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.5]), (3, 1, [1.0, 2.2]), (3, 1, [1.0, 2.2]), (4, None, [1.0, 2.0]), (5, 1, None), (6, 1, [1.0, None]), (7, 1, [math.nan, 1.0]), (8, 1, [math.inf, 1.0]),
        (None, 1, [1.0, 2.3]), (9, 1, []), (10, 1, [2.1]), (11, 0, [1.0, 2.0]), (11, 2, [5.0, 5.0]), (12, 2, [-1.0, -1.0]), (13, 0, [0.0, 0.0]), (14, 1, [0.0]), (15, 2, [1.0, 2.0, 0.0, 0.0]),
    ]
    assert found(rows, spark) == brute(rows, lambda i: True)
    assert found([*rows, (20, 0, [1e30, 0.0])], spark) == brute(rows, lambda i: True)


@pytest.mark.parametrize("rows", [[], [(1, 0, [1.0])], [(1, 0, [1.0]), (2, 0, [1.0])], [(1, 0, [1.0]), (2, 1, [1.0])], [(1, None, None)]])
def test_nothing_to_mine(spark, rows):
    assert found(rows, spark) == set()


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    y, q = rng.integers(-300, 300, (200, 6)), rng.integers(-300, 300, (20, 6))
    most = float((y * y).sum(1).max())
    full, asked = hn.augmented(y, most), np.c_[q.astype(float), np.zeros(len(q))]
    assert np.allclose((full**2).sum(1), most)
    pivots = hn.choose_pivots(full, 5)
    dy, dq = hn.distances(full, pivots), hn.distances(asked, pivots)
    near, far = np.abs(dq[:, None] - dy).max(2), (dq[:, None] + dy).min(2)
    whole = (q * q).sum(1)[:, None] + most
    score = q @ y.T
    assert ((whole - far**2) / 2 - 1e-3 <= score).all() and (score <= (whole - near**2) / 2 + 1e-3).all()


def test_large_products_are_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 1], [1, 1]])
    assert hn.products(a, b, float(1 << 61)).tolist() == [[(1 << 60) + 3, (1 << 30) + 3]]
