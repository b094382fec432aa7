from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict, limit: float = 3.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > limit * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            full.add(s)
            left -= target[s]


def check(rows, docs):
    sizes = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    by_source = Counter()
    for d in docs:
        by_source[d.source] += sizes[d.doc_id]
    targets = brute_targets(dict(by_source))
    taken = Counter()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    return {s: (taken[s], targets[s]) for s in targets}


def test_words_come_near_the_targets(spark, middle_dir):
    rows = queries.op2_mix_sources(spark, middle_dir).collect()
    docs = spark.read.parquet(f"{middle_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for s, (taken, target) in check(rows, docs).items():
        assert abs(taken - target) <= max(100, 0.02 * target), s


def test_reruns_and_other_partitions_agree(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    one, two = (sorted(map(tuple, mixing.mix(d, node=16).select("doc_id", "copies").collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_many_nodes_keep_the_sum(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 2) END AS source", "repeat('w ', cast(1 + id % 7 AS int)) AS text")
    rows = mixing.mix(docs, node=32).collect()
    for taken, target in check(rows, docs.collect()).values():
        assert abs(taken - target) <= 8


def test_long_texts_beside_a_hot_source_are_made_up_for(spark):
    """Sources of one node and of several, each with one very long text; other words come one text at a time."""
    docs = spark.range(5300).selectExpr("id AS doc_id", "CASE WHEN id < 5000 THEN 'hot' WHEN id < 5200 THEN 'small' ELSE 'third' END AS source", "repeat('w ', CASE WHEN id IN (17, 5100) THEN 5001 ELSE cast(11 + id % 40 AS int) END) AS text")
    for seed in range(4):
        for taken, target in check(mixing.mix(docs, seed=seed).collect(), docs.collect()).values():
            assert abs(taken - target) <= 51


def test_edge_cases(edge_docs):
    rows = mixing.mix(edge_docs).collect()
    check(rows, edge_docs.collect())
    assert {r.doc_id for r in rows} == set(range(1, 12)) and all(r.copies == 0 for r in rows if r.size == 0)


def test_no_rows(no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.take_mix(no_docs).columns == no_docs.columns


def test_take_mix_repeats_rows(edge_docs):
    copies = {r.doc_id: r.copies for r in mixing.mix(edge_docs).collect()}
    got = Counter(r.doc_id for r in mixing.take_mix(edge_docs).collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_all_texts_empty(spark):
    rows = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in rows)


def test_pivot_keeps_the_sum_and_is_fair():
    rng = np.random.default_rng(1)
    p0, size = np.array([0.3, 0.8, 0.5, 0.1, 0.65]), np.array([5.0, 2.0, 9.0, 4.0, 3.0])
    mean = np.zeros(5)
    for _ in range(4000):
        p = p0.copy()
        left = mixing.pivot(p, size, rng.random(5))
        assert (p @ size) == pytest.approx(p0 @ size) and all(p[i] in (0.0, 1.0) for i in range(5) if i != left)
        mean += p / 4000
    assert np.abs(mean - p0).max() < 0.03


def test_rows_of_one_id_are_taken_by_their_texts(spark):
    rows = [(1, "a " * 50, "x"), (1, "", "x"), (1, "b " * 7, "y"), (None, "c " * 9, "y"), (None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect()}
    got = [(r.doc_id, len((r.text or "").split())) for r in mixing.take_mix(docs).collect()]
    assert sorted(got, key=str) == sorted([k for k, n in taken.items() for _ in range(n)], key=str) and (1, 0) not in got


def test_many_rows_without_an_id_are_dealt_to_many_nodes(spark, monkeypatch):
    """All ids are null, texts differ: no node gets more than some twice its share, and the source comes near its target."""
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('w', id, repeat(' x', CAST(id % 9 AS INT))) AS text", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    largest = []
    real = mixing._level

    def seen(rows, *args):
        largest.append(max(r["count"] for r in rows.groupBy("source", "node").count().collect()))
        return real(rows, *args)

    monkeypatch.setattr(mixing, "_level", seen)
    out = mixing.mix(docs)
    got = out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert largest and max(largest) <= 2.2 * mixing.NODE
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 for r in got) and out.count() == 100_000
