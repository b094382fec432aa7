from __future__ import annotations

import hashlib
import re

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import exact_dedup, queries

SPACES = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[SPACES.sub("", t or "")]
        keep = min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(SPACES.sub("", t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_same_rows_as_sql(spark, middle_dir):
    assert oracle.check(spark, middle_dir, queries.op1_exact_dedup, queries.ORACLE_SQL["op1_exact_dedup"]) == 1000


def test_edge_cases(edge_docs):
    got = sorted(map(tuple, exact_dedup.exact_dedup(edge_docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(5, "a b"), (3, "a b"), (None, "ab"), (4, "ab "), (9, "q"), (9, "q"), (None, "z")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    from collections import Counter

    rows = [(1, "a b"), (1, "ab"), (1, "other"), (2, "ab"), (3, "q"), (3, "q"), (None, "z"), (None, "z"), (None, "y"), (4, "y")]
    left = exact_dedup.drop_exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, left.collect())) == Counter([(1, "a b"), (1, "other"), (3, "q"), (None, "z"), (4, "y")])


@pytest.mark.parametrize("bits", [1, 2])
def test_filters_of_many_partitions_meet_in_a_tree(spark, bits):
    from pyspark.sql import functions as F

    rows = spark.range(0, 3000, numPartitions=13).select(F.xxhash64(F.col("id") % 1700).alias("_fp"))
    got = sorted(map(tuple, exact_dedup.repeated_fingerprints(rows, bits).collect()))
    want = rows.groupBy("_fp").count().filter("count > 1")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 1300


def test_no_rows(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs).columns == no_docs.columns


def test_drop_keeps_all_columns(edge_docs):
    left = exact_dedup.drop_exact_copies(edge_docs)
    assert left.columns == edge_docs.columns
    assert {r.doc_id for r in left.collect()} == {4, 5, 6, 7, 8, 9, 10, 11}


def test_a_group_with_most_rows(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN repeat('same text ', 3) ELSE cast(id AS string) END AS text")
    got = exact_dedup.exact_dedup(rows).collect()
    assert sum(r.group_size == 2000 and r.keep_id == 1 for r in got) == 2000 and sum(r.kept for r in got) == 1001


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 5)), max_size=60), st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 5)), max_size=60), st.integers(0, 3))
def test_filters_merge_without_loss(a, b, prefix):
    def entries(pairs, top):
        found = sorted({f >> prefix | top << (64 - prefix) if prefix else f: c for f, c in pairs}.items())
        return np.array([f for f, _ in found], np.uint64), np.array([c for _, c in found], np.int64)

    top = (1 << prefix) - 1
    x, y = entries(a, top), entries(b, top)
    filters = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.build(*e, prefix).to_bytes()) for e in (x, y)]
    got = exact_dedup.CountingQuotientFilter.merge(filters, top).entries(top)
    want = exact_dedup.add_up(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))
    assert all((p == q).all() for p, q in zip(got, want, strict=True))


def test_equal_fingerprints_are_told_apart_by_all_bytes(spark, monkeypatch):
    rows = [(1, "a"), (2, "b"), (3, "b"), (4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: F.lit(7).cast("long"))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_filter_keeps_counts(n):
    found = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    counts = np.arange(1, len(found) + 1)
    got = exact_dedup.CountingQuotientFilter.build(found, counts, 0).entries(0)
    assert (got[0] == found).all() and (got[1] == counts).all()
