from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import queries, toxicity
from gleaner.llm.common import span_hashes, utf8


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@lru_cache(None)
def slot(span, stem):
    h = int(span_hashes(np.frombuffer(span, np.uint8), np.array([0]), np.array([len(span)]))[0])
    return ((h ^ (0x9E3779B97F4A7C15 if stem else 0)) >> 44) % toxicity.SLOTS


@lru_cache(None)
def word_slots(word):
    return [slot(word, False), *(slot(word[:k], True) for k in toxicity.STEMS if len(word) > k)]


def brute_marks(text):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    return Counter(s for w in words for s in word_slots(w)), len(words)


@pytest.mark.parametrize("texts", [["", "Stupid, STUPID fool!", "réeuxment"], ["a", "", "b c"], [""], ["x" * 3000 + " y", "é", "12 34"], ["ab", "cd"]])
def test_marks(texts):
    text, offsets = utf8(toxicity.lower(pa.array(texts)))
    rows, slots, words = toxicity.marks(text, offsets)
    for k, t in enumerate(texts):
        want, n = brute_marks(t)
        assert Counter(slots[rows == k].tolist()) == want and words[k] == n


def test_whole_table_against_brute_force(spark, small_dir):
    """Samples, chosen marks, training step by step on dense rows, and every score."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect() if fold(r.doc_id, 5) != 0}
    prior = np.mean(list(labels.values()))
    found = {i: brute_marks(t) for i, t in docs.items()}
    positive = sorted(i for i, y in labels.items() if y == 1)
    rest = sorted(i for i in docs if fold(i, 5) != 0)
    n, m = len(positive), len(rest)
    p, u = (Counter(s for i in ids for s in found[i][0]) for ids in (positive, rest))

    def distance(s):
        both = (p[s] + u[s] + 1) / (n + m + 2)
        return abs(p[s] / n - u[s] / m) / math.sqrt(both * (1 - both) * (1 / n + 1 / m))

    ranked = sorted({*p, *u}, key=lambda s: (-distance(s), s))
    model = toxicity.fit(spark.read.parquet(f"{small_dir}/documents.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    slots = model.slots.tolist()
    assert abs(model.prior - prior) < 1e-12 and len(slots) == toxicity.MARKS
    assert np.allclose(sorted(map(distance, slots)), sorted(distance(s) for s in ranked[: len(slots)]))  # ties aside, the same marks
    dense = {i: np.array([100 * c[s] / (k + toxicity.SMOOTH) for s in slots]) for i, (c, k) in found.items()}
    weights = [brute_train(np.array([dense[i] for i in positive]), np.array([dense[i] for i in rest]), prior, seed) for seed in (1, 2, 3)]
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, small_dir).collect()}
    assert set(rows) == set(docs)
    for i, x in dense.items():
        want = np.mean([1 / (1 + math.exp(-(x @ w[:-1] + w[-1]))) for w in weights])
        assert abs(rows[i].score - want) < 1e-3 and rows[i].held_out == (fold(i, 5) == 0) and rows[i].predicted == (rows[i].score >= 0.5)


def brute_train(p, u, prior, seed, epochs=60, batches=8, rate=0.05, decay=1e-3):
    """The risk's gradient by its definition, row by row, with the intercept as a column of ones."""
    rng = np.random.default_rng(seed)
    p, u = (np.c_[x, np.ones(len(x))] for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = math.log(prior / (1 - prior))
    a, b, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        shares = [np.array_split(rng.permutation(k), min(batches, len(p), len(u))) for k in (len(p), len(u))]
        for i, j in zip(*shares, strict=True):
            plus = lambda x: [1 / (1 + math.exp(-v)) for v in x @ w]
            soft = lambda x: [math.log1p(math.exp(v)) for v in x @ w]
            clean_grad = sum(s * x for s, x in zip(plus(u[j]), u[j], strict=True)) / len(j) - prior * sum(s * x for s, x in zip(plus(p[i]), p[i], strict=True)) / len(i)
            toxic_grad = -prior * sum((1 - s) * x for s, x in zip(plus(p[i]), p[i], strict=True)) / len(i)
            clean = sum(soft(u[j])) / len(j) - prior * sum(soft(p[i])) / len(i)
            g = -clean_grad if clean < 0 else clean_grad + toxic_grad
            g = g + decay * np.r_[w[:-1], 0]
            step += 1
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            w = w - rate * (1 - epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return w


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    test = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if fold(r.doc_id, 5) == 0]
    toxic, clean = ([s for s, y in test if y == k] for k in (1, 0))
    assert np.mean(np.array(toxic) >= 0.5) > 0.9 and np.mean(np.array(clean) >= 0.5) < 0.01
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_and_clean_labels_change_nothing(spark, small_dir, monkeypatch):
    from pyspark.sql import functions as F

    one = sorted(map(tuple, queries.op12_toxicity(spark, small_dir).collect()))
    real = queries.table

    def flipped(s, d, name):
        out = real(s, d, name)
        return out.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))) if name == "labels" else out

    monkeypatch.setattr(queries, "table", flipped)
    assert sorted(map(tuple, queries.op12_toxicity(spark, small_dir).collect())) == one


def test_risk_stays_non_negative():
    """Unlabelled texts are half toxic; the prior-corrected risk finds the boundary, the uncorrected one would call all unlabelled clean."""
    rng = np.random.default_rng(3)
    row = lambda toxic: ([0, 1], [1.0, rng.normal()]) if toxic else ([1, 2], [rng.normal(), 1.0])
    p = [row(True) for _ in range(100)]
    truth = rng.random(400) < 0.5
    u = [row(t) for t in truth]
    w = toxicity.train(toxicity.Sparse.of(*zip(*p, strict=True)), toxicity.Sparse.of(*zip(*u, strict=True)), 0.5, 3, 1)
    score = toxicity.sigmoid(toxicity.Sparse.of(*zip(*u, strict=True)).dot(w) + w[-1])
    assert ((score >= 0.5) == truth).mean() > 0.97
    assert np.isfinite(w).all() and np.abs(w).max() < 50


def test_edge_cases(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (7, 1), (10, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(edge_docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1, 12)) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3] == by[5]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(edge_docs, none).collect()} == {0.5}
    assert toxicity.classify(no_docs, none).count() == 0 and toxicity.classify(no_docs, labels).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "foul words here"), (1, "foul words here"), (None, "kind words"), (None, "foul foul foul"), (2, "kind words there")], "doc_id long, text string")
    rows = toxicity.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), prior=0.4).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None", "None"]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
