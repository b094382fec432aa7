from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import quality, queries
from gleaner.llm.common import span_hashes, utf8


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    test = [(rows[r.doc_id].score, r.quality) for r in labels if fold(r.doc_id, 3) == 1]
    assert all(rows[r.doc_id].held_out == (fold(r.doc_id, 3) == 1) for r in labels)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = np.mean([(s >= 0.5) == (y == 1) for s, y in test])
    assert right > max(0.9, np.mean([y for _, y in test]))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_held_out_labels_change_nothing(spark, small_dir, monkeypatch):
    from pyspark.sql import functions as F

    one = sorted(map(tuple, queries.op9_quality(spark, small_dir).collect()))
    real = queries.table

    def flipped(s, d, name):
        out = real(s, d, name)
        return out.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality"))) if name == "labels" else out

    monkeypatch.setattr(queries, "table", flipped)
    assert sorted(map(tuple, queries.op9_quality(spark, small_dir).collect())) == one


def brute_kind(byte):
    c = chr(byte)
    if byte >= 128:
        return "wide"
    if c in " \t\n\x0b\x0c\r":
        return "space"
    if byte < 32 or byte == 127:
        return "control"
    if c.isalpha():
        return "upper" if c.isupper() else "lower"
    if c.isdigit():
        return "digit"
    return {"!": "exclaim", "|": "pipe"}.get(c, "stop" if c in ".,;:'\"-?()" else "symbol")


@lru_cache(None)
def brute_bucket(word):
    """A word's bucket; hashed once for each different word, which are far fewer than words times buckets."""
    return int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]) % quality.BUCKETS


@lru_cache(None)
def brute_marked(word):
    return any(brute_kind(b) in ("symbol", "exclaim", "pipe", "digit") for b in word)


def brute_features(text):
    """All FEATURES of a text by name, word by word."""
    raw = text.encode()
    words, lines = raw.split(), re.findall(rb"[^\n]*\n|[^\n]+", raw)
    used = Counter(raw)
    kinds = Counter()
    for byte, n in used.items():
        kinds[brute_kind(byte)] += n
    pairs = list(zip(words, words[1:], strict=False))
    share = lambda a, b: a / b if b else 0.0
    of_words = lambda test: share(sum(map(test, words)), len(words))
    shown = len(raw) - kinds["space"]
    out = {k: share(kinds[k], shown) for k in ("digit", "stop", "symbol", "exclaim", "pipe", "wide", "control")}
    dealt = Counter(map(brute_bucket, words))
    out |= {f"words_{k}": share(dealt[k], len(words)) for k in range(quality.BUCKETS)}
    return out | {
        "bytes": math.log1p(len(raw)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines)), "word_len": share(shown, len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)), "line_len": math.log1p(share(len(raw), len(lines))),
        "upper": share(kinds["upper"], kinds["upper"] + kinds["lower"]), "capital_words": of_words(lambda w: brute_kind(w[0]) == "upper"),
        "marked_words": of_words(brute_marked), "short_words": of_words(lambda w: len(w) <= 2),
        "same_words": share(len(words) - len(set(words)), len(words)), "same_lines": share(len(lines) - len(set(lines)), len(lines)),
        "same_pairs": share(len(pairs) - len(set(pairs)), len(pairs)), "top_word": share(max(Counter(words).values(), default=0), len(words)),
        "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in used.values()), "packed": share(len(zlib.compress(raw, 1)), len(raw)),
    }


@pytest.mark.parametrize("texts", [["a b a b", "", "one", "x  y\nx  y\n"], ["", ""], ["A! é|1 " * 50, "\n\n", "q" * 1000, "a b", "(\x01\x7f) $5\n\n$5"]])
def test_features(texts):
    x = quality.features(*utf8(pa.array(texts)))
    want = [[brute_features(t)[f] for f in quality.FEATURES] for t in texts]
    assert np.allclose(x, want)


def brute_tree(g, h):
    """Leaf values of the best cut, and of the best cut of each side."""
    gain = lambda a, b: a * a / (b + 1.0)

    def best(a, b):
        found, at = 1e-9, None
        for cut in range(a + 1, b):
            left, right = (sum(g[a:cut]), sum(h[a:cut])), (sum(g[cut:b]), sum(h[cut:b]))
            if left[1] >= 1 and right[1] >= 1:
                worth = gain(*left) + gain(*right) - gain(left[0] + right[0], left[1] + right[1])
                if worth > found + 1e-12:
                    found, at = worth, cut
        return at

    edges = [0, len(g)]
    for _ in range(2):
        edges = sorted({*edges, *(best(a, b) for a, b in zip(edges, edges[1:], strict=False))} - {None})
    return [(a, b, sum(g[a:b]) / (sum(h[a:b]) + 1.0)) for a, b in zip(edges, edges[1:], strict=False)]


def brute_scores(x, y, everything, rounds=60, pair_rounds=20, n_pairs=8, rate=0.1):
    """Scores of `everything` by boosting all rows' sums step by step, without lookup tables."""
    n, width = x.shape
    rows = np.concatenate([x, everything])
    bins = lambda k: [np.searchsorted(np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])), rows[:, f], "right") for f in range(width)]
    fine, rough = bins(32), bins(8)
    start = (y.sum() + 0.5) / (n + 1.0)
    total = np.full(len(rows), math.log(start / (1 - start)))

    def sums(at, size, pick=None):
        p = 1 / (1 + np.exp(-total[:n]))
        g, h = [0.0] * size, [0.0] * size
        for i in range(n) if pick is None else np.flatnonzero(pick[:n]).tolist():
            g[at[i]] += y[i] - p[i]
            h[at[i]] += p[i] * (1 - p[i])
        return g, h

    for _ in range(rounds):
        for at in fine:
            for a, b, value in brute_tree(*sums(at, int(at.max()) + 1)):
                total[(at >= a) & (at < b)] += rate * value

    def pair_gain(f, k):
        worth = lambda at: sum(a * a / (b + 1.0) for a, b in zip(*sums(at, int(at.max()) + 1), strict=True))
        return worth(rough[f] * 8 + rough[k]) - worth(rough[f]) - worth(rough[k])

    pairs = sorted(combinations(range(width), 2), key=lambda p: -pair_gain(*p))[:n_pairs]
    for _ in range(pair_rounds):
        for f, k in pairs:
            steps = np.zeros(len(rows))
            for a, b, _ in brute_tree(*sums(rough[f], 8)):
                leaf = (rough[f] >= a) & (rough[f] < b)
                for c, d, value in brute_tree(*sums(rough[k], 8, leaf)):
                    steps[leaf & (rough[k] >= c) & (rough[k] < d)] = rate * value
            total += steps
    return 1 / (1 + np.exp(-total[n:]))


def test_whole_table_against_brute_force(spark, middle_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{middle_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    want = np.array([[brute_features(docs[i])[f] for f in quality.FEATURES] for i in ids])
    found = {r.doc_id: r.x for r in quality.feature_rows(spark.read.parquet(f"{middle_dir}/documents.parquet")).collect()}
    x = np.array([found[i] for i in ids], np.float32)
    assert np.allclose(x, want, rtol=1e-5, atol=1e-6)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{middle_dir}/labels.parquet").collect() if r.quality is not None and fold(r.doc_id, 3) != 1}
    train = [k for k, i in enumerate(ids) if i in labels]
    scores = brute_scores(x[train], np.array([labels[ids[k]] for k in train], float), x)
    rows = {r.doc_id: r.score for r in queries.op9_quality(spark, middle_dir).collect()}
    assert np.allclose([rows[i] for i in ids], scores, atol=1e-6)


def test_edge_cases(edge_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (7, 1), (10, None), (None, 1), (999, 0)], "doc_id long, quality int")
    rows = quality.classify(edge_docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1, 12)) and all(0 <= r.score <= 1 for r in rows)


def test_no_labels_and_no_rows(edge_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(edge_docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).count() == 0


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)  # an interaction only
    model = quality.fit(x, y)
    assert (0, 3) in model.pairs and ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95
    total = model.intercept + sum(t[np.searchsorted(c, x[:, f], "right")] for f, (t, c) in enumerate(zip(model.tables, model.cuts, strict=True)))
    total = total + sum(t[np.searchsorted(model.coarse[f], x[:, f], "right"), np.searchsorted(model.coarse[g], x[:, g], "right")] for (f, g), t in model.pairs.items())
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))
