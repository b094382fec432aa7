from __future__ import annotations

import math

import numpy as np

from gleaner.llm import embedding_dedup, queries


def brute(rows, threshold=0.98):
    ok = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    ids = sorted(ok)
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if label[i] == label[j] and len(ok[i]) == len(ok[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    out = []
    for r in rows:
        c = root(r[0]) if r[0] in ok else r[0]
        out.append((r[0], links.get(r[0], 0), c, r[0] is None or c == r[0]))
    return sorted(out, key=str)


def test_same_rows_as_brute_force(spark, small_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op4_embedding_dedup(spark, small_dir).collect()), key=str) == brute(rows)


def clustered(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, width))
    return [(i, [float(x) for x in centres[i % len(centres)] + rng.normal(size=width) * 0.12 * rng.random()], int(i % 2)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_many_lists_and_blocks_lose_no_link(spark):
    rows = clustered(600, 3)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=16, list_size=32)
    want = brute(rows)
    assert sum(r[1] for r in want) > 500
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_floats_move_as_floats(spark):
    rows = [(i, [float(np.float32(x)) for x in v] + [0.5] * (i % 3 == 0), n) for i, v, n in clustered(200, 9)] + [(900, None, 1), (901, [], 1), (902, [float("nan")] * 12, 1), (903, [3e38] * 12, 1), (904, [1e-45] * 12, 1)]
    vectors = spark.createDataFrame(rows, SCHEMA.replace("double", "float"))
    assert embedding_dedup.float_kind(vectors) == "<f4"
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(vectors, block=16, list_size=32).collect()), key=str) == brute([tuple(r) for r in vectors.collect()])


def test_lists_grow_with_the_classes(spark, monkeypatch):
    sizes = [embedding_dedup.lists_for(n, 4096) for n in (0, 1, 50_000, 4 << 20, 100_000_000, 10**9, 10**11)]
    assert sizes == [1, 1, 8, 1024, 8192, 16384, 262144]
    monkeypatch.setattr(embedding_dedup, "slices", lambda n, centres: [slice(i, min(i + 7, n)) for i in range(0, n, 7)])
    rows = clustered(300, 8)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, SCHEMA), block=16, list_size=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_small_fit_loses_no_link(spark):
    rows = clustered(400, 5)
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(spark.createDataFrame(rows, SCHEMA), fit_vectors=20, list_size=32).collect()), key=str) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1),
        (11, [2e-300, 0.0], 1), (12, [3e300, 1e299], 1), (13, [1.0, 0.0, 0.0], 1), (14, [-1.0, 0.0], 1), (None, [1.0, 0.0], 1), (15, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS rep", "'x' AS component", "'x' AS links", "'x' AS raw", "'x' AS known")
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(df).collect()), key=str) == brute(rows)


def test_no_rows(spark):
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_vector_that_a_third_of_all_rows_repeat(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "CASE WHEN id % 3 = 0 THEN array(1d, 2d) ELSE array(cast(id AS double), -cast(id * id AS double)) END AS embedding", "1 AS label")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert all(got[i].n_links == 999 and got[i].component_id == 0 for i in range(0, 3000, 3))
