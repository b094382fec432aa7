"""Ranking by positions, segments and pruned BM25."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import duckdb
import pytest

from gleaner.operators import impacts, ranking, retrieval, segments
from gleaner.plans import ORACLE_SQL, QUERIES

WORDS = "ab cd ef gh ij kl mn op".split()


def texts(seed, n, longest=12):
    rng = random.Random(seed)
    return {i: " ".join(rng.choices(WORDS, [1, 2, 3, 5, 8, 13, 21, 34], k=rng.randint(0, longest))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id long, text string")


def brute_gain(classes):
    weights = [ranking.CLASS_WEIGHTS[c] for c in classes]
    best = max(range(len(weights)), key=lambda j: (weights[j], -j))
    total = weights[best] + sum(w / (j + 1) ** 2 for j, w in enumerate(weights) if j != best)
    return total / ranking.ALL_SQUARES


@pytest.mark.parametrize("classes", ["A", "D", "DDD", "DAD", "DBBA", "CCCCCCCC"])
def test_gain_of_places(spark, classes):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([([(i, c) for i, c in enumerate(classes)],)], "p array<struct<pos:int,class:string>>").select(ranking.place_gain(F.col("p"))).first()[0]
    assert got == pytest.approx(brute_gain(classes), rel=1e-12)


def test_rank_by_places_against_brute_force(spark):
    docs = {i: (t.split()[:2], t.split()[2:]) for i, t in texts(1, 60).items()}
    rows = spark.createDataFrame([(i, " ".join(h), " ".join(b)) for i, (h, b) in docs.items()] + [(99, None, None)], "id long, h string, b string")
    index = ranking.positional_postings(rows, "id", {"h": "A", "b": "D"})
    queries = {"q1": "ab cd zz", "q2": "op op", "q3": "", "q4": "zz"}
    got = ranking.rank_by_places(index, spark.createDataFrame(list(queries.items()), "q string, t string"), "id", "q", "t", 5).collect()
    want = set()
    for q, said in queries.items():
        terms = set(said.split())
        score = {i: round(sum(brute_gain("A" * h.count(t) + "D" * b.count(t)) for t in terms if t in h + b) / len(terms), 6) for i, (h, b) in docs.items() if terms & {*h, *b}}
        want |= {(q, i, s, k + 1) for k, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])}
    assert {(r.q, r.id, round(r.score, 6), r.rank) for r in got} == want


def test_stemmed_index_counts_terms_of_a_stem_together(spark):
    docs = frame(spark, {1: "вагон вагоны вагона", 2: "вагоны вода", 3: ""})
    dictionary = ranking.stem_dictionary(docs, "text")
    got = {(r.id, r.term): r.tf for r in ranking.stemmed_index(retrieval.postings(docs, "id", "text"), dictionary, "id").collect()}
    assert got == {(1, "вагон"): 3, (2, "вагон"): 1, (2, "вод"): 1}
    places = ranking.positional_postings(docs, "id", {"text": "D"}, dictionary).collect()
    assert {(r.id, r.term): [p.pos for p in r.places] for r in places} == {(1, "вагон"): [0, 1, 2], (2, "вагон"): [0], (2, "вод"): [1]}


def state(index):
    postings = {(r.id, r.term): (r.tf, r.len) for r in index.postings().collect()}
    total = index.totals().first()
    return postings, {r.term: r.df for r in index.frequencies().collect()}, (total.n, total.avg_len and round(total.avg_len, 9)), {r.id: r.len for r in index.chunks().collect()}


def rebuilt(docs):
    counts = {i: Counter(re.findall(r"\w+", t)) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in counts.items()}
    df = Counter(t for c in counts.values() for t in c)
    return {(i, t): (n, size[i]) for i, c in counts.items() for t, n in c.items()}, dict(df), (len(docs), round(sum(size.values()) / len(docs), 9) if docs else None), size


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_segments_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    index = segments.SegmentedIndex(spark, path)
    assert state(index) == ({}, {}, (0, None), {})
    docs = texts(2, 200)
    index.upsert(frame(spark, docs), "id", "text")
    assert state(index) == rebuilt(docs)
    before = files(path)
    change = {7: "ab ab new", 8: "", 500: "kl brand new"}
    index.upsert(frame(spark, change), "id", "text")
    docs |= change
    assert state(index) == rebuilt(docs)
    after = files(path)
    assert all(after[f] == t for f, t in before.items())  # nothing that was there is written again
    added = sum(os.path.getsize(f) for f in after if f not in before and "postings" in f and f.endswith(".parquet"))
    assert spark.read.parquet(f"{path}/{index.log[-1][1]}/postings").count() == 5 and added < 10_000
    index.delete(spark.createDataFrame([(8,), (9,), (12345,), (None,)], "id long"), "id")
    docs = {i: t for i, t in docs.items() if i not in (8, 9)}
    assert state(index) == rebuilt(docs)
    index.upsert(frame(spark, {9: "back again"}), "id", "text")
    docs[9] = "back again"
    assert state(index) == rebuilt(docs)
    again = segments.SegmentedIndex(spark, path)  # another reader finds the same
    assert state(again) == rebuilt(docs) and again.version == 4
    again.compact(2)
    assert len(again.log) == 2 and state(again) == rebuilt(docs)
    again.compact()
    assert len(again.log) == 1 and state(again) == rebuilt(docs)
    assert spark.read.parquet(f"{path}/{again.log[0][1]}/gone").count() == 0
    assert state(segments.SegmentedIndex(spark, path, 1)) == rebuilt(texts(2, 200))  # an older version


def test_a_segment_that_was_not_committed_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = segments.SegmentedIndex(spark, path)
    index.upsert(frame(spark, {1: "ab cd"}), "id", "text")

    def dies(self, listed):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(segments.SegmentedIndex, "_commit", dies)
        with pytest.raises(OSError):
            index.upsert(frame(spark, {1: "ef", 2: "gh"}), "id", "text")
    assert state(segments.SegmentedIndex(spark, path)) == rebuilt({1: "ab cd"})
    index = segments.SegmentedIndex(spark, path)
    index.upsert(frame(spark, {1: "ef", 2: "gh"}), "id", "text")
    assert state(index) == rebuilt({1: "ef", 2: "gh"})


def test_search_in_segments_reads_the_asked_terms(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"))
    docs = texts(3, 80)
    index.upsert(frame(spark, docs), "id", "text")
    index.delete(spark.createDataFrame([(0,)], "id long"), "id")
    got = {(r.id, r.term) for r in index.postings(spark.createDataFrame([("ab",), ("ab",)], "term string")).collect()}
    assert got == {(i, "ab") for i, t in docs.items() if "ab" in t.split() and i != 0}


@pytest.mark.parametrize("seed, k", [(4, 3), (5, 8), (6, 500)])
def test_pruned_bm25_is_bm25(spark, seed, k):
    """Hot and rare terms, ties and queries with few or no hits."""
    docs = texts(seed, 300, 30) | {1000 + i: f"rare{i % 7} op op kl" for i in range(40)}
    index = retrieval.postings(frame(spark, docs), "id", "text")
    queries = spark.createDataFrame([(1, "rare1 op kl"), (2, "op"), (3, "nothing here"), (4, "rare1 rare2 rare3 ab"), (5, ""), (6, "ab cd ef gh ij kl mn op")], "q int, t string")
    want = {tuple(r) for r in retrieval.bm25(index, queries, "id", "q", "t", k).collect()}
    got = {tuple(r) for r in impacts.top_k(*impacts.impact_index(index, "id"), queries, "id", "q", "t", k).collect()}
    assert got == want


def test_a_hot_term_stays_where_it_is(spark):
    """`op` is in all of 4,000 chunks; the query's other term decides, so few of its postings move."""
    docs = {i: "op " * (1 + i % 5) + "kl " * (i % 3) + ("rare" if i % 400 == 0 else f"w{i % 50}") for i in range(4000)}
    index = retrieval.postings(frame(spark, docs), "id", "text")
    queries = spark.createDataFrame([(1, "rare op")], "q int, t string")
    trace = {}
    got = {tuple(r) for r in impacts.top_k(*impacts.impact_index(index, "id"), queries, "id", "q", "t", 8, trace).collect()}
    assert got == {tuple(r) for r in retrieval.bm25(index, queries, "id", "q", "t", 8).collect()}
    moved = sum(trace[n].count() for n in ("first", "second"))
    whole = index.filter("term IN ('rare', 'op')").count()
    assert moved < whole / 50 and trace["candidates"].count() == 10
    assert whole == 4010


def test_terms_are_counted_in_their_rows_without_a_shuffle(spark):
    """Only the rows of ids that several rows have are shuffled; they count together."""
    docs = spark.createDataFrame([(1, "b a b"), (2, "c"), (3, ""), (4, None)], "id long, t string")
    twice = docs.unionByName(spark.createDataFrame([(2, "c d"), (None, "e"), (None, "e")], "id long, t string"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(retrieval.postings(docs, "id", "t")) and "Exchange" not in plan(ranking.positional_postings(docs, "id", {"t": "A"}))
    got = {(r.id, r.term): r.tf for r in retrieval.postings(twice, "id", "t").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (2, "c"): 2, (2, "d"): 1, (None, "e"): 2}
    places = {(r.id, r.term): [(p.pos, p["class"]) for p in r.places] for r in ranking.positional_postings(twice, "id", {"t": "A"}).collect()}
    assert places[1, "b"] == [(0, "A"), (2, "A")] and places[2, "c"] == [(0, "A"), (0, "A")] and places[None, "e"] == [(0, "A"), (0, "A")]


def test_weighted_rank_adds_up_and_ranks_sheets_where_they_are_dealt(spark):
    """Scores are not added up before the sheets are dealt by the number of hits; sheets that share an id count together."""
    sheets = spark.createDataFrame([(1, "oxide", "", "oxide of iron"), (2, "", "oxide", None), (2, "", "", "iron"), (3, "", "", "water")], "id int, title string, description string, text string")
    queries = spark.createDataFrame([("a", "iron oxide"), ("b", "water"), ("c", "none")], "item string, q string")
    out = retrieval.weighted_rank(sheets, queries, "item", "q", ("title", "description", "text"), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.item, r.id, r.score, r["rank"]) for r in out.collect()) == [("a", 1, 14, 1), ("a", 2, 5, 2), ("b", 3, 1, 1)]
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 2  # by sheet, then each task's best by query


def searched(spark, tmp_path, name, docs, items):
    """Rows of a search over tables of these documents and benchmark items, and those of its SQL."""
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = {(r.item_id, r.doc_id, round(r.score, 6), r["rank"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    return got, {(i, d, round(x, 6), k) for i, d, x, k in con.execute(ORACLE_SQL[name]).fetchall()}


def test_bm25_topk_searches_with_whole_texts(spark, tmp_path):
    """The word that decides is behind 200 characters; texts that share an id count together, and items that share one ask for a word once."""
    docs = [(1, "ab ab cd"), (2, "late cd cd"), (3, ""), (4, None), (5, "ef gh"), (5, "late ij kl mn op"), (6, "gh gh")]
    items = [(1, "ab " * 80 + "late"), (2, "gh"), (2, "gh cd"), (3, "")]
    got, want = searched(spark, tmp_path, "bm25_topk", docs, items)
    assert got == want and {d for i, d, *_ in got if i == 1} == {1, 2, 5}


def test_an_index_of_the_asked_terms_searches_as_the_whole_one(spark):
    docs = frame(spark, texts(7, 300, 30) | {1000: "only others", 1001: "", 5: "ab"}).unionByName(frame(spark, {3: "kl mn other"}))
    queries = spark.createDataFrame([(1, "ab kl"), (2, "op zz")], "q int, t string")
    whole = retrieval.postings(docs, "id", "text")
    asked = retrieval.postings(docs, "id", "text", asked=retrieval.asked_terms(queries, "t"))
    assert {r.term for r in asked.select("term").distinct().collect()} == {"ab", "kl", "op", None}
    assert asked.filter("term IS NULL").count() == whole.select("id").distinct().count()
    assert {tuple(r) for r in retrieval.bm25(asked, queries, "id", "q", "t").collect()} == {tuple(r) for r in retrieval.bm25(whole, queries, "id", "q", "t").collect()}


def shuffled(spark, run):
    """Rows that the stages of a run write for shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def records():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = records()
    run()
    return sum(n for s, n in records().items() if s not in before)


def test_pruned_bm25_moves_no_postings_that_nobody_asks_for(spark, tmp_path):
    """Of 12,000 postings 360 are of asked terms; texts that share an id count together, and items that share one ask for a word once."""
    docs = [(i, f"{'ab ' * (i % 4)}{'cd' if i % 3 else 'cd ef'} " + " ".join(f"w{i * j % 997}x{j}" for j in range(39))) for i in range(300)]
    docs += [(7, "late ab"), (1000, ""), (1001, None)]
    items = [(1, "ab ef"), (2, "ef"), (2, "ef late"), (3, ""), (4, "none")]
    out = []
    moved = shuffled(spark, lambda: out.extend(searched(spark, tmp_path, "bm25_pruned", docs, items)))
    assert out[0] == out[1] and len(out[0]) == 16
    assert moved < 6_000


def test_candidates_are_few_where_whole_scores_are_high(spark):
    """The best chunks are found by their rare term; what else they have of the query lifts the threshold over the bounds of all others together."""
    docs = {i: "rare t0 t1 t2" for i in range(8)} | {100 + i: f"t{i % 3} " * 6 + "o1 o2 o3 o4 o5 o6" for i in range(600)}
    index = retrieval.postings(frame(spark, docs), "id", "text")
    queries = spark.createDataFrame([(1, "rare t0 t1 t2")], "q int, t string")
    trace = {}
    got = {tuple(r) for r in impacts.top_k(*impacts.impact_index(index, "id"), queries, "id", "q", "t", 8, trace).collect()}
    assert got == {tuple(r) for r in retrieval.bm25(index, queries, "id", "q", "t", 8).collect()} and {d for _, d, *_ in got} == set(range(8))
    assert trace["candidates"].count() == 8 and trace["second"].count() == 8 * 4
