from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import components, minhash, queries

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute(rows, threshold=0.8):
    sets, by_words = {}, {}
    for i, t in rows:
        words = WORD.findall((t or "").encode())
        if words and i is not None:
            runs = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
            sets[i] = frozenset((x, k) for x, n in runs.items() for k in range(n))  # as often as the text has it
            by_words.setdefault(tuple(words), []).append(i)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, n in common.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    copy = {i: min(g) for g in by_words.values() for i in g}
    return sorted(((i, copy.get(i, i), root(i) if i in sets else i, i is None or i not in sets or root(i) == i) for i, _ in rows), key=str)


def test_same_classes_as_brute_force(spark, middle_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{middle_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op5_minhash_dedup(spark, middle_dir).collect()), key=str) == brute(rows)


def test_weights_count(spark):
    """Texts with the same runs of words, as often or far more often."""
    line = "the same line of eight words again and "
    rows = [(1, line * 20 + "end one"), (2, line * 21 + "end two"), (3, line * 60 + "end"), (4, line * 3), (5, line * 61)]
    want = brute(rows)
    assert [r[2] for r in want] == [1, 1, 3, 4, 3]
    assert sorted(map(tuple, minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_that_polynomial_hashes_confuse(spark, n):
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, " ".join([word] * 3)), (4, " ".join([other] * 3)), (5, word + "\t")]
    assert sorted(map(tuple, minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, alone, other = base + " end", " ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(30))
    rows = [(1, base), (5, near), (5, alone), (7, other), (7, other), (1, base), (9, "")] + [(9, "")] * 2
    left = minhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, left.collect())) == Counter([(1, base), (5, alone), (7, other), (9, "")])
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 1): 2, (5, 1): 1, (5, 5): 1, (7, 7): 2, (9, 9): 3})


def chains(n, seed):
    """Texts in which each is like the ones before and after it, and most pairs of a chain are not alike."""
    rng = np.random.default_rng(seed)
    rows, words = [], [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    for i in range(n):
        if i % 15 == 0:
            words = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
        words = list(words)
        at = int(rng.integers(0, 118))
        words[at : at + 2] = [f"w{k}" for k in rng.integers(0, 10**6, 2)]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_chains_are_one_class(spark, block):
    rows = chains(150, 1)
    want = brute(rows)
    assert 10 <= len({r[2] for r in want}) < 60
    assert sorted(map(tuple, minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()), key=str) == want


def test_edge_cases(edge_docs):
    got = sorted(map(tuple, minhash.near_dedup(edge_docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    left = minhash.drop_near_copies(edge_docs)
    assert left.columns == edge_docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in got if r[3]}


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    assert sorted(map(tuple, minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_no_rows(no_docs):
    assert minhash.near_dedup(no_docs).count() == 0 and minhash.drop_near_copies(no_docs).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.random(60) * 3, rng.random(60) * 3
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = np.repeat([0, 1], 60)
    s = minhash.signatures(rows, np.r_[elements, elements], np.r_[a, b], 2, 4000)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_weights_of_any_size_are_sampled_alike():
    """One heavy element beside light ones: the share of its darts is its share of the weight."""
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 101).astype(np.uint64)
    weights = np.r_[300.0, np.ones(100)]
    both = minhash.signatures(np.repeat([0, 1], [101, 100]), np.r_[elements, elements[1:]], np.r_[weights, weights[1:]], 2, 4000)
    assert abs((both[0] == both[1]).mean() - 100 / 400) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 105), (105, 101), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()))
    assert all(got[i] == i - i % 10 for i in range(40)) and got[101] == got[105] == got[100] == 100


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
