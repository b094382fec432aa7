from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import queries, suffix_dedup


def brute(rows, length=200):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        starts = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r)[:5] for r in suffix_dedup.remove_repeats(docs, **options).collect()), key=str)


def test_same_rows_as_brute_force(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op7_suffix_dedup(spark, small_dir).collect()), key=str) == brute(rows)


def pieces(seed, n=60):
    """Texts of shared passages of all lengths around the bound, cut and joined at odd places, and with small changes."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefgh ij\n"))
    passages = ["".join(rng.choice(letters, int(k))) for k in rng.integers(150, 420, 12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            p = passages[int(rng.integers(0, 12))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            parts += [p[a:b] if rng.random() < 0.5 else p, "".join(rng.choice(letters, int(rng.integers(0, 60))))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("group", [4096, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, group):
    """group 2: all anchors with more than two contexts are split in cells, down to single strings."""
    rows = pieces(seed)
    want = brute(rows)
    assert sum(r[2] for r in want) > 2000 and any(0 < r[2] < r[1] for r in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), group=group) == want


def test_a_frequent_anchor(spark):
    """One passage in many surroundings; its anchors have more contexts than a group may have."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgh ij"))
    passage = "".join(rng.choice(letters, 260))
    rows = [(i, "".join(rng.choice(letters, 90)) + passage[int(rng.integers(0, 40)) :] + "".join(rng.choice(letters, 90))) for i in range(150)]
    want = brute(rows)
    assert all(r[2] >= 200 for r in want)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), group=20) == want


def test_rows_with_one_id_or_none(spark):
    """Each row is cut by its own text; a passage counts wherever it is."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh ij"), n))
    one, two, three = word(300), word(300), word(300)
    rows = [(1, word(70) + one + word(50)), (1, word(90) + two), (2, two + word(20)), (3, word(10) + one), (None, word(60) + three + word(30)), (4, word(80) + three), (1, word(500)), (None, word(500))]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) == 6
    for group in (4096, 2):
        assert got(spark.createDataFrame(rows, "doc_id long, text string"), group=group) == want


def morse(n):
    """The pattern of a and b for which polynomial hashes modulo 2 ** 64 are equal to those of its complement."""
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_patterns_that_polynomial_hashes_confuse(spark):
    turned = str.maketrans("ab", "ba")
    rows = [(i, f"{i:05d}" * 30 + (t if i % 2 else t.translate(turned)) + f"{i:07d}" * 30) for i, t in enumerate(morse(n) for n in (64, 64, 128, 128, 256, 256, 1024, 1024))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_periodic_texts(spark):
    rows = [(1, "a" * 199), (2, "a" * 200), (3, "b" * 201), (4, "ab" * 150), (5, "abc" * 90 + "x" + "abc" * 90), (6, "q" * 1000), (7, None), (8, "")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edge_cases(edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert got(edge_docs) == brute(rows)


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_kept_bytes(spark):
    rows = [(1, "x" + "p" * 3 + "q" * 400), (2, "unique")]
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: b"xppp", 2: b"unique"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    array = suffix_dedup.suffix_array(text)
    assert array == sorted(range(len(text)), key=lambda i: text[i:])
    common = suffix_dedup.common_prefixes(text, array)
    for a, b in zip(array, array[1:], strict=False):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert common[b] == n
