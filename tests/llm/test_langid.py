from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pytest

from gleaner.llm import langid, queries


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len(rows) == len(docs) and all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    right = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out and d.lang and any(c.isalpha() for c in d.text)]
    assert len(right) > 2000 and np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def brute_bundle(text, bound):
    """The direction of the sum of the n-gram vectors of a text, letter by letter; None without a letter."""
    letters = [ord(c) if unicodedata.category(c)[0] == "L" else 0 for c in text.lower()]
    codes = [0]
    for code in letters + [0]:
        if code or codes[-1]:
            codes.append(code)
    if not any(codes):
        return None
    total = np.zeros(langid.DIMENSIONS)
    for at in range(len(codes) - 2):
        key = tuple(codes[at : at + 3])
        if key not in bound:
            a, b, c = (langid.letter(k, langid.DIMENSIONS).astype(float) for k in key)
            bound[key] = a * np.roll(b, 1) * np.roll(c, 2)
        total += bound[key]
    return total / np.linalg.norm(total)


def test_whole_table_against_brute_force(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    bound, sums, vectors = {}, {}, {}
    for d in docs:
        vectors[d.doc_id] = v = brute_bundle(d.text or "", bound)
        if v is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2:
            sums[d.lang] = sums.get(d.lang, 0) + v
    rows = {r.doc_id: r for r in queries.op10_language_id(spark, small_dir).collect()}
    assert set(rows) == set(vectors)
    for i, v in vectors.items():
        if v is None:
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        cosines = {k: float(v @ s / np.linalg.norm(s)) for k, s in sums.items()}
        best = max(cosines.values())
        assert abs(rows[i].score - min(max(best, 0), 1)) < 1e-4 and cosines[rows[i].lang_pred] > best - 1e-5


def test_bundles_are_sums_of_bound_letters():
    text = "Ab, cÄ"
    want = np.zeros(langid.DIMENSIONS)
    codes = [0, *map(ord, "ab"), 0, *map(ord, "cä"), 0]
    for i in range(len(codes) - 2):
        v = np.ones(langid.DIMENSIONS)
        for place in range(3):
            v = v * np.roll(langid.letter(codes[i + place], langid.DIMENSIONS), place)
        want += v
    assert np.allclose(langid.bundles([text])[0], want)
    assert np.allclose(langid.bundles(["", text, "12 !", text], most=1)[[1, 3]], [want, want])


def test_a_long_text_counts_as_a_whole():
    long = "lorem ipsum dolor sit amet " * 3000
    once = langid.bundles(["lorem ipsum dolor sit amet lorem ipsum dolor sit amet"])[0] - langid.bundles(["lorem ipsum dolor sit amet"])[0]
    assert np.allclose(langid.bundles([long])[0], 2999 * once + langid.bundles(["lorem ipsum dolor sit amet"])[0])


def test_edge_cases(edge_docs, no_docs):
    prototypes = langid.fit(edge_docs)
    assert set(prototypes) == {"en", "de"}
    rows = {r.doc_id: r for r in langid.predict(edge_docs, prototypes).collect()}
    assert set(rows) == set(range(1, 12))
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {2, 3, 5, 10} and all(rows[i].score == 0 for i in (2, 3, 5, 10))
    assert langid.predict(no_docs, prototypes).count() == 0
    left = langid.keep_languages(edge_docs, prototypes)
    assert left.columns == edge_docs.columns and {r.doc_id for r in left.collect()} == {1, 4, 6, 7, 8, 9, 11}


def test_unlearned_scripts_go_and_clean_short_texts_stay(spark, middle_dir):
    rng = np.random.default_rng(3)
    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "abcdefghijklmnopqrstuvwxyz"]
    unlike = []
    for letters in scripts:
        words = ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(2, 10, 400)]
        unlike += [" ".join(words[min(int(k), 399)] for k in rng.exponential(40, int(n))) for n in rng.integers(30, 300, 50)]
    docs = spark.read.parquet(f"{middle_dir}/documents.parquet")
    prototypes = langid.fit(docs.filter(langid.fold("doc_id", 4) != 2))
    wide = langid.fit_wide(docs.filter(langid.fold("doc_id", 4) != 2))
    made = spark.createDataFrame(list(enumerate(unlike)), "doc_id long, text string")
    assert langid.keep_languages(made, prototypes, wide).count() <= 0.03 * len(unlike)
    short = spark.createDataFrame([(1, "For reanha of ndnt."), (2, "É la qui. Est èoiç."), (3, "Laosllboas osarosll. Se. Oses el el.")], "doc_id long, text string")
    assert langid.keep_languages(short, prototypes, wide).count() == 3
    clean = {d.doc_id for d in docs.collect() if d.text and len(langid.grams(d.text))}
    assert {r.doc_id for r in langid.keep_languages(docs, prototypes, wide).collect()} == clean


def test_error_rates_by_length(spark, middle_dir):
    """Texts of a few words, as many of a learned language as of two scripts that are not: nearly all of the one stay, of the others hardly any."""
    rng = np.random.default_rng(4)
    docs = spark.read.parquet(f"{middle_dir}/documents.parquet")
    known = docs.filter(langid.fold("doc_id", 4) != 2)
    prototypes, wide = langid.fit(known), langid.fit_wide(known)
    words = [r.text.split() for r in docs.filter("lang IS NOT NULL AND length(text) > 400").limit(300).collect()]
    rows = []
    for n in (1, 2, 4, 8, 16, 32):
        for w in words:
            at = int(rng.integers(0, len(w) - n))
            rows.append((f"clean{n}", " ".join(w[at : at + n])))
            for letters in ("бвгджзклмнпрстаеиоу", "αβγδεζηθικλμνξοπρστ"):
                rows.append((f"unlike{n}", " ".join("".join(rng.choice(list(letters), int(k))) for k in rng.integers(2, 9, n))))
    made = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, kind string")
    kept = {r.kind: r["count"] for r in langid.keep_languages(made, prototypes, wide).groupBy("kind").count().collect()}
    for n, least in ((1, 0.85), (2, 0.95), (4, 0.98), (8, 0.98), (16, 0.99), (32, 0.99)):
        assert kept[f"clean{n}"] >= least * len(words) and kept.get(f"unlike{n}", 0) <= 0.01 * 2 * len(words)


def test_wide_prototypes_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "ab ba", "x"), (2, "abab", "x"), (3, "cd", "y"), (4, None, "y"), (5, "no lang", None)], "doc_id long, text string, lang string")
    unit = lambda v: v / np.linalg.norm(v)
    one = lambda t: unit(sum(langid.bound(int(c), langid.WIDE).astype(float) for c in langid.grams(t)))
    found = langid.fit_wide(docs)
    assert np.allclose(found["x"], unit(one("ab ba") + one("abab")), atol=1e-6) and np.allclose(found["y"], one("cd"), atol=1e-6) and set(found) == {"x", "y"}


def test_nothing_to_learn_from(spark, no_docs):
    assert langid.fit(no_docs) == {}
    rows = langid.predict(spark.createDataFrame([(1, "text"), (None, None)], "doc_id long, text string"), {}).collect()
    assert {r.lang_pred for r in rows} == {"und"}


def test_a_bounded_fit_uses_a_share(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'the quick brown fox' ELSE 'der schnelle braune fuchs' END AS text", "CASE WHEN id % 2 = 0 THEN 'en' ELSE 'de' END AS lang")
    prototypes = langid.fit(docs, most=200)
    assert {r.lang_pred for r in langid.predict(docs.filter("doc_id % 2 = 0"), prototypes).collect()} == {"en"}


@pytest.mark.parametrize("text", ["", "123 !?", "١٢"])
def test_no_letters(text):
    assert len(langid.grams(text)) == 0
