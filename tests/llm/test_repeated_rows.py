"""Rows that are stored twice have a defined result in every operator."""

from __future__ import annotations

from collections import Counter

import pytest
from test_suffix_dedup import brute as repeats

from gleaner.llm import chat, embedding_dedup, exact_dedup, langid, merge_dropout, minhash, mixing, quality, suffix_dedup

LONG = "a rather long text that goes on and on, number {}, with many words in it so that it has five of them in a row. " * 4


@pytest.fixture
def twice(spark):
    rows = [(i, LONG.format(*[i] * 4), "en", "a") for i in range(6)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string")


def test_documents(twice):
    ids = Counter({0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1})
    once = Counter(range(6))
    count = lambda df: Counter(r.doc_id for r in df.collect())
    assert count(exact_dedup.exact_dedup(twice)) == ids and count(exact_dedup.drop_exact_copies(twice)) == once
    assert count(minhash.near_dedup(twice)) == ids and count(minhash.drop_near_copies(twice)) == once
    assert count(langid.keep_languages(twice, langid.fit(twice), langid.fit_wide(twice))) == ids
    predicted = langid.predict(twice, langid.fit(twice)).collect()
    assert len(predicted) == 9 and len(set(predicted)) == 6
    assert count(mixing.mix(twice)) == ids
    assert set(mixing.take_mix(twice).collect()) <= set(twice.collect()) and max(count(mixing.take_mix(twice)).values()) <= 6
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    assert sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(twice).collect()) == repeats(rows)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)]
    got = sorted(map(tuple, embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_encoding_quality_and_chats(twice, spark):
    import public_tokenizers

    found = merge_dropout.round_trip(twice, str(public_tokenizers.path("piece_bpe_32k.model"))).select("doc_id", "ids_crc32").collect()
    assert len(found) == 9 and len(set(found)) == 6
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    scored = quality.classify(twice, labels).collect()
    assert len(scored) == 9 and len(set(scored)) == 6
    turns = spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(turns).first()
    assert row.formatted.count("<|im_start|>user") == 2 and not row.valid and row.first_bad_turn == 1


def test_one_id_with_different_texts(spark):
    import public_tokenizers

    rows = [(1, "first text of the id", "en", "a"), (1, "1 2 3", "en", "a"), (2, "first text of the id", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {(r.doc_id, r.text) for r in langid.keep_languages(docs, langid.fit(docs)).collect()} == {(1, rows[0][1]), (2, rows[2][1])}
    out = merge_dropout.round_trip(docs, str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    assert len(out) == 3 and all(r.lossless for r in out)
    assert len({r.score for r in quality.classify(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect()}) >= 1
