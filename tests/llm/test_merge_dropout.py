from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import merge_dropout as md
from gleaner.llm import queries

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def v():
    return md.vocabulary(PATH)


def slow_encode(v, text, doc_id, rate, seed=md.SEED, variants=md.VARIANTS):
    """Segment by segment, the agenda as a list that is searched anew for each merge."""
    segments = md._SEGMENT.findall(" " + text) if text else []
    own = md.mix64(np.array([(doc_id or 0) & (2**64 - 1)], np.uint64) + np.uint64(seed))
    out = []
    for place, segment in enumerate(segments):
        variant = int(md.mix64(np.array([place + 1], np.uint64) + own)[0] % np.uint64(variants)) if rate > 0 else 0
        key = md.segment_keys(md.codes_of([segment]), np.array([len(segment)]), np.array([variant]), seed)
        parts = [(int(v.char[ord(c)]), i, i + 1) for i, c in enumerate(segment)]
        while True:
            best = None
            for k in range(len(parts) - 1):
                (a, s, m), (b, _, e) = parts[k], parts[k + 1]
                to = v.merges.get(a << 22 | b)
                if to is None or (rate > 0 and bool(md.skipped(key, np.array([s]), np.array([m]), np.array([e]), rate)[0])):
                    continue
                if best is None or v.score[to] > v.score[best[1]]:
                    best = (k, to)
            if best is None:
                break
            k, to = best
            parts[k : k + 2] = [(to, parts[k][1], parts[k + 1][2])]
        out += v.spell(p[0] for p in parts)
    return out


TEXTS = ["The unbelievable thing", "  two  spaces\n\nlines \t tab", "ünïcödé 漢字 😀", "▁mark \\ and <s> </s> <0x41>", "a" * 130, "", " ", "x" * 60 + " ok", "é" * 50]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_same_ids_as_brute_force(spark, v, rate):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r.ids for r in md.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, rate=rate).collect()}
    assert got == {i: slow_encode(v, t, i, rate) for i, t in rows}


def test_rate_zero_is_the_library(spark, small_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in md.encode(docs, PATH, rate=0.0).collect()}
    same = [got[i] == model.encode(t) for i, t in text.items() if "\n" not in t and "  " not in t and t == t.strip()]
    assert len(same) == 0 or sum(same) / len(same) > 0.95


def test_dropout_varies_and_reruns_agree(spark):
    rows = spark.createDataFrame([(i, "international considerations " * 20) for i in range(20)], "doc_id long, text string")
    one, two = (sorted((r.doc_id, tuple(r.ids)) for r in md.encode(d, PATH, rate=0.3).collect()) for d in (rows, rows.repartition(5)))
    assert one == two and len({x[1] for x in one}) > 10
    assert len(one[0][1]) > len(md.encode(rows.limit(1), PATH, rate=0.0).first().ids)


def test_a_word_has_more_than_a_few_segmentations():
    """One word in 2,000 documents, and in copies of one document."""
    encoder = md.Encoder(PATH, 0.3)
    texts, one = ["internationalization"] * 2000, ["international considerations " * 20] * 3
    ids, counts = encoder.encode(texts, list(range(2000)))
    assert len({x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])}) > 50
    ids, counts = encoder.encode(one, [7] * 3, copies=[0, 1, 2])
    assert len({x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])}) == 3


def check(rows, docs):
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs, key=lambda r: r.doc_id), strict=True):
        assert r.lossless and r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_round_trip_of_all_documents(spark, middle_dir):
    rows = queries.op6_merge_dropout(spark, middle_dir).collect()
    check(rows, spark.read.parquet(f"{middle_dir}/documents.parquet").collect())
    assert set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"}


def test_edge_cases(edge_docs):
    rows = md.round_trip(edge_docs, PATH).collect()
    check(rows, edge_docs.collect())
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    apart = md.decode(md.encode(edge_docs, PATH), PATH).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in apart) == sorted((r.doc_id, tuple(r.ids)) for r in rows)
    check(apart, edge_docs.collect())


def test_null_id_and_no_rows(spark, no_docs):
    assert md.round_trip(spark.createDataFrame([(None, "some text")], "doc_id long, text string"), PATH).first().lossless
    assert md.round_trip(no_docs, PATH).count() == 0


def test_a_small_memory_gives_the_same_ids(v):
    texts = [f"word{i} and number {i * 7919}" for i in range(200)]
    wide, narrow = md.Encoder(PATH), md.Encoder(PATH, remembered=10)
    assert all((x == y).all() for x, y in zip(wide.encode(texts, list(range(200)), most=100), narrow.encode(texts, list(range(200)), most=100), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.sampled_from([0.0, 0.2, 1.0]))
def test_lossless_for_any_text(text, rate):
    text = text.encode("utf-8", "ignore").decode()
    encoder = md.Encoder(PATH, rate)
    ids, _ = encoder.encode([text], [3])
    assert encoder.v.decode(ids.tolist()).decode() == text
