from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from test_exact_dedup import brute as exact
from test_minhash import brute as near

from gleaner.llm import langid


def test_stages_one_after_another(spark, small_dir):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    languages = corpus_pipeline.language_id(spark, docs, small_dir)
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in languages.collect()}
    assert languages.columns == columns and set(kept) == {i for i, t in before.items() if t and len(langid.grams(t))}
    once = corpus_pipeline.exact_copies(spark, languages, small_dir)
    left = {r.doc_id: r.text for r in once.collect()}
    assert once.columns == columns and set(left) == {r[0] for r in exact(list(kept.items())) if r[3]}
    unlike = corpus_pipeline.near_copies(spark, once, small_dir)
    ids = {r.doc_id for r in unlike.collect()}
    assert unlike.columns == columns and ids == {r[0] for r in near(list(left.items())) if r[3]}
    mixed = corpus_pipeline.mix_sources(spark, unlike, small_dir)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= ids and max(copies.values()) <= 3
    out = corpus_pipeline.sentencepiece(spark, mixed, small_dir).collect()
    assert Counter(r.doc_id for r in out) == copies
    assert all(r.lossless and r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in out)


def test_run_is_repeatable(spark, small_dir):
    one, two = (sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, small_dir).collect()) for _ in range(2))
    assert one == two and len(one) > 100


def test_edge_cases(spark, edge_docs, no_docs, small_dir):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small_dir)
            assert docs.columns == edge_docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mix_sources", "sentencepiece"]
