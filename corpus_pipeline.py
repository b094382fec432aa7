"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, SentencePiece encoding.

Each stage takes the documents that the one before kept, written as Parquet and read again. All but the last return
the columns of documents; the mixing stage repeats a document as often as the mix takes it. Every row is decided by its id
and text together: texts that share an id, or have none, are documents of their own, and a row that is stored more than once leaves
the two dedup stages once. No rows give no rows, and columns beside those of documents pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, langid, merge_dropout, minhash, mixing
from gleaner.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or unlike every language learned, go; short ones are judged in more
    dimensions, so that a few n-grams are told from noise as surely as many."""
    known = docs.filter(langid.fold("doc_id", 4) != 2)
    return langid.keep_languages(docs, langid.fit(known), langid.fit_wide(known))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, spaces left out, the longest stays, then the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; documents without words or id stay."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives about its target of words; documents without words are never taken, others three times at most."""
    return mixing.take_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded_sha256, lossless. Each copy of a document is segmented on its own."""
    alike = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    numbered = docs.select("doc_id", "text", (F.row_number().over(alike) - 1).alias("copy"))
    return merge_dropout.round_trip(numbered, str(public_tokenizers.path("piece_bpe_32k.model")), copy_col="copy")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: The mix and the segmentation draw from seeded hashes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
