"""Near-duplicates of a statement among the statements before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.numbers import number_keys, number_tokens, plain_tokens
from gleaner.functions.text import jaccard, word_set

from gleaner.session import written

from .relational import running

#: Fixed values.
LIMIT = 0.85
NUMBER_OVERLAP = 0.8
NEIGHBOURS = 50


def profiles(statements: DataFrame, text_col: str, plain: bool = False) -> DataFrame:
    """statements with `_words` and `_numbers` in place of the text. Words are compared by 64-bit hashes."""
    tokens = plain_tokens(text_col) if plain else number_tokens(text_col)
    words = F.transform(word_set(text_col), lambda w: F.xxhash64(w))
    return statements.withColumns({"_words": words, "_numbers": number_keys(tokens)}).drop(text_col)


def duplicate(similarity, numbers_a, numbers_b):
    """Alike in words, and without numbers on both sides or with nearly the same numbers: variants of a task differ in them."""
    none = (F.size(numbers_a) == 0) & (F.size(numbers_b) == 0)
    return (similarity > LIMIT) & (none | (jaccard(numbers_a, numbers_b) >= NUMBER_OVERLAP))


def dedup_bounded(statements: DataFrame, group: str, id_col: str, text_col: str, neighbours: int = NEIGHBOURS, plain: bool = False, eligible: Column | None = None) -> DataFrame:
    """id, group, similarity, duplicate: each statement against the last `neighbours` eligible ones before it in its group, by id.

    The distance condition is an equality: eligible statements are numbered within their group and dealt into blocks of
    `neighbours`; each statement is joined with the block of the last one before it and the block before that. A block holds at most
    that many rows, whatever the size of the group.
    """
    fit = eligible if eligible is not None else F.lit(True)
    flagged = statements.select(group, id_col, text_col, F.coalesce(fit, F.lit(False)).alias("_fit"))
    made = written(profiles(flagged, text_col, plain), "profiles")  # once, for the ranges, the numbers and both sides of the pairs; texts are not moved
    rows = running(made, [group], [id_col], {"_e": F.when(F.col("_fit"), 1).otherwise(0)})
    before = F.col("_e") - F.when(F.col("_fit"), 1).otherwise(0)
    block = lambda c: F.floor((c - 1) / neighbours)
    mine = rows.select(group, id_col, before.alias("_before"), F.col("_words").alias("w"), F.col("_numbers").alias("x"), F.explode(F.array(block(before), block(before) - 1)).alias("block"))
    prior = rows.filter("_fit").select(F.col(group).alias("_g"), F.col("_e").alias("_n"), F.col("_words").alias("_w"), F.col("_numbers").alias("_x"), block(F.col("_e")).alias("_block"))
    near = (F.col("_before") - F.col("_n")).between(0, neighbours - 1)
    pairs = mine.join(prior, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_block")) & near)
    similarity = jaccard(F.col("w"), F.col("_w"))
    found = pairs.select(id_col, similarity.alias("s"), duplicate(similarity, F.col("x"), F.col("_x")).alias("d"))
    best = found.groupBy(id_col).agg(F.max("s").alias("s"), F.max("d").alias("d"))
    return rows.select(group, id_col).join(best, id_col, "left").select(id_col, group, F.round(F.coalesce("s", F.lit(0.0)), 6).alias("similarity"), F.coalesce("d", F.lit(False)).alias("duplicate"))
