"""Ranking by positions, and a stemmed index from a dictionary of terms.

A posting holds the places of a term in a chunk, each with the class of the field it stands in. What a posting adds to a rank does not depend on
the query, so it is computed when the index is built; a query is a join by terms and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.stem import stem_ru
from gleaner.functions.text import let, words
from gleaner.session import written

from .retrieval import by_single_id, ranked, runs

#: The weights of the classes of fields, and the sum of 1 / k ** 2 over all k.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
ALL_SQUARES = 1.64493406685


def positional_postings(chunks: DataFrame, id_col: str, fields: dict[str, str], dictionary: DataFrame | None = None) -> DataFrame:
    """id, term, places: for each term of a chunk its places, in order, as (pos, class).

    fields maps a column to its class, in the order in which they are read; positions go on from one to the next. With a dictionary
    (term, stem) terms are their stems. The fields of a chunk that are null have no words.
    """
    def read(c: str, kind: str) -> Column:
        return F.transform(words(c), lambda w: F.struct(w.alias("term"), F.lit(kind).alias("class")))

    found = F.concat(*[read(c, kind) for c, kind in fields.items()])
    single, several = (chunks, None) if dictionary is not None else by_single_id(chunks, id_col)
    if dictionary is None:  # a chunk's places are in its row
        places = F.transform(found, lambda t, i: F.struct(t["term"].alias("term"), i.alias("pos"), t["class"].alias("class")))
        one = lambda items, i, n: F.struct(F.get(items, i)["term"].alias("term"), F.transform(F.slice(items, i + 1, n), lambda x: F.struct(x["pos"].alias("pos"), x["class"].alias("class"))).alias("places"))
        out = single.select(id_col, F.explode(runs(F.sort_array(places), lambda x: x["term"], one)).alias("_x")).select(id_col, "_x.term", "_x.places")
        if several is None:
            return out
    rows = (chunks if several is None else several).select(id_col, F.posexplode(found).alias("pos", "_t")).select(id_col, "pos", "_t.term", "_t.class")
    if dictionary is not None:
        rows = rows.join(dictionary, "term").drop("term").withColumnRenamed("stem", "term")
    rest = rows.groupBy(id_col, "term").agg(F.sort_array(F.collect_list(F.struct("pos", "class"))).alias("places"))
    return rest if dictionary is not None else out.unionByName(rest)


def place_gain(places: Column) -> Column:
    """What a term's places add to a rank: the first place of the greatest weight counts whole, and place j of the others by
    its weight over j squared; the sum is at most 1 for one weight of 1."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_WEIGHTS.items() for x in pair])

    def gain(weights: Column) -> Column:
        whole = F.aggregate(F.transform(weights, lambda w, j: w / ((j + 1) * (j + 1))), F.lit(0.0), lambda a, x: a + x)
        most, first = F.array_max(weights), F.array_position(weights, F.array_max(weights))
        return (most + whole - most / (first * first)) / ALL_SQUARES

    return let(F.transform(places, lambda p: F.element_at(table, p["class"])), gain)


def rank_by_places(index: DataFrame, queries: DataFrame, id_col: str, query_id: str, query_col: str, k: int = 8, dictionary: DataFrame | None = None) -> DataFrame:
    """query, id, score, rank of the k best chunks: the gains of the query's terms, summed and divided by their number, found or not.

    Terms are or-ed. Scores are rounded to 6 places, ties go by id.
    """
    asked = queries.select(query_id, F.array_distinct(words(query_col)).alias("_t"))
    asked = asked.select(query_id, F.explode("_t").alias("term"))
    if dictionary is not None:
        asked = asked.select(query_id, stem_ru(F.col("term")).alias("term")).distinct()
    asked = written(asked, "asked")  # of a known size, so postings are picked where they are made
    sizes = asked.groupBy(query_id).agg(F.count("*").alias("n"))
    asked = written(asked.join(sizes, query_id), "terms")
    # of a hot term's postings only those that a query asks for leave their task
    hits = index.select(id_col, "term", place_gain(F.col("places")).alias("gain")).join(asked, "term")
    scored = hits.groupBy(query_id, id_col).agg(F.round(F.sum(F.col("gain") / F.col("n")), 6).alias("score"))
    return ranked(scored, [query_id], k, F.col("score").desc(), F.col(id_col))


def stem_dictionary(chunks: DataFrame, text_col: str) -> DataFrame:
    """term, stem: every different word of the texts, stemmed once. Words are made different within a row and a task before the shuffle."""
    return chunks.select(F.explode(F.array_distinct(words(text_col))).alias("term")).distinct().withColumn("stem", stem_ru(F.col("term")))


def stemmed_index(index: DataFrame, dictionary: DataFrame, id_col: str) -> DataFrame:
    """id, term (a stem), tf, len of a term index (id, term, tf, len): terms of one stem count together."""
    joined = index.join(dictionary, "term").drop("term").withColumnRenamed("stem", "term")
    return joined.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
