"""BM25 over impact-ordered postings with upper bounds, so that most postings of a query's hot terms never leave their tasks.

A posting's gain (idf and all) does not depend on the query. The index keeps it with a band, its share of the term's greatest gain in steps. Postings stay in the task
that read their chunk, sorted by term and falling band, so a band is a block whose members gain at most its bound. A query runs in four steps:

1. The best bands of each term give partial scores; the chunks of the best of them are scored whole. The k-th best of those scores is one that the result has at
   least (the threshold).
2. The terms of the least bounds whose bounds add up to less than the threshold can't lift a chunk into the result by themselves. Candidates come from the other,
   essential terms, and of those only from postings which together with the bounds of all other terms reach the threshold.
3. These postings, each once for all queries, are dealt by chunk over as many tasks as their hits take, and added up there. A candidate whose found gains and the
   bounds of the rest don't reach the threshold goes.
4. The others are scored whole. They are written first, so Spark knows their size and sends them to the postings if they are few, and shuffles both sides if not;
   a candidate is joined with its chunk's postings, not with its query's terms, so it is moved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import words
from gleaner.session import written

from .relational import dealt
from .retrieval import K1, B, ranked

BANDS = 32
#: So many times k chunks of the best partial scores are scored whole for the threshold.
PROBES = 4
#: Scores are ranked after rounding to 6 places, so bounds give way by this much.
ROOM = 2e-6


def impact_index(index: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings, bounds) of a term index (id, term, tf, len), of whose rows without term only the length counts: id, term, gain, band, sorted by term and falling
    band within the tasks that read the index; and term, most (its greatest gain) and held (postings by band, best first)."""
    lengths = index.groupBy(id_col).agg(F.first("len").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    placed = index.filter(F.col("term").isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")  # one row
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a term's greatest gain is that of its greatest share, with room for another order of products
    terms = placed.groupBy("term").agg(F.count("*").alias("df"), F.max("n").alias("n"), F.max(share).alias("share"))
    terms = written(terms.select("term", idf.alias("idf"), (idf * F.col("share") * (1 + 1e-12)).alias("most")), "terms")  # its size decides the join
    gains = placed.join(terms, "term").select("term", id_col, (F.col("idf") * share).alias("gain"), "most")
    banded = gains.withColumn("band", F.least(F.floor(F.col("gain") / F.col("most") * BANDS), F.lit(BANDS - 1)).cast("int"))
    postings = written(banded.drop("most").sortWithinPartitions("term", F.desc("band")), "impacts")
    held = postings.groupBy("term", "band").agg(F.count("*").alias("n"))
    held = held.groupBy("term").agg(F.reverse(F.sort_array(F.collect_list(F.struct("band", "n")))).alias("held"))
    return postings, written(held.join(terms.select("term", "most"), "term").select("term", "most", "held"), "bounds")


def top_k(postings: DataFrame, bounds: DataFrame, queries: DataFrame, id_col: str, query_id: str, query_col: str, k: int = 8, trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """query, id, score, rank of the k best chunks, exactly those of a full BM25. trace gets the postings that each step moves."""
    asked = queries.select(query_id, F.explode(F.array_distinct(words(query_col))).alias("term")).distinct().join(bounds, "term")
    # the best bands of a term until they hold k postings
    upto = F.aggregate("held", F.struct(F.lit(0).cast("long").alias("n"), F.lit(BANDS).alias("band")), lambda at, x: F.when(at["n"] >= k, at).otherwise(F.struct((at["n"] + x["n"]).alias("n"), x["band"].alias("band"))))
    asked = written(asked.select(query_id, "term", "most", upto["band"].alias("seed")), "asked")

    def whole(pairs: DataFrame) -> DataFrame:
        """The postings of pairs of a query and a chunk."""
        return postings.join(pairs, id_col).join(asked.select(query_id, "term"), [query_id, "term"], "left_semi")

    def kth(scores: DataFrame, n: int) -> DataFrame:
        return scores.withColumn("r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score")))).filter(F.col("r") <= n)

    seeds = postings.join(asked, "term").filter(F.col("band") >= F.col("seed"))
    partial = seeds.groupBy(query_id, id_col).agg(F.sum("gain").alias("score"))
    probes = written(kth(partial, PROBES * k).select(query_id, id_col), "probes")
    best = kth(whole(probes).groupBy(query_id, id_col).agg(F.sum("gain").alias("score")), k).filter(F.col("r") == k)
    threshold = best.select(query_id, (F.col("score") - ROOM).alias("least"))
    order = Window.partitionBy(query_id).orderBy("most", "term")
    every = Window.partitionBy(query_id)
    # upto: bounds of this term and all of lesser bounds; a term is essential if they reach the threshold
    terms = asked.join(threshold, query_id, "left").withColumns({"least": F.coalesce("least", F.lit(0.0)), "upto": F.sum("most").over(order), "all": F.sum("most").over(every)})
    terms = terms.withColumn("essential", F.col("upto") >= F.col("least"))
    rest = F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(every)
    # from: the least band that reaches the threshold with the bounds of all other terms
    reach = lambda band: (band + 1) / F.lit(BANDS) * F.col("most") + F.col("all") - F.col("most") >= F.col("least")
    least_band = F.get(F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), reach), 0)
    terms = terms.withColumns({"rest": rest, "from": least_band}).filter("essential AND from IS NOT NULL")
    essential = written(terms.select(query_id, "term", "least", "rest", "from"), "essential")
    count = F.aggregate(F.filter("held", lambda x: x["band"] >= F.col("from")), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    hits = essential.join(bounds, "term").agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    picked = postings.join(essential.groupBy("term").agg(F.min("from").alias("_from")), "term").filter(F.col("band") >= F.col("_from")).drop("_from")
    first = dealt(picked, [id_col], hits, 2_000_000).join(essential, "term").filter(F.col("band") >= F.col("from"))
    found = first.groupBy(query_id, id_col).agg(F.sum("gain").alias("found"), F.max("least").alias("least"), F.max("rest").alias("rest"))
    candidates = written(found.filter(F.col("found") + F.col("rest") >= F.col("least") - ROOM).select(query_id, id_col), "candidates")
    # all their terms; of essential ones the postings below the bound belong to no candidate that can win, but count for those that do
    second = whole(candidates)
    scored = second.groupBy(query_id, id_col).agg(F.round(F.sum("gain"), 6).alias("score"))
    if trace is not None:
        trace |= {"seeds": seeds, "first": first, "candidates": candidates, "second": second}
    return ranked(scored, [query_id], k, F.col("score").desc(), F.col(id_col))
