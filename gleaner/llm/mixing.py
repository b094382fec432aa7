"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the target of its source divided by the size of
its source. The whole part is certain. The fractions are rounded by the pivotal method: two documents trade
probability, measured in words so that the sum of words does not change, in a random direction and until one of them
is 0 or 1; the other goes on. A node of the reduction tree does this for at most about NODE documents of one source,
largest first, and hands the one document that is left to its parent, with settled ones of all sizes as spares. The
words that a source takes differ from its target by the rounding of the last document at the root alone; what that adds
or lacks is made up for, largest first, by other documents of the root, so small sources come near their targets too.

Nodes are buckets of a hash, so a source with a third of all rows has many of them; the depth of a source is the
logarithm of its own size to the base NODE, and a source that fits one node has its root there, whatever the others
have. Every level is one shuffle of the rows that go on: one and the spares for each node.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.relational import numbered

from .common import materialize, per_text, small_batches, text_blocks, text_key, word_starts

NODE = 2048
#: Settled documents that the children of a node hand to it, about; each child hands one at least.
SPARES = 512
WEIGHTS = (1, 2, 3)
LIMIT = 3

ROWS = "doc_id long, key long, source string, size long, source_size long, target double, base long, p double, node long, nodes long, up boolean"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key (see text_key), source and the number of runs of characters other than [\\x20\\x09-\\x0D]."""

    def each(batches):
        for batch in batches:
            counts = [per_text(word_starts(text, offsets)[0], offsets) for _, _, text, offsets in text_blocks(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))], ["doc_id", "key", "source", "size"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key("text"), F.col("source").cast("string"), F.col("text").cast("string"))
    return small_batches(rows).mapInArrow(each, "doc_id long, key long, source string, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """A row per source: source, source_size, n, target.

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating, and share the sum of all
    sizes. A target stops at limit times the size of its source; the excess is shared again by weight: the level of words per weight
    rises until no further source is full at it. Each rise is one sum over the sources, few of which are needed, as the level grows
    with each; the positions come from numbered(), so no task holds all sources, which may be hosts.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = numbered(totals.withColumn("none", F.col("source").isNull()), [], ["none", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    full = materialize(placed.select("source", "source_size", "n", weight.alias("w"), (F.col("source_size") * float(limit)).alias("room")), "sources")
    level, n_full = 0.0, -1
    while True:
        over = F.col("room") < F.col("w") * level
        left = F.sum("source_size") - F.coalesce(F.sum(F.when(over, F.col("room"))), F.lit(0.0))
        found = full.agg(left.alias("left"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count_if(over).alias("full")).first()
        if found["full"] == n_full or not found["w"]:
            return full.select("source", "source_size", "n", F.least(F.col("w") * level, F.col("room")).alias("target"))
        level, n_full = found["left"] / found["w"], found["full"]


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Rounds all of p in place but one, whose position is returned. sum(p * size) does not change."""
    open_ = 0
    for j in range(1, len(p)):
        i = open_
        into_i, into_j = min((1 - p[i]) * size[i], p[j] * size[j]), min(p[i] * size[i], (1 - p[j]) * size[j])
        if into_i + into_j <= 0:  # one of the two is settled already
            open_ = j if p[i] in (0.0, 1.0) else i
            continue
        if draws[j] * (into_i + into_j) < into_j:
            i_is_full = (1 - p[i]) * size[i] <= p[j] * size[j]
            p[i], p[j] = (1.0, max(0.0, p[j] - into_i / size[j])) if i_is_full else (min(1.0, p[i] + into_i / size[i]), 0.0)
            open_ = j if i_is_full else i
        else:
            i_is_empty = p[i] * size[i] <= (1 - p[j]) * size[j]
            p[i], p[j] = (0.0, min(1.0, p[j] + into_j / size[j])) if i_is_empty else (max(0.0, p[i] - into_j / size[i]), 1.0)
            open_ = j if i_is_empty else i
    return open_


def make_up(p: np.ndarray, size: np.ndarray, excess: float) -> None:
    """Turns settled p (0 or 1, largest size first) around in place while that brings the excess of words nearer to 0."""
    for j in range(len(p)):
        change = size[j] if p[j] == 0 else -size[j]
        if abs(excess + change) < abs(excess):
            p[j], excess = 1 - p[j], excess + change


def _level(rows: DataFrame, seed: int, depth: int, node: int) -> DataFrame:
    """Rounds each node; up is whether a row goes on to the parent, which a root has not."""

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].to_numpy(np.float64).copy(), pdf["size"].to_numpy(np.float64)
        first, nodes = pdf["doc_id"].iloc[0], int(pdf["nodes"].iloc[0])
        draws = np.random.default_rng([seed, depth, int(pdf["node"].iloc[0]), 0 if pd.isna(first) else int(first) & (2**63 - 1)]).random(len(p))
        left = pivot(p, size, draws)
        up = np.zeros(len(p), bool)
        if nodes == 1:
            asked = p[left]
            p[left] = float(asked >= 0.5)
            make_up(p, size, (p[left] - asked) * size[left])
        else:
            spares = max(1, SPARES // min(node, nodes))
            up[np.linspace(0, len(p) - 1, min(spares, len(p))).astype(np.int64)] = True
            up[[left, -1]] = True  # the shortest one comes nearest
        pdf["p"], pdf["up"] = p, up
        return pdf

    return rows.groupBy("source", "node").applyInPandas(rounded, ROWS)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 20, node: int = NODE) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies.

    docs has doc_id, text and source; other columns are ignored. Rows that repeat an id count each on its own. Null or blank text has size 0 and is never taken.
    A null source is a source of its own, the last one. taken is copies times size, and copies is at most limit.
    The same rows and the same seed give the same copies, whatever the partitions. An empty table gives no rows.
    """
    return _mixed(docs, weights, limit, seed, node).drop("key")


def _mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 20, node: int = NODE) -> DataFrame:
    """mix(), and the key of each text."""
    sized = materialize(sizes(docs), "sizes")
    shares = targets(sized, weights, limit)
    deepest = max(1, math.ceil((shares.agg(F.max("n")).first()[0] or 1) / node))
    shares = shares.select(F.col("source").alias("_source"), "source_size", "target", "n")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(shares, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", F.least(copies, F.lit(float(limit))))
    nodes = F.ceil(F.col("n") / F.lit(node)).cast("long")
    rows = rows.select(
        "doc_id", "key", "source", "size", "source_size", "target", F.floor("copies").cast("long").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("key"), F.lit(seed)), nodes).alias("node"), nodes.alias("nodes"),
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    done = [rows.filter(~open_).withColumn("p", F.lit(0.0)).withColumn("up", F.lit(False))]
    rows = rows.filter(open_).withColumn("up", F.lit(True))
    depth = 0
    while True:
        level = materialize(_level(rows, seed, depth, node), f"level{depth}")
        done.append(level.filter(~F.col("up")))
        if deepest == 1:
            break
        rows = level.filter("up").withColumn("node", F.floor(F.col("node") / F.lit(node)).cast("long")).withColumn("nodes", F.ceil(F.col("nodes") / F.lit(node)).cast("long"))
        deepest, depth = math.ceil(deepest / node), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    taken = F.col("base") + F.col("p").cast("long")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("copies"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, and with all columns. Rows that repeat an id are taken by their texts;
    those that repeat both, as often as the one that is taken most. No rows give no rows."""
    taken = _mixed(docs, **options).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.max("copies").cast("int").alias("copies"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key("text").alias("key"), F.struct("*").alias("row"))
    met = rows.join(taken, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
