"""Hard-negative mining by a pivot table.

Scores are inner products. With one more component, sqrt(M - |y|^2) where M is the greatest squared norm, every vector gets the same
norm sqrt(M), and for a query q with 0 in that place |q - y|^2 = |q|^2 + M - 2 <q, y>: the highest scores are the least distances.
Every vector is stored with its distances to a few pivots. For each pivot p the triangle inequality brackets the unknown distance,
|d(q,p) - d(y,p)| <= d(q,y) <= d(q,p) + d(y,p), hence the score; only pairs whose bracket reaches into the wanted range are multiplied out.

Equal vectors of one label are one class with its smallest ids, as many as a result can take. Classes lie in blocks of one label and one
nearest pivot; a block keeps the range of its distances to each pivot, which brackets the scores of all its members at once. An
anchor first meets the blocks that promise most. What it finds there is the least that others have to beat, so it then meets only blocks
whose bracket goes beyond that. A task holds one block and a part of the anchors that go there, and returns a few rows for each anchor.
Pivots are taken farthest first from a sample of about FIT_VECTORS classes; they steer the work only, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
PIVOTS = 16
FIT_VECTORS = 2_000
BLOCK = 4096
#: Anchors of a task.
PART = 8192
#: Blocks that an anchor meets first.
FIRST = 2
#: Pairs that are bracketed at once in a task.
AT_ONCE = 1 << 20
#: Squared norms stay below this, so that every score fits a long.
MOST_NORM = float(1 << 62)
#: Brackets are wider by this share of |q|^2 + M, more than their rounding errors.
ROOM = 1e-9
#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (long), raw (longs floor(scale c) as bytes), norm (squared) of the rows that take part."""

    def each(batches):
        for batch in batches:
            raw, norms, keep = [], [], []
            for i, x in enumerate(batch.column(2)):
                v = None if not x.is_valid or x.values.null_count else np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if v is not None and np.isfinite(v).all() and float(v @ v) < MOST_NORM:
                    raw.append(np.trim_zeros(v.astype("<i8"), "b").tobytes())
                    norms.append(float(v @ v))
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(raw, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "label", "raw", "norm"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(each, "vec_id long, label long, raw binary, norm double")


def matrix(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width), np.int64)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, "<i8")
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole vectors whose squared norms are at most `most`."""
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < EXACT else a @ b.T


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of x, farthest first: each is the one that is farthest from those before; ties by place."""
    if not len(x):
        return x
    far, out = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(min(count, len(x))):
        k = int(far.argmax())
        if out and far[k] <= 0:
            break
        out.append(k)
        gap = ((x - x[k]) ** 2).sum(1)
        far = gap if len(out) == 1 else np.minimum(far, gap)
    return x[out]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def with_distances(rows: DataFrame, pivots: np.ndarray, width: int, most: float, query: bool = False) -> DataFrame:
    """rows (with raw) and `far`, the distances to the pivots; a query has 0 in the added place."""

    def each(batches):
        for batch in batches:
            x = matrix(batch.column("raw").to_pylist(), width)
            full = np.c_[x.astype(np.float64), np.zeros(len(x))] if query else augmented(x, most)
            far = distances(full, pivots)
            lists = pa.ListArray.from_arrays((np.arange(len(x) + 1) * far.shape[1]).astype(np.int32), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "far"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(each, f"{schema}, far array<double>")


def bounds(norm: Column, most: float, far: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The least and greatest score of a query with members of a block whose distances to each pivot are from low to high."""
    zero = F.lit(0.0)
    gap = lambda q, r: F.greatest(q - r["hi"], r["lo"] - q, zero)
    ranges = F.zip_with(low, high, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    nearest = F.coalesce(F.array_max(F.zip_with(far, ranges, gap)), zero)
    farthest = F.array_min(F.zip_with(far, high, lambda a, b: a + b))
    room = (norm + F.lit(most)) * F.lit(ROOM) + F.lit(1e-6)
    return F.when(farthest.isNull(), F.lit(-MOST_NORM)).otherwise((norm + most - farthest * farthest) / 2) - room, (norm + most - nearest * nearest) / 2 + room


def _best(score: np.ndarray, ids: list[np.ndarray], cols: np.ndarray, count: int, own: int) -> list[tuple[int, int]]:
    """The first `count` of (score, id), higher scores and smaller ids first, of the members of the columns; own is left out."""
    if len(cols) > count + 1:
        least = np.partition(score[cols], len(cols) - count - 1)[len(cols) - count - 1]
        cols = cols[score[cols] >= least]
    found = sorted((-int(score[c]), int(i)) for c in cols.tolist() for i in ids[c] if i != own)
    return [(-s, i) for s, i in found[:count]]


def _facing(width: int, most: float, count: int, ranged: bool):
    """For cogroups of a block's members and a part of the anchors: each anchor's best members, in all or within each positive's range."""

    def face(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            y, q = matrix(left.column("raw").to_pylist(), width), matrix(right.column("raw").to_pylist(), width)
            ids = [np.array(x, np.int64) for x in left.column("ids").to_pylist()]
            far_y, far_q = (np.stack(t.column("far").to_numpy(zero_copy_only=False)) for t in (left, right))
            norms, anchors = right.column("norm").to_numpy(), right.column("anchor").to_numpy()
            floor = right.column("least").to_pylist()  # what is to be beaten: of the anchor, or of each of its positives
            positives = right.column("positives").to_pylist() if ranged else None
            step = max(1, AT_ONCE // len(y))
            for a in range(0, len(q), step):
                part = slice(a, a + step)
                near, reach = np.zeros((len(q[part]), len(y))), np.full((len(q[part]), len(y)), np.inf)
                for p in range(far_y.shape[1]):
                    f, g = far_q[part, p, None], far_y[None, :, p]
                    np.maximum(near, np.abs(f - g), out=near)
                    np.minimum(reach, f + g, out=reach)
                whole = norms[part, None] + most
                room = ROOM * whole + 1e-6
                wanted = np.array([float(min(x)) for x in floor[part]])
                maybe = (whole - near * near) / 2 + room >= wanted[:, None]
                if ranged:
                    top = np.array([float(max(p["score"] for p in x)) for x in positives[part]])
                    maybe &= (whole - reach * reach) / 2 - room <= top[:, None]
                rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                if not len(rows):
                    continue
                score = products(q[part][rows], y[cols], most)
                members = [ids[c] for c in cols.tolist()]
                for k, r in enumerate(rows.tolist()):
                    i, here = a + r, np.flatnonzero(maybe[r, cols])
                    s = score[k]
                    if not ranged:
                        found = _best(s, members, here[s[here] >= floor[i][0]], count, int(anchors[i]))
                        out += [(int(anchors[i]), int(anchors[i]), v, j) for v, j in found]
                        continue
                    for p, least in zip(positives[i], floor[i], strict=True):
                        inside = here[(s[here] <= p["score"]) & (s[here] >= least)]
                        if len(inside):
                            out += [(int(anchors[i]), p["id"], v, j) for v, j in _best(s, members, inside, count, int(anchors[i]))]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "positive", "score", "id"), cols, strict=True)})

    return face


def _meet(pairs: DataFrame, members: DataFrame, anchors: DataFrame, facing) -> DataFrame:
    """pairs: anchor, part, block. The members of each block meet the anchors of each part that are paired with it."""
    asked = pairs.join(anchors, ["anchor", "part"])
    here = members.join(pairs.select(F.col("block").alias("met"), F.col("part").alias("by")).distinct(), F.col("block") == F.col("met"))
    return here.groupBy("met", "by").cogroup(asked.groupBy("block", "part")).applyInArrow(facing, "anchor long, positive long, score long, id long")


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _search(pairs: DataFrame, members: DataFrame, anchors: DataFrame, facing, count: int, name: str) -> DataFrame:
    """pairs: anchor, part, block, upper. The first `count` of each anchor and positive: first from the most promising blocks, then from
    the others that can still hold better ones. anchors has `least`, one for each of `keys`."""
    order = Window.partitionBy("anchor").orderBy(F.desc("upper"), "block")
    pairs = materialize(pairs.withColumn("turn", F.row_number().over(order)), f"{name}-pairs")
    one = materialize(_first(_meet(pairs.filter(F.col("turn") <= FIRST).select("anchor", "part", "block"), members, anchors, facing), count), f"{name}-first")
    # the last of `count` found so far is to be reached; ties count, as smaller ids come first
    beaten = one.filter(F.col("rank") == count).select("anchor", "positive", F.col("score").alias("reached"))
    keys = anchors.select("anchor", F.posexplode("keys").alias("at", "positive"))
    raised = keys.join(beaten, ["anchor", "positive"], "left").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "reached"))).alias("r"))
    now = anchors.join(raised, "anchor").withColumn("least", F.zip_with("least", "r", lambda a, b: F.coalesce(F.greatest(a, b["reached"]), a))).drop("r")
    now = materialize(now, f"{name}-raised")
    rest = pairs.filter(F.col("turn") > FIRST).join(now.select("anchor", F.array_min("least").alias("wanted")), "anchor").filter(F.col("upper") >= F.col("wanted"))
    two = _meet(rest.select("anchor", "part", "block"), members, now, facing)
    return materialize(_first(one.drop("rank").unionByName(two), count), name)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | None = None, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, part: int = PART, fit_vectors: int = FIT_VECTORS
) -> DataFrame:
    """For each anchor and each of its positives, the hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label and embedding; anchors are the rows where is_anchor holds (of vec_id; all by default). A score is the inner product of the
    vectors' entries floor(scale c). Positives are the anchor's first `positives` other rows of its label, negatives the first
    `negatives` rows of other labels whose score is at most the positive's and at least low_percent of it; higher scores come first,
    ties by smaller id. So a positive of a negative score has none.

    Rows with a null id, label or vector, or an entry that is null or not finite (or so large that scores may not fit a long) take no part. Shorter
    vectors count as filled up with zeros, an empty one as zero. Of rows that share an id the one with the least label takes part, then the
    one whose vector's bytes come first. Other columns are ignored; no rows give no rows.
    """
    keep = max(positives + 1, negatives)
    each_id = whole_vectors(vectors, scale).groupBy("vec_id").agg(F.min(F.struct("label", "raw", "norm")).alias("r"))
    rows = materialize(each_id.select("vec_id", "r.*"), "whole")
    order = Window.partitionBy("label", "raw").orderBy("vec_id")
    ranked = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= keep)
    classes = materialize(ranked.groupBy("label", "raw").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("norm").alias("norm")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0.0)).alias("most"), F.coalesce(F.max(F.length("raw")), F.lit(0)).alias("w")).first()
    n, most, width = size["n"], float(size["most"]), max(1, size["w"] // 8)
    key = F.pmod(F.xxhash64("label", "raw"), F.lit(1 << 30))
    sample = classes.filter(key < int(min(1.0, fit_vectors / max(1, n)) * (1 << 30))).select("raw").orderBy("raw").collect()
    table = choose_pivots(augmented(matrix([bytes(r["raw"]) for r in sample], width), most), pivots)
    members, blocks = _blocks(with_distances(classes, table, width, most), len(table), block)

    asked = (rows if is_anchor is None else rows.filter(is_anchor)).select(F.col("vec_id").alias("anchor"), "label", "raw", "norm")
    parts = max(1, -(-asked.count() // part))
    asked = materialize(with_distances(asked, table, width, most, query=True).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")), "anchors")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    least, greatest = bounds(F.col("norm"), most, F.col("far"), F.col("lo"), F.col("hi"))

    open_ = asked.withColumns({"keys": F.array("anchor"), "least": F.array(F.lit(-int(MOST_NORM)))})
    own = open_.join(blocks.withColumnRenamed("of", "label"), ["label", "part"]).select("anchor", "part", "block", greatest.alias("upper"))
    best = _search(own, members, open_, _facing(width, most, positives, False), positives, "positives")

    # 80 * positive <= 100 * negative <= 100 * positive can only hold from 0 on
    ranges = best.filter("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    wanted = asked.join(ranges, "anchor").withColumns({"keys": F.col("positives.id"), "least": F.expr(f"transform(positives, p -> (p.score div 100) * {low_percent} + ((p.score % 100) * {low_percent} + 99) div 100)")})
    wanted = materialize(wanted, "ranges")
    met = wanted.join(blocks, "part").filter("label != of")
    met = met.withColumns({"_lower": least, "_upper": greatest}).filter((F.col("_lower") <= F.array_max("positives.score")) & (F.col("_upper") >= F.array_min("least")))
    reach = met.select("anchor", "part", "block", F.col("_upper").alias("upper"))
    found = _search(reach, members, wanted, _facing(width, most, negatives, True), negatives, "negatives")
    of = wanted.select("anchor", F.explode("positives").alias("p")).select("anchor", F.col("p.id").alias("positive"), F.col("p.score").alias("positive_score"))
    return found.join(of, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _blocks(far: DataFrame, pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The classes with their block, and of each block its label and its least and greatest distances to each pivot.

    A label of at most `block` classes is one block; of a larger one each nearest pivot's classes are blocks, cut by a hash if they are more."""
    far = materialize(far, "far").withColumn("cell", F.coalesce(F.array_position("far", F.array_min("far")), F.lit(0)))
    labels = far.groupBy("label").agg(F.count("*").alias("size"))
    cells = far.groupBy("label", "cell").agg(F.count("*").alias("held")).join(labels, "label")
    whole = F.col("size") <= block
    cells = cells.select("label", "cell", F.when(whole, 0).otherwise(F.col("cell")).alias("home"), F.when(whole, 1).otherwise(F.ceil(F.col("held") / block)).cast("long").alias("pieces"))
    placed = far.join(cells, ["label", "cell"])
    members = placed.select(F.struct("label", "home", F.pmod(F.xxhash64("raw", F.lit(3)), F.col("pieces")).alias("piece")).alias("block"), "label", "raw", "ids", "norm", "far")
    members = materialize(members, "members")
    ends = [f(F.get("far", F.lit(p))).alias(f"{n}{p}") for p in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    lists = [F.array(*[F.col(f"{n}{p}") for p in range(pivots)]).cast("array<double>").alias(n) for n in ("lo", "hi")]
    return members, materialize(members.groupBy("block").agg(F.first("label").alias("of"), *ends).select("block", "of", *lists), "blocks")
