"""Embedding whitening: the covariance as Spark SQL aggregates over every pair of dimensions, its eigenvectors from LAPACK.

Entries become whole numbers, so that sums and each row's deviation are exact. One aggregation sums every dimension; a second one
has an expression for each pair of the upper triangle, the sum of the products of the two centred entries, so each task
sends one row of d (d + 1) / 2 doubles, however many rows it has read. The driver assembles the covariance and decomposes it
(`numpy.linalg.eigh`, LAPACK). Rows are projected in batches; the covariance of the projections is summed in the same way, as a check.

What reaches the driver and the tasks' closures depends on the dimensions only: sums, triangle, and d x components doubles.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Directions whose variance is below this share of the whole can't be told from rounding and aren't whitened.
LEAST_SHARE = 1e-12
#: Most expressions of one aggregation; wider vectors take their triangle in several.
MOST_PAIRS = 4096
#: Scaled entries stay below this, so that they fit a long.
MOST_ENTRY = float(1 << 62)


@dataclass
class Whitener:
    """n rows with sums S; columns of `directions` are unit eigenvectors by falling eigenvalue, scaled by 1 / sqrt(eigenvalue)."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """The mean as a whole part and the rest, so that large means lose no digits."""
        return np.array([[s // self.n, (s % self.n) / self.n] for s in self.sums]).reshape(-1, 2)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whole entries, a row per vector, to whitened components."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return ((x - whole).astype(np.float64) - np.array([(s % self.n) / self.n for s in self.sums])) @ self.directions

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exact; None where it doesn't fit a long."""
        most = max((int(np.abs(x).max()) * self.n if x.size else 0) + max(map(abs, self.sums), default=0), 1)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [int(v) if v < 1 << 63 else None for v in exact]


def whole_entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as longs floor(64 c) + 1000000, of the rows whose vector and entries are all there and finite."""
    entry = lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) * SCALE >= MOST_ENTRY)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    return kept.select("vec_id", F.transform("v", entry).alias("x"))


def centred(x: Column, i: int, s: int, n: int) -> Column:
    """Entry i less S / n: the whole part is taken off exactly, as a long."""
    return (F.get(x, F.lit(i)) - F.lit(s // n)).cast("double") - F.lit((s % n) / n)


def triangle(rows: DataFrame, columns: list[str], most: int = MOST_PAIRS) -> np.ndarray:
    """Sums of the products of every pair of columns as a symmetric matrix; one expression for each pair of the upper triangle,
    all in one aggregation up to `most` of them."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for k in range(0, len(pairs), most):
        part = pairs[k : k + most]
        for (i, j), v in zip(part, rows.agg(*[F.expr(f"sum(`{columns[i]}` * `{columns[j]}`) AS p{i}_{j}") for i, j in part]).first(), strict=True):
            out[i, j] = out[j, i] = v or 0.0
    return out


def fit(rows: DataFrame, components: int = COMPONENTS, most: int = MOST_PAIRS) -> Whitener:
    """rows: of whole_entries, all of one length. Directions without variance are left out."""
    d = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()["d"]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, s = sums["n"], [int(v if v is not None else Decimal(0)) for v in sums[1:]]
    if n == 0 or d == 0:
        return Whitener(n, s, np.zeros((d, 0)), np.zeros(0))
    names = [f"c{i}" for i in range(d)]
    covariance = triangle(rows.select(*[centred(F.col("x"), i, s[i], n).alias(c) for i, c in enumerate(names)]), names, most) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    total = float(np.trace(covariance))
    held = int((values[:components] > LEAST_SHARE * total).sum()) if total > 0 else 0
    return Whitener(n, s, vectors[:, :held] / np.sqrt(values[:held]), values[:held] / total if total > 0 else values[:0])


def project(rows: DataFrame, model: Whitener) -> DataFrame:
    """vec_id, deviation and w, the whitened components as an array, for every row of whole_entries."""

    def each(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            w = model.project(x)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32) if w.shape[1] else np.zeros(len(w) + 1, np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviation(x), pa.int64()), lists], ["vec_id", "deviation", "w"])

    return rows.mapInArrow(each, "vec_id long, deviation long, w array<double>")


def identity_error(projected: DataFrame, k: int, n: int, most: int = MOST_PAIRS) -> float:
    """The largest entry, sign left out, of the covariance of the k whitened components less the identity."""
    if not k:
        return 0.0
    means = projected.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(k)]).first()
    names = [f"w{i}" for i in range(k)]
    rows = projected.select(*[(F.get("w", F.lit(i)) - F.lit(float(means[i]))).alias(c) for i, c in enumerate(names)])
    return float(np.abs(triangle(rows, names, most) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_PAIRS) -> DataFrame:
    """A row per remaining row of vectors and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a vector, or with an entry that is null, not finite or too large for a long, are dropped, and so are
    vectors shorter than the longest, whose last entries are missing. Rows that repeat each count and are returned; a null id stays null.
    Equal eigenvalues may come in any basis of their space, the same for all rows. Components without variance (constant dimensions, fewer
    rows than dimensions) are not returned, so equal vectors only, one row or none give no rows. deviation is null where it does not fit a
    long. Other columns are ignored.
    """
    rows = whole_entries(vectors, id_col, vector_col)
    rows = materialize(rows.filter(F.size("x") > 0), "entries")
    widest = rows.agg(F.max(F.size("x")).alias("d")).first()["d"]
    rows = rows.filter(F.size("x") == F.lit(widest or 0))
    model = fit(rows, components, most)
    projected = materialize(project(rows, model), "whitened")
    k = model.directions.shape[1]
    error = identity_error(projected, k, model.n, most)
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
