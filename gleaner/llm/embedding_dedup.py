"""Embedding near-dedup with product quantisation.

Equal vectors of one label are one class with a count, so a vector that a third of all rows repeat is compared once.
Each class goes to the inverted list of its nearest coarse centroid and gets residual codes: the nearest codeword in
each subspace, and the length of the error they leave. Two unit vectors with a cosine of t or more are at most
reach = sqrt(2 - 2t) apart, so a vector can only link into lists whose border with its own list is that near; these are
its probes. Two lists are compared where the vectors of both probe the other. There, asymmetric distances from lookup
tables, less the error's length, are a lower bound of the true distance; pairs it doesn't exclude get the exact cosine in
doubles. No link is lost by any of these bounds, whatever the centroids and codewords, which are fitted on a sample of
about FIT_VECTORS classes, or four for each list if that is more. Lists number one for each LIST_SIZE classes, beyond 4 million
classes the square root of their number.

Lists are cut in blocks of about BLOCK classes and compared block by block: a task holds two blocks, emits the links of
each class as a count and the components as at most one edge per class, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import materialize
from .components import block_stars, connected_components

THRESHOLD = 0.98
FIT_VECTORS = 20_000
BLOCK = 1024
LIST_SIZE = 4096
SUBSPACES = 8
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def slices(n: int, centres: np.ndarray) -> list[slice]:
    """Runs of n rows whose distances to all centres take 32 MB at most."""
    step = max(1, (1 << 22) // max(1, len(centres)))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(squared(x[s], centres).argmin(1) for s in slices(len(x), centres))])


def lists_for(n: int, list_size: int, linear: int = 1024) -> int:
    """A list for each list_size classes, up to `linear` lists; then as many as the square root of n, so that both the distances to the
    centroids and those within lists grow with n ** 1.5. Powers of two."""
    power = lambda k: 1 << max(0, k.bit_length() - 1)
    return min(power(n // list_size), max(linear, power(isqrt(n))))


@dataclass
class Quantiser:
    centres: np.ndarray  # lists x width
    words: np.ndarray  # subspaces x words x width of a subspace

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, words: int = 256, seed: int = 4) -> Quantiser:
        """x: unit vectors, their width a multiple of subspaces."""
        rng = np.random.default_rng(seed)
        centres = kmeans(x, lists, 8, rng)
        rest = (x - centres[nearest(x, centres)]) if len(x) else x
        parts = np.split(rest, subspaces, axis=1)
        found = [kmeans(p, words, 6, rng) for p in parts]
        return cls(centres, np.stack(found))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The list, the codes (uint8) and the length of the error of each vector."""
        at = nearest(x, self.centres)
        parts = np.split(x - self.centres[at], len(self.words), axis=1)
        codes = np.stack([nearest(p, w) for p, w in zip(parts, self.words, strict=True)], axis=1)
        left = sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(parts, self.words, codes.T, strict=True))
        return at, codes.astype(np.uint8), np.sqrt(left)

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[list[int]]:
        """The lists that a vector within reach of x can be in, for each x."""
        out = []
        for s in slices(len(x), self.centres):
            far, own = squared(x[s], self.centres), (np.arange(s.stop - s.start), at[s])
            homes, which = np.unique(at[s], return_inverse=True)
            apart = np.sqrt(squared(self.centres[homes], self.centres))[which]
            near = far - far[own][:, None] <= 2 * reach * apart + SLACK
            near[own] = True
            out += [np.flatnonzero(p).tolist() for p in near]
        return out

    def near(self, x: np.ndarray, at: int, codes: np.ndarray, errors: np.ndarray, reach: float) -> np.ndarray:
        """Flags of the pairs (vector, coded vector of list at) that the table-lookup distance doesn't exclude."""
        parts = np.split(x - self.centres[at], len(self.words), axis=1)
        total = np.zeros((len(x), len(codes)), np.float32)
        for k, (p, w) in enumerate(zip(parts, self.words, strict=True)):
            total += squared(p, w).astype(np.float32)[:, codes[:, k]]
        return total <= (reach + errors + SLACK).astype(np.float32) ** 2 + np.float32(1e-4)


def unit_vectors(raw: list[bytes], width: int, kind: str = "<f8") -> np.ndarray:
    """Doubles of length 1 from the bytes of vectors of a kind of float, filled up with zeros to the width."""
    out = np.zeros((len(raw), width))
    if len({len(x) for x in raw}) == 1:
        alike = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
        out[:, : alike.shape[1]] = alike
    else:
        for i, x in enumerate(raw):
            v = np.frombuffer(x, kind)
            out[i, : len(v)] = v
    # scaled before it is squared, so that large and tiny components neither overflow nor vanish
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def float_kind(vectors: DataFrame) -> str:
    """Vectors of floats move as floats, which doubles hold exactly; all others as doubles."""
    held = vectors.select("embedding").schema[0].dataType
    return "<f4" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, raw (bytes of the vector, of its float_kind) of the rows that can link."""
    kind = float_kind(vectors)

    def each(batches):
        for batch in batches:
            raw, keep = [], []
            for i, x in enumerate(batch.column(2)):
                v = None if not x.is_valid or x.values.null_count or not len(x) else x.values.to_numpy(zero_copy_only=False).astype(kind)
                if v is not None and np.isfinite(v).all() and v.any():
                    raw.append(v.tobytes())
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    return rows.filter("label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(each, "vec_id long, label string, raw binary")


def _compare(quantiser: Quantiser, width: int, kind: str, threshold: float, reach: float):
    def compare(table: pa.Table) -> pa.Table:
        side = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        own = bool(table.column("own")[0].as_py())  # a block with itself
        ids, counts = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x = unit_vectors(table.column("raw").to_pylist(), width, kind)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        errors, home = table.column("error").to_numpy(), table.column("home").to_numpy()
        a = np.arange(len(ids)) if own else np.flatnonzero(~side)
        b = np.arange(len(ids)) if own else np.flatnonzero(side)
        links, nodes, roots = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a) and len(b):
            maybe = quantiser.near(x[a], int(home[b[0]]), codes[b], errors[b], reach)
            maybe &= ids[a][:, None] != ids[b]
            linked = np.zeros_like(maybe)
            ra, rb = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            linked[np.ix_(ra, rb)] = (x[a[ra]] @ x[b[rb]].T >= threshold) & maybe[np.ix_(ra, rb)]
            if own:
                linked |= linked.T
            np.add.at(links, a, linked @ counts[b])
            if not own:
                np.add.at(links, b, linked.T @ counts[a])
            nodes, roots = block_stars(linked, ids[a], ids[b])
        some = np.flatnonzero(links)
        return pa.table({"a": np.r_[ids[some], nodes], "b": np.r_[ids[some], roots], "links": np.r_[links[some], np.zeros(len(nodes), np.int64)]})

    return compare


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, fit_vectors: int = FIT_VECTORS, block: int = BLOCK, list_size: int = LIST_SIZE) -> DataFrame:
    """One row per row of vectors (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and the cosine in doubles is threshold or more; both vectors have to have the
    same length. Rows with a null id, label or vector, an empty or zero vector, or a component that is null or not finite
    link with nothing and are their own component. Rows that repeat an id count
    each as a vector and have the same result. Other columns are ignored; no rows give
    no rows.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    rows = materialize(usable(vectors), "vectors")
    classes = materialize(rows.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("w")).first()
    kind = float_kind(vectors)
    n, widest = size["n"], (size["w"] or 8) // int(kind[-1])
    width = -(-widest // SUBSPACES) * SUBSPACES
    lists = lists_for(n, list_size)
    share = classes.filter(F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(1 << 30)) < int(min(1, max(fit_vectors, 4 * lists) / max(1, n)) * (1 << 30)))
    sample = unit_vectors([bytes(r["raw"]) for r in share.orderBy("rep").select("raw").collect()], width, kind)
    quantiser = Quantiser.fit(sample, lists)

    def encode(batches):
        for batch in batches:
            x = unit_vectors(batch.column("raw").to_pylist(), width, kind)
            at, codes, errors = quantiser.encode(x)
            probes = quantiser.probes(x, at, reach)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(probes, pa.list_(pa.int32()))], [*batch.schema.names, "home", "codes", "error", "probes"])

    coded = classes.mapInArrow(encode, "label string, raw binary, rep long, n long, home int, codes binary, error double, probes array<int>")
    coded = materialize(coded.withColumn("wide", F.length("raw")), "coded")
    lists = coded.groupBy("label", "wide", "home").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    lists = materialize(lists, "lists")
    mine = coded.join(lists, ["label", "wide", "home"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = mine.withColumn("other", F.explode("probes")).join(lists.select("label", "wide", F.col("home").alias("other"), F.col("blocks").alias("their")), ["label", "wide", "other"])
    met = met.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("their") - 1)))
    me, they = F.struct(F.col("home").alias("l"), F.col("block").alias("b")), F.struct(F.col("other").alias("l"), F.col("facing").alias("b"))
    met = met.withColumns({"lo": F.least(me, they), "hi": F.greatest(me, they), "right": me > they, "own": me == they})
    met = met.select("label", "wide", "lo", "hi", "right", "own", "rep", "n", "raw", "home", "codes", "error")
    found = met.groupBy("label", "wide", "lo", "hi").applyInArrow(_compare(quantiser, width, kind, threshold, reach), "a long, b long, links long")
    found = materialize(found, "links")
    links = found.filter("links > 0").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    parts = connected_components(found.filter("links = 0")).select(F.col("node").alias("rep"), "component")
    decided = classes.join(links, "rep", "left").join(parts, "rep", "left").select("label", "raw", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    decided = materialize(decided, "decided")
    known = rows.join(decided, ["label", "raw"]).groupBy(F.col("vec_id").alias("known")).agg(F.max("links").alias("links"), F.min("component").alias("component"))
    return vectors.select(F.col("vec_id").cast("long")).join(known, F.col("vec_id") == F.col("known"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept")
    )
