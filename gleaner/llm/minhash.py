"""MinHash near-dedup with DartMinHash signatures.

An element of a text is a run of five words; its weight is how often the text has it. An element throws darts at random
places of the plane weight x rank; they depend on the element alone. A dart counts for a text if it lands below the
element's weight there and below the text's rank limit, which is set so that about COORDINATES * (ln COORDINATES + 4) darts
count whatever the text's size. Each dart belongs to one coordinate, and a coordinate keeps its dart of least rank;
where one stays empty the limit is doubled. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity: the sum of the lesser weights over the sum of the greater ones.

Equal word sequences are one class, so copies are compared once. BANDS bands of ROWS coordinates are joined: a pair of
similarity 0.8 shares a band with a probability of 0.999997. In the first round every class of a bucket is verified, on
its whole weighted set, against the bucket's smallest class only, so a bucket with a third of all classes costs as many
comparisons as it has classes. Buckets that still hold different components after that go through a second round,
in blocks of BLOCK classes against blocks. There signatures, a byte for each coordinate, leave those classes that agree with
one of another component in nearly enough coordinates; only these get their sets and are verified where they meet, and a
task gives out one link for each two components that it joins. Pairs within a component are not made. The signatures leave
out a pair of similarity 0.8 with a probability of some 3 in a million (DEVIATIONS), as rare as one without a shared band.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches, span_hashes, text_blocks, text_key, unit, without, word_starts
from .components import Forest, connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
BLOCK = 256
#: Standard deviations of the estimate that a pair may lie below the threshold and still be verified.
DEVIATIONS = 4.5

_FACTORS = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingles(text: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of `words` words of each text; a text with fewer words has all of them as its one run."""
    starts, ends = (np.flatnonzero(x) for x in word_starts(text, offsets))
    hashes = span_hashes(text, starts, ends + 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    full = np.flatnonzero(rows[words - 1 :] == rows[: len(rows) - words + 1]) if len(rows) >= words else np.zeros(0, np.int64)
    runs = sum(hashes[full + k] * _FACTORS[k] for k in range(words)) if len(full) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts[rows] < words))
    within = short - (np.cumsum(counts) - counts)[rows[short]]
    ends_ = np.zeros(n, np.uint64)
    np.add.at(ends_, rows[short], hashes[short] * _FACTORS[within])
    few = np.flatnonzero((counts > 0) & (counts < words))
    out_rows, out = np.r_[rows[full], few], mix64(np.r_[runs, ends_[few] + counts[few].astype(np.uint64)])
    order = np.argsort(out_rows, kind="stable")
    return out_rows[order], out[order]


def weighted(rows: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, how often the row has it), each element of a row once."""
    order = np.lexsort((elements, rows))
    rows, elements = rows[order], elements[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (elements[1:] != elements[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], elements[first], np.diff(np.r_[first, len(rows)])


@lru_cache(256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    k = np.arange(int(area + 40 * (area**0.5 + 1)))
    return np.minimum(np.cumsum(np.exp(k * log(area) - area - np.cumsum(np.log(np.maximum(k, 1))))), 1.0)


def darts(elements: np.ndarray, rows: np.ndarray, weights: np.ndarray, limits: np.ndarray, coordinates: int):
    """(row, coordinate, rank, id) of all darts of the elements below their weight and their row's limit.

    The plane is cut in cells, [0, 1), [1, 2), [2, 4), ... by weight and, below weight w, [0, 1/2w), [1/2w, 1/w), [1/w, 2/w), ... by rank,
    whose number of darts and places are drawn from a hash of element and cell, so every text sees the same darts.
    """
    found = []
    high = limits[rows]
    w_low, w_top, nu = 0.0, 1.0, 0
    while (heavy := np.flatnonzero(weights > w_low)).size:
        r_low, r_top, rho = 0.0, 0.5 / w_top, 0
        while (here := heavy[high[heavy] > r_low]).size:
            key = mix64(elements[here] + np.uint64((nu * 97 + rho + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            counts = np.searchsorted(_poisson((w_top - w_low) * (r_top - r_low)), unit(key), "right")
            of = np.repeat(np.arange(len(here)), counts)
            number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix64(key[of] ^ mix64((number + 1).astype(np.uint64)))
            rank = r_low + (r_top - r_low) * unit(mix64(dart ^ np.uint64(0xD1B54A32D192ED03)))
            ok = rank < high[here[of]]
            if w_top > 1 or (weights[here] < 1).any():
                ok &= w_low + (w_top - w_low) * unit(mix64(dart ^ np.uint64(0x8CB92BA72F3D8DD7))) < weights[here[of]]
            of, dart, rank = of[ok], dart[ok], rank[ok]
            found.append((rows[here[of]], (dart % np.uint64(coordinates)).astype(np.int64), rank, mix64(dart)))
            r_low, r_top, rho = r_top, r_top * 2, rho + 1
        w_low, w_top, nu = w_top, w_top * 2, nu + 1
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)]


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """n x coordinates dart ids; rows without elements stay 0."""
    out = np.zeros((n, coordinates), np.uint64)
    mass = np.bincount(rows, weights, n)
    open_ = mass > 0
    limits = np.divide(coordinates * (log(coordinates) + 4), mass, out=np.zeros(n), where=open_)
    while open_.any():
        pick = open_[rows]
        r, c, rank, name = darts(elements[pick], rows[pick], weights[pick], np.where(open_, limits, 0), coordinates)
        least = np.full(n * coordinates, np.inf)
        np.minimum.at(least, r * coordinates + c, rank)
        won = rank == least[r * coordinates + c]
        out[r[won], c[won]] = name[won]
        open_ &= np.isinf(least).reshape(n, coordinates).any(1)
        limits = limits * 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    keys = sum(parts[:, :, k] * _FACTORS[k] for k in range(parts.shape[2])) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(keys).view(np.int64)


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc, key, same (a digest of the word sequence, null without words), bands, sketch (a byte of each coordinate)."""

    def each(batches):
        for batch in batches:
            for first, last, text, offsets in text_blocks(batch.column(2)):
                n = last - first
                rows, hashes, weights = weighted(*shingles(text, offsets))
                signature = signatures(rows, hashes, weights, n)
                worded = np.bincount(rows, minlength=n) > 0
                raw, cut = text.tobytes(), offsets.tolist()
                same = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() if w else None for a, b, w in zip(cut, cut[1:], worded, strict=False)]
                keys = band_keys(signature)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
                sketch = signature.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(same, pa.binary()), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc", "key", "same", "bands", "sketch"])

    return small_batches(docs).mapInArrow(each, "doc long, key long, same binary, bands array<long>, sketch binary")


def weighted_sets(docs: DataFrame) -> DataFrame:
    """node, copies and centres of docs, and the shingle hashes of the whole text, all different: the second, third, ... of equal ones
    are hashed with their number, so Jaccard similarities of these sets are the weighted ones of the texts."""

    def each(batches):
        for batch in batches:
            for first, last, text, offsets in text_blocks(batch.column(3)):
                rows, hashes, weights = weighted(*shingles(text, offsets))
                number = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
                rows, hashes = np.repeat(rows, weights), np.repeat(hashes, weights)
                again = number > 0
                hashes[again] = mix64(hashes[again] ^ mix64(number[again].astype(np.uint64)))
                ends = np.zeros(last - first + 1, np.int32)
                np.cumsum(np.bincount(rows, minlength=last - first), out=ends[1:])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))], ["node", "copies", "centres", "set"])

    return small_batches(docs).mapInArrow(each, "node long, copies long, centres array<long>, set array<long>")


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of a set and one of its centres that have the similarity. A set moves once, to its centres."""
    stars = sets.select(F.col("node").alias("a"), F.col("set").alias("x"), F.explode("centres").alias("b"))
    both = F.size(F.array_intersect("x", "y"))
    met = stars.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return met.filter(both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two arrays without repeats."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _blocks_met(members: DataFrame, block: int) -> DataFrame:
    """key, lo, hi, left, node, component, sketch, bands: a row of each class for each two blocks of its bucket that it is compared in.

    members: key, n_main, n_other (classes of the bucket in its main component and in others), main, node, component, sketch, bands. Classes
    of the main component meet blocks of the others only, so a bucket that is nearly all one component costs little.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    mine = members.withColumns({"mains": blocks("n_main"), "others": blocks("n_other")})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    at = lambda side, b: F.struct(F.lit(side).alias("s"), b.alias("b"))
    met = lambda lo, hi, left: F.struct(lo.alias("lo"), hi.alias("hi"), left.alias("left"))
    facing_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: met(at(0, b), at(1, F.col("own")), F.lit(False)))
    facing_other = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda b: met(at(1, F.least(b, F.col("own"))), at(1, F.greatest(b, F.col("own"))), F.col("own") <= b))
    as_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda b: met(at(0, F.col("own")), at(1, b), F.lit(True)))
    meetings = F.when(F.col("main"), as_main).otherwise(F.concat(facing_main, facing_other))
    return mine.withColumn("own", own).withColumn("m", F.explode(meetings)).select("key", "m.lo", "m.hi", "m.left", "node", "component", "sketch", "bands")


class _Meeting:
    """The classes of two blocks of a bucket (rows: left, node, component, sketch, bands, ...), and which may be alike."""

    def __init__(self, at: tuple, rows: list[tuple], least: float):
        self.at, self.inner, self.least = at, at[1] == at[2], least
        self.nodes, self.parts = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
        side = np.array([x[0] for x in rows])
        self.left = np.arange(len(rows)) if self.inner else np.flatnonzero(side)
        self.right = np.arange(len(rows)) if self.inner else np.flatnonzero(~side)
        self.sketch = np.frombuffer(b"".join(x[3] for x in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([x[4] for x in rows])

    def near(self):
        """(i, those j) of different components whose signatures agree nearly enough, in the first bucket that they share."""
        if not len(self.left) or not len(self.right) or (self.parts == self.parts[0]).all():
            return
        for i in self.left.tolist():
            ok = ((self.sketch[i] == self.sketch[self.right]).mean(1) >= self.least) & (self.parts[self.right] != self.parts[i])
            if self.inner:
                ok &= self.nodes[self.right] > self.nodes[i]
            found = self.right[ok]
            if len(found):
                same = self.bands[found] == self.bands[i]
                found = found[self.bands[i][same.argmax(1)] == self.at[0]]
                yield i, found


def _meetings(batches, found):
    """found(at, rows) of each run of rows with one (key, lo, hi), where it has rows to give out."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(7)]
        lists = [batch.column(i) for i in range(7, batch.num_columns)]
        for r, (key, lo, hi, *row) in enumerate(zip(*plain, strict=True)):
            if (key, lo, hi) != at:
                if held and (out := found(at, held)) is not None:
                    yield out
                at, held = (key, lo, hi), []
            held.append((*row, *(x[r].values.to_numpy() for x in lists)))
    if held and (out := found(at, held)) is not None:
        yield out


def _second_links(members: DataFrame, sets: DataFrame, coordinates: int, threshold: float, block: int) -> DataFrame:
    """Links between different components within a bucket, at most one for each two components and two blocks."""
    least = threshold - DEVIATIONS * (threshold * (1 - threshold) / coordinates) ** 0.5
    rows = _blocks_met(members, block)
    kind = "key long, lo struct<s:int,b:int>, hi struct<s:int,b:int>, left boolean, node long, component long, sketch binary, bands array<long>"
    place = pa.struct([("s", pa.int32()), ("b", pa.int32())])

    def alike(at, held):
        meeting = _Meeting(at, held, least)
        keep = sorted({k for i, near in meeting.near() if len(near) for k in (i, *near.tolist())})
        if not keep:
            return None
        some = [held[k] for k in keep]
        columns = [pa.array([at[0]] * len(some), pa.int64()), pa.array([at[1]] * len(some), place), pa.array([at[2]] * len(some), place), pa.array([bool(x[0]) for x in some])]
        columns += [pa.array([x[k] for x in some], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(columns, ["key", "lo", "hi", "left", "node", "component", "sketch", "bands"])

    def linked(at, held):
        meeting, forest, a, b = _Meeting(at, held, least), Forest(), [], []
        for i, near in meeting.near():
            for j in near.tolist():
                one, two = int(meeting.parts[i]), int(meeting.parts[j])
                if forest.root(one) != forest.root(two) and _jaccard(held[i][5], held[j][5]) >= threshold - 1e-12:
                    forest.join(one, two)
                    a.append(min(meeting.nodes[i], meeting.nodes[j]))
                    b.append(max(meeting.nodes[i], meeting.nodes[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    dealt = lambda df: df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    some = materialize(dealt(rows).mapInArrow(lambda batches: _meetings(batches, alike), kind), "alike")
    met = some.join(sets.select("node", "set"), "node").select("key", "lo", "hi", "left", "node", "component", "sketch", "bands", "set")
    return dealt(met).mapInArrow(lambda batches: _meetings(batches, linked), "a long, b long").distinct()


def _decided(docs: DataFrame, id_col: str, text_col: str, threshold: float, block: int) -> DataFrame:
    """doc, key, copy_id, class_id, stays for every row of docs. Rows are told apart by id and text; classes have numbers of their own."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(sketch_rows(texts), "sketches")
    linkable = rows.filter("same IS NOT NULL AND doc IS NOT NULL")
    classes = linkable.groupBy("same").agg(F.min(F.struct("doc", "key")).alias("rep"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "same", "rep"), "classes")
    reps = linkable.drop("same").join(classes.select("node", F.col("rep.doc").alias("doc"), F.col("rep.key").alias("key")), ["doc", "key"])
    reps = reps.groupBy("doc", "key").agg(*[F.first(c).alias(c) for c in ("node", "bands", "sketch")], F.count("*").alias("copies"))
    reps = materialize(reps, "reps")
    banded = reps.select("node", F.explode("bands").alias("bucket"))
    shared = materialize(banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = materialize(banded.join(shared, "bucket").select(F.col("bucket").alias("key"), "node", "centre"), "members")
    wanted = members.groupBy("node").agg(F.collect_set(F.when(F.col("node") != F.col("centre"), F.col("centre"))).alias("centres"))
    wanted = materialize(wanted.join(reps.select("node", "doc", "key", "copies"), "node"), "wanted")
    sets = weighted_sets(texts.join(wanted.hint("merge"), ["doc", "key"]).select("node", "copies", "centres", "text"))
    sets = materialize(sets, "sets")
    sets = sets.filter("copies = 1").unionByName(sets.filter("copies > 1").dropDuplicates(["node"]))
    links = materialize(_verified(sets, threshold), "links")
    parts = connected_components(links)
    named = members.select("key", F.col("node").alias("n")).join(parts, F.col("n") == F.col("node"), "left")
    named = materialize(named.select("key", F.col("n").alias("node"), F.coalesce("component", "n").alias("component")), "named")
    counts = named.groupBy("key", "component").agg(F.count("*").alias("c"))
    unsettled = counts.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min_by("c", "component").alias("n_main"), (F.sum("c") - F.min_by("c", "component")).alias("n_other"))
    unsettled = unsettled.filter("first <> last").select("key", "first", "n_main", "n_other")
    more = named.join(unsettled, "key").withColumn("main", F.col("component") == F.col("first")).join(reps.select("node", "sketch", "bands"), "node")
    links = links.unionByName(materialize(_second_links(more, sets, BANDS * ROWS, threshold, block), "links"))
    parts = materialize(connected_components(links), "parts")
    firsts = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    parts = materialize(parts.join(firsts, "component").select(F.col("node").alias("part"), "first"), "firsts")
    named = classes.join(parts, F.col("node") == F.col("part"), "left").select("same", "rep", F.coalesce("first", "rep").alias("first"))
    named = materialize(named, "decided")
    known = F.col("first").isNotNull() & F.col("doc").isNotNull()
    return rows.select("doc", "key", "same").join(named, "same", "left").select(
        "doc", "key", F.when(known, F.col("rep.doc")).otherwise(F.col("doc")).alias("copy_id"), F.when(known, F.col("first.doc")).otherwise(F.col("doc")).alias("class_id"),
        F.when(known, (F.col("first.doc") == F.col("doc")) & (F.col("first.key") == F.col("key"))).otherwise(F.lit(True)).alias("stays"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, copy_id, class_id, kept.

    copy_id is the smallest id with the same word sequence, class_id the smallest id that links lead to; a link is a weighted
    Jaccard similarity of the five-word runs of threshold or more. Words are runs of bytes other than [\\x20\\x09-\\x0D]. A text
    with one to four words has all of them as its one run. Texts without words, null ones included, and rows
    with a null id link with nothing and stay. kept marks the smallest id of a class. Rows that repeat an id are each decided by
    their own text; with the same text they have the same result. Other columns are ignored; no rows give no rows.
    """
    out = _decided(docs, id_col, text_col, threshold, block)
    return out.select(F.col("doc").alias("doc_id"), "copy_id", "class_id", (F.col("doc").isNull() | (F.col("class_id") == F.col("doc"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class, the one with the smallest id, and with all columns. A row that is stored more than once stays
    once. Rows with a null id stay, and so do texts without words. No rows give no rows."""
    rows = _decided(docs, id_col, text_col, threshold, block).filter("doc IS NOT NULL")
    marks = rows.groupBy(F.col("doc").alias("id"), "key").agg(F.max("stays").alias("once"), F.count("*").alias("n")).filter("NOT once OR n > 1")
    return without(docs, id_col, text_col, marks, "near")
