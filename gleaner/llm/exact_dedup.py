"""Exact dedup with counting quotient filters.

Texts are compared without the characters [\\x20\\x09-\\x0D]. Each partition packs the 64-bit fingerprints of its
texts into counting quotient filters, one for each range of the top bits. The filters of one range merge without
loss, since quotient and remainder give the fingerprint back: their sorted remainders are merged and counts of equal
ones added, in a tree of FAN_BITS bits a step. Only rows whose fingerprint has a count above one go on to the verification,
which reads their texts again and groups them by all their bytes; rows whose fingerprint is single are done.

A group of copies that holds a third of all rows arrives as one filter entry and one partial group per partition; the
joins that hand its result back to its rows have plain exchanges on both sides, which adaptive execution splits.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_key, without

#: Bits by which a step of the merge cuts ranges, and partitions that it brings together.
FAN_BITS = 6


class CountingQuotientFilter:
    """An immutable filter over 64-bit fingerprints that share their top `prefix` bits.

    A fingerprint is split into prefix | quotient | remainder. `occupied` has a bit for each quotient that has a run,
    `last` a bit for each slot that ends a run, `remainders` the sorted remainders of the runs one after another,
    `counted` a bit for each slot with a counter, and `counters` the counts above one.
    """

    def __init__(self, prefix: int, quotient_bits: int, occupied, last, remainders, counted, counters):
        self.prefix, self.quotient_bits = prefix, quotient_bits
        self.occupied, self.last, self.remainders, self.counted, self.counters = occupied, last, remainders, counted, counters

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, prefix: int) -> CountingQuotientFilter:
        """fingerprints: sorted, distinct, uint64."""
        bits = max(1, min(64 - prefix - 1, int(len(fingerprints)).bit_length()))
        low = 64 - prefix - bits
        quotients = (fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotients.astype(np.int64)] = True
        last = np.ones(len(fingerprints), bool)
        last[:-1] = quotients[1:] != quotients[:-1]
        counted = counts > 1
        return cls(prefix, bits, occupied, last, fingerprints & np.uint64((1 << low) - 1), counted, counts[counted])

    def entries(self, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts. top: the value of the prefix bits."""
        low = 64 - self.prefix - self.quotient_bits
        run = np.zeros(len(self.remainders), np.int64)
        run[1:] = np.cumsum(self.last[:-1])
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64) if len(run) else np.zeros(0, np.uint64)
        high = np.uint64(top << (64 - self.prefix)) if self.prefix else np.uint64(0)
        counts = np.ones(len(run), np.int64)
        counts[self.counted] = self.counters
        return high | (quotients << np.uint64(low)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        width = (64 - self.prefix - self.quotient_bits + 7) // 8
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return struct.pack("<BBII", self.prefix, self.quotient_bits, len(self.remainders), len(self.counters)) + np.packbits(self.occupied).tobytes() + np.packbits(self.last).tobytes() + np.packbits(self.counted).tobytes() + packed + self.counters.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        prefix, bits, n, m = struct.unpack_from("<BBII", data)
        width, at = (64 - prefix - bits + 7) // 8, 10

        def flags(k: int) -> np.ndarray:
            nonlocal at
            out = np.unpackbits(np.frombuffer(data, np.uint8, (k + 7) // 8, at), count=k).astype(bool)
            at += (k + 7) // 8
            return out

        occupied, last, counted = flags(1 << bits), flags(n), flags(n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(prefix, bits, occupied, last, wide.view("<u8").reshape(-1).astype(np.uint64), counted, np.frombuffer(data, "<i8", m, at + n * width).astype(np.int64))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], top: int) -> CountingQuotientFilter:
        parts = [f.entries(top) for f in filters]
        return cls.build(*add_up(np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])), filters[0].prefix)


def add_up(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fingerprints, kind="stable")  # sorted runs: the merge sort behind it merges them
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(order) else np.zeros(0, np.int64)
    return fingerprints[first], np.add.reduceat(counts, first) if len(first) else counts


def normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES.decode(), "")


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _key (of the original text), _sha and _fp (SHA-256 and a 64-bit fingerprint of the normalised text),
    _points (code points of the original)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), normalised(text_col).alias("_norm"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("_points"))
    return rows.select("_id", "_key", F.sha2("_norm", 256).alias("_sha"), fingerprint(F.col("_norm")).alias("_fp"), "_points")


def _split(found: np.ndarray, counts: np.ndarray, group: int, bits: int) -> pa.RecordBatch:
    """A filter for each value of the top bits: group, top, filter."""
    tops = (found >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    blocks = [CountingQuotientFilter.build(found[a:b], counts[a:b], bits).to_bytes() for a, b in zip(cuts, np.r_[cuts[1:], len(found)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([group] * len(cuts), pa.int64()), pa.array(tops[cuts]), pa.array(blocks, pa.binary())], ["group", "top", "filter"])


def repeated_fingerprints(digest_rows: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """_fp, _n of the fingerprints that occur more than once.

    Each partition packs its fingerprints into filters of 2 ** fan_bits ranges. A step merges the filters of one range and of as many
    partitions, and cuts the merged filter into as many finer ranges for the next step, until all partitions are merged. So a filter
    holds as many fingerprints on every step, and their number grows with the rows alone.
    """
    partitions = digest_rows.rdd.getNumPartitions()
    steps = 1
    while 1 << (fan_bits * steps) < partitions:
        steps += 1

    def build(batches):
        found, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def packed():
            both = np.concatenate([found, *new])
            return add_up(both, np.concatenate([counts, np.ones(len(both) - len(found), np.int64)]))

        for batch in batches:
            new.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, new)) > max(1 << 20, len(found)):
                (found, counts), new = packed(), []
        found, counts = packed()
        if len(found):
            yield _split(found, counts, TaskContext.get().partitionId() >> fan_bits, fan_bits)

    def merge(last: bool, bits: int):
        def each(key, table):
            group, top = key[0].as_py(), key[1].as_py()
            found, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")], top).entries(top)
            if last:
                return pa.table({"_fp": found[counts > 1].view(np.int64), "_n": counts[counts > 1]})
            return pa.Table.from_batches([_split(found, counts, group >> fan_bits, bits + fan_bits)])

        return each

    filters = digest_rows.select("_fp").mapInArrow(build, "group long, top long, filter binary")
    for step in range(1, steps + 1):
        last = step == steps
        filters = filters.groupBy("group", "top").applyInArrow(merge(last, fan_bits * step), "_fp long, _n long" if last else "group long, top long, filter binary")
    return filters


def _groups(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_sha, _size, _best (p, u, i, key: the row that stays) of every text that several rows have.

    Only rows whose fingerprint is repeated are read again. They are grouped by their normalised texts themselves, with partial
    groups before the shuffle, so a group's text is sent once by each partition that has it.
    """
    again = materialize(repeated_fingerprints(rows).select("_fp"), "fingerprints")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"), normalised(text_col).alias("_norm"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("_points"))
    suspects = texts.withColumn("_fp", fingerprint(F.col("_norm"))).join(again, "_fp", "left_semi")
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("u"), F.col("_id").alias("i"), F.col("_key").alias("key")))
    groups = suspects.groupBy("_fp", "_norm").agg(best.alias("_best"), F.count("*").alias("_size")).filter("_size > 1")
    return materialize(groups.select(F.sha2("_norm", 256).alias("_sha"), "_size", "_best"), "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts equal each other. Of equal texts the row with the most code points
    stays, then the smallest id (null last). kept tells whether a row has the id that stays; rows that repeat an id with equal text
    are one document stored twice and carry the same decision. An empty table gives no rows. Other columns of docs are ignored.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    groups = _groups(docs, rows, id_col, text_col).select("_sha", "_size", F.col("_best.i").alias("_keep"))
    return rows.join(groups, "_sha", "left").select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_size").isNull(), F.lit(True)).otherwise(F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, with all their columns: of a document that is stored twice one row stays, and another text with the
    same id is a document of its own. Rows with a null id that has copies are dropped with them. No rows give no rows."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    groups = _groups(docs, rows, id_col, text_col).select("_sha", "_best")
    stays = F.col("_best.i").eqNullSafe(F.col("_id")) & (F.col("_best.key") == F.col("_key"))
    marks = rows.join(groups, "_sha").groupBy(F.col("_id").alias("id"), F.col("_key").alias("key")).agg(F.max(stays).alias("once"), F.count("*").alias("n"))
    return without(docs, id_col, text_col, marks.filter("NOT once OR n > 1"), "exact")
