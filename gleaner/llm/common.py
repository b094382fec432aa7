"""Helpers that the operators of this subpackage share: scratch tables and Arrow text access."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D], as bytes.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; an own one only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the rereading of a file, not a rerun of what made it, and
    a table that several jobs use is computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """df, whose session sends at most `rows` rows at a time to Python workers from now on: texts may be long, and a worker and
    its executor hold whole batches. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, rows)
    return df


def text_key(text_col: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def without(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, name: str) -> DataFrame:
    """docs without the rows that marks name by id and text (columns id, key = text_key(), once): of rows with `once` set one stays,
    the others go. Null ids equal each other. Columns of docs may have any names.

    marks is written first, so Spark knows its size and sends it to all tasks if it is small, else joins by shuffle.
    """
    marks = materialize(marks.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "once"), name)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"))
    rows = rows.join(marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("row", "id", "key", "once")
    repeated = rows.filter("once").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.filter("once IS NULL").select("row").unionByName(repeated.select("row")).select("row.*")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column and their n + 1 offsets; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, starts, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if starts is not None else np.zeros(len(column) + 1, np.int64)
    low = offsets[0] if len(offsets) else 0
    text = np.frombuffer(data, np.uint8)[low : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return text, offsets - low


def text_blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `most` bytes; a longer text comes alone."""
    text, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, text[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text; a text may be empty."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_starts(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) flags of the runs of non-space bytes, which never reach over the border of two texts."""
    inside = ~IS_SPACE[text]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[full[full > 0] - 1] = False
    return inside & ~before, inside & ~after


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays; wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as uniform doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Bytes up to which spans are hashed in steps of eight bytes, all at once; longer ones go one by one.
_STEPPED = 512
_SPAN = np.uint64(0xA0761D6478BD642F)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' contents and lengths.

    Each step mixes the next eight bytes into all bits, so no pattern of the bytes makes two spans collide, as
    polynomials modulo 2 ** 64 do. Longer spans are hashed with BLAKE2b.
    """
    size = ends - starts
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    eight = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix64(size.astype(np.uint64) * _SPAN + _SPAN)
    live, at = np.flatnonzero((size > 0) & (size <= _STEPPED)), 0
    while live.size:
        chunk, left = eight[starts[live] + at], size[live] - at
        last = np.flatnonzero(left < 8)
        chunk[last] &= (np.uint64(1) << (left[last] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix64(out[live] ^ chunk) + _SPAN
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _STEPPED).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out
