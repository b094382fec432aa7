"""Background work as streams: files that arrive are cleaned and chunked, progress events become counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.text import clean_lines, windows


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """path, text, ord, window of every text file that arrives under a path, in windows of bounded size."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), clean_lines("value").alias("text"))
    return rows.select("path", F.posexplode(windows("text")).alias("ord", "window"))


def progress(events: DataFrame, key: str, kind: str, time: str, late: str = "1 hour") -> DataFrame:
    """key, done, failed, total of a stream of events; state of keys without events for `late` is dropped with the watermark."""
    day = F.window(time, "1 day")
    counts = events.withWatermark(time, late).groupBy(day, key)
    return counts.agg(F.count_if(F.col(kind) == "purchase").alias("done"), F.count_if(F.col(kind) == "error").alias("failed"), F.count("*").alias("total")).select(F.col("window.start").alias("day"), key, "done", "failed", "total")


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there, as micro-batches with exactly-once files; it can be started again at any time."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
