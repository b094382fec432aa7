"""A term index of immutable segments in a folder of Parquet tables.

An upsert or delete writes one segment and touches no other: the postings of its chunks, a row per chunk (its length and terms), the ids
it replaces or deletes (tombstones), and what it changes in the statistics (document frequencies, number and length of chunks), which are
therefore sums over segments. A posting is alive if no later segment has a tombstone for its chunk. Compaction writes the living rows of the latest
segments as one. Which segments count is a version of the log, written last, so a job that dies half-way leaves the index as it was. One writer at a
time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import postings as counted

LOG = "segment string, seq int"
#: The row of the statistics that holds the number of chunks (df) and their length, instead of a term's frequency.
ALL = "\0"


class SegmentedIndex:
    """The index in a folder of the file system that all tasks share. Ids are longs; a chunk has one row, in the latest segment that holds its id."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """version: an older state of the log; the latest if not given."""
        self.spark, self.path = spark, path.rstrip("/")
        self.log = []
        self.version = 0
        log = self._log()
        if log is not None:
            self.version = version if version is not None else log.agg(F.max("version").alias("v")).first()["v"]
            self.log = sorted((r["seq"], r["segment"]) for r in log.filter(F.col("version") == self.version).collect())

    def _log(self) -> DataFrame | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not place.getFileSystem(conf).exists(place):
            return None
        return self.spark.read.schema(f"{LOG}, version int").parquet(f"{self.path}/log")

    def _table(self, kind: str, schema: str, least: int = 0) -> DataFrame:
        paths = [f"{self.path}/{segment}/{kind}" for seq, segment in self.log if seq >= least]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, segments: list[tuple[int, str]]) -> None:
        self.log, self.version = sorted(segments), self.version + 1
        self.spark.createDataFrame([(s, n) for n, s in self.log], LOG).coalesce(1).write.parquet(f"{self.path}/log/version={self.version}")

    def tombstones(self) -> DataFrame:
        """id, last: the latest segment that replaces or deletes a chunk."""
        return self._table("gone", "id long, seq int").groupBy("id").agg(F.max("seq").alias("last"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        dead = self.tombstones().withColumnRenamed("id", "_id")
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("last")), "left_anti")

    def chunks(self, least: int = 0) -> DataFrame:
        """id, len, terms, seq of the living chunks."""
        return self._alive(self._table("chunks", "id long, len int, terms array<string>, seq int", least))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """id, term, tf, len of the living chunks; only of `terms` (a table with a column term), which are picked before anything is joined."""
        rows = self._table("postings", "id long, term string, tf long, len int, seq int")
        return self._alive(rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")).drop("seq")

    def frequencies(self) -> DataFrame:
        """term, df over the living chunks."""
        return self._table("stats", "term string, df long, len long").filter(F.col("term") != ALL).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def totals(self) -> DataFrame:
        """n and avg_len over the living chunks, one row."""
        rows = self._table("stats", "term string, df long, len long").filter(F.col("term") == ALL)
        return rows.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.try_divide(F.sum("len"), F.sum("df")).alias("avg_len"))

    def upsert(self, rows: DataFrame, id_col: str, text_col: str) -> None:
        """Adds the chunks of rows; those whose id is known replace what was there. Of rows of one id the one with the greatest text counts."""
        one = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
        self._write(counted(one, "id", "text"), one.select("id"), True)

    def delete(self, ids: DataFrame, id_col: str) -> None:
        """Chunks that are not there are left out of account."""
        none = self.spark.createDataFrame([], "id long, term string, tf long, len int")
        self._write(none, ids.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct(), False)

    def _write(self, added: DataFrame, gone: DataFrame, all_stay: bool) -> None:
        """all_stay: the ids of `gone` come anew, those without a posting as chunks without words."""
        seq = self.log[-1][0] + 1 if self.log else 1
        segment = f"segment-{seq}-{uuid.uuid4().hex}"
        at = f"{self.path}/{segment}"
        mark = F.lit(seq).alias("seq")
        gone.select("id", mark).write.parquet(f"{at}/gone")
        ids = self.spark.read.parquet(f"{at}/gone").select("id")
        # terms in order, so that a search reads the row groups of its terms
        added.select("id", "term", "tf", F.col("len").cast("int").alias("len"), mark).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        new = self.spark.read.parquet(f"{at}/postings").groupBy("id").agg(F.first("len").alias("len"), F.collect_list("term").alias("terms"))
        new = ids.join(new, "id", "left" if all_stay else "inner").select("id", F.coalesce("len", F.lit(0)).cast("int").alias("len"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), mark)
        new.write.parquet(f"{at}/chunks")
        now = self.spark.read.parquet(f"{at}/chunks").select("len", "terms", F.lit(1).alias("sign"))
        old = self.chunks().join(ids, "id", "left_semi").select("len", "terms", F.lit(-1).alias("sign"))
        self._stats(now.unionByName(old), at)
        self._commit([*self.log, (seq, segment)])

    @staticmethod
    def _stats(rows: DataFrame, at: str) -> None:
        each = rows.select(F.explode(F.concat("terms", F.array(F.lit(ALL)))).alias("term"), "sign", (F.col("sign") * F.col("len")).alias("len"))
        each.groupBy("term").agg(F.sum("sign").alias("df"), F.sum(F.when(F.col("term") == ALL, F.col("len")).otherwise(0)).cast("long").alias("len")).filter("df <> 0 OR len <> 0").write.parquet(f"{at}/stats")

    def compact(self, least: int = 0) -> None:
        """The segments from number `least` on become one, without dead rows. Their tombstones stay while older segments are there."""
        chosen = [(seq, s) for seq, s in self.log if seq >= least]
        rest = [x for x in self.log if x not in chosen]
        if len(chosen) < 2:
            return
        seq = chosen[-1][0]
        segment = f"segment-{seq}-{uuid.uuid4().hex}"
        at = f"{self.path}/{segment}"
        mark = F.lit(seq).alias("seq")
        own = self._table("postings", "id long, term string, tf long, len int, seq int", least)
        self._alive(own).select("id", "term", "tf", "len", mark).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        self.chunks(least).select("id", "len", "terms", mark).write.parquet(f"{at}/chunks")
        gone = self._table("gone", "id long, seq int", least)
        (gone.select("id").distinct() if rest else gone.select("id").limit(0)).select("id", mark).write.parquet(f"{at}/gone")
        stats = self._table("stats", "term string, df long, len long", least)
        stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("len").alias("len")).filter("df <> 0 OR len <> 0").write.parquet(f"{at}/stats")
        self._commit([*rest, (seq, segment)])
