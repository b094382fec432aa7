"""Filters, lookups, latest-per-key, exclusive flags, numbering and desired-state comparison on any DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.session import checkpointed, shared_folder, written


def in_list(c: Column, allowed: list | None) -> Column:
    """None allows everything, an empty list nothing."""
    if allowed is None:
        return F.lit(True)
    return c.isin(allowed) if allowed else F.lit(False)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that were asked for; None is one that was not."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def once(rows: DataFrame, inputs: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that `read` adds to a table of `inputs`, which is made once for each different combination of them.

    For work that costs more than a shuffle of its inputs (texts, not doubles): copies are read once, and the work is dealt over all tasks whatever
    the row groups of the files. The number of tasks is given, else small texts would be merged for a single task by their bytes, which say nothing of
    the work. What is read is written first, so that few different inputs are sent to the rows and none of those is shuffled."""
    different = rows.select(*inputs).distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism)
    found = written(read(different), "read")
    added = [c for c in found.columns if c not in inputs]
    keys = {c: f"_{c}_read" for c in inputs}
    found = found.select(*[F.col(c).alias(k) for c, k in keys.items()], *added)
    return rows.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])).drop(*keys.values())


def dealt(rows: DataFrame, keys: list[str], groups: int, share: int = 500_000) -> DataFrame:
    """rows in tasks by the hash of the keys, so many that of `groups` (rows or groups that will be made of them) some `share` fall to each.

    For aggregates that hardly make rows fewer, whose memory is that of the groups of a task: what follows by these keys, or by more, is aggregated where
    it is. The number of tasks is given, so that they are not merged by their bytes, of which such rows have few."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-groups // share)), *keys)


def contains_any(needle: Column | str, *columns: Column) -> Column:
    """Whether a text occurs in any of the columns, whatever the case; an empty one occurs everywhere."""
    wanted = F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    return reduce(or_, [F.coalesce(F.contains(F.lower(c), wanted), F.lit(False)) for c in columns])


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """df with the value that names (key, value) has for its key, or the default."""
    return df.join(names.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 where there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def nested(parents: DataFrame, children: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, sorted by the columns."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key, "left")


def ambiguous_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys that are not unique, and how often they occur."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def exactly_one(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted keys with the number of rows found and a state: ok, missing or ambiguous."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return wanted.join(counts, keys, "left").withColumn("n", n).withColumn("state", F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "missing").otherwise("ambiguous"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order. The window group limit keeps one row per key and task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def recent(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key by the order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def next_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def one_hot(df: DataFrame, keys: list[str], chosen: Column, *order: Column) -> DataFrame:
    """df with `active`: set on the chosen row of each key that comes first by the order, and cleared on all others.

    The winner is a grouped minimum that is joined back, so a key with very many rows never meets in one task.
    """
    rank = F.struct(*order)
    best = df.filter(chosen).groupBy(*keys).agg(F.min(rank).alias("_best"))
    return df.join(best, keys, "left").withColumn("active", F.coalesce(chosen & (rank == F.col("_best")), F.lit(False))).drop("_best")


def first_of_key(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, the least by the columns; replays of a key return what was stored first."""
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("_f")).select(key, "_f.*")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums, within each key and by the order columns, of whole numbers.

    Rows are range partitioned by key and order, so a key with a third of all rows lies in many partitions. Sums run
    within each of them and are shifted by the sums of the partitions before, a table of a row per key and partition. The
    checkpoint fixes the ranges; it is written to the shared folder of the session.
    """
    marked = df.select("*", *[c.cast("long").alias(f"_v_{name}") for name, c in sums.items()])
    ranged = checkpointed(marked.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_r_{n}") for n in sums]).join(shifts, same)
    return totals.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """df with the position (from 1) of each row within its key by the order columns, which are unique there."""
    return running(df, keys, order, {name: F.lit(1)})


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1; below that the first) of the ordered rows: a top-k of the cluster, for the first pages. See OrderedPages for pages far
    behind, whose rows before would all meet in one task."""
    start = (max(1, number) - 1) * size
    return df.orderBy(*order).limit(start + size).orderBy(*order).offset(start)


class OrderedPages:
    """Ordered rows in range partitions on disk, any page of which is read from the partitions that hold it.

    The rows are ranged and written once, in a folder for each range, with the count of each; a page far behind costs as little as the
    first. The order columns tell rows apart, else rows that tie may come on either of two pages. Page numbers below 1 are the first, beyond the end the last.
    """

    def __init__(self, df: DataFrame, *order: Column, ranges: int | None = None):
        """ranges: in how many parts the rows are cut, the session's shuffle partitions if not given; a page sorts a part or two."""
        self.order, self.spark, self.schema = order, df.sparkSession, df.schema
        self.path = shared_folder(df.sparkSession, "pages")
        count = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(self.path)
        self.counts = {r["_range"]: r["n"] for r in self._rows().groupBy("_range").agg(F.count("*").alias("n")).collect()}
        self.total = sum(self.counts.values())

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("_range", IntegerType())])).parquet(self.path)

    def page(self, number: int, size: int) -> DataFrame:
        number = min(max(1, number), max(1, -(-self.total // size)))
        start = (number - 1) * size
        before, ranges, skipped = 0, [], 0
        for part in sorted(self.counts):
            if before + self.counts[part] > start and before < start + size:
                skipped = skipped if ranges else before
                ranges.append(part)
            before += self.counts[part]
        rows = self._rows().filter(F.col("_range").isin(ranges) if ranges else F.lit(False)).drop("_range")
        return rows.orderBy(*self.order).limit(start - skipped + size).orderBy(*self.order).offset(start - skipped)


def changes(current: DataFrame, desired: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action: create, update, keep or delete; fields are compared null-safely."""
    a = current.select(key, F.struct(*fields).alias("_now"))
    b = desired.select(key, F.struct(*fields).alias("_then"))
    action = F.when(F.col("_now").isNull(), "create").when(F.col("_then").isNull(), "delete").when(F.col("_now").eqNullSafe(F.col("_then")), "keep").otherwise("update")
    return a.join(b, key, "full").select(key, action.alias("action"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming, and those of current that it has no key for."""
    return incoming.unionByName(current.join(incoming.select(*keys).distinct(), keys, "left_anti"))


def same_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, n_a, n_b, equal: the reconciliation of two copies of a table."""
    x, y = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((a, "n_a"), (b, "n_b")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.join(y, key, "full").select(key, zero("n_a"), zero("n_b"), F.col("n_a").eqNullSafe(F.col("n_b")).alias("equal"))
