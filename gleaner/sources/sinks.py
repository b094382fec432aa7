"""Writers: nested JSON, compressed dumps, copies between databases with reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.relational import same_counts


def write_json(rows: DataFrame, path: str, compress: bool = False) -> None:
    """One JSON object per row, in as many files as the rows have partitions."""
    rows.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as compressed JSON under path/name."""
    for name, rows in tables.items():
        write_json(rows, f"{path}/{name}", compress=True)


def copy_table(spark: SparkSession, name: str, source: dict[str, str], target: dict[str, str], partition: str | None = None, low: int = 0, high: int = 0, parts: int = 8) -> None:
    """Copies a table over JDBC. source and target: url, driver, user and the like. partition: a numeric column that
    reads are split by, between low and high."""
    split = {"partitionColumn": partition, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)} if partition else {}
    rows = spark.read.format("jdbc").options(dbtable=name, **source, **split).load()
    rows.write.format("jdbc").options(dbtable=name, **target).mode("append").save()


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys whose row counts differ between two copies of a table."""
    return same_counts(a, b, key).filter("NOT equal")
