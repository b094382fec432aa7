"""Interrupted work in batch and as a stream, and pages of ordered rows."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest

from gleaner.operators.relational import OrderedPages
from gleaner.streaming import ingest, work

START = datetime(2024, 1, 1)
SCHEMA = "job long, id long, at timestamp, kind string"


def events(seed, n=150):
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.3 else rng.randint(2, 9), i, START + timedelta(seconds=rng.randint(0, 4000)), rng.choice(["start", "start", "commit"])) for i in range(n)]


def brute(rows, limit, attempts=3):
    out = set()
    for job in {r[0] for r in rows}:
        own = sorted((at, kind != "start", i) for j, i, at, kind in rows if j == job)
        n = 0
        for k, (at, later, _) in enumerate(own):
            if not later:
                n += 1
                good = k + 1 < len(own) and own[k + 1][1] and own[k + 1][0] <= at + timedelta(seconds=limit)
                out.add((job, n, at, "committed" if good else "retry" if n < attempts else "failed"))
    return out


def test_outcomes_against_brute_force(spark):
    rows = events(1)
    odd = [(None, 900, START, "start"), (3, 901, None, "start"), (3, 902, START, "other"), (3, 903, START, None)]
    got = work.outcomes(spark.createDataFrame(rows + odd, SCHEMA), 120).collect()
    assert {tuple(r) for r in got} == brute(rows, 120) and len(got) == sum(r[3] == "start" for r in rows)
    assert work.outcomes(spark.createDataFrame([], SCHEMA), 120).count() == 0


def test_a_stream_that_is_killed_equals_the_batch(spark, tmp_path):
    """Files in order of time, one each micro-batch; the stream is stopped after some of them and started again."""
    rows = sorted(events(2, 90), key=lambda r: r[2])
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    far = [(-1, 10_000 + k, START + timedelta(days=1 + k), "commit") for k in range(2)]
    parts = [rows[k : k + 15] for k in range(0, len(rows), 15)] + [[f] for f in far]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)

    def stream():
        read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return work.outcome_stream(read, 120, "1 minute")

    first = stream().writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", kept).trigger(processingTime="0 seconds").start()
    until = time.time() + 100
    while time.time() < until and (first.lastProgress is None or first.lastProgress["batchId"] < 1):
        time.sleep(0.1)
    first.stop()
    done = {tuple(r) for r in spark.read.schema(work.FOUND).parquet(out).collect()}
    assert done < brute(rows, 120)
    ingest.to_table(stream(), out, kept).awaitTermination(200)
    got = [tuple(r) for r in spark.read.schema(work.FOUND).parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 120)


@pytest.mark.parametrize("number, size", [(1, 10), (7, 3), (50, 10), (100, 10), (101, 10), (0, 10), (-5, 4), (10**9, 7), (3, 5000)])
def test_any_page(spark, pages, number, size):
    whole = sorted((-((i * 7919 % 1000) // 3), i) for i in range(1000))
    last = -(-1000 // size)
    at = (min(max(1, number), last) - 1) * size
    assert [(-r.v, r.id) for r in pages.page(number, size).collect()] == whole[at : at + size]


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, (i * 7919 % 1000) // 3) for i in range(1000)], "id long, v long")
    return OrderedPages(rows, F.col("v").desc(), F.col("id"), ranges=20)


def test_a_page_reads_its_ranges_only(pages):
    deep = pages.page(90, 10)
    assert deep.inputFiles()
    assert len(pages.counts) == 20 and max(pages.counts.values()) < 200
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan


def test_no_rows_have_an_empty_page(spark):
    from pyspark.sql import functions as F

    assert OrderedPages(spark.createDataFrame([], "id long"), F.col("id")).page(3, 10).count() == 0
