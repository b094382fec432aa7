"""Background work that can be interrupted: attempts that start, commit in time or are taken up again, in batch and as a stream.

An event is a job, a time, a kind (start or commit) and an id. A start opens the job's next attempt. It is committed if the job's next event is a commit,
not later than the limit; else it is to be retried, or has failed if it was the last one allowed. Events of one instant count starts first, then by id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.relational import running

ATTEMPTS = 3
FOUND = "job long, attempt int, started timestamp, state string"


def outcomes(events: DataFrame, limit_s: int, attempts: int = ATTEMPTS) -> DataFrame:
    """job, attempt, started, state (committed, retry, failed) of every start of a table of events (job, id, at, kind).

    Positions within a job are running sums over ranges of events, and the next event is found by its position, so a job with a third of all
    events is spread like any other. Rows with a null job, time or kind have no part. ids tell events of a job apart.
    """
    known = events.filter("job IS NOT NULL AND at IS NOT NULL AND kind IN ('start', 'commit')").select("job", "id", "at", F.when(F.col("kind") == "start", 0).otherwise(1).alias("later"))
    placed = running(known, ["job"], ["at", "later", "id"], {"place": F.lit(1), "attempt": 1 - F.col("later")})
    after = placed.select("job", (F.col("place") - 1).alias("place"), F.col("at").alias("next_at"), F.col("later").alias("next_later"))
    rows = placed.filter("later = 0").join(after, ["job", "place"], "left")
    in_time = (F.col("next_later") == 1) & (F.unix_micros("next_at") <= F.unix_micros("at") + F.lit(limit_s * 1_000_000))
    state = F.when(in_time, "committed").when(F.col("attempt") < attempts, "retry").otherwise("failed")
    return rows.select("job", F.col("attempt").cast("int").alias("attempt"), F.col("at").alias("started"), state.alias("state"))


def outcome_stream(events: DataFrame, limit_s: int, late: str = "10 minutes", attempts: int = ATTEMPTS) -> DataFrame:
    """outcomes() of a stream of events that come up to `late` behind the newest: an attempt is decided once the watermark has passed its limit.

    What is kept of a job are the events since its first open attempt and the number of those decided, in the stream's checkpoint; a run that is
    killed goes on from there. A timer on the first open attempt's limit decides it though no more events of the job come.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, decided = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        if state.hasTimedOut:
            batches = iter(())
        for batch in batches:
            micros = batch["at"].astype("datetime64[us]").astype("int64")
            pending += [[int(t), int(k != "start"), int(i)] for t, k, i in zip(micros, batch["kind"], batch["id"], strict=True)]
        pending.sort()
        passed, limit, out = state.getCurrentWatermarkMs() * 1000, limit_s * 1_000_000, []
        while pending:
            at, later, _ = pending[0]
            if not later:
                if at + limit >= passed:
                    break  # an event in time may still come
                decided += 1
                committed = len(pending) > 1 and pending[1][1] == 1 and pending[1][0] <= at + limit
                out.append((key[0], decided, pd.Timestamp(at, unit="us"), "committed" if committed else "retry" if decided < attempts else "failed"))
            elif at >= passed:
                break  # a start before this commit may still come
            pending.pop(0)
        state.update((json.dumps(pending), decided))
        if pending:
            state.setTimeoutTimestamp(max(pending[0][0] // 1000 + (0 if pending[0][1] else limit_s * 1000), passed // 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["job", "attempt", "started", "state"])

    known = events.filter("job IS NOT NULL AND at IS NOT NULL AND kind IN ('start', 'commit')").select("job", "id", "at", "kind").withWatermark("at", late)
    return known.groupBy("job").applyInPandasWithState(decide, FOUND, "pending string, decided int", "append", "EventTimeTimeout")
