"""Streaming twins of the runtime state: job stages, sessions, latest revisions, retention and funnels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Stages in order; the last three end a job.
STAGES = ["queued", "analyzing", "planning", "generating", "validating", "evaluating", "completed", "failed", "cancelled"]
TERMINAL = frozenset(STAGES[-3:])


def advance(stage: int, ended: bool, events: list[str]) -> tuple[int, bool, list[str]]:
    """Stage after events: only forward, one terminal stage, nothing after it; and the events that took effect."""
    taken = []
    for e in events:
        if ended or e not in STAGES:
            continue
        n = STAGES.index(e)
        if e in TERMINAL or n > stage:
            stage, ended = n, e in TERMINAL
            taken.append(e)
    return stage, ended, taken


def job_stages(events: DataFrame, timeout: str = "PT30S") -> DataFrame:
    """(job, stage, ended, expired) updates of a stream (job, ts, event). A job without events for the processing-time
    timeout is failed once. State per job is two numbers.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, ended = state.get if state.exists else (-1, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield pd.DataFrame([(key[0], "failed", True, True)], columns=["job", "stage", "ended", "expired"])
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        stage, ended, taken = advance(stage, ended, rows["event"].tolist())
        state.update((stage, ended))
        state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        if taken:
            yield pd.DataFrame([(key[0], STAGES[stage], ended, False)], columns=["job", "stage", "ended", "expired"])

    return events.groupBy("job").applyInPandasWithState(
        run, "job string, stage string, ended boolean, expired boolean", "stage int, ended boolean", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def session_stream(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of an event stream, closed when the watermark passes their gap; later rows than ``late`` are dropped."""
    w = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest_stream(revisions: DataFrame, key: str, revision: str, value: str) -> DataFrame:
    """The value of the highest revision per key, updated as rows arrive; older revisions that arrive late change nothing."""
    return revisions.groupBy(key).agg(F.max_by(value, revision).alias(value), F.max(revision).alias(revision))


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def append_to(df: DataFrame, path: str, checkpoint: str):
    """Run a stream over all that is available now and append each batch to a Parquet table; returns the finished query."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    # state with processing-time timeouts would otherwise ask for empty batches for ever
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
