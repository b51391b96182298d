"""Structured Streaming: incremental ingest by micro-batch, provider alarms, and the sliding rate limit.

State that must outlive a batch is keyed state of Spark's, with timers where time alone changes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.schema import REPEAT_HOURS, STALE_HOURS

HOUR = 3600


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Take all new files, transform each micro-batch, and write it under its own number: a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_changes(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """provider, fetched_at, seq, sha256 of payloads that differ from the provider's payload before, from a stream (provider, fetched_at, seq, sha256). A to B to A are three changes,
    so this is not a plain removal of duplicates.

    Takes all that is new, then ends. Each micro-batch writes its changes and the last hash of each provider under its own number, and starts from the hashes of the batch before: a batch that
    is repeated replaces itself, and a second run with nothing new adds nothing. Within a batch payloads are ordered by time, so that a provider's payloads are sorted, not held.
    """
    fields = "provider string, fetched_at timestamp_ntz, seq long, sha256 string"
    types = {f.name: f.dataType for f in stream.schema.fields}

    def write(batch: DataFrame, number: int) -> None:
        last = spark.read.schema("provider string, sha256 string").parquet(f"{target}/last/batch={number - 1}") if number else spark.createDataFrame([], "provider string, sha256 string")
        batch = batch.select(F.col("provider").cast("string").alias("provider"), "fetched_at", "seq", "sha256")
        before = F.lag("sha256").over(Window.partitionBy("provider").orderBy("fetched_at", "seq"))
        first = F.row_number().over(Window.partitionBy("provider").orderBy("fetched_at", "seq")) == 1
        known = batch.withColumns({"_before": before, "_first": first}).join(last.withColumnRenamed("sha256", "_last"), "provider", "left")
        changed = known.where(~F.col("sha256").eqNullSafe(F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_before"))))
        changed.select("provider", "fetched_at", "seq", "sha256").write.mode("overwrite").parquet(f"{target}/changes/batch={number}")
        now = batch.groupBy("provider").agg(F.max_by("sha256", F.struct("fetched_at", "seq")).alias("sha256"))
        now.unionByName(last.join(now, "provider", "left_anti")).write.mode("overwrite").parquet(f"{target}/last/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = fields if types["fetched_at"].simpleString() == "timestamp_ntz" else fields.replace("timestamp_ntz", "timestamp")
    return spark.read.schema(schema).parquet(f"{target}/changes/*")


def alarms(stream: DataFrame) -> DataFrame:
    """provider, at, notice (stale, still stale, recovered), opened_at: from runs (provider, at, ok) in event time.

    A provider is stale when STALE_HOURS have gone since its last good run; the notice repeats every REPEAT_HOURS while it stays so, and a good
    run closes the alarm. Notices carry the time at which they were due: each run is a clock tick for its provider, and the watermark rings where no run comes. `alarm_history` gives
    the same notices from a table.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good, opened, told = state.get if state.exists else (None, None, None)
        out = []

        def tick(at: float) -> None:
            nonlocal opened, told
            while good is not None and (due := good + STALE_HOURS * HOUR if told is None else told + REPEAT_HOURS * HOUR) <= at:
                opened = due if opened is None else opened
                out.append((key[0], due, "stale" if told is None else "still stale", opened))
                told = due

        if state.hasTimedOut:
            tick(state.getCurrentWatermarkMs() / 1000)
        else:
            for row in pd.concat(list(frames)).sort_values("at").itertuples():
                at = row.at.timestamp()
                good = at if good is None else good
                tick(at)
                if row.ok and at >= good:
                    if opened is not None:
                        out.append((key[0], at, "recovered", opened))
                    good, opened, told = at, None, None
        state.update((good, opened, told))
        due = (good if told is None else told) + (STALE_HOURS if told is None else REPEAT_HOURS) * HOUR
        state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        stamp = lambda s: pd.Timestamp(s, unit="s")
        yield pd.DataFrame([(p, stamp(a), n, stamp(o)) for p, a, n, o in out], columns=["provider", "at", "notice", "opened_at"])

    marked = stream.withWatermark("at", "1 hour")
    return marked.groupBy("provider").applyInPandasWithState(step, "provider string, at timestamp, notice string, opened_at timestamp", "good double, opened double, told double", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(stream: DataFrame, limit: int, seconds: int) -> DataFrame:
    """user, at, allowed: at most `limit` allowed hits of a user in the last `seconds`; rejected hits count for nothing. `limits.rate_limited` says the same of a table."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("at")
        allowed = []
        for at in rows["at"]:
            now = at.timestamp()
            kept = [t for t in kept if now - t < seconds]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(now)
        state.update((kept,))
        yield rows[["user", "at"]].assign(allowed=allowed)

    return stream.groupBy("user").applyInPandasWithState(step, "user long, at timestamp, allowed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Events per window and type, final once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
