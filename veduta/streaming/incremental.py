"""The incremental feed on Structured Streaming: new urls, quotas, windows and sessions.

Every function maps a streaming (or batch) DataFrame to one; state is bounded by the watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.functions.urls import canonical_url


def new_urls(stream: DataFrame, url: str, ts: str, memory: str = "1 day") -> DataFrame:
    """First appearance of every canonical url; a url is remembered for ``memory``."""
    named = stream.withColumn("canonical", canonical_url(F.col(url))).where("canonical is not null")
    return named.withWatermark(ts, memory).dropDuplicatesWithinWatermark(["canonical"])


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per window and key; a window closes when the watermark passes it."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, ts: str, width: str, step: str, late: str, *keys: str) -> DataFrame:
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def user_sessions(stream: DataFrame, ts: str, user: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user that end after a quiet ``gap``."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_quota(stream: DataFrame, user: str, ts: str, limit: int) -> DataFrame:
    """Rows with ``accepted``: the first ``limit`` of a user and day, counted across micro-batches.

    The state is one counter per user and day; it goes a day after the day's end."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values(ts)
            rows["accepted"] = [used + i < limit for i in range(len(rows))]
            used += len(rows)
            yield rows[[user, "day", ts, "accepted"]]
        state.update((used,))
        after = (pd.Timestamp(key[1]) + pd.Timedelta(days=2)).timestamp() * 1000
        state.setTimeoutTimestamp(max(int(after), state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark(ts, "1 day").select(user, F.to_date(ts).alias("day"), ts)
    kind = rows.schema[user].dataType.simpleString()
    schema = f"{user} {kind}, day date, {ts} timestamp, accepted boolean"
    return rows.groupBy(user, "day").applyInPandasWithState(count, schema, "used long", "append", "EventTimeTimeout")


def merge_sink(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges every micro-batch into the table at ``path``.

    With a merge that is idempotent (upsert, insert-or-ignore) a repeated batch changes nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        write(merge(spark.read.parquet(path), batch), path)

    return sink
