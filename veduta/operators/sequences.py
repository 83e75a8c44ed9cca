"""Order-dependent logic over rows of a page, user or event, as window expressions.

Windows are partitioned by the sequence; a sequence is a page, a programme or a user's history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _in_order(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return _in_order(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column], when: Column, value: Column, into: str) -> DataFrame:
    """``value`` of the last row so far for which ``when`` holds. A null value there resets the carry."""
    wrapped = F.when(when, F.struct(value.alias("v")))
    return df.withColumn(into, F.last(wrapped, ignorenulls=True).over(_so_far(keys, order))["v"])


def stable_positions(df: DataFrame, keys: Sequence[str], position: Sequence[str], tie: Sequence[Column], counts: Column) -> DataFrame:
    """``stable_order``: dense rank of the rows that count, over distinct positions; ``primary`` marks
    the first row at a position. Rows that do not count have null and false."""
    ranked = df.withColumn("_counts", counts)
    own = Window.partitionBy(*keys, "_counts").orderBy(*position)
    at = Window.partitionBy(*keys, "_counts", *position).orderBy(*tie)
    return (
        ranked.withColumn("stable_order", F.when(F.col("_counts"), F.dense_rank().over(own)))
        .withColumn("primary", F.col("_counts") & (F.row_number().over(at) == 1))
        .drop("_counts")
    )


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column, into: str) -> DataFrame:
    """Numbers runs of rows: a run begins where ``starts`` holds. Rows before the first are run 0."""
    return df.withColumn(into, F.sum(F.when(starts, 1).otherwise(0)).over(_so_far(keys, order)))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """``session_no`` from 0 per key: a gap of ``gap_seconds`` or more begins a new one."""
    before = F.lag(ts).over(_in_order([key], [F.col(ts)]))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    marked = df.withColumn("_new", F.coalesce(seconds >= gap_seconds * 1_000_000, F.lit(False)).cast("int"))
    return marked.withColumn("session_no", F.sum("_new").over(_so_far([key], [F.col(ts)]))).drop("_new")


def running_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str, budget: int) -> DataFrame:
    """``spent_before`` and ``accepted``: rows are accepted while what came before stays below the budget."""
    w = _in_order(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return df.withColumn("spent_before", spent).withColumn("accepted", F.col("spent_before") < budget)


def round_robin(df: DataFrame, key: str, order: Column, start: int) -> DataFrame:
    """``turn``: place of every row when the ordered list is entered at index ``start`` and wraps.

    For the short list of sources: the window is not partitioned."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    index = F.row_number().over(Window.orderBy(order, key)) - 1
    return df.withColumn("turn", F.pmod(index - start, n).cast("int"))


def anchored_sizes(sorted_values: Column, gap: float) -> Column:
    """Sizes of the groups of a sorted array of doubles: a group takes the values within ``gap`` of its
    first one. (Sessions differ: there the gap counts from the last value.) Only where a group ends is
    anything appended."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ends = acc["anchor"].isNotNull() & (x - acc["anchor"] > gap)
        begins = ends | acc["anchor"].isNull()
        out = F.when(ends, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"])
        return F.struct(F.when(begins, x).otherwise(acc["anchor"]).alias("anchor"), F.when(begins, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), out.alias("out"))

    return F.aggregate(sorted_values, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(none))


def anchored_groups(sorted_values: Column, gap: float) -> Column:
    """Group number of every value of a sorted array, by ``anchored_sizes``."""
    return F.flatten(F.transform(anchored_sizes(sorted_values, gap), lambda n, i: F.array_repeat(i, n)))


def most_common(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: its most common ``value``, of equally common ones the one seen first by ``order``,
    and ``rows``, the number of its rows. Two aggregations, both combined before their exchange."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"), F.col(value).alias("value")))
    return counts.groupBy(key).agg(best["value"].alias(value), F.sum("_n").alias("rows"))
