"""Lookups and states of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi_unless_empty(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` has, text keys in any case; all rows if ``right`` is empty.

    The emptiness of ``right`` is one aggregated row, found in the same job."""
    text = {c for c, t in left.dtypes if t == "string"}
    fold = lambda c: F.lower(c) if c in text else F.col(c)
    folded = right.select(*[fold(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_hit", F.lit(True))
    marked = left.join(folded, [fold(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], "left")
    none = right.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return marked.join(F.broadcast(none), F.lit(True)).where(F.col("_none") | F.col("_hit")).select(*left.columns)


def city_filled(rows: DataFrame, directory: DataFrame, name: str, value: str) -> DataFrame:
    """``value`` looked up by ``name`` in any case, for rows that have none; the directory's least value
    counts where it lists a name twice."""
    listed = directory.groupBy(F.lower(name).alias("_name")).agg(F.min(value).alias("_listed"))
    missing, whole = rows.where(F.col(value).isNull()), rows.where(F.col(value).isNotNull())
    filled = missing.join(listed, F.lower(name) == F.col("_name"), "left").withColumn(value, F.col("_listed")).select(*rows.columns)
    return whole.unionByName(filled)


def transitions(actions: DataFrame, key: str, order: Sequence[str], action: str, touch: str, guarded: str, start: str) -> DataFrame:
    """One row per ``key``: its status after all actions in ``order``, ``needs_reconfirmation``, actions.

    Any action but ``touch`` sets the status. A touch while the status is ``guarded`` asks for
    reconfirmation, which the next ``guarded`` action settles; the status itself stays. Only the last
    touch, the last guarded and the last other action matter, so three maxima replace a walk."""
    at = F.struct(*order)
    sets = F.max(F.when(F.col(action) != touch, F.struct(*order, action)))
    last = lambda what: F.max(F.when(F.col(action) == what, at))
    before = actions.groupBy(key).agg(sets.alias("_set"), last(guarded).alias("_guard"), F.count(F.lit(1)).alias("actions"))
    # The first status change after the last guarded action ends the time in which touches count.
    after = actions.join(before.select(key, "_guard"), key).where(F.col("_guard").isNotNull() & (at > F.col("_guard")))
    ends = after.groupBy(key).agg(F.min(F.when(F.col(action) != touch, at)).alias("_end"), F.min(F.when(F.col(action) == touch, at)).alias("_touch"))
    out = before.join(ends, key, "left")
    needs = F.col("_touch").isNotNull() & (F.col("_end").isNull() | (F.col("_touch") < F.col("_end")))
    return out.select(key, F.coalesce(F.col("_set")[action], F.lit(start)).alias("status"), F.coalesce(needs, F.lit(False)).alias("needs_reconfirmation"), "actions")
