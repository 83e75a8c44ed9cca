"""First, last, best and unique rows of a group; ordered uniqueness.

Each takes an explicit total order: never file order. All are one shuffle on the group key. Where a
group may be hot and only its best row is wanted, ``pick_best`` aggregates before the shuffle
instead of sorting whole groups in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_keyless: bool = False) -> DataFrame:
    """The least row of every key by ``order`` (ascending, nulls first; negate numbers to reverse).

    A map-side combined ``min`` over structs, so a hot key sends one row a task. Rows that tie in
    ``order`` are told apart by their other columns. With ``keep_keyless`` rows that have a null
    key are all kept."""
    keyed, loose = df, None
    if keep_keyless:
        has_key = F.lit(True)
        for k in keys:
            has_key = has_key & F.col(k).isNotNull()
        keyed, loose = df.where(has_key), df.where(~has_key)
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    best = keyed.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    out = best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])
    return out if loose is None else out.unionByName(loose)


def unique_match(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """keys, matches (distinct targets) and the target if it is the only one, else null.

    Pairs are dealt out as they are before repeats go: where few repeat, a table of them in every task that
    reads the rows would grow with the input and save nothing. Pairs of a hot key go to many tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = df.select(*keys, target).repartition(parts, *keys, target).distinct()
    return pairs.groupBy(*keys).agg(F.count(target).alias("matches"), F.min(target).alias("_one")).select(
        *keys, "matches", F.when(F.col("matches") == 1, F.col("_one")).alias(target)
    )


def ordered_unique(c: Column) -> Column:
    """Array without repeats, in the order of first appearance."""
    return F.array_distinct(c)
