"""Bounded, repeatable samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 3. Fold 1 is held out. A null key has fold 0."""
    return (F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3).cast("int")


def held_out(key: Column) -> Column:
    return fold(key) == 1


def bounded_sample(df: DataFrame, by: str, per_class: int, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """At most ``per_class`` rows of every non-null value of ``by``, the ones least by a hash of ``key``.

    Classes of more than twice that number are first thinned to about as much by a threshold on
    the hash, from one count per class, so that no task ever sorts a whole class. Only the counts
    of such classes are broadcast: at most one row for every ``2 * per_class`` rows of ``df``."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = df.where(F.col(by).isNotNull() & F.col(key).isNotNull()).withColumn("_u", u)
    large = rows.groupBy(F.col(by).alias("_class")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * per_class)
    thin = rows.join(F.broadcast(large), F.col(by) == F.col("_class"), "left").where(F.col("_u") * F.coalesce("_n", F.lit(0)) <= 2.0 * per_class + 50)
    first = Window.partitionBy(by).orderBy("_u", key)
    return thin.withColumn("_no", F.row_number().over(first)).where(F.col("_no") <= per_class).drop("_u", "_n", "_no", "_class")
