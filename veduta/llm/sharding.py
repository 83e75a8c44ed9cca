"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.llm.tables import without

#: Sub-ranges in which slots of a shard are numbered independently of each other.
SLOT_RANGES = 1024


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score ``-ln(u(key, shard)) / weight`` is least.

    ``u`` is uniform in (0, 1) from a 64-bit hash of key and shard number, so every shard is chosen
    with probability in proportion to its weight, and appending a shard moves a key only if the
    new shard's score is the least, i.e. only into it. A null key is a key like any other; a shard
    of weight 0 is never chosen; ties (of probability 2**-53) go to the lower shard."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and one of them positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((-F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))["shard"]


def with_shards(df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Adds ``shard`` (and ``grown_shard``, the shard under ``grown_weights``). No shuffle.

    Existing columns of these names are replaced."""
    df = without(df, "shard", "grown_shard") if grown_weights else without(df, "shard")
    out = df.withColumn("shard", rendezvous_shard(F.col(f"`{key}`"), weights))
    return out.withColumn("grown_shard", rendezvous_shard(F.col(f"`{key}`"), grown_weights)) if grown_weights else out


def with_slots(df: DataFrame, key: str, order: Sequence[str], ranges: int = SLOT_RANGES) -> DataFrame:
    """Numbers the rows of every ``shard`` gaplessly from 0 as ``slot``.

    A shard is cut into ``ranges`` hash ranges of key and ``order``; rows are numbered inside a range
    and offset by the sizes of the ranges before it, so no task holds a whole shard, and rows
    without a key spread by their other columns. The table of range sizes has at most shards x
    ``ranges`` rows, which bounds what is broadcast. Rows equal in key and ``order`` are numbered
    in any order; an empty table gives none. An existing column ``slot`` is replaced."""
    df = without(df, "slot", "_range", "_before")
    ranged = df.withColumn("_range", F.pmod(F.xxhash64(F.lit("slot"), F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in order]), F.lit(ranges)).cast("int"))
    sizes = ranged.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_range").orderBy(F.col(f"`{key}`").asc_nulls_first(), *[F.col(f"`{c}`").asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    placed = numbered.join(F.broadcast(offsets), ["shard", "_range"])
    return placed.withColumn("slot", F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: where it goes under law ``key``, and where with one more shard.

    doc_id, size (UTF-8 bytes of text plus 8; null text: 8), text_crc32 (unsigned; null text: 0),
    law, shard, slot, grown_shard. Only ids, sizes and checksums are shuffled, never texts. Repeated
    rows get slots of their own; null doc_ids share a shard, as law ``key`` asks."""
    text = F.col("text").cast("binary")
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = with_slots(with_shards(thin, "doc_id", [1.0] * shards, [1.0] * (shards + 1)), "doc_id", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
