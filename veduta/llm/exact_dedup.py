"""Exact dedup as a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.llm.tables import ascii_lower

#: Sorted runs at the start, and runs merged into one in a round: three binomial steps at once (runs
#: at distance 1, 2 and 4, then 8, 16 and 32, ...), so that RUNS meet after log(RUNS) / log(FAN_IN) rounds.
RUNS, FAN_IN = 512, 8
_KEY = ["text_sha256", "_bytes", "_check"]


def digested(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_sha256, _bytes, _check): SHA-256 of the A-Z folded text and, to verify an equal
    digest, its byte length and an independent 64-bit hash. Null text counts as empty."""
    folded = F.coalesce(ascii_lower(F.col(f"`{text}`")), F.lit(""))
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.sha2(folded.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(folded).alias("_bytes"),
        F.xxhash64(folded).alias("_check"),
    )


def merged_runs(rows: DataFrame, keep=F.max, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per verified digest: key columns, keep_id, group_size.

    Input partitions are dealt to ``runs`` runs. In every round the runs whose numbers agree but for
    the last digit to base ``fan_in`` are merged: each task sorts its part by (digest, run), keeps
    one row per digest and sends it to the task that merges these runs' share of the digests; there
    the sorted parts are merged and reduced again. Identifier and count of a digest form one struct, which
    Spark reduces over sorted rows (SortAggregate), so every partial result is a sorted run.
    A digest reaches a merging task as one row for each part, however many rows carry it, and an
    equal digest counts only with equal length and second hash."""
    value = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id"))
    if keep is F.min:
        value = F.struct(F.col("doc_id").isNull().alias("named"), F.col("doc_id").alias("id"))
    at = rows.select(*_KEY, value.alias("best"), F.lit(1).cast("long").alias("n"), F.pmod(F.spark_partition_id(), F.lit(runs)).cast("int").alias("_run"))
    left = max(2, runs)
    while left > 1:
        left = -(-left // fan_in)
        merged = at.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        at = merged.groupBy(*_KEY, "_run").agg(keep("best").alias("best"), F.sum("n").alias("n"))
    return at.select(*_KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, keep=F.max) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after folding A-Z; null equals empty. The query keeps the
    largest doc_id (``keep=F.max``); ``F.min`` keeps the smallest, as the method has it. A null doc_id is kept only if
    its whole group has none; rows tied on the kept doc_id are all marked. An empty table gives an
    empty result; other columns are ignored. Only digests are shuffled, and only digests of two or
    more rows are joined back."""
    rows = digested(docs)
    groups = merged_runs(rows, keep).where("group_size > 1")
    out = rows.join(groups, _KEY, "left")
    single = F.col("group_size").isNull()
    keep_id: Column = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
