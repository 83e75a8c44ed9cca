"""An ingestion run in one pass: sound rows, quarantined rows and the run's counters from one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """array<string>: names of the rules that a row breaks; a null condition is not broken."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def run_ingestion(rows: DataFrame, source: str, rules: Mapping[str, Column], path: str, counters: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sound rows, quarantined rows with ``errors``, counters) of a run written under ``path``.

    The rows are scanned once: they are written to two partitions of one table while an observation counts
    all, sound and quarantined rows, each rule's offenders (``bad_<rule>``) and ``counters`` (conditions, over sound rows).
    What was written is then read for each part alone."""
    judged = rows.withColumn("errors", broken_rules(rules)).withColumn("quarantined", F.size("errors") > 0)
    sound = ~F.col("quarantined")
    counts = {"records": F.count(F.lit(1)), "sound": F.count_if(sound), "quarantined": F.count_if("quarantined")}
    counts |= {f"bad_{name}": F.count_if(F.array_contains("errors", name)) for name in rules}
    counts |= {name: F.count_if(sound & condition) for name, condition in (counters or {}).items()}
    observation = Observation()
    judged.observe(observation, *[c.alias(n) for n, c in counts.items()]).write.partitionBy("quarantined").parquet(path)
    written = rows.sparkSession.read.schema(judged.schema).parquet(path)
    return written.where(sound).select(*rows.columns), written.where("quarantined").select(*rows.columns, "errors"), {n: observation.get[n] for n in counts}


def source_verdicts(sound: DataFrame, quarantined: DataFrame, source: str) -> DataFrame:
    """One row per source: sound and quarantined rows, and READY (nothing lost), PARTIAL or FAILED (nothing sound)."""
    both = sound.select(source, F.lit(1).alias("_s"), F.lit(0).alias("_q")).unionByName(quarantined.select(source, F.lit(0).alias("_s"), F.lit(1).alias("_q")))
    counted = both.groupBy(source).agg(F.sum("_s").alias("sound"), F.sum("_q").alias("quarantined"))
    verdict = F.when(F.col("sound") == 0, "FAILED").when(F.col("quarantined") > 0, "PARTIAL").otherwise("READY")
    return counted.withColumn("verdict", verdict)
