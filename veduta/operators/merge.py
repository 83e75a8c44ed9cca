"""Changes to stored relations as pure plans, and an atomic replacement of a stored table.

Parquet has no MERGE: a change is the new content, made of joins on the key, and written beside the
old content before the two are swapped."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` replace target rows of the same key; others stay. Keys are unique in source."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def inserted(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``source`` whose key ``target`` lacks: what insert-or-ignore adds and returns."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(inserted(target, source, keys), allowMissingColumns=True)


def patched(target: DataFrame, patch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Target with ``columns`` overwritten where the patch has a non-null value; no row comes or goes."""
    renamed = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(renamed, list(keys), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def deleted(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target without the rows whose key ``doomed`` holds."""
    return target.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def replace_groups(target: DataFrame, desired: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every group that ``desired`` mentions is replaced whole by its desired rows; others stay."""
    return deleted(target, desired, group).unionByName(desired)


def replace_set(target: DataFrame, desired: DataFrame, keys: Sequence[str], replaceable: Column) -> DataFrame:
    """Upserts ``desired`` and drops the replaceable target rows that it does not hold."""
    kept = target.where(~F.coalesce(replaceable, F.lit(False)))
    return upsert(kept, desired, keys)


def set_difference(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Rows in one relation only, with ``side`` telling which; empty if the sets are equal."""
    a, b = left.subtract(right), right.subtract(left)
    return a.withColumn("side", F.lit(names[0])).unionByName(b.withColumn("side", F.lit(names[1])))


def swap_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Writes ``df`` beside ``path``, reads it back for ``check``, then puts it in the path's place.

    ``df`` may read ``path`` itself. If writing, checking or either renaming fails, the old content is
    at ``path`` as before; it is deleted only once the new content is there."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, fresh, old = (hadoop.Path(path + s) for s in ("", ".fresh", ".old"))
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old):
        if files.exists(here):
            files.delete(old, True)  # left by a run that ended after its swap
        elif not files.rename(old, here):  # left by a run that ended amid its swap
            raise OSError(f"cannot restore {path}")
    df.write.mode("overwrite").parquet(path + ".fresh")
    if check:
        check(spark.read.parquet(path + ".fresh"))
    replaces = files.exists(here)
    if replaces and not files.rename(here, old):
        raise OSError(f"cannot set {path} aside")
    if not files.rename(fresh, here):
        if replaces and not files.rename(old, here):
            raise OSError(f"cannot put {path} in place; its old content is at {path}.old")
        raise OSError(f"cannot put {path} in place")
    files.delete(old, True)


def guard_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: its name and the number of offending rows (0 passes)."""
    out: DataFrame | None = None
    for name, offenders in checks.items():
        one = offenders.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check_name"), "offenders")
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out


def assert_guards(report: DataFrame) -> None:
    """Raises if a check of a guard report has offenders. The report has one row per check."""
    failed = [(r["check_name"], r["offenders"]) for r in report.where("offenders > 0").collect()]
    if failed:
        raise ValueError(f"guards failed: {failed}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent has; null keys are not orphans."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
