"""Generated SQL scripts that change a table behind guards, and scripts that validate it afterwards.

A script is a compound statement for ``spark.sql``. Guards raise before anything is written, and what is written
is built beside the target and checked before it takes the target's place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(c: Column) -> Column:
    """A value as SQL text: numbers as they are, other values quoted, null as NULL."""
    text = c.cast("string")
    quoted = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(quoted)


def number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def _guard(condition: str, message: str) -> str:
    return f"IF {condition} THEN SELECT raise_error('{message}'); END IF;"


def apply_script(target: str, staged: str, keys: Sequence[str], columns: Sequence[str], baseline: int, guards: Mapping[str, str] | None = None) -> str:
    """The script that merges ``staged`` into ``target`` by ``keys``: staged rows replace those of equal keys.

    Before: the target has ``baseline`` rows, staged keys are whole and unique, and each of ``guards`` (a query by
    name) gives no row. After: no key is lost or twice, and every staged row is there. If any check
    fails, the script raises and the target is as it was."""
    key, every = ", ".join(keys), ", ".join([*keys, *columns])
    same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    new = f"{target}_new"
    before = [
        _guard(f"(SELECT count(*) FROM {target}) <> {baseline}", f"baseline: {target} should have {baseline} rows"),
        _guard(f"EXISTS (SELECT 1 FROM {staged} WHERE {' OR '.join(f'{k} IS NULL' for k in keys)})", "staged: missing key"),
        _guard(f"EXISTS (SELECT 1 FROM {staged} GROUP BY {key} HAVING count(*) > 1)", "staged: key twice"),
        *[_guard(f"EXISTS ({rows})", f"guard: {name}") for name, rows in (guards or {}).items()],
    ]
    after = [
        _guard(f"EXISTS (SELECT 1 FROM {new} GROUP BY {key} HAVING count(*) > 1)", "result: key twice"),
        _guard(f"EXISTS (SELECT {key} FROM {target} EXCEPT SELECT {key} FROM {new})", "result: key lost"),
        _guard(f"EXISTS (SELECT {every} FROM {staged} EXCEPT SELECT {every} FROM {new})", "result: staged row missing"),
    ]
    build = f"CREATE TABLE {new} USING parquet AS SELECT {every} FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {staged} s WHERE {same}) UNION ALL SELECT {every} FROM {staged};"
    return "\n".join(["BEGIN", *before, f"DROP TABLE IF EXISTS {new};", build, *after, f"INSERT OVERWRITE {target} SELECT {every} FROM {new};", f"DROP TABLE {new};", "END"])


def validate_script(target: str, checks: Mapping[str, str], report: str = "script_report") -> str:
    """A script whose result is (check_name, offenders) for queries of offending rows by name.

    Every check runs, whatever the others find; the rows go to the temporary view ``report``."""
    parts = [f"SELECT '{name}' AS check_name, count(*) AS offenders FROM ({rows})" for name, rows in checks.items()]
    return "\n".join(["BEGIN", f"CREATE OR REPLACE TEMPORARY VIEW {report} AS", " UNION ALL ".join(parts) + ";", f"SELECT * FROM {report};", "END"])


def row_scripts(rows: DataFrame, group: str, target: str, columns: Mapping[str, Column], order: Sequence[str], expected: str) -> DataFrame:
    """(group, rows, script): per group the script that inserts its rows into ``target``.

    It raises unless the target has as many rows of the group as column ``expected`` says, and unless all rows are
    there afterwards. ``columns`` are the target's, the group first, as SQL text."""
    values = F.concat(F.lit("("), F.concat_ws(", ", *columns.values()), F.lit(")"))
    sorted_values = F.transform(F.sort_array(F.collect_list(F.struct(*order, values.alias("_v")))), lambda x: x["_v"])
    grouped = rows.groupBy(group).agg(F.array_join(sorted_values, ", ").alias("_values"), F.count(F.lit(1)).alias("rows"), F.max(expected).alias("_n"))
    name, at = F.col(group).cast("string"), next(iter(columns))
    check = lambda n, what: F.concat(F.lit(f"IF (SELECT count(*) FROM {target} WHERE {at} = "), name, F.lit(") <> "), n.cast("string"), F.lit(f" THEN SELECT raise_error('{what} "), name, F.lit("'); END IF; "))
    insert = F.concat(F.lit(f"INSERT INTO {target} ({', '.join(columns)}) VALUES "), F.col("_values"), F.lit("; "))
    script = F.concat(F.lit("BEGIN "), check(F.col("_n"), "before"), insert, check(F.col("_n") + F.col("rows"), "after"), F.lit("END"))
    return grouped.select(group, "rows", script.alias("script"))
