"""Words with positions read as lines, columns and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.operators.sequences import anchored_groups


def words_to_lines(words: DataFrame, page: str, x: str, y: str, tolerance: float = 1.4) -> DataFrame:
    """Words with ``line``, their line's number on the page from 0: a line begins with its topmost word and holds
    the words up to ``tolerance`` below it.

    Distinct heights of a page, not its words, form the array that is grouped."""
    heights = words.groupBy(page).agg(F.array_sort(F.collect_set(F.col(y).cast("double"))).alias("_h"))
    grouped = heights.select(page, F.inline(F.arrays_zip(F.col("_h").alias("_y"), anchored_groups(F.col("_h"), tolerance).alias("line"))))
    return words.withColumn("_y", F.col(y).cast("double")).join(grouped, [page, "_y"]).drop("_y")


def in_columns(words: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """Words with ``column``: how many of the ascending ``edges`` are at or left of them."""
    column = sum((F.when(F.col(x) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return words.withColumn("column", column.cast("int"))


def line_texts(words: DataFrame, page: str, x: str, text: str, size: str) -> DataFrame:
    """(page, column, line, text, size): the words of a line within a column from left to right, and their largest size."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(x), F.col(text).alias("_t"))))
    return words.groupBy(page, "column", "line").agg(F.array_join(F.transform(ordered, lambda w: w["_t"]), " ").alias("text"), F.max(size).alias("size"))


def carried_labels(lines: DataFrame, page: str, is_label: Column) -> DataFrame:
    """Lines that are no labels with ``label``, the last one above them in their column (null: none)."""
    above = Window.partitionBy(page, "column").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    labelled = lines.withColumn("_is", is_label).withColumn("label", F.last(F.when(F.col("_is"), F.col("text")), ignorenulls=True).over(above))
    return labelled.where(~F.col("_is")).drop("_is")
