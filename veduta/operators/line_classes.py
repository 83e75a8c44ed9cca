"""Classes of a page's lines: an ordered rule cascade over the line, its neighbours and the carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.operators.rules import cascade


def split_lines(blocks: DataFrame, page: str, block: str, text: str) -> DataFrame:
    """page, block, line, text: the lines of every block, numbered from 0."""
    return blocks.select(page, block, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "text"))


def classify_lines(lines: DataFrame, page: str, order: list[str]) -> DataFrame:
    """Adds ``class``, first rule that fits: blank; title (a page's first line); item (a bullet);
    header (ends in a colon); name (three words at most before a line twice as long); number (holds a
    digit); entry (eight words at most under a header); prose."""
    w = Window.partitionBy(page).orderBy(*order)
    t = F.trim("text")
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
    first = F.row_number().over(w) == 1
    longer = F.coalesce(F.length(F.lead("text").over(w)), F.lit(0)) >= 2 * F.length("text")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    last_head = F.last(F.when(t != "", F.when(t.endswith(":"), F.lit("header")).otherwise(F.when(words > 8, F.lit("body")))), ignorenulls=True).over(so_far)
    return lines.withColumn(
        "class",
        cascade(
            [
                (t == "", "blank"),
                (first, "title"),
                (t.rlike(r"^[-*•]"), "item"),
                (t.endswith(":"), "header"),
                ((words <= 3) & longer, "name"),
                (t.rlike(r"\d"), "number"),
                ((words <= 8) & (last_head == "header"), "entry"),
            ],
            "prose",
        ),
    )
