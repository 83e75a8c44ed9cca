"""JSON documents, JSON lines and feeds as relations; staging files as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veduta.functions.dates import parse_moment


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped, and broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, element: str, field: str = "articles") -> DataFrame:
    """Elements of whole-document JSON files: a list, or an object with the list under ``field``.

    ``element`` is the DDL of an element's fields. Broken JSON, and documents of another shape, raise."""
    return json_elements(spark.read.text(path, wholetext=True), "value", element, field)


def json_elements(documents: DataFrame, column: str, element: str, field: str = "articles") -> DataFrame:
    """Elements of a column of JSON documents, as ``json_documents`` has them."""
    strict = {"mode": "FAILFAST"}
    is_list = F.ltrim(column).startswith("[")
    listed = F.from_json(F.when(is_list, F.col(column)), f"array<struct<{element}>>", strict)
    wrapped = F.from_json(F.when(~is_list, F.col(column)), f"struct<{field}: array<struct<{element}>>>", strict)[field]
    wrong = F.raise_error(F.concat(F.lit(f"neither a list nor an object with {field}: "), F.substring(column, 1, 60)))
    return documents.select(F.coalesce(listed, wrapped, wrong).alias("_elements")).select(F.inline("_elements"))


def stage_json_lines(df: DataFrame, path: str) -> None:
    """Writes staged rows as JSON lines, nulls left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def feed_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS items of a column of feed documents: feed columns, position, link, title, published, body.

    The body is the first of content, summary and description that has text."""
    item = "struct<link: string, title: string, pubDate: string, updated: string, content: string, summary: string, description: string>"
    parsed = F.from_xml(F.col(xml), f"struct<channel: struct<item: array<{item}>>>")
    rows = feeds.select("*", F.posexplode(parsed["channel"]["item"]).alias("position", "_item")).drop(xml)
    body = F.coalesce(*[F.when(F.trim(f"_item.{c}") != "", F.col(f"_item.{c}")) for c in ("content", "summary", "description")])
    when = parse_moment(F.coalesce("_item.pubDate", "_item.updated"))
    return rows.select(*[c for c in rows.columns if c != "_item"], F.trim("_item.link").alias("link"), F.trim("_item.title").alias("title"), when.alias("published"), body.alias("body"))


def first_unseen(entries: DataFrame, seen: DataFrame, feed: str, most: int) -> DataFrame:
    """The first ``most`` entries of every feed whose link ``seen`` lacks, in the feed's order (column
    ``position``)."""
    fresh = entries.join(seen.select("link").distinct(), "link", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(feed).orderBy("position"))).where(F.col("_r") <= most).drop("_r")


def ingestion_report(events: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row: events, quarantined, with date, with time, with venue, and the run's status."""
    counts = events.agg(
        F.count(F.lit(1)).alias("events"), F.count("date").alias("with_date"), F.count_if(F.coalesce(F.col("start_time"), F.lit("")) != "").alias("with_time"), F.count("venue").alias("with_venue")
    )
    lost = quarantined.agg(F.count(F.lit(1)).alias("quarantined"))
    status = F.when((F.col("quarantined") > 0) | (F.col("events") == 0), "PARTIAL").otherwise("READY")
    return counts.join(lost, F.lit(True)).withColumn("status", status)
