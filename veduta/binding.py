"""The event-catalogue relations, bound to the tables at hand.

Operators are generic in their columns; this module alone knows that orders play the part of
events, lineitem that of programmes and credits, part of works, supplier of artists, customer of
venues, documents of articles, events of usage records and conversations of page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, date, event_type, status, venue_id, price."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("event_type"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("venue_id"),
        F.col("o_totalprice").alias("price"),
    )


def programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, position, work_id."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("work_id"))


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, position, artist_id, role."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("artist_id"), F.col("l_returnflag").alias("role")
    )


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, position, work_id, artist_id, role: programme and credits of one scan."""
    columns = {"l_orderkey": "event_id", "l_linenumber": "position", "l_partkey": "work_id", "l_suppkey": "artist_id", "l_returnflag": "role"}
    return table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(name) for c, name in columns.items()])


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, title, composer, kind."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("composer"), F.col("p_type").alias("kind"))


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist_id, artist_name."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """venue_id, venue, organization, city, country."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return places.select(F.col("c_custkey").alias("venue_id"), F.col("c_name").alias("venue"), F.col("c_mktsegment").alias("organization"), F.col("n_name").alias("city"), F.col("r_name").alias("country"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, props."""
    return table(spark, sf_dir, "events")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source, n_chars."""
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html."""
    return table(spark, sf_dir, "pages")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, line_no, role, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("line_no"), "role", "text")
