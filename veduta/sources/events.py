"""Canonical events from structured pages, with quarantine instead of failure."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.functions.dates import clock, strict_iso_date
from veduta.functions.identity import event_key
from veduta.operators.dedup import pick_best

_EVENT = "array<struct<`@id`: string, `@type`: string, name: string, startDate: string, endDate: string, url: string, location: struct<name: string>>>"
_BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def json_ld(html: Column) -> Column:
    """array<event> of all JSON-LD blocks; lists are flattened and broken JSON gives nothing."""
    blocks = F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1))

    def events(block: Column) -> Column:
        return F.coalesce(F.from_json(block, _EVENT), F.array().cast(_EVENT))

    return F.flatten(F.transform(blocks, events))


def canonical_events(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """One row per JSON-LD event: event_key, source, source_event_id, title, date, start_time,
    end_time, venue, source_url and ``errors``, the rules it breaks."""
    rows = pages.select(F.explode(json_ld(F.col(html))).alias("e"))
    start, end = F.col("e.startDate"), F.col("e.endDate")
    found = rows.select(
        F.lit(source).alias("source"),
        F.col("e.`@id`").alias("source_event_id"),
        F.trim("e.name").alias("title"),
        strict_iso_date(F.substring(start, 1, 10)).alias("date"),
        clock(F.regexp_extract(start, r"T(\d{1,2}:\d{2}(?::\d{2})?)", 1)).alias("start_time"),
        clock(F.regexp_extract(end, r"T(\d{1,2}:\d{2}(?::\d{2})?)", 1)).alias("end_time"),
        F.col("e.location.name").alias("venue"),
        F.col("e.url").alias("source_url"),
    )
    rules = {
        "missing_id": F.coalesce(F.col("source_event_id"), F.lit("")) == "",
        "missing_title": F.coalesce(F.col("title"), F.lit("")) == "",
        "bad_date": F.col("date").isNull(),
        "bad_url": ~F.coalesce(F.col("source_url").rlike(r"(?i)^https?://"), F.lit(False)),
    }
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return found.withColumn("errors", errors).withColumn("event_key", event_key(F.col("source"), F.col("source_event_id")))


def split_quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound events, quarantined ones)."""
    return events.where(F.size("errors") == 0).drop("errors"), events.where(F.size("errors") > 0)


def season_rows(events: DataFrame, first: date, last: date, position: str) -> DataFrame:
    """Events of a season, the last row of every key by input ``position`` (a numeric column), by
    (date, start_time, key)."""
    kept = events.where(F.col("date").between(F.lit(first), F.lit(last)))
    return pick_best(kept, ["event_key"], [-F.col(position)]).orderBy("date", F.coalesce("start_time", F.lit("")), "event_key")
