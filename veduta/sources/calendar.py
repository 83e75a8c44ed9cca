"""Calendar and detail pages of venues as nested columns, by patterns over their markup.

A page stays one row until its cards are exploded; a badge is joined to its card by element id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.functions.dates import clock_pair
from veduta.operators.dedup import pick_best
from veduta.sources.html import plain

_CARD = r'(?s)<div class="event-list-item" id="([^"]*)">(.*?)</div>'
_BADGE = r'(?s)<div class="sticky-date" data-event="([^"]*)">(.*?)</div>'
_BOX = r'(?s)<div class="day" id="day-(\d{4}-\d{2}-\d{2})">(.*?)</div>'


def _pairs(html: Column, pattern: str) -> Column:
    """array<struct<key, body>> of a pattern with two groups, in page order."""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("body"))
    return F.transform(both, lambda x: F.struct(x["key"].alias("key"), x["body"].alias("body")))


def _part(body: Column, tag: str, name: str) -> Column:
    return plain(F.regexp_extract(body, rf'(?s)<{tag} class="{name}">(.*?)</{tag}>', 1))


def calendar_events(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, place, source_id (slug:date), title, genre, date, start_time, end_time of the cards of pages.

    A card without an id or a detail link is none. Times stand in a badge elsewhere on the page that
    names its card, so they are joined by page and id; of cards with one slug and date the first
    counts. ``place`` is a card's number on its page, from 1."""
    cards = pages.select(page, F.posexplode(_pairs(F.col(html), _CARD)).alias("_n", "_c"))
    link = F.regexp_extract("_c.body", r"/calendar/detail/([^/\"]+)/(\d{4}-\d{2}-\d{2})/?[\"?#]", 0)
    parts = [F.regexp_extract("_c.body", r"/calendar/detail/([^/\"]+)/(\d{4}-\d{2}-\d{2})/?[\"?#]", i) for i in (1, 2)]
    rows = cards.where((link != "") & (F.col("_c.key") != "")).select(
        page, (F.col("_n") + 1).cast("long").alias("place"), F.col("_c.key").alias("_id"), F.concat_ws(":", *parts).alias("source_id"), _part(F.col("_c.body"), "h3", "event-title").alias("title"),
        _part(F.col("_c.body"), "span", "event-genre").alias("genre"), F.to_date(parts[1]).alias("date"),
    )
    badges = pages.select(page, F.explode(_pairs(F.col(html), _BADGE)).alias("_b"))
    start, end = clock_pair(F.col("_b.body"))
    times = badges.groupBy(F.col(page).alias("_page"), F.col("_b.key").alias("_event")).agg(F.max(F.struct(start.alias("start"), end.alias("end"))).alias("_t"))
    timed = rows.join(times, (F.col(page) == F.col("_page")) & (F.col("_id") == F.col("_event")), "left")
    once = pick_best(timed, [page, "source_id"], [F.col("place")])
    return once.select(page, "place", "source_id", "title", "genre", "date", F.col("_t.start").alias("start_time"), F.col("_t.end").alias("end_time"))


def day_boxes(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, date, title, start_time: one row per distinct time of every day's box."""
    boxes = pages.select(page, F.explode(_pairs(F.col(html), _BOX)).alias("_b"))
    times = F.array_distinct(F.transform(F.regexp_extract_all("_b.body", F.lit(r'<span class="time">(\d{1,2}:\d{2})</span>'), F.lit(1)), lambda t: F.lpad(t, 5, "0")))
    return boxes.select(page, F.to_date("_b.key").alias("date"), _part(F.col("_b.body"), "h3", "title").alias("title"), F.explode(times).alias("start_time"))


def detail_credits(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, title, composer, side (team or cast), label, person of the credits of detail pages.

    Who is on the team of a page is not in its cast as well."""
    item = lambda name: _pairs(F.regexp_extract(F.col(html), rf'(?s)<ul class="{name}">(.*?)</ul>', 1), r"(?s)<li>([^<:]*):(.*?)</li>")
    head = [page, _part(F.col(html), "h1", "title").alias("title"), _part(F.col(html), "p", "composer").alias("composer")]
    side = lambda s: F.transform(item(s), lambda i: F.struct(F.lit(s).alias("side"), F.trim(i["key"]).alias("label"), plain(i["body"]).alias("person")))
    # one look at every page; each row of several pages with one key is held against the team of all of them
    credits = pages.select(*head, F.inline(F.concat(side("team"), side("cast"))))
    on_team = F.col(page).isNotNull() & F.max(F.col("side") == "team").over(Window.partitionBy(page, "person"))
    return credits.select("*", on_team.alias("_on_team")).where("side = 'team' or not _on_team").drop("_on_team")
