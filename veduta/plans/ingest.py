"""Sources read from the documents they come in: structured pages, calendars, feeds, JSON and manifests.

The documents are written from the tables by Spark, so what is read back can be held against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.dates import season_bounds
from veduta.functions.identity import event_key
from veduta.functions.text import first_non_empty
from veduta.operators.rules import calendar_classification, calendar_event_type, cascade
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql
from veduta.sources import calendar, events, files

_JSON_LD = """
    SELECT event_id, event_id::VARCHAR AS source_event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type || ' ' || event_id END AS title, CASE WHEN event_id % 7 > 0 THEN strftime(ts, '%Y-%m-%d') END AS date, strftime(ts, '%H:%M') AS start_time,
           CASE WHEN event_id % 10 = 0 THEN 'ftp://x' ELSE 'https://h.org/' || event_id END AS source_url, 'json:' || substr(sha256('json' || chr(0) || event_id), 1, 24) AS event_key,
           CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS errors
    FROM events"""


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one JSON-LD event each, some in a list, some beside a broken block."""
    n, ts = F.col("event_id"), F.col("ts")
    day = F.when(n % 7 > 0, F.date_format(ts, "yyyy-MM-dd")).otherwise("2024-02-30")
    event = F.to_json(
        F.struct(
            n.cast("string").alias("@id"), F.when(n % 9 == 0, F.lit("")).otherwise(F.concat_ws(" ", "event_type", n.cast("string"))).alias("name"), F.concat(day, F.lit("T"), F.date_format(ts, "HH:mm:'00'")).alias("startDate"),
            F.when(n % 10 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://h.org/"), n.cast("string"))).alias("url"),
        )
    )
    block = F.when(n % 2 == 0, F.concat(F.lit("["), event, F.lit("]"))).otherwise(event)
    broken = F.when(n % 5 == 0, F.lit('<script type="application/ld+json">{"name": </script>')).otherwise("")
    return binding.usage(spark, sf_dir).select(F.concat(F.lit("<html>"), broken, F.lit('<script type="application/ld+json">'), block, F.lit("</script></html>")).alias("html"))


@query("structured_events", f"SELECT event_key, source_event_id, title, date, start_time, source_url, errors::INTEGER AS errors FROM ({_JSON_LD})")
def structured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of JSON-LD blocks with the number of rules that each breaks."""
    found = events.canonical_events(_structured(spark, sf_dir), "json")
    return found.select("event_key", "source_event_id", "title", F.col("date").cast("string").alias("date"), "start_time", "source_url", F.size("errors").alias("errors"))


@query(
    "ingestion_runs",
    f"SELECT count(*) FILTER (WHERE errors = 0) AS events, count(*) FILTER (WHERE errors > 0) AS quarantined, count(*) FILTER (WHERE errors = 0 AND date IS NOT NULL) AS with_date, count(*) FILTER (WHERE errors = 0) AS with_time, 0::BIGINT AS with_venue, 'PARTIAL' AS status FROM ({_JSON_LD})",
)
def ingestion_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an ingestion: sound and quarantined events, what they hold, and its status."""
    sound, lost = events.split_quarantine(events.canonical_events(_structured(spark, sf_dir), "json"))
    return files.ingestion_report(sound, lost)


@query(
    "season_events",
    """
    WITH e AS (SELECT event_id, 'json:' || substr(sha256('json' || chr(0) || (event_id % 500)), 1, 24) AS event_key, CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS start_time FROM events WHERE ts >= '2023-09-01' AND ts < '2024-09-01')
    SELECT event_key, date, start_time, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY event_id DESC) AS r FROM e) WHERE r = 1""",
)
def season_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's events from monthly pages, the last row of every key."""
    rows = binding.usage(spark, sf_dir).select(event_key(F.lit("json"), (F.col("event_id") % 500).cast("string")).alias("event_key"), F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm").alias("start_time"), "event_id")
    return events.season_rows(rows, *season_bounds("2023-24"), "event_id")


@query(
    "feed_first_unseen",
    """
    WITH e AS (SELECT user_id || '-' || event_id // 1000 AS feed, 'https://h.org/' || event_id AS link, event_type || ' & ' || event_id AS title, ts, CASE event_id % 3 WHEN 0 THEN 'content' WHEN 1 THEN 'summary' ELSE 'description' END || ' of ' || event_id AS body, event_id FROM events),
    u AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY event_id) AS r FROM e WHERE event_id % 4 > 0)
    SELECT feed, link, title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, body FROM u WHERE r <= 2""",
)
def feed_first_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two unseen entries of every feed (a limit of the feature), with their first body that has text."""
    n, escaped = F.col("event_id"), F.concat_ws(" &amp; ", "event_type", F.col("event_id").cast("string"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    blank = lambda k, name: F.when(n % 3 == k, F.concat(F.lit(f"{name} of "), n.cast("string"))).otherwise(" ")
    item = F.concat(
        tag("link", F.concat(F.lit(" https://h.org/"), n.cast("string"))), tag("title", escaped), tag("pubDate", F.date_format(F.col("ts").cast("timestamp"), "'Tue, 'dd MMM yyyy HH:mm:ss '+0000'")),
        tag("content", blank(0, "content")), tag("summary", blank(1, "summary")), tag("description", F.concat(F.lit("description of "), n.cast("string"))),
    )
    rows = binding.usage(spark, sf_dir)
    feeds = rows.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.expr("cast(event_id div 1000 as string)")).alias("feed")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("event_id", tag("item", item).alias("t"))))["t"], "").alias("items"))
    xml = feeds.select("feed", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("xml"))
    seen = rows.where(n % 4 == 0).select(F.concat(F.lit("https://h.org/"), n.cast("string")).alias("link"))
    first = files.first_unseen(files.feed_entries(xml), seen, "feed", 2)
    return first.select("feed", "link", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "body")


@query("json_document_items", "SELECT source, doc_id AS id, lang FROM documents WHERE source IS NOT NULL")
def json_document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of whole JSON documents, some of them lists and some objects that hold one."""
    element = F.to_json(F.struct("source", F.col("doc_id").alias("id"), "lang"))
    listed = binding.articles(spark, sf_dir).where("source is not null").groupBy("source", F.expr("doc_id div 100").alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(element), ","), F.lit("]")).alias("list"))
    document = F.when(F.col("part") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"articles": '), "list", F.lit("}")))
    return files.json_elements(listed.select(document.alias("value")), "value", "source: string, id: bigint, lang: string")


_GENRES = ("Oper", "Ballett", "Matinee", "Konzert", "Führung")
_GENRE_TYPES = (("Oper", "opera", "opera"), ("Ballett", "ballet", "ballet"), ("Matinee", "matinee", "matinee"), ("Konzert", "concert", "concert"), ("Führung", "other", "guided_tour"))


@query(
    "calendar_cards",
    f"""
    WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') || '/' || o_orderkey // 512 AS page, 'work-' || (o_orderkey % 40) || ':' || strftime(o_orderdate, '%Y-%m-%d') AS source_id, o_orderkey AS n, CAST(o_orderdate AS DATE) AS date, {dealt_sql(_GENRES, 'o_orderkey')} AS genre FROM orders WHERE o_orderkey % 6 > 0)
    SELECT page, source_id, 'Title & ' || n AS title, genre, date, CASE WHEN n % 4 > 0 THEN lpad((9 + n % 12)::VARCHAR, 2, '0') || ':30' END AS start_time, CASE WHEN n % 4 > 1 THEN lpad((9 + n % 12 + 2)::VARCHAR, 2, '0') || ':15' END AS end_time, event_type, activity
    FROM (SELECT *, row_number() OVER (PARTITION BY page, source_id ORDER BY n) AS r FROM c) JOIN {values_sql(_GENRE_TYPES, 't', 'g, event_type, activity')} ON g = genre WHERE r = 1""",
)
def calendar_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of monthly calendar pages with the times that badges elsewhere on the page give them."""
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = lambda c: c.cast("string")
    link = F.when(n % 6 == 0, F.lit("/about")).otherwise(F.concat(F.lit("/calendar/detail/work-"), text(n % 40), F.lit("/"), day, F.lit("/")))
    card = F.concat(F.lit('<div class="event-list-item" id="e'), text(n), F.lit('"><a href="'), link, F.lit('"><h3 class="event-title">Title &amp; '), text(n), F.lit('</h3></a>\n<span class="event-genre"> '), dealt(_GENRES, n), F.lit("</span></div>"))
    hour = 9 + n % 12
    time = F.when(n % 4 > 1, F.concat(text(hour), F.lit(".30 – "), text(hour + 2), F.lit(":15"))).otherwise(F.concat(text(hour), F.lit(".30 Uhr")))
    badge = F.when(n % 4 > 0, F.concat(F.lit('<div class="sticky-date" data-event="e'), text(n), F.lit('"><b>'), time, F.lit("</b></div>")))
    ordered = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("t"))))["t"], "\n")
    months = binding.table(spark, sf_dir, "orders").groupBy(F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM"), F.expr("cast(o_orderkey div 512 as string)")).alias("page")).agg(F.concat(ordered(badge), ordered(card)).alias("html"))
    found = calendar.calendar_events(months, "page", "html")
    label, title = F.col("genre"), F.col("title")
    return found.drop("place").withColumn("event_type", calendar_event_type(label, title)).withColumn("activity", calendar_classification(label, title))


@query(
    "calendar_days",
    "SELECT DISTINCT strftime(o_orderdate, '%Y') AS page, CAST(o_orderdate AS DATE) AS date, 'Day ' || strftime(o_orderdate, '%Y-%m-%d') AS title, lpad((10 + o_orderkey % 11)::VARCHAR, 2, '0') || ':00' AS start_time FROM orders",
)
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct time in the boxes of a calendar's days."""
    orders = binding.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (10 + F.col("o_orderkey") % 11).cast("string").alias("hour"))
    boxes = orders.groupBy("day").agg(F.array_join(F.transform(F.collect_set("hour"), lambda h: F.concat(F.lit('<span class="time">'), h, F.lit(":00</span>"))), " ").alias("times"))
    box = F.concat(F.lit('<div class="day" id="day-'), "day", F.lit('"><h3 class="title">Day <i>'), "day", F.lit("</i></h3>"), "times", F.lit("</div>"))
    pages = boxes.groupBy(F.substring("day", 1, 4).alias("page")).agg(F.array_join(F.collect_list(box), "").alias("html"))
    return calendar.day_boxes(pages, "page", "html")


@query(
    "detail_credits",
    """
    WITH c AS (SELECT l_orderkey AS page, s_name AS person, l_linenumber AS n, l_linenumber % 3 = 0 AS team FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT page, 'Work ' || page AS title, 'C. Composer' AS composer, CASE WHEN team THEN 'team' ELSE 'cast' END AS side, 'Role ' || n AS label, person FROM c
    WHERE team OR (page, person) NOT IN (SELECT page, person FROM c WHERE team)""",
)
def detail_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of detail pages; who is on the team is not in the cast."""
    rows = binding.credits(spark, sf_dir).join(binding.artists(spark, sf_dir), "artist_id")
    item = F.concat(F.lit("<li>Role "), F.col("position").cast("string"), F.lit(": <b>"), "artist_name", F.lit("</b></li>"))
    listed = lambda keep: F.array_join(F.collect_list(F.when(keep, item)), "")
    lists = rows.groupBy("event_id").agg(listed(F.col("position") % 3 == 0).alias("team"), listed(F.col("position") % 3 > 0).alias("cast"))
    html = F.concat(F.lit('<h1 class="title">Work '), F.col("event_id").cast("string"), F.lit('</h1><p class="composer"> C. <i>Composer</i></p><ul class="team">'), "team", F.lit('</ul><ul class="cast">'), "cast", F.lit("</ul>"))
    return calendar.detail_credits(lists.select(F.col("event_id").alias("page"), html.alias("html")), "page", "html")


@query(
    "manifest_selection",
    """
    WITH m AS (SELECT 'm-' || lpad(s_suppkey::VARCHAR, 6, '0') AS slug, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT min(city) AS city FROM m)
    SELECT 'slug' AS asked, slug, city FROM m WHERE slug = 'm-000007' UNION ALL SELECT 'city', slug, m.city FROM m JOIN c ON m.city = c.city UNION ALL SELECT 'all', slug, city FROM m""",
)
def manifest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests asked for by slug, by city in any case, or all."""
    supplier, nation = binding.table(spark, sf_dir, "supplier"), binding.table(spark, sf_dir, "nation")
    manifests = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("m-"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("slug"), F.col("n_name").alias("city"))
    some = manifests.agg(F.min(F.lower("city")).alias("_city"))
    asked = (("slug", manifests.where("slug = 'm-000007'")), ("city", manifests.join(some, F.lower("city") == F.col("_city")).drop("_city")), ("all", manifests))
    out = None
    for name, rows in asked:
        one = rows.withColumn("asked", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("asked", "slug", "city")


@query(
    "overridden_articles",
    r"""
    WITH l AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    q AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t, min(i) AS i FROM l GROUP BY 1, 2 HAVING t <> ''),
    a AS (SELECT doc_id, left(string_agg(t, chr(10) ORDER BY i), 20000) AS body FROM q GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'Title ' || d.doc_id ELSE lang END AS title, md5(CASE WHEN d.doc_id % 5 = 0 THEN 'own text' ELSE coalesce(body, '') END) AS body FROM documents d LEFT JOIN a USING (doc_id)""",
)
def overridden_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with manual overrides where they have text; else distinct lines in order (the 20,000
    characters at most are the feature, a space at the cut stays)."""
    n = F.col("doc_id")
    lines = F.filter(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.trim(F.regexp_replace(t, r"[ \t\n\f\r]+", " ")))), lambda t: t != "")
    title = first_non_empty(F.when(n % 4 == 0, F.concat(F.lit("Title "), n.cast("string"))).otherwise(""), F.col("lang"))
    body = first_non_empty(F.when(n % 5 == 0, "own text").otherwise(""), F.substring(F.array_join(lines, "\n"), 1, 20000))
    return binding.articles(spark, sf_dir).select("doc_id", title.alias("title"), F.md5(F.coalesce(body, F.lit("")).cast("binary")).alias("body"))


@query(
    "master_snapshot",
    """
    WITH m AS (SELECT l_suppkey AS composer_id, s_name AS canonical_name, CASE WHEN l_linenumber % 2 = 0 THEN s_name ELSE lower(s_name) || '-' || (l_linenumber % 5) END AS raw FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 6)
    SELECT DISTINCT 'composer' AS kind, composer_id, canonical_name AS name FROM m UNION ALL SELECT DISTINCT 'alias', composer_id, raw FROM m WHERE raw <> canonical_name""",
)
def master_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composers and aliases rebuilt from a matcher's pages, verified and in review; matches without a
    composer are none, and a raw name that differs from the canonical one is an alias."""
    named = binding.credits(spark, sf_dir).join(binding.artists(spark, sf_dir), "artist_id").where("position <= 6")
    raw = F.when(F.col("position") % 2 == 0, F.col("artist_name")).otherwise(F.concat_ws("-", F.lower("artist_name"), (F.col("position") % 5).cast("string")))
    pages = named.groupBy("event_id").agg(F.collect_list(F.struct(F.col("artist_id").alias("composer_id"), F.col("artist_name").alias("canonical_name"), raw.alias("raw_name"))).alias("matches"))
    verified, review = pages.where("event_id % 2 = 0"), pages.where("event_id % 2 = 1")
    every = verified.unionByName(review).select(F.inline("matches")).where("composer_id is not null and canonical_name is not null")
    composers = every.select(F.lit("composer").alias("kind"), "composer_id", F.col("canonical_name").alias("name"))
    aliases = every.where("raw_name != canonical_name").select(F.lit("alias").alias("kind"), "composer_id", F.col("raw_name").alias("name"))
    return composers.unionByName(aliases).distinct()


@query(
    "probe_report",
    """
    WITH p AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, len(list_distinct(regexp_extract_all(html, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}'))) AS times, len(regexp_extract_all(html, '<h[2-4][^>]*>')) AS titles FROM pages),
    h AS (SELECT *, CASE WHEN titles > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status, row_number() OVER (PARTITION BY titles > 0 ORDER BY pages DESC, host) AS r FROM (SELECT host, count(*) AS pages, sum(titles)::BIGINT AS titles FROM p GROUP BY host))
    SELECT status, count(*) AS venues, '| venue | pages | titles |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || host || ' | ' || pages || ' | ' || titles || ' |', chr(10) ORDER BY r) FILTER (WHERE r <= 20) AS report FROM h GROUP BY 1""",
)
def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues by what a probe of their pages found, and a Markdown table of each status' twenty largest."""
    c = F.col("html")
    host = F.substring_index(F.split("url", "://")[1], "/", 1)
    probed = binding.pages(spark, sf_dir).select(host.alias("host"), F.size(F.regexp_extract_all(c, F.lit("(<h[2-4][^>]*>)"), F.lit(1))).alias("titles"))
    venues = probed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("titles").alias("titles"))
    line = F.format_string("| %s | %d | %d |", "host", "pages", "titles")
    status = cascade([(F.col("titles") > 0, "PARTIAL")], "FAILED")
    named = venues.withColumn("status", status)
    top = named.withColumn("_r", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("pages"), "host"))).where("_r <= 20")
    tables = top.groupBy("status").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("t"))))["t"].alias("_lines"))
    told = named.groupBy("status").agg(F.count(F.lit(1)).alias("venues")).join(tables, "status")
    head = F.array(F.lit("| venue | pages | titles |"), F.lit("|---|---|---|"))
    return told.select("status", "venues", F.array_join(F.concat(head, "_lines"), "\n").alias("report"))
