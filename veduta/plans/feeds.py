"""Page scans and the incremental feed: new urls, quotas, gates, digests and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.identity import short_digest
from veduta.functions.urls import canonical_url, url_host
from veduta.operators.dedup import pick_best
from veduta.operators.line_classes import classify_lines, split_lines
from veduta.operators.merge import inserted
from veduta.plans.registry import query
from veduta.sources import html

_PLAIN = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"
)
_CANON = r"""CASE WHEN lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) IN ('http', 'https') AND regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) <> ''
    THEN lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/{{2,}}', '/', 'g'), '/$', ''), ''), '/') END"""


@query(
    "page_links",
    rf"""
    WITH a AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0) AS origin, regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
    l AS (SELECT page_id, origin, unnest(h) AS href, {_PLAIN.format(x='unnest(t)')} AS title FROM a)
    SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN prefix(href, '/') AND origin <> '' THEN origin || href END AS link, title FROM l
    WHERE length(title) >= 5 AND NOT regexp_matches(href, '(?i)/(author|tag|category|page)(/|$)')""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of every page with a title of five characters or more."""
    rows = binding.pages(spark, sf_dir).select("page_id", "url", F.explode(html.links(F.col("html"))).alias("l"))
    kept = rows.where((F.length("l.title") >= 5) & ~F.col("l.href").rlike(r"(?i)/(author|tag|category|page)(/|$)"))
    return kept.select("page_id", html.absolute(F.col("url"), F.col("l.href")).alias("link"), F.col("l.title").alias("title")).distinct()


@query(
    "article_paragraphs",
    rf"""
    WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), 1) AS i FROM pages),
    q AS (SELECT page_id, {_PLAIN.format(x='raw')} AS t, min(i) AS i FROM p GROUP BY 1, 2)
    SELECT pages.page_id, count(q.t) AS paragraphs, md5(coalesce(string_agg(q.t, chr(10) ORDER BY q.i), '')) AS body FROM pages LEFT JOIN q ON q.page_id = pages.page_id AND length(q.t) >= 50 GROUP BY pages.page_id""",
)
def article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the number and digest of its distinct paragraphs of 50 characters or more."""
    found = html.paragraphs(F.col("html"))
    return binding.pages(spark, sf_dir).select("page_id", F.size(found).cast("long").alias("paragraphs"), F.md5(F.array_join(found, "\n").cast("binary")).alias("body"))


@query(
    "page_probe",
    rf"""
    WITH h AS (SELECT page_id, {_PLAIN.format(x="unnest(regexp_extract_all(html, '(?s)<h[1-4][^>]*>(.*?)</h[1-4]>', 1))")} AS t FROM pages)
    SELECT page_id, (SELECT count(DISTINCT x) FROM (SELECT unnest(regexp_extract_all(html, '\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}')) AS x)) AS dates,
           (SELECT count(DISTINCT t) FROM h WHERE h.page_id = pages.page_id AND t <> '' AND length(t) < 180) AS titles,
           CASE WHEN regexp_matches(html, '(?i)application/(?:rss|atom)\+xml') THEN 'alternate' ELSE 'website' END AS kind, lower(regexp_extract(html, '(?i)<html[^>]*\slang="([A-Za-z]{{2}})', 1)) AS language
    FROM pages""",
)
def page_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, titles, kind of source and language found in every page."""
    c = F.col("html")
    return binding.pages(spark, sf_dir).select(
        "page_id", F.size(html.date_tokens(c)).cast("long").alias("dates"), F.size(html.titles(c)).cast("long").alias("titles"), html.source_kind(c).alias("kind"), html.page_language(c).alias("language")
    )


@query(
    "line_classes",
    r"""
    WITH s AS (SELECT conv_id AS page, turn AS block, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM conversations),
    w AS (SELECT *, trim(text) AS t, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\s+')) END AS words, row_number() OVER o AS no, coalesce(length(lead(text) OVER o), 0) >= 2 * length(text) AS longer
          FROM s WINDOW o AS (PARTITION BY page ORDER BY block, line)),
    h AS (SELECT *, last_value(CASE WHEN t <> '' THEN CASE WHEN suffix(t, ':') THEN 'header' WHEN words > 8 THEN 'body' END END IGNORE NULLS) OVER (PARTITION BY page ORDER BY block, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS head FROM w)
    SELECT page, block, line::INTEGER AS line, CASE WHEN t = '' THEN 'blank' WHEN no = 1 THEN 'title' WHEN regexp_matches(t, '^[-*•]') THEN 'item' WHEN suffix(t, ':') THEN 'header' WHEN words <= 3 AND longer THEN 'name'
           WHEN regexp_matches(t, '\d') THEN 'number' WHEN words <= 8 AND head = 'header' THEN 'entry' ELSE 'prose' END AS class FROM h""",
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all lines of all pages."""
    lines = split_lines(binding.lines(spark, sf_dir), "page", "line_no", "text").withColumnRenamed("line_no", "block")
    return classify_lines(lines, "page", ["block", "line"]).select("page", "block", "line", "class")


@query(
    "new_urls",
    f"""
    WITH c AS (SELECT page_id, {_CANON.format(u='url')} AS canonical, contains(url, 'utm_source') AS seen FROM pages)
    SELECT canonical, min(page_id) AS page_id, substr(sha256(canonical), 1, 16) AS url_id FROM c WHERE canonical IS NOT NULL AND canonical NOT IN (SELECT canonical FROM c WHERE seen AND canonical IS NOT NULL) GROUP BY canonical""",
)
def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical urls that the seen set lacks, first page of each."""
    pages = binding.pages(spark, sf_dir).select("page_id", canonical_url(F.col("url")).alias("canonical"), F.col("url").contains("utm_source").alias("seen")).where("canonical is not null")
    fresh = inserted(pages.where("seen"), pages, ["canonical"])
    return fresh.groupBy("canonical").agg(F.min("page_id").alias("page_id")).withColumn("url_id", short_digest(F.col("canonical")))


@query(
    "daily_quota",
    "SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS accepted FROM events",
)
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records within a user's quota of three a day."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    rows = binding.usage(spark, sf_dir).select("event_id", "user_id", F.to_date("ts").alias("day"), "ts")
    return rows.withColumn("accepted", F.row_number().over(w) <= 3).drop("ts")


@query(
    "rate_limit_24h",
    "WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, strftime(last_ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS available_at, last_ts + INTERVAL 24 HOUR > now AS limited FROM l CROSS JOIN n",
)
def rate_limit_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user when the next purchase is allowed, and whether that is still to come."""
    rows = binding.usage(spark, sf_dir)
    now = rows.agg(F.max("ts").alias("now"))
    last = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("_last")).join(F.broadcast(now), F.lit(True))
    free = F.col("_last") + F.expr("INTERVAL 24 HOURS")
    return last.select("user_id", F.date_format(free, "yyyy-MM-dd HH:mm:ss").alias("available_at"), (free > F.col("now")).alias("limited"))


@query(
    "invite_claims",
    "SELECT event_id, user_id % 40 AS code, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id)::BIGINT AS claim, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) <= 10 AS accepted FROM events WHERE event_type = 'signup'",
)
def invite_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of invite codes in order; a code is exhausted after ten.

    Claims are numbered within a code's days and offset by the days before, so no code is one task's."""
    rows = binding.usage(spark, sf_dir).where("event_type = 'signup'").select("event_id", "ts", (F.col("user_id") % 40).alias("code"), F.to_date("ts").alias("day"))
    before = Window.partitionBy("code").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("code", "day").agg(F.count(F.lit(1)).alias("_n")).select("code", "day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("code", "day").orderBy("ts", "event_id"))
    claims = rows.withColumn("_inside", inside).join(days, ["code", "day"]).select("event_id", "code", (F.col("_before") + F.col("_inside")).alias("claim"))
    return claims.withColumn("accepted", F.col("claim") <= 10)


@query(
    "digest_bodies",
    """
    SELECT user_id, day, string_agg(event_type || '#' || event_id, '; ' ORDER BY ts, event_id) FILTER (WHERE r <= 3) AS body, count(*) AS items
    FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) GROUP BY user_id, day""",
)
def digest_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day a digest of the first three records, and how many there were."""
    day = F.to_date("ts").alias("day")
    rows = binding.usage(spark, sf_dir).select("user_id", day, "ts", "event_id", F.concat("event_type", F.lit("#"), "event_id").alias("item"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    top = F.array_sort(F.collect_list(F.when(F.col("_r") <= 3, F.struct("_r", "item"))))
    return ranked.groupBy("user_id", "day").agg(F.array_join(top["item"], "; ").alias("body"), F.count(F.lit(1)).alias("items"))


@query(
    "day_gate",
    "SELECT CAST(ts AS DATE) AS day, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM (SELECT event_id, user_id, timezone('Europe/Paris', timezone('UTC', ts)) AS ts FROM events) WHERE hour(ts) = 9) WHERE r = 1",
)
def day_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one record a day of Paris that passes the gate at nine o'clock there."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Paris")
    rows = binding.usage(spark, sf_dir).withColumn("ts", local).where(F.hour("ts") == 9).select(F.to_date("ts").alias("day"), "event_id", "user_id", "ts")
    return pick_best(rows, ["day"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query(
    "delivery_reservations",
    "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, 'pending' AS status FROM events WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = events.user_id AND CAST(p.ts AS DATE) = CAST(events.ts AS DATE))",
)
def delivery_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries reserved once per user and day where none exists (insert-or-ignore)."""
    rows = binding.usage(spark, sf_dir).select("user_id", F.to_date("ts").alias("day"), "event_type")
    wanted = rows.where("event_type = 'view'").select("user_id", "day").distinct().withColumn("status", F.lit("pending"))
    return inserted(rows.where("event_type = 'purchase'"), wanted, ["user_id", "day"])


@query(
    "public_articles",
    """
    SELECT substr(sha256(source || '/' || doc_id), 1, 16) AS id, doc_id, coalesce(nullif(lang, ''), 'en') AS language, source, coalesce(q.quality, 0) AS rank, n_chars >= 200 AS published
    FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS quality FROM labels GROUP BY doc_id) q ON d = doc_id""",
)
def public_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article rows: derived ids, defaults for what is missing, publication flag."""
    known = binding.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = binding.articles(spark, sf_dir).select("doc_id", "lang", "source", "n_chars").join(known, "doc_id", "left")
    return rows.select(
        short_digest(F.concat_ws("/", "source", "doc_id")).alias("id"), "doc_id", F.coalesce(F.when(F.col("lang") != "", F.col("lang")), F.lit("en")).alias("language"), "source", F.coalesce("quality", F.lit(0)).alias("rank"), (F.col("n_chars") >= 200).alias("published")
    )


@query(
    "archive_newest",
    """
    WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('purchase', 'signup')), old AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
    SELECT event_id, user_id FROM (SELECT * FROM r UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 200)) ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
def archive_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after a run: results and what they do not replace, newest 200 (a top-k report)."""
    rows = binding.usage(spark, sf_dir)
    fresh = rows.where(F.col("event_type").isin("purchase", "signup"))
    replaced = rows.where("event_type = 'purchase' and value > 200").select("user_id").distinct()
    old = rows.where("event_type = 'view'").join(replaced, "user_id", "left_anti")
    both = fresh.select("event_id", "user_id", "ts").unionByName(old.select("event_id", "user_id", "ts"))
    return both.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).drop("ts")


@query(
    "fetch_once_fan_out",
    f"""
    WITH c AS (SELECT page_id, {_CANON.format(u='url')} AS canonical, length(html) AS size FROM pages), f AS (SELECT canonical, min(page_id) AS fetched, max(size) AS size FROM c GROUP BY canonical)
    SELECT c.page_id, c.canonical, f.fetched, f.size::BIGINT AS size FROM c LEFT JOIN f ON f.canonical IS NOT DISTINCT FROM c.canonical""",
)
def fetch_once_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done once per distinct url and joined back to every occurrence."""
    pages = binding.pages(spark, sf_dir).select("page_id", canonical_url(F.col("url")).alias("canonical"), F.length("html").alias("_size"))
    once = pages.groupBy(F.col("canonical").alias("_c")).agg(F.min("page_id").alias("fetched"), F.max("_size").cast("long").alias("size"))
    return pages.join(once, pages["canonical"].eqNullSafe(once["_c"]), "left").select("page_id", "canonical", "fetched", "size")


@query(
    "hosts_by_source_kind",
    r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
)
def hosts_by_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and characters by host."""
    return binding.pages(spark, sf_dir).groupBy(url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).cast("long").alias("chars"))
