"""Normalisers, urls, dates and identities applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.functions import dates, identity, text, urls
from veduta.plans.registry import query

_PLAIN = "strip_accents(replace(replace(replace(replace(coalesce({c}, ''), 'œ', 'oe'), 'æ', 'ae'), 'Œ', 'OE'), 'Æ', 'AE'))"


@query(
    "text_keys",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_PLAIN.format(c='text')} AS p FROM documents)
    SELECT doc_id,
      md5(trim(regexp_replace(regexp_replace(replace(replace(replace(lower(p), '‘', ''''), '’', ''''), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s''\\-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS unicode_key,
      md5(trim(regexp_replace(replace(lower(p), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))) AS ascii_key,
      md5(trim(regexp_replace(lower(strip_accents(t)), '\\s+', ' ', 'g'))) AS sql_key,
      md5(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', '', 'g')) AS compact_key
    FROM d""",
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of four search keys of every whole text."""
    c, plain = F.col("text"), F.col("_plain")
    # Three of the keys start from the text without accents, which is made once.
    keys = {"unicode_key": text.search_key_unicode(c, plain), "ascii_key": text.search_key_ascii(c), "sql_key": text.search_key_sql(c, plain), "compact_key": text.compact_key(c, plain)}
    return binding.articles(spark, sf_dir).select("doc_id", "text", text.unaccent(text.text_or_empty(c)).alias("_plain")).select("doc_id", *[F.md5(k.cast("binary")).alias(n) for n, k in keys.items()])


@query(
    "excerpts",
    r"""
    WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE rtrim(substr(t, 1, 600)) || '…' END AS excerpt,
           CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS summary FROM d""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of 600 characters and summaries of 80 (the limits are the feature)."""
    c = F.col("text")
    return binding.articles(spark, sf_dir).select("doc_id", text.excerpt(c).alias("excerpt"), text.value_summary(text.squeeze(text.text_or_empty(c))).alias("summary"))


@query(
    "canonical_urls",
    r"""
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS authority,
        regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path FROM pages)
    SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND authority <> '' THEN scheme || '://' || authority || CASE path WHEN '' THEN '/' ELSE path END END AS canonical,
           split_part(url, '#', 1) AS no_fragment,
           CASE WHEN regexp_matches(authority, '\.(de|fr|es|it|at|ch|pt)$') THEN split_part(authority, '.', -1) WHEN suffix(authority, '.uk') THEN 'gb' ELSE 'other' END AS country,
           CASE WHEN regexp_matches(lower(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1)), '^(de|fr|es|it|pt)([-_].*)?$') THEN lower(regexp_extract(html, '(?i)<html[^>]*\slang="([A-Za-z]*)', 1)) ELSE 'other' END AS language_country,
           CASE WHEN regexp_matches(trim(url), '(?i)^https?:') THEN trim(url) ELSE '#' END AS safe
    FROM (SELECT u.*, pages.html FROM u JOIN pages USING (page_id))""",
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, fragment-free and safe form of every page url; country by domain and by language."""
    u = F.col("url")
    return binding.pages(spark, sf_dir).select("page_id", urls.canonical_url(u).alias("canonical"), urls.without_fragment(u).alias("no_fragment"), urls.country_of(u).alias("country"),
        urls.country_of_language(F.regexp_extract("html", r'(?i)<html[^>]*\slang="([^"]*)"', 1)).alias("language_country"), urls.safe_link(u).alias("safe"))


@query(
    "identity_keys",
    """
    SELECT doc_id, source || ':' || substr(sha256(source || chr(0) || doc_id), 1, 24) AS event_key,
           'veduta:' || substr(sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(doc_id::VARCHAR, '')), 1, 24) AS stable_key,
           'source:' || md5(lower(source)) AS named_key, substr(sha256(text), 1, 16) AS short_key
    FROM documents""",
)
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event keys, stable identities and digests of every document."""
    doc_id = F.col("doc_id").cast("string")
    return binding.articles(spark, sf_dir).select(
        "doc_id",
        identity.event_key(F.col("source"), doc_id).alias("event_key"),
        identity.stable_identity("veduta", F.col("source"), F.col("lang"), doc_id).alias("stable_key"),
        identity.named_identity("source", F.col("source")).alias("named_key"),
        identity.short_digest(F.col("text")).alias("short_key"),
    )


@query(
    "moments",
    """
    SELECT event_id, strftime(timezone('Europe/Paris', timezone('UTC', ts)), '%Y-%m-%d') AS paris_day,
           strftime(timezone('UTC', timezone('Europe/Paris', date_trunc('day', timezone('Europe/Paris', timezone('UTC', ts))))), '%Y-%m-%d %H:%M:%S') AS midnight_utc,
           strftime(ts, '%H:%M') AS clock, strftime(ts + INTERVAL 2 HOUR, '%H%M%S') AS default_end, strftime(ts, '%Y-%m') AS month
    FROM events""",
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local day and midnight, clock, default end and month of every usage record."""
    ts = F.col("ts").cast("timestamp")
    return binding.usage(spark, sf_dir).select(
        "event_id",
        dates.local_day(ts).cast("string").alias("paris_day"),
        F.date_format(dates.local_midnight_utc(ts), "yyyy-MM-dd HH:mm:ss").alias("midnight_utc"),
        dates.clock(F.concat(F.hour(ts).cast("string"), F.date_format(ts, ":mm:00"))).alias("clock"),
        F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "HHmmss").alias("default_end"),
        dates.year_month(ts).alias("month"),
    )


@query(
    "json_props",
    "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, json_valid(props) AS valid FROM events",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column."""
    parsed = F.from_json("props", "k int")
    return binding.usage(spark, sf_dir).select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query(
    "title_keys",
    r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '(^|[^\p{L}\p{N}_])(no|nr|num|op)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key
    FROM (SELECT doc_id, lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1))) AS h FROM documents)""",
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys of the documents' headings, their first lines."""
    heading = F.substring_index(text.text_or_empty(F.col("text")), "\n", 1)
    return binding.articles(spark, sf_dir).select("doc_id", text.title_key(heading).alias("title_key"))


@query(
    "url_uuids",
    """
    SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""",
)
def url_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 UUID of every page url."""
    return binding.pages(spark, sf_dir).select("page_id", identity.uuid5(F.col("url")).alias("uuid"))
