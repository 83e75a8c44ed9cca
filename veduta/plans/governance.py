"""Legacy records, production groups, residual reasons, discovery, paged scans and guards of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.functions.records import first_value, json_object
from veduta.operators.merge import guard_report
from veduta.operators.rules import cascade
from veduta.operators.sequences import most_common
from veduta.operators.titles import production_group
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql
from veduta.sources import html

#: Columns of a normalised article that come from one key, or from the first of several that has a value.
_PLAIN = ("kind", "source", "country", "title", "author", "category", "translation_instruction", "result", "cover", "language", "mode", "processed_at", "metadata_updated_at")
_KEYS = {
    "id": ("id", "key", "article_id"), "canonical_url": ("canonical_url", "url", "original_url"), "url": ("url", "original_url", "canonical_url"), "original_title": ("original_title", "title"),
    "author_label": ("author_label", "author"), "published_at": ("published_at", "published"),
}
_MAPS = ("translations", "translated_titles", "summaries", "translation_jobs", "contents", "titles")


@query(
    "normalized_articles",
    f"""
    WITH d AS (SELECT doc_id AS n, source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 10 > 0)
    SELECT 'a' || n AS id, 'https://h.org/' || n AS url, CASE WHEN n % 2 = 0 THEN 'https://c.org/' || n ELSE 'https://h.org/' || n END AS canonical_url, 'T' || n AS title, CASE WHEN n % 3 = 0 THEN 'O' || n ELSE 'T' || n END AS original_title, source, lang AS language,
      'A' AS author, 'A' AS author_label, CASE WHEN n % 4 = 0 THEN '2024-01-01' ELSE '2023-01-01' END AS published_at, CASE WHEN n % 5 = 0 THEN '{{"zh":"x"}}' WHEN n % 5 = 1 THEN '{{"zh":"raw"}}' ELSE '{{}}' END AS translations,
      {', '.join(f"NULL AS {c}" for c in _PLAIN if c not in ('source', 'title', 'author', 'language'))}, {', '.join(f"'{{}}' AS {c}" for c in _MAPS if c != 'translations')} FROM d""",
)
def normalized_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy article records as rows of one shape: values of several keys, then of the raw record; maps with
    the raw record's where they are empty. Records without id or url are left out."""
    n = F.col("doc_id")
    text = lambda prefix: F.concat(F.lit(prefix), n.cast("string"))
    none = F.lit(None).cast("string")
    raw = F.struct(text("a").alias("article_id"), F.lit("2023-01-01").alias("published"), F.lit("A").alias("author"), F.when(n % 5 == 1, F.struct(F.lit("raw").alias("zh"))).alias("translations"))
    record = F.to_json(
        F.struct(
            F.when(n % 2 > 0, text("a")).otherwise("").alias("id"), F.when(n % 10 > 0, text("https://h.org/")).alias("original_url"), F.when((n % 2 == 0) & (n % 10 > 0), text("https://c.org/")).alias("canonical_url"),
            text("T").alias("title"), F.when(n % 3 == 0, text("O")).otherwise(none).alias("original_title"), F.col("source"), F.col("lang").alias("language"), F.when(n % 4 == 0, "2024-01-01").alias("published_at"),
            F.when(n % 5 == 0, F.struct(F.lit("x").alias("zh"))).alias("translations"), raw.alias("raw_data"),
        )
    )
    rows = binding.articles(spark, sf_dir).where("source is not null and lang is not null").select(record.alias("r"))
    r = F.col("r")
    out = rows.select(*[first_value(r, *keys).alias(c) for c, keys in _KEYS.items()], *[first_value(r, c).alias(c) for c in _PLAIN], *[json_object(r, c).alias(c) for c in _MAPS])
    return out.where("id is not null and url is not null")


_GROUPS = (
    ("Las bodas de FÍGARO", "figaro"), ("The Marriage", "figaro"), ("Il barbiere di Siviglia", "barbiere"), ("Manon Lescaut", "manon"), ("Bodas de sangre", "blood"), ("La Pasión según San Mateo", "matthew"),
    ("Riccardo III", "richard"), ("San Giovanni Battista", "john"), ("El castillo de Barbazul", "bluebeard"), ("El Mesías", "messiah"), ("Bayreuth!", "bayreuth"), ("Domingos de cámara", "chamber"), ("La mer, op. 1", "lamerop1"),
)


@query("production_groups", f"SELECT event_id, grouped FROM (SELECT event_id, {dealt_sql([g[0] for g in _GROUPS], 'event_id')} AS t FROM ev) JOIN {values_sql(_GROUPS, 'g', 'title, grouped')} ON t = title", "ev")
def production_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production that a title belongs to, by the words that tell it, or else by its own key."""
    return binding.occurrences(spark, sf_dir).select("event_id", production_group(dealt([g[0] for g in _GROUPS], F.col("event_id"))).alias("grouped"))


_STATUSES = ("ambiguous_work", "unresolved_work", "parent_work_excerpt_review", "source_attribution_review", "parser_issue", "done")
_REASONS = (
    ("ambiguous_work", "ambiguous_existing_work_review", "P3"), ("unresolved_work", "canonical_gap_review", "P2"), ("parent_work_excerpt_review", "parent_excerpt_unresolved", "P2"),
    ("source_attribution_review", "source_attribution_unresolved", "P1"), ("parser_issue", "parser_structure_unresolved", "P1"),
)


@query(
    "residual_causes",
    f"""
    WITH r AS (SELECT event_id, position, min({dealt_sql(_STATUSES, 'work_id')}) AS status FROM pr GROUP BY event_id, position),
    c AS (SELECT event_id, reason, priority, count(*) AS n, min(position) AS first FROM r JOIN {values_sql(_REASONS, 'x', 'status, reason, priority')} USING (status) GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY event_id) AS rows FROM c)
    SELECT e.event_id, coalesce(reason, 'relationship_evidence_insufficient') AS reason, coalesce(priority, 'P1') AS priority, coalesce(rows, 0)::BIGINT AS rows FROM (SELECT DISTINCT event_id FROM pr) e LEFT JOIN p ON p.event_id = e.event_id AND k = 1""",
    "pr",
)
def residual_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an event stays in review: the most common reason among its rows (of equal ones the first), its
    priority, and how many rows there are; without any the evidence is insufficient."""
    rows = binding.programme(spark, sf_dir).groupBy("event_id", "position").agg(F.min(dealt(_STATUSES, F.col("work_id"))).alias("status"))
    reason = cascade([(F.col("status") == s, r) for s, r, _ in _REASONS], F.lit(None).cast("string"))
    main = most_common(rows.select("event_id", "position", reason.alias("reason")).where("reason is not null"), "event_id", "reason", "position")
    priority = cascade([(F.col("reason") == r, p) for _, r, p in _REASONS], "P1")
    every = rows.select("event_id").distinct().join(main, "event_id", "left")
    return every.select("event_id", F.coalesce("reason", F.lit("relationship_evidence_insufficient")).alias("reason"), priority.alias("priority"), F.coalesce("rows", F.lit(0)).alias("rows"))


@query(
    "source_discovery",
    """
    WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://h' || page_id || '.fr' WHEN 1 THEN 'https://h' || page_id || '.org' ELSE 'https://h' || page_id || '.co.uk' END AS base, CASE WHEN page_id % 2 = 0 THEN 'pt' ELSE 'nl' END AS lang, page_id % 5 AS form FROM pages)
    SELECT page_id, CASE WHEN form = 1 THEN base || '/blog/feed.xml' ELSE base || '/blog/' || page_id END AS source_url, CASE WHEN form <= 1 THEN 'rss' ELSE 'website' END AS kind,
           CASE page_id % 3 WHEN 0 THEN 'fr' WHEN 2 THEN 'gb' ELSE CASE WHEN lang = 'pt' AND form > 0 THEN 'pt' ELSE 'other' END END AS country FROM p""",
)
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a url is as a source: a feed, a page that names its feed (with the feed's own url), or a
    website; and its country, by domain or else by language."""
    n = F.col("page_id")
    base = F.concat(F.lit("https://h"), n.cast("string"), F.when(n % 3 == 0, ".fr").when(n % 3 == 1, ".org").otherwise(".co.uk"))
    url = F.concat(base, F.lit("/blog/"), n.cast("string"), F.lit("?x=1"))
    head = F.concat(F.lit('<html lang="'), F.when(n % 2 == 0, "pt-BR").otherwise("nl"), F.lit('"><head>'), F.when(n % 5 == 1, F.lit('<link rel="alternate" type="application/rss+xml" href="feed.xml">')).otherwise(""), F.lit("</head>"))
    rows = binding.pages(spark, sf_dir).select("page_id", url.alias("url"), F.when(n % 5 == 0, F.lit("<rss><channel></channel></rss>")).otherwise(head).alias("html"))
    return html.discovered(rows, "page_id", "url", "html")


@query(
    "paged_sources",
    """
    WITH s AS (SELECT l_suppkey AS source, l_partkey % 100 AS key, l_orderkey AS event_id, l_orderkey // 500 AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate BETWEEN '1995-01-01' AND '1996-12-31')
    SELECT source, key, event_id % 400 AS event_id, count(*) AS rows, count(DISTINCT page) > 1 AS across_pages FROM s GROUP BY ALL""",
)
def paged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows of events within a range of dates; a key that comes on several pages of the scan is
    flagged, while repeats within one page are legal."""
    rows = binding.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("key"), F.col("l_orderkey").alias("_event"))
    events = binding.occurrences(spark, sf_dir).where(F.col("date").between("1995-01-01", "1996-12-31")).select(F.col("event_id").alias("_event"))
    scan = rows.join(events, "_event").select("source", "key", (F.col("_event") % 400).alias("event_id"), F.expr("_event div 500").alias("page"))
    return scan.groupBy("source", "key", "event_id").agg(F.count(F.lit(1)).alias("rows"), (F.count_distinct("page") > 1).alias("across_pages"))


@query(
    "run_guards",
    """
    WITH before AS (SELECT * FROM pr WHERE position < 5), after AS (SELECT event_id, position, CASE WHEN work_id % 97 > 0 THEN work_id END AS work_id FROM pr WHERE position < 6)
    SELECT 'baseline_rows' AS check_name, CASE WHEN (SELECT count(*) FROM before) <> (SELECT count(*) FROM pr WHERE position <> 5 AND position < 6) THEN 1 ELSE 0 END::BIGINT AS offenders
    UNION ALL SELECT 'null_work', count(*) FROM after WHERE work_id IS NULL
    UNION ALL SELECT 'title_of_several_works', count(*) FROM (SELECT title FROM wk GROUP BY title HAVING count(DISTINCT work_id) > 1)
    UNION ALL SELECT 'rows_not_in_whole_table', count(*) FROM (SELECT * FROM after EXCEPT SELECT event_id, position, work_id FROM pr)
    UNION ALL SELECT 'slots_taken_twice', count(*) FROM (SELECT event_id, position FROM after GROUP BY ALL HAVING count(*) > 1)""",
    "pr wk",
)
def run_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guards around a change: rows as in the baseline, no missing work, aliases of one work, no row that
    the whole table lacks, one row a slot."""
    whole = binding.programme(spark, sf_dir)
    before = whole.where("position < 5")
    after = whole.where("position < 6").withColumn("work_id", F.when(F.col("work_id") % 97 > 0, F.col("work_id")))
    expected = whole.where("position <> 5 and position < 6")
    counts = before.agg(F.count(F.lit(1)).alias("_a")).join(expected.agg(F.count(F.lit(1)).alias("_b")), F.lit(True))
    checks = {
        "baseline_rows": counts.where("_a != _b"),
        "null_work": after.where("work_id is null"),
        "title_of_several_works": binding.works(spark, sf_dir).groupBy("title").agg(F.count_distinct("work_id").alias("n")).where("n > 1"),
        "rows_not_in_whole_table": after.subtract(whole),
        "slots_taken_twice": after.groupBy("event_id", "position").count().where("count > 1"),
    }
    return guard_report(checks)
