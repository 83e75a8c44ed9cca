"""Reports of runs, lookups between staged and stored rows, and rules for what is no work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.text import strong_tokens, text_or_empty
from veduta.operators.reconcile import OBSERVED, observation
from veduta.operators.rules import cascade
from veduta.operators.titles import group_key, looks_like_person, non_work_reason
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql


@query(
    "programme_summary",
    """
    WITH p AS (SELECT event_id, count(*) AS n, bool_or(position % 5 = 0 AND kind = 'ECONOMY') AS missing FROM pr JOIN wk USING (work_id) GROUP BY event_id)
    SELECT event_type, count(*) AS events, count(n) AS with_programme, count(*) FILTER (WHERE missing) AS with_missing, count(*) FILTER (WHERE n IS NULL) AS without_programme,
           round(100.0 * count(n) / count(*), 2)::DOUBLE AS percentage, (count(*) - count(DISTINCT (venue_id, date)))::BIGINT AS excess
    FROM ev LEFT JOIN p USING (event_id) GROUP BY event_type""",
    "ev pr wk",
)
def programme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type: events with a programme, with any work that lacks data, without one, and how many
    occurrences repeat a place and date."""
    works = binding.programme(spark, sf_dir).join(binding.works(spark, sf_dir).select("work_id", "kind"), "work_id")
    listed = works.groupBy("event_id").agg(F.collect_list(F.struct("position", "kind")).alias("programme"))
    rows = binding.occurrences(spark, sf_dir).join(listed, "event_id", "left")
    missing = F.exists("programme", lambda w: (w["position"] % 5 == 0) & (w["kind"] == "ECONOMY"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("programme").alias("with_programme"), F.count_if(missing).alias("with_missing"), F.count_if(F.col("programme").isNull()).alias("without_programme"),
        F.round(100.0 * F.count("programme") / F.count(F.lit(1)), 2).alias("percentage"), (F.count(F.lit(1)) - F.count_distinct("venue_id", "date")).alias("excess"),
    )


@query(
    "discovery_summary",
    """
    WITH o AS (SELECT split_part(split_part(url, '://', 2), '#', 1) AS page, url, page_id, html, regexp_matches(html, '(?i)<article') AS detail, length(html) AS size FROM pages),
    f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY page_id) AS r, count(*) OVER (PARTITION BY page) AS n FROM o)
    SELECT count(*) AS occurrences, count(*) FILTER (WHERE r = 1) AS pages, sum(CASE WHEN r = 1 THEN n - 1 END)::BIGINT AS repeats, count(*) FILTER (WHERE r = 1 AND n > 1) AS reused_pages, max(n) AS most_reused,
      count(*) FILTER (WHERE r = 1 AND detail) AS pages_with_detail, count(*) FILTER (WHERE detail) AS occurrences_with_detail, count(*) FILTER (WHERE r = 1 AND size > 3000) AS long_pages,
      round(100.0 * count(*) FILTER (WHERE r = 1 AND detail) / count(*) FILTER (WHERE r = 1), 2)::DOUBLE AS coverage, min(page_id) AS first_page, max(page_id) AS last_page
    FROM f""",
)
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a discovery, by pages (the first occurrence counts) and by occurrences."""
    page = F.substring_index(F.split("url", "://")[1], "#", 1)
    rows = binding.pages(spark, sf_dir).select(page.alias("page"), "page_id", F.col("html").rlike("(?i)<article").alias("detail"), (F.length("html") > 3000).alias("long"))
    by_page = rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "detail", "long")).alias("first"), F.count_if("detail").alias("details"), F.max("page_id").alias("last"))
    first = lambda c: F.count_if(F.col(f"first.{c}"))
    return by_page.agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("n") > 1).alias("reused_pages"), F.max("n").alias("most_reused"),
        first("detail").alias("pages_with_detail"), F.sum("details").alias("occurrences_with_detail"), first("long").alias("long_pages"),
        F.round(100.0 * first("detail") / F.count(F.lit(1)), 2).alias("coverage"), F.min("first.page_id").alias("first_page"), F.max("last").alias("last_page"),
    )


@query(
    "conflict_counts",
    f"""
    WITH f AS (SELECT {dealt_sql(OBSERVED, 'doc_id')} AS field, CASE WHEN doc_id % 3 = 0 THEN lang END AS old, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS new FROM documents)
    SELECT field || ':' || CASE WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' WHEN coalesce(new, '') = '' THEN 'empty_staging' ELSE 'changed_or_quality_review' END AS observation, count(*) AS n FROM f GROUP BY 1""",
)
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each observation was made of fields that are never written."""
    n = F.col("doc_id")
    seen = F.create_map(dealt(OBSERVED, n), observation(F.when(n % 3 == 0, F.col("lang")), F.when(n % 2 == 0, F.col("lang")).otherwise("")))
    each = binding.articles(spark, sf_dir).select(F.explode(seen).alias("field", "what"))
    return each.groupBy(F.concat_ws(":", "field", "what").alias("observation")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reconciliation_counts",
    """
    WITH official AS (SELECT DISTINCT venue_id, date FROM ev WHERE event_id % 3 > 0), db AS (SELECT event_id, venue_id, date FROM ev WHERE event_id % 4 > 0),
    m AS (SELECT o.venue_id, o.date, count(d.event_id) AS n FROM official o LEFT JOIN db d ON d.venue_id = o.venue_id AND d.date = o.date GROUP BY ALL),
    x AS (SELECT event_id FROM db WHERE (venue_id, date) NOT IN (SELECT venue_id, date FROM official))
    SELECT count(*) FILTER (WHERE n >= 1) AS matched, count(*) FILTER (WHERE n = 0) AS unmatched, count(*) FILTER (WHERE n > 1) AS ambiguous, (SELECT count(*) FROM x) AS extra,
           (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM x)) AS dependants FROM m""",
    "ev",
)
def reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official dates found once, not, or more than once among stored events, stored events that no
    official date has, and what depends on those."""
    rows = binding.occurrences(spark, sf_dir).select("event_id", "venue_id", "date")
    official = rows.where("event_id % 3 > 0").select("venue_id", "date").distinct()
    stored = rows.where("event_id % 4 > 0")
    by_key = stored.groupBy("venue_id", "date").agg(F.count(F.lit(1)).alias("n"))
    counts = official.join(by_key, ["venue_id", "date"], "left").agg(F.count("n").alias("matched"), F.count_if(F.col("n").isNull()).alias("unmatched"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    extra = stored.join(official, ["venue_id", "date"], "left_anti").select("event_id")
    parts = binding.programme(spark, sf_dir).join(extra, "event_id", "left_semi").agg(F.count(F.lit(1)).alias("dependants"))
    return counts.join(extra.agg(F.count(F.lit(1)).alias("extra")), F.lit(True)).join(parts, F.lit(True))


@query(
    "event_type_baseline",
    "SELECT event_type, count(*) AS n, max(c) - count(*) AS off FROM ev JOIN (SELECT event_type, count(*) AS c FROM ev WHERE event_id % 100 > 0 GROUP BY 1) USING (event_type) GROUP BY event_type",
    "ev",
)
def event_type_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, and by how many the count is off its baseline."""
    rows = binding.occurrences(spark, sf_dir)
    baseline = rows.where("event_id % 100 > 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("_c"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(baseline, "event_type").select("event_type", "n", (F.col("_c") - F.col("n")).alias("off"))


@query(
    "revalidated_works",
    """
    WITH u AS (SELECT title, min(work_id) AS work_id FROM wk GROUP BY title HAVING count(*) = 1),
    s AS (SELECT work_id AS n, CASE WHEN work_id % 3 = 0 THEN work_id WHEN work_id % 3 = 1 THEN -1 END AS prior, title FROM wk)
    SELECT s.n, coalesce(a.work_id, u.work_id) AS work_id, CASE WHEN a.work_id IS NOT NULL THEN 'prior' WHEN u.work_id IS NOT NULL THEN 'identity' END AS via FROM s LEFT JOIN wk a ON a.work_id = s.prior LEFT JOIN u ON u.title = s.title""",
    "wk",
)
def revalidated_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works looked up by the id they had before and then by an identity that only one work has."""
    works = binding.works(spark, sf_dir).select("work_id", "title")
    staged = works.select(F.col("work_id").alias("n"), F.when(F.col("work_id") % 3 == 0, F.col("work_id")).when(F.col("work_id") % 3 == 1, -1).alias("prior"), "title")
    unique = works.groupBy("title").agg(F.count(F.lit(1)).alias("_c"), F.min("work_id").alias("_unique")).where("_c = 1").drop("_c")
    found = staged.join(works.select(F.col("work_id").alias("_prior")), F.col("prior") == F.col("_prior"), "left").join(unique, "title", "left")
    return found.select("n", F.coalesce("_prior", "_unique").alias("work_id"), cascade([(F.col("_prior").isNotNull(), "prior"), (F.col("_unique").isNotNull(), "identity")], F.lit(None).cast("string")).alias("via"))


@query(
    "equivalent_works",
    """
    WITH k AS (SELECT event_id, position, work_id, title, CASE WHEN work_id % 4 > 0 THEN composer END AS composer FROM pr JOIN wk USING (work_id))
    SELECT a.event_id, a.position, count(*) AS same FROM k a JOIN k b ON a.event_id = b.event_id AND a.position < b.position AND (a.work_id = b.work_id OR (a.title = b.title AND a.composer IS NOT DISTINCT FROM b.composer)) GROUP BY 1, 2""",
    "pr wk",
)
def equivalent_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later entries of a programme that are the same work: one id, or one title and composer, where no
    composer equals no composer."""
    rows = binding.programme(spark, sf_dir).join(binding.works(spark, sf_dir), "work_id").select("event_id", "position", "work_id", "title", F.when(F.col("work_id") % 4 > 0, F.col("composer")).alias("composer"))
    later = rows.select("event_id", F.col("position").alias("_p"), F.col("work_id").alias("_w"), F.col("title").alias("_t"), F.col("composer").alias("_c"))
    same = (F.col("work_id") == F.col("_w")) | ((F.col("title") == F.col("_t")) & F.col("composer").eqNullSafe(F.col("_c")))
    return rows.join(later, "event_id").where((F.col("position") < F.col("_p")) & same).groupBy("event_id", "position").agg(F.count(F.lit(1)).alias("same"))


@query(
    "events_by_url",
    """
    WITH u AS (SELECT event_id, 'https://h.org/' || (event_id % 500) AS url FROM ev)
    SELECT p.page, u.event_id FROM (SELECT DISTINCT 'https://h.org/' || (l_partkey % 700) AS page FROM lineitem) p JOIN u ON u.url = p.page""",
    "ev",
)
def events_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every enriched page, by url."""
    url = lambda c: F.concat(F.lit("https://h.org/"), c.cast("string"))
    stored = binding.occurrences(spark, sf_dir).select("event_id", url(F.col("event_id") % 500).alias("page"))
    pages = binding.programme(spark, sf_dir).select(url(F.col("work_id") % 700).alias("page")).distinct()
    return pages.join(stored, "page").select("page", "event_id")


@query(
    "merged_defaults",
    "SELECT s_suppkey AS id, s_name AS name, 'stored' AS origin FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT c_custkey, c_name, 'default' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)",
)
def merged_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored subscriptions, and the defaults whose feed is not among them."""
    stored = binding.table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("stored").alias("origin"))
    defaults = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("default").alias("origin"))
    return stored.unionByName(defaults.join(stored.select("id"), "id", "left_anti"))


@query(
    "found_or_created",
    """
    WITH n AS (SELECT DISTINCT p_name || '/' || p_brand AS key FROM part), m AS (SELECT p_name || '/' || p_brand AS key, min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
    SELECT n.key, coalesce('stored-' || m.id, 'new-' || substr(md5(n.key), 1, 8)) AS id, m.id IS NULL AS created FROM n LEFT JOIN m ON m.key = n.key""",
)
def found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct key of a batch with the entity it finds, or the one that is made for it once."""
    part = binding.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("key"))
    master = part.where("p_partkey % 2 = 0").groupBy("key").agg(F.min("p_partkey").alias("_id"))
    rows = part.select("key").distinct().join(master, "key", "left")
    made = F.concat(F.lit("new-"), F.substring(F.md5(F.col("key").cast("binary")), 1, 8))
    return rows.select("key", F.coalesce(F.concat(F.lit("stored-"), F.col("_id").cast("string")), made).alias("id"), F.col("_id").isNull().alias("created"))


@query(
    "repaired_keys",
    """
    WITH c AS (SELECT event_id, position, min(work_id) AS created FROM pr WHERE work_id % 2 = 0 GROUP BY 1, 2)
    SELECT p.event_id, p.position, coalesce(CASE WHEN p.work_id % 3 > 0 THEN p.work_id END, c.created) AS work_id, p.work_id % 3 = 0 AND c.created IS NULL AS unresolved FROM pr p LEFT JOIN c USING (event_id, position)""",
    "pr",
)
def repaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing work ids filled from what was created for the same occurrence; the rest stay unresolved."""
    rows = binding.programme(spark, sf_dir)
    created = rows.where("work_id % 2 = 0").groupBy("event_id", "position").agg(F.min("work_id").alias("_created"))
    own = F.when(F.col("work_id") % 3 > 0, F.col("work_id"))
    filled = rows.join(created, ["event_id", "position"], "left").withColumn("work_id", F.coalesce(own, "_created"))
    return filled.select("event_id", "position", "work_id", F.col("work_id").isNull().alias("unresolved"))


#: A title, whether it looks like a person, why it is no work without and with a composer, and its group.
_TITLES = (
    ("Ludwig van Beethoven", 1, "artist_or_attribution_name", None, "ludwigvanbeethoven"),
    ("Piano: Anna Roe", 0, "instrument_or_role_label", "instrument_or_role_label", "pianoannaroe"),
    ("Segunda parte", 0, "programme_separator", "programme_separator", "segundaparte"),
    ("II. Allegro con brio", 0, "movement_or_numbered_fragment", "movement_or_numbered_fragment", "iiallegroconbrio"),
    ("3. Suite BWV 1008", 1, "artist_or_attribution_name", None, "3suitebwv1008"),
    ("ABCD", 1, "artist_or_attribution_name", "ensemble_or_acronym", "abcd"),
    ("a", 0, "empty_or_too_short", "empty_or_too_short", "a"),
    ("Sinfonía nº 5 en do menor", 0, None, None, "sinfoniano5endomenor"),
    ("la Bella de Cádiz", 1, "artist_or_attribution_name", None, "labelladecadiz"),
    ("«Eroica»", 0, None, None, "eroica"),
    ("tres danzas", 0, None, None, "tresdanzas"),
    ("", 0, "empty_or_too_short", "empty_or_too_short", ""),
)


@query(
    "non_works",
    f"SELECT event_id, position, person = 1 AS person, alone, composed, grouped FROM (SELECT event_id, position, {dealt_sql([t[0] for t in _TITLES], 'event_id + position')} AS t FROM pr) JOIN {values_sql(_TITLES, 'x', 'title, person, alone, composed, grouped')} ON t = title",
    "pr",
)
def non_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a title is no work, without and with a composer, whether it looks like a person, and its key."""
    t = dealt([x[0] for x in _TITLES], F.col("event_id") + F.col("position"))
    return binding.programme(spark, sf_dir).select(
        "event_id", "position", looks_like_person(t).alias("person"), non_work_reason(t, F.lit(False)).alias("alone"), non_work_reason(t, F.lit(True)).alias("composed"), group_key(t).alias("grouped")
    )


@query(
    "contaminated_works",
    "SELECT work_id, work_id % 3 = 0 AND work_id % 2 = 0 AS contaminated FROM wk",
    "wk",
)
def contaminated_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a composer whose title is a person's name without a catalogue number: parsing debris."""
    n = F.col("work_id")
    title = F.when(n % 3 == 0, "Anna María Roe (1901-1980) –").when(n % 3 == 1, "Suite op. 4").otherwise("Anna Roe, BWV 12")
    found = looks_like_person(title_alone(title)) & (F.size(strong_tokens(title)) == 0)
    return binding.works(spark, sf_dir).select("work_id", ((n % 2 == 0) & found).alias("contaminated"))


def title_alone(c: Column) -> Column:
    """A title without life span and edge punctuation."""
    return F.btrim(F.regexp_replace(text_or_empty(c), r"\s*\((?:ca\.\s*)?\d{3,4}(?:\s*[-–—]\s*(?:ca\.\s*)?\d{2,4})?\s*\)", ""), F.lit(" –—-.,"))


@query(
    "slot_duplicates",
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_id, work_id ORDER BY position) AS r FROM pr)
    SELECT event_id, position, work_id, CASE WHEN r > 1 THEN 'noop' ELSE 'insert' END AS outcome FROM r""",
    "pr",
)
def slot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an event and work: the first keeps its insert, the others do nothing."""
    again = F.row_number().over(Window.partitionBy("event_id", "work_id").orderBy("position")) > 1
    return binding.programme(spark, sf_dir).select("event_id", "position", "work_id", F.when(again, "noop").otherwise("insert").alias("outcome"))
