"""Data-quality profiles of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.identity import SHAPES, identity_shape
from veduta.functions.urls import canonical_url
from veduta.operators.merge import guard_report, orphans
from veduta.operators.rules import cascade
from veduta.plans.registry import query

SAMPLES = 20


@query(
    "source_audit_summary",
    """
    SELECT source, count(*) AS records, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS blank_texts, count(DISTINCT nullif(trim(text), '')) AS distinct_texts,
           count(DISTINCT lang) AS languages, min(n_chars) AS shortest, max(n_chars) AS longest, round(100.0 * count(*) FILTER (WHERE n_chars >= 1000) / count(*), 2)::DOUBLE AS long_percent
    FROM documents GROUP BY source""",
)
def source_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: records, blanks, distinct texts (by digest), range of lengths, share of long ones."""
    filled = F.when(F.trim("text") != "", F.sha2(F.trim("text").cast("binary"), 256))
    return binding.articles(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank_texts"),
        F.count_distinct(filled).alias("distinct_texts"),
        F.count_distinct("lang").alias("languages"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        F.round(F.lit(100.0) * F.count_if(F.col("n_chars") >= 1000) / F.count(F.lit(1)), 2).alias("long_percent"),
    )


@query(
    "duplicate_identity_groups",
    """
    SELECT event_id, position, count(*) AS occurrences, count(DISTINCT work_id) AS works, min(work_id) AS first_work
    FROM pr GROUP BY event_id, position HAVING count(*) > 1""",
    "pr",
)
def duplicate_identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that occur more than once, with their distinct works."""
    groups = binding.programme(spark, sf_dir).groupBy("event_id", "position")
    return groups.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("work_id").alias("works"), F.min("work_id").alias("first_work")).where("occurrences > 1")


@query(
    "shared_keys",
    "SELECT work_id, artist_id, count(DISTINCT event_id) AS events FROM (SELECT l_partkey AS work_id, l_suppkey AS artist_id, l_orderkey AS event_id FROM lineitem) GROUP BY ALL HAVING count(DISTINCT event_id) > 1",
)
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work, artist) keys that stand for more than one event."""
    rows = binding.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("artist_id"), F.col("l_orderkey").alias("event_id"))
    return rows.groupBy("work_id", "artist_id").agg(F.count_distinct("event_id").alias("events")).where("events > 1")


@query(
    "event_multiplicity",
    "SELECT identities, count(*) AS events FROM (SELECT event_id, count(DISTINCT (work_id, position)) AS identities FROM pr GROUP BY event_id) GROUP BY identities",
    "pr",
)
def event_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events have how many distinct identities (nested aggregation)."""
    per_event = binding.programme(spark, sf_dir).distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("identities"))
    return per_event.groupBy("identities").agg(F.count(F.lit(1)).alias("events"))


@query(
    "identity_histogram",
    r"""
    WITH v AS (SELECT doc_id::VARCHAR AS v, source AS s FROM documents UNION ALL SELECT source || ':' || doc_id, source FROM documents UNION ALL SELECT url, 'web' FROM pages
               UNION ALL SELECT p_name, 'part' FROM part UNION ALL SELECT p_brand || '?', 'part' FROM part
               UNION ALL SELECT '//' || split_part(url, '://', 2), 'web' FROM pages UNION ALL SELECT source || ':', source FROM documents UNION ALL SELECT lpad(doc_id::VARCHAR, 8, '0') || '-0000-' || (doc_id % 8) || '000-8000-000000000000', 'u' FROM documents
               UNION ALL SELECT '9' || strftime(o_orderdate, '%Y-%m-%d'), 'o' FROM orders UNION ALL SELECT 'x-' || strftime(o_orderdate, '%Y-%m-%d') || '-1', 'o' FROM orders),
    k AS (SELECT CASE WHEN regexp_full_match(v, '\p{Nd}+') THEN 'numeric'
        WHEN regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'uuid'
        WHEN prefix(v, s || ':') AND length(v) > length(s) + 1 THEN 'source_prefixed' WHEN regexp_matches(v, '(?i)^(https?://|//|www\.)') THEN 'url_like'
        WHEN regexp_matches(v, '(^|[^0-9])\d{4}-\d{2}-\d{2}([^0-9]|$)') THEN 'date_composite'
        WHEN regexp_matches(v, '^[\p{L}\p{N}_][\p{L}\p{N}_ .:/+''()–—-]*$') AND regexp_matches(v, '\p{L}') THEN 'slug_or_text' ELSE 'other' END AS shape FROM (SELECT trim(v) AS v, s FROM v))
    SELECT d.shape, count(k.shape) AS n FROM (SELECT unnest(['numeric', 'uuid', 'source_prefixed', 'url_like', 'date_composite', 'slug_or_text', 'other']) AS shape) d LEFT JOIN k ON k.shape = d.shape GROUP BY d.shape""",
)
def identity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of several relations by shape, zero-filled over the fixed domain."""
    docs = binding.articles(spark, sf_dir)
    part, orders = binding.table(spark, sf_dir, "part"), binding.table(spark, sf_dir, "orders")
    values = docs.select(F.col("doc_id").cast("string").alias("v"), F.col("source").alias("s"))
    for more in (
        docs.select(F.concat_ws(":", "source", "doc_id"), "source"),
        binding.pages(spark, sf_dir).select("url", F.lit("web")),
        part.select("p_name", F.lit("part")),
        part.select(F.concat("p_brand", F.lit("?")), F.lit("part")),
        binding.pages(spark, sf_dir).select(F.concat(F.lit("//"), F.split("url", "://")[1]), F.lit("web")),
        docs.select(F.concat("source", F.lit(":")), "source"),
        docs.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("-0000-"), (F.col("doc_id") % 8).cast("string"), F.lit("000-8000-000000000000")), F.lit("u")),
        orders.select(F.concat(F.lit("9"), F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("o")),
        orders.select(F.concat(F.lit("x-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-1")), F.lit("o")),
    ):
        values = values.union(more)
    counted = values.groupBy(identity_shape(F.col("v"), F.col("s")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    domain = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SHAPES])).alias("shape"))
    return domain.join(counted, "shape", "left").select("shape", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "reused_hosts_topk",
    r"""
    SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host ORDER BY n DESC, host LIMIT 10""",
)
def reused_hosts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hosts with most pages (a top-k report)."""
    host = F.regexp_extract(canonical_url(F.col("url")), r"^[a-z]+://([^/?#]*)", 1)
    return binding.pages(spark, sf_dir).groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query(
    "first_last_samples",
    f"""
    SELECT source, doc_id, n_chars, CASE WHEN f <= {SAMPLES} THEN f END AS from_first, CASE WHEN l <= {SAMPLES} THEN l END AS from_last FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS f, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS l FROM documents)
    WHERE f <= {SAMPLES} OR l <= {SAMPLES}""",
)
def first_last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last samples of every source by (n_chars, doc_id); a top-k report.

    Both ends are cut per task before rows meet (window group limits), so a hot source sends few."""
    rows = binding.articles(spark, sf_dir).select("source", "doc_id", "n_chars")
    first = Window.partitionBy("source").orderBy("n_chars", "doc_id")
    last = Window.partitionBy("source").orderBy(F.desc("n_chars"), F.desc("doc_id"))
    head = rows.withColumn("from_first", F.row_number().over(first).cast("long")).where(F.col("from_first") <= SAMPLES)
    tail = rows.withColumn("from_last", F.row_number().over(last).cast("long")).where(F.col("from_last") <= SAMPLES)
    return head.join(tail, ["source", "doc_id", "n_chars"], "full")


@query(
    "readiness_ladder",
    """
    WITH s AS (SELECT source, count(*) AS found, count(*) FILTER (WHERE n_chars >= 200) AS detailed, count(labels.doc_id) AS checked FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) labels ON labels.doc_id = documents.doc_id GROUP BY source)
    SELECT source, found, detailed, checked, CASE WHEN found = 0 THEN 'EMPTY' WHEN detailed < found THEN 'PARTIAL' WHEN checked = 0 THEN 'UNCHECKED' ELSE 'READY' END AS status FROM s""",
)
def readiness_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its milestones, each counted from a field of its own, and the rung reached."""
    known = binding.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("_known")).dropDuplicates(["doc_id"])
    rows = binding.articles(spark, sf_dir).select("doc_id", "source", "n_chars").join(known, "doc_id", "left")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("n_chars") >= 200).alias("detailed"), F.count_if(F.col("_known")).alias("checked"))
    status = cascade([(F.col("found") == 0, "EMPTY"), (F.col("detailed") < F.col("found"), "PARTIAL"), (F.col("checked") == 0, "UNCHECKED")], "READY")
    return counts.withColumn("status", status)


@query(
    "guard_checks",
    """
    SELECT 'one_row_per_slot' AS check_name, count(*) AS offenders FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'programme_without_event', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'programme_without_work', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08)
    UNION ALL SELECT 'blank_name', count(*) FROM part WHERE coalesce(trim(p_name), '') = ''
    UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""",
)
def guard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint report: uniqueness, references, ranges, blanks and enumerations."""
    line, orders, part = (binding.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return guard_report(
        {
            "one_row_per_slot": line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
            "programme_without_event": orphans(line, orders, "l_orderkey", "o_orderkey"),
            "programme_without_work": orphans(line, part, "l_partkey", "p_partkey"),
            "discount_out_of_range": line.where(~F.col("l_discount").between(0, 0.08)),
            "blank_name": part.where(F.coalesce(F.trim("p_name"), F.lit("")) == ""),
            "unknown_status": orders.where(~F.col("o_orderstatus").isin("O", "F")),
        }
    )


@query(
    "dependency_counts",
    """
    SELECT s_suppkey AS artist_id, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS credits, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS events,
           (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS neighbours FROM supplier""",
)
def dependency_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on every artist: aggregates joined once instead of subqueries per row."""
    line = binding.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("artist_id")).agg(F.count(F.lit(1)).alias("credits"), F.count_distinct("l_orderkey").alias("events"))
    near = binding.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("neighbours"))
    artists = binding.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist_id"), "s_nationkey")
    joined = artists.join(line, "artist_id", "left").join(near, "s_nationkey", "left")
    return joined.select("artist_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("credits", "events", "neighbours")])
