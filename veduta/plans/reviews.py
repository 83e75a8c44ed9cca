"""Evidence reviews, indexes, staging files, baselines and array tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions import text, urls
from veduta.operators import merge
from veduta.operators.evidence import identity_statuses, key_multimap
from veduta.plans.registry import query
from veduta.session import new_folder
from veduta.sources import files

_KINDS = {"1-URGENT": "verified", "2-HIGH": "other_role", "3-MEDIUM": "attribution", "4-NOT SPECIFIED": "malformed", "5-LOW": "fragment"}
_KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_KINDS)) + " END"


@query(
    "evidence_statuses",
    f"""
    WITH e AS (SELECT o_custkey, {_KIND_SQL} AS kind, 'Supplier#' || (o_orderkey % 40) AS canonical FROM orders WHERE o_orderstatus <> 'O'),
    b AS (SELECT 'name ' || o_custkey AS name, (min(struct_pack(kind := kind, canonical := canonical))).kind AS kind, (min(struct_pack(kind := kind, canonical := canonical))).canonical AS canonical FROM e WHERE kind IS NOT NULL GROUP BY o_custkey),
    m AS (SELECT 'supplier#' || s_suppkey AS k, min(s_suppkey) AS id FROM supplier WHERE s_suppkey % 40 < 25 GROUP BY 1),
    al AS (SELECT 'name ' || c_custkey AS k, min(c_nationkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
    r AS (SELECT n.name, b.kind, lower(b.canonical) AS h, al.id AS alias_id, CASE WHEN b.kind = 0 THEN m.id END AS hinted FROM (SELECT DISTINCT 'name ' || c_custkey AS name FROM customer) n LEFT JOIN b ON b.name = n.name LEFT JOIN al ON al.k = n.name LEFT JOIN m ON m.k = lower(b.canonical))
    SELECT name, CASE WHEN hinted IS NOT NULL AND alias_id IS NULL THEN 'global_alias_gap' WHEN alias_id IS NOT NULL THEN 'existing_global_identity' WHEN kind = 0 THEN 'confirmed_new_global_composer' WHEN kind = 1 THEN 'not_a_composer'
                WHEN kind = 2 THEN 'source_attribution_review' WHEN kind = 3 THEN 'malformed_source' WHEN kind = 4 THEN 'incomplete_identity_review' ELSE 'unresolved_identity' END AS status,
           CASE WHEN hinted IS NOT NULL AND alias_id IS NULL THEN hinted ELSE alias_id END AS composer_id, CASE WHEN alias_id IS NULL AND kind = 0 THEN name END AS proposed_alias FROM r""",
)
def evidence_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names reviewed against masters, aliases and the strongest evidence found for each."""
    customer, orders, supplier = (binding.table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    name = lambda c: F.concat(F.lit("name "), F.col(c).cast("string"))
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("o_orderpriority")]
    evidence = orders.where("o_orderstatus != 'O'").select(name("o_custkey").alias("name"), kind.alias("kind"), F.concat(F.lit("Supplier#"), (F.col("o_orderkey") % 40).cast("string")).alias("canonical"))
    masters = supplier.where("s_suppkey % 40 < 25").select(F.col("s_suppkey").alias("composer_id"), F.concat(F.lit("Supplier#"), F.col("s_suppkey").cast("string")).alias("canonical_name"))
    aliases = customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("composer_id"), name("c_custkey").alias("alias"))
    return identity_statuses(customer.select(name("c_custkey").alias("n")), "n", masters, aliases, evidence, lambda c: F.lower(F.trim(c)))


@query(
    "title_index",
    """
    WITH k AS (SELECT p_partkey, p_name AS key FROM part UNION SELECT p_partkey, lower(replace(p_name, ' ', '')) FROM part)
    SELECT key, list_sort(list(DISTINCT p_partkey)) AS ids, count(DISTINCT p_partkey) > 1 AS ambiguous FROM k WHERE key <> '' GROUP BY key""",
)
def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by their title and by its letters and digits; keys of several works are ambiguous."""
    return key_multimap(binding.works(spark, sf_dir), "work_id", F.col("title"), text.compact_key(F.col("title")))


@query("staged_lines", "SELECT event_id, CASE WHEN value > 50 THEN value END AS value, event_type FROM events")
def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records staged as JSON lines and read back, with nulls left out of the file."""
    path = new_folder(spark, "staged")
    rows = binding.usage(spark, sf_dir).select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("value"), "event_type")
    files.stage_json_lines(rows, path)
    return files.json_lines(spark, path, "event_id long, value double, event_type string")


@query(
    "report_documents",
    "SELECT o_orderstatus AS status, count(*) AS events, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY o_orderstatus",
)
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files, one JSON document for each status, read back."""
    path = new_folder(spark, "reports")
    rows = binding.occurrences(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("events"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    rows.write.partitionBy("status").json(path)
    return spark.read.schema("events long, first_day date, last_day date, status string").json(path)


@query(
    "inserted_once",
    """
    WITH t AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS artist_id FROM lineitem WHERE l_returnflag = 'A'), s AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS artist_id FROM lineitem)
    SELECT * FROM t UNION SELECT * FROM s""",
)
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after inserting those that are absent; conflicts change nothing."""
    rows = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("artist_id"), F.col("l_returnflag").alias("flag"))
    stored = rows.where("flag = 'A'").select("event_id", "artist_id").distinct()
    return merge.insert_ignore(stored, rows.select("event_id", "artist_id").distinct(), ["event_id", "artist_id"])


@query(
    "host_pages",
    r"""
    WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages)
    SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || host || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '\?[^#]*', 0) AS link
    FROM h WHERE host = (SELECT max(host) FROM h)""",
)
def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host, whose query is part of their identity (the last host by name)."""
    pages = binding.pages(spark, sf_dir)
    host = pages.agg(F.max(urls.url_host(F.col("url")))).first()[0]
    return pages.select("page_id", urls.canonical_keeping_query(F.col("url"), host).alias("link")).where("link is not null")


@query(
    "baseline_checks",
    """
    WITH s AS (SELECT o_custkey AS venue_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), c AS (SELECT o_custkey AS venue_id, count(*) AS n FROM orders GROUP BY 1)
    SELECT c.venue_id, coalesce(s.n, 0) AS expected, c.n AS found, coalesce(s.n, 0) = c.n AS unchanged FROM c LEFT JOIN s USING (venue_id)""",
)
def baseline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of every venue against a snapshot's: only unchanged ones may be written."""
    rows = binding.occurrences(spark, sf_dir)
    snapshot = rows.where("status != 'P'").groupBy("venue_id").agg(F.count(F.lit(1)).alias("expected"))
    found = rows.groupBy("venue_id").agg(F.count(F.lit(1)).alias("found")).join(snapshot, "venue_id", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return found.select("venue_id", "expected", "found", (F.col("expected") == F.col("found")).alias("unchanged"))


@query(
    "array_tests",
    """
    SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.25)) > 0 AS some_large, len(list_filter(embedding, lambda x: x <= -0.3)) = 0 AS no_low, len(list_filter(embedding, lambda x: x > 0)) AS positive,
           round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE * 2)), 5) AS head, embedding[64]::DOUBLE AS last FROM embeddings""",
)
def array_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any, all, filter, map, slice and index over arrays."""
    v = F.col("embedding").cast("array<double>")
    head = F.aggregate(F.transform(F.slice(v, 1, 4), lambda x: x * 2), F.lit(0.0), lambda a, x: a + x)
    return binding.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.exists(v, lambda x: x > 0.25).alias("some_large"), F.forall(v, lambda x: x > -0.3).alias("no_low"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(head, 5).alias("head"), F.element_at(v, -1).alias("last")
    )


@query(
    "newest_articles",
    """
    WITH d AS (SELECT doc_id, source, lang, DATE '2024-01-01' + (doc_id % 365)::INTEGER AS day FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, source, day, row_number() OVER (PARTITION BY source ORDER BY day DESC, doc_id DESC) AS place FROM d""",
)
def newest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of every source, newest first: numbered within a source's months and offset by those after them."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    rows = binding.articles(spark, sf_dir).where("text is not null").select("doc_id", "source", day.alias("day")).withColumn("_m", F.trunc("day", "month"))
    later = Window.partitionBy("source").orderBy(F.desc("_m")).rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy("source", "_m").agg(F.count(F.lit(1)).alias("_n")).select("source", "_m", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    inside = F.row_number().over(Window.partitionBy("source", "_m").orderBy(F.desc("day"), F.desc("doc_id")))
    return rows.withColumn("_inside", inside).join(months, ["source", "_m"]).select("doc_id", "source", "day", (F.col("_later") + F.col("_inside")).alias("place"))
