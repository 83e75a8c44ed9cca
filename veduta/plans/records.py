"""Rows and documents: fallbacks, preferences, checks of records, states and small set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.identity import short_digest
from veduta.functions.records import canonical_json, document_value, fenced_json, preference
from veduta.functions.text import first_non_empty, is_empty
from veduta.operators.records import city_filled, semi_unless_empty, transitions
from veduta.operators.rules import cascade
from veduta.plans.registry import query


@query(
    "documents_from_rows",
    """
    SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'raw-' || (props->>'$.k') END AS kind,
           CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 3 = 1 THEN 'k' || (props->>'$.k') ELSE '' END AS published,
           CASE WHEN event_id % 5 = 0 THEN 'zh' WHEN event_id % 5 = 1 THEN 'content' END AS body,
           CASE event_id % 3 WHEN 0 THEN 'T' || event_id ELSE 'plain text ' || event_id END AS title
    FROM events""",
)
def documents_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of rows: columns override the raw record, maps and fenced JSON have fallbacks."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    raw = F.to_json(F.struct(F.concat(F.lit("raw-"), k).alias("kind"), F.when(n % 3 == 1, F.concat(F.lit("k"), k)).alias("published")))
    published_at = F.when(n % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
    none = F.create_map().cast("map<string,string>")
    translations = F.when(n % 5 == 0, F.create_map(F.lit("zh"), F.lit("zh"))).otherwise(none)
    contents = F.when(n % 5 <= 1, F.create_map(F.lit("zh"), F.lit("content"))).otherwise(none)
    answer = F.when(n % 3 == 0, F.concat(F.lit('```json\n{"title": "T'), n.cast("string"), F.lit('", "content": "c"}\n```'))).otherwise(F.concat(F.lit("```json {broken "), n.cast("string")))
    return binding.usage(spark, sf_dir).select(
        "event_id",
        document_value(F.when(n % 4 > 0, F.col("event_type")), raw, "kind").alias("kind"),
        F.coalesce(document_value(published_at, raw, "published"), F.lit("")).alias("published"),
        F.coalesce(translations["zh"], contents["zh"]).alias("body"),
        fenced_json(answer, F.concat(F.lit("plain text "), n.cast("string")), "title").alias("title"),
    )


@query(
    "rows_from_documents",
    """
    SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'own-' || doc_id END, substr(sha256('https://' || source || '.org/' || doc_id), 1, 16)) AS id, 'https://' || source || '.org/' || doc_id AS canonical_url, true AS published,
           CASE WHEN doc_id % 3 = 0 THEN '{"' || lang || '":"x"}' ELSE '{}' END AS translations, '{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' AS raw_data
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL""",
)
def rows_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows with one set of columns: derived ids, empty maps, the record as canonical JSON."""
    n = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".org/"), n.cast("string"))
    own = F.when(n % 2 == 0, F.concat(F.lit("own-"), n.cast("string")))
    maps = F.when(n % 3 == 0, F.create_map("lang", F.lit("x")))
    rows = binding.articles(spark, sf_dir).where("source is not null and lang is not null and n_chars is not null")
    return rows.select(
        "doc_id", first_non_empty(own, short_digest(url)).alias("id"), url.alias("canonical_url"), F.lit(True).alias("published"),
        F.to_json(F.coalesce(maps, F.create_map().cast("map<string,string>"))).alias("translations"), canonical_json("source", "n_chars", "lang").alias("raw_data"),
    )


@query(
    "profile_preferences",
    """
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal > 0 WHEN c_custkey % 2 = 0 THEN c_acctbal > 5000 ELSE false END AS digest,
           CASE WHEN c_custkey % 5 = 0 THEN true ELSE c_acctbal < 9000 END AS enabled, CASE WHEN c_custkey % 5 = 0 THEN false ELSE c_acctbal < 9000 END AS general_enabled,
           c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' AS passes, CASE WHEN c_custkey % 2 = 0 THEN 'optional' ELSE 'going' END AS stored_intent, CASE WHEN c_custkey % 2 = 0 THEN 'maybe_go' ELSE 'going' END AS shown_intent
    FROM customer""",
)
def profile_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of three states, defaults for what is missing, filters that a missing column passes, and
    intents in both codes."""
    n, money = F.col("c_custkey"), F.col("c_acctbal")
    digest = preference(F.when(n % 3 > 0, money > 0), F.when(n % 2 == 0, money > 5000))
    flag, kind = F.when(n % 5 > 0, money < 9000), F.when(n % 4 > 0, F.col("c_mktsegment"))
    intent = F.when(n % 2 == 0, "maybe_go").otherwise("going")
    stored = cascade([(intent == "maybe_go", "optional")], intent)
    return binding.table(spark, sf_dir, "customer").select(
        n.alias("user_id"), digest.alias("digest"), F.coalesce(flag, F.lit(True)).alias("enabled"), F.coalesce(flag, F.lit(False)).alias("general_enabled"),
        (kind.isNull() | (kind == "BUILDING")).alias("passes"), stored.alias("stored_intent"), cascade([(stored == "optional", "maybe_go")], stored).alias("shown_intent"),
    )


@query(
    "public_subscriptions",
    "SELECT s_suppkey AS id, s_name AS name, 'https://' || s_suppkey || '.org/feed' AS feed_url, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey % 8 = 0 ELSE s_suppkey % 3 = 0 END AS custom_eligible FROM supplier WHERE s_suppkey % 7 > 0",
)
def public_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safe fields of subscriptions with a feed; a flag that is missing follows the source type."""
    n = F.col("s_suppkey")
    feed = F.when(n % 7 > 0, F.concat(F.lit("https://"), n.cast("string"), F.lit(".org/feed")))
    kind, custom = F.when(n % 3 == 0, "Website").otherwise("rss"), F.when(n % 4 == 0, n % 8 == 0)
    rows = binding.table(spark, sf_dir, "supplier").withColumn("feed_url", feed).where(~is_empty(F.col("feed_url")))
    return rows.select(n.alias("id"), F.col("s_name").alias("name"), "feed_url", F.coalesce(custom, F.lower(kind) == "website").alias("custom_eligible"))


@query(
    "record_errors",
    """
    WITH e AS (SELECT event_id, venue_id, CASE WHEN event_id % 11 = 0 THEN '1998-02-30' ELSE date::VARCHAR END AS d, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'T' END AS title, event_id % 5 = 0 AS no_role, CASE event_id % 6 WHEN 0 THEN '31:00' ELSE '19:30' END AS start_time FROM ev),
    x AS (SELECT venue_id, event_id, row_number() OVER (PARTITION BY venue_id ORDER BY event_id) AS n, list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN d = '1998-02-30' THEN 'bad_date' WHEN d NOT BETWEEN '1993-01-01' AND '1997-12-31' THEN 'out_of_season' END,
            CASE WHEN start_time = '31:00' THEN 'bad_time' END, CASE WHEN no_role THEN 'cast_without_role' END], lambda e: e IS NOT NULL) AS errors FROM e)
    SELECT venue_id, count(*) FILTER (WHERE len(errors) > 0) AS failed, string_agg(n || ':' || array_to_string(errors, '+'), '; ' ORDER BY n) FILTER (WHERE len(errors) > 0 AND k <= 10) AS first_ten
    FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, len(errors) > 0 ORDER BY n) AS k FROM x) GROUP BY venue_id""",
    "ev",
)
def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of event records by venue: how many fail, and the first ten with their place in the input."""
    n = F.col("event_id")
    text = F.when(n % 11 == 0, "1998-02-30").otherwise(F.col("date").cast("string"))
    day = F.try_to_date(text, "yyyy-MM-dd")
    cast = F.array(F.struct(F.when(n % 5 > 0, "Figaro").alias("character_role"), F.lit("A. Singer").alias("person")))
    start = F.when(n % 6 == 0, "31:00").otherwise("19:30")
    rules = (
        ("missing_title", F.when(n % 13 == 0, "").otherwise("T") == ""),
        ("bad_date", day.isNull()),
        ("out_of_season", day.isNotNull() & ~F.coalesce(day.between("1993-01-01", "1997-12-31"), F.lit(True))),
        ("bad_time", ~start.rlike(r"^[0-2]\d:[0-5]\d$")),
        ("cast_without_role", F.exists(cast, lambda c: is_empty(c["character_role"]) | is_empty(c["person"]))),
    )
    errors = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda e: e.isNotNull())
    rows = binding.occurrences(spark, sf_dir).select("venue_id", "event_id", errors.alias("errors"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("venue_id").orderBy("event_id"))).where(F.size("errors") > 0)
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("venue_id").orderBy("n")))
    line = F.concat_ws(":", F.col("n").cast("string"), F.array_join("errors", "+"))
    told = ranked.groupBy("venue_id").agg(F.count(F.lit(1)).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.struct("n", line.alias("t")))))["t"], "; ").alias("first_ten"))
    return rows.select("venue_id").distinct().join(told, "venue_id", "left").select("venue_id", F.coalesce("failed", F.lit(0)).alias("failed"), "first_ten")


@query(
    "cities_filled",
    """
    SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN 'City ' || event_id % 9 END, city) AS city FROM ev LEFT JOIN ve ON ve.venue_id = ev.venue_id AND ev.venue_id % 10 > 0""",
    "ev ve",
)
def cities_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities looked up in the venues' directory by name in any case, only where an event has none."""
    n = F.col("event_id")
    venues = binding.venues(spark, sf_dir).select("venue_id", "venue", F.col("city").alias("listed"))
    city = F.when(n % 3 > 0, F.concat(F.lit("City "), (n % 9).cast("string")))
    rows = binding.occurrences(spark, sf_dir).join(venues.select("venue_id", F.lower("venue").alias("venue")), "venue_id", "left").select("event_id", "venue", city.alias("city"))
    directory = venues.where("venue_id % 10 > 0").select(F.upper("venue").alias("venue"), F.col("listed").alias("city"))
    return city_filled(rows, directory, "venue", "city").select("event_id", "city")


@query(
    "pairs_unless_none",
    """
    SELECT 'some' AS side, c_custkey AS venue_id FROM customer WHERE (lower(c_mktsegment), c_nationkey) IN (SELECT lower(c_mktsegment), c_nationkey FROM customer WHERE c_acctbal > 9800)
    UNION ALL SELECT 'none', c_custkey FROM customer""",
)
def pairs_unless_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of active (organization, place) pairs in any case; without active pairs, all venues."""
    rows = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue_id"), F.col("c_mktsegment").alias("organization"), "c_nationkey", "c_acctbal")
    active = rows.where("c_acctbal > 9800").withColumn("organization", F.lower("organization"))
    sides = [(name, semi_unless_empty(rows, right, ["organization", "c_nationkey"])) for name, right in (("some", active), ("none", active.where("c_acctbal < 0")))]
    return sides[0][1].select(F.lit("some").alias("side"), "venue_id").unionByName(sides[1][1].select(F.lit("none").alias("side"), "venue_id"))


@query(
    "schedule_states",
    """
    WITH a AS (SELECT user_id AS schedule_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'planned' WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'edit' WHEN 'error' THEN 'completed' END AS action FROM events),
    s AS (SELECT *, max(CASE WHEN action <> 'edit' THEN strftime(ts, '%Y%m%d%H%M%S%f') || lpad(event_id::VARCHAR, 12, '0') || action END) OVER (PARTITION BY schedule_id ORDER BY ts, event_id) AS st FROM a WHERE action IS NOT NULL),
    l AS (SELECT *, coalesce(substr(st, 33), 'draft') AS status, max(CASE WHEN action = 'planned' THEN event_id END) OVER (PARTITION BY schedule_id ORDER BY ts, event_id) AS p FROM s)
    SELECT schedule_id, arg_max(status, (ts, event_id)) AS status, coalesce(max(CASE WHEN action = 'edit' AND status = 'planned' THEN (ts, event_id) END) > max(CASE WHEN action = 'planned' THEN (ts, event_id) END), false) AS needs_reconfirmation, count(*) AS actions
    FROM l GROUP BY schedule_id""",
)
def schedule_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every schedule after its actions; a planned one that was edited since needs confirming."""
    action = F.create_map(*[F.lit(x) for kv in (("purchase", "planned"), ("signup", "draft"), ("view", "edit"), ("error", "completed")) for x in kv])[F.col("event_type")]
    rows = binding.usage(spark, sf_dir).select(F.col("user_id").alias("schedule_id"), "ts", "event_id", action.alias("action")).where("action is not null")
    return transitions(rows, "schedule_id", ["ts", "event_id"], "action", touch="edit", guarded="planned", start="draft")


@query(
    "status_sets",
    """
    WITH a AS (SELECT DISTINCT l_orderkey AS event_id FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000),
    c AS (SELECT l_orderkey AS event_id FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag IN ('A', 'N')))
    SELECT event_id, event_id IN (SELECT event_id FROM c) AS closed, event_id NOT IN (SELECT event_id FROM c) AS deferred FROM a""",
)
def status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected events (the union of two sets), those whose statuses all lie in a set, and the others."""
    lineitem, orders = binding.table(spark, sf_dir, "lineitem"), binding.table(spark, sf_dir, "orders")
    affected = lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("event_id")).union(orders.where("o_totalprice > 300000").select("o_orderkey")).distinct()
    statuses = lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.collect_set("l_returnflag").alias("s"))
    closed = statuses.where(F.size(F.array_except("s", F.array(F.lit("A"), F.lit("N")))) == 0).select("event_id", F.lit(True).alias("closed"))
    out = affected.join(closed, "event_id", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    return out.select("event_id", "closed", (~F.col("closed")).alias("deferred"))


@query(
    "renumbered_programme",
    """
    WITH k AS (SELECT l_orderkey AS event_id, l_linenumber AS position, l_partkey AS work_id FROM lineitem WHERE l_returnflag <> 'R'),
    f AS (SELECT l_orderkey AS event_id, l_linenumber AS seq, l_partkey AS work_id FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey, l_partkey) NOT IN (SELECT event_id, work_id FROM k)),
    m AS (SELECT event_id, max(position) AS m FROM k GROUP BY 1)
    SELECT event_id, position, work_id, 'stored' AS origin FROM k
    UNION ALL SELECT f.event_id, (coalesce(m, 0) + row_number() OVER (PARTITION BY f.event_id ORDER BY seq, work_id))::INTEGER, work_id, 'added' FROM f LEFT JOIN m ON m.event_id = f.event_id""",
)
def renumbered_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of programmes numbered on from the last stored position, without gaps."""
    rows = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("work_id"), "l_returnflag")
    stored = rows.where("l_returnflag != 'R'").drop("l_returnflag")
    fresh = rows.where("l_returnflag = 'R'").drop("l_returnflag").join(stored.select("event_id", "work_id").distinct(), ["event_id", "work_id"], "left_anti")
    last = stored.groupBy("event_id").agg(F.max("position").alias("_last"))
    number = F.row_number().over(Window.partitionBy("event_id").orderBy("position", "work_id"))
    added = fresh.join(last, "event_id", "left").withColumn("position", (F.coalesce("_last", F.lit(0)) + number).cast("int"))
    return stored.withColumn("origin", F.lit("stored")).unionByName(added.drop("_last").withColumn("origin", F.lit("added")))


@query(
    "reordered_programme",
    "SELECT l_orderkey AS event_id, l_partkey AS work_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey DESC) - 1 AS position FROM lineitem",
)
def reordered_programme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions taken from the order in which a programme's ids were sent."""
    sent = F.sort_array(F.collect_list(F.struct("l_quantity", "l_linenumber", "l_partkey")), asc=False)["l_partkey"]
    lists = binding.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(sent.alias("ids"))
    return lists.select("event_id", F.posexplode("ids").alias("position", "work_id")).select("event_id", "work_id", F.col("position").cast("long").alias("position"))


@query(
    "ranked_context",
    """
    SELECT source, doc_id, rank, row_number() OVER (PARTITION BY source ORDER BY coalesce(rank, 999999), doc_id) AS place FROM (
      SELECT *, CASE WHEN doc_id % 4 > 0 THEN n_chars % 7 END AS rank, row_number() OVER (PARTITION BY source ORDER BY n_chars % 5 DESC, n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10""",
)
def ranked_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the ten documents of the best score, then of the newest mark (a top-k report), numbered
    by position with those that have none at the end."""
    best = Window.partitionBy("source").orderBy(F.desc(F.col("n_chars") % 5), F.desc("n_chars"), "doc_id")
    top = binding.articles(spark, sf_dir).select("source", "doc_id", "n_chars").withColumn("_r", F.row_number().over(best)).where("_r <= 10")
    ranked = top.withColumn("rank", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars") % 7))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("rank"), "doc_id"))
    return ranked.select("source", "doc_id", "rank", place.cast("long").alias("place"))


@query(
    "quota_counters",
    """
    SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AND count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 40 AS within FROM events""",
)
def quota_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record is within the day's quota of three and the month's of forty."""
    rows = binding.usage(spark, sf_dir).select("user_id", "event_id", "ts")
    daily = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    monthly = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts", "event_id"))
    return rows.select("user_id", "event_id", ((daily <= 3) & (monthly <= 40)).alias("within"))


@query(
    "schedule_date_ranges",
    "SELECT c_custkey AS schedule_id, min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS end_date FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def schedule_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date of a schedule's events, written back to it; null for an empty one."""
    bounds = binding.occurrences(spark, sf_dir).groupBy(F.col("venue_id").alias("schedule_id")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("schedule_id")).join(bounds, "schedule_id", "left")


@query(
    "source_records",
    """
    SELECT s_suppkey AS source_id, substr(sha256('https://h' || s_suppkey || '.org/feed'), 1, 16) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'h' || s_suppkey || '.org' ELSE s_name END AS name,
           substr('redacted [key] for ' || s_name, 1, 30) AS error, s_suppkey % 2 = 0 OR s_suppkey % 9 = 0 AS special FROM supplier""",
)
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions as stored: derived id, the host for a name, redacted and capped errors, a kind flag."""
    n = F.col("s_suppkey")
    feed = F.concat(F.lit("https://h"), n.cast("string"), F.lit(".org/feed"))
    host = F.regexp_extract(feed, "//([^/]*)", 1)
    error = F.substring(F.replace(F.concat(F.lit("redacted SECRET for "), "s_name"), F.lit("SECRET"), F.lit("[key]")), 1, 30)
    kind, country = F.when(n % 2 == 0, "letters"), F.when(n % 9 == 0, "cn").otherwise("de")
    special = F.coalesce(kind == "letters", F.lit(False)) | (country == "cn")
    return binding.table(spark, sf_dir, "supplier").select(n.alias("source_id"), short_digest(feed).alias("id"), first_non_empty(F.when(n % 3 > 0, F.col("s_name")), host).alias("name"), error.alias("error"), special.alias("special"))
