"""Runs, invites and word tables: what an operator of the service does with a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.operators import scripts
from veduta.operators.invites import register_invites
from veduta.operators.word_tables import carried_labels, in_columns, line_texts, words_to_lines
from veduta.plans.registry import query
from veduta.session import new_folder
from veduta.sources.paged import register_paged
from veduta.sources.runs import run_ingestion, source_verdicts


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Articles ingested: those without or with a short text, of a wrong length or with a mail address are quarantined."""
    text = F.coalesce("text", F.lit(""))
    rules = {
        "missing_text": F.col("text").isNull(),
        "short_text": F.length(text) < 80,
        "wrong_length": F.col("n_chars") != F.length(text),
        "mail_address": text.rlike(r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[A-Za-z]"),
    }
    rows = binding.articles(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars")
    return run_ingestion(rows, "source", rules, new_folder(spark, "run"), {"with_title": text.rlike(r"^[^.\n]{1,60}\."), "with_language": F.col("lang").isNotNull()})


_JUDGED = r"""
    j AS (SELECT *, text IS NULL AS missing_text, length(coalesce(text, '')) < 80 AS short_text, n_chars <> length(coalesce(text, '')) AS wrong_length, regexp_matches(coalesce(text, ''), '[A-Za-z0-9.]+@[A-Za-z0-9]+\.[A-Za-z]') AS mail_address FROM documents),
    q AS (SELECT *, missing_text OR short_text OR wrong_length OR mail_address AS lost FROM j)"""


@query("run_verdicts", f"WITH {_JUDGED.strip()} SELECT source, count(*) FILTER (WHERE NOT lost) AS sound, count(*) FILTER (WHERE lost) AS quarantined, CASE WHEN bool_and(lost) THEN 'FAILED' WHEN bool_or(lost) THEN 'PARTIAL' ELSE 'READY' END AS verdict FROM q GROUP BY source")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source of a run is ready, partial or failed, from what the run has written."""
    sound, lost, _ = _run(spark, sf_dir)
    return source_verdicts(sound, lost, "source")


@query(
    "run_counters",
    rf"""
    WITH {_JUDGED.strip()},
    c AS (SELECT count(*) AS records, count(*) FILTER (WHERE NOT lost) AS sound, count(*) FILTER (WHERE lost) AS quarantined, count(*) FILTER (WHERE missing_text) AS bad_missing_text, count(*) FILTER (WHERE short_text) AS bad_short_text,
                 count(*) FILTER (WHERE wrong_length) AS bad_wrong_length, count(*) FILTER (WHERE mail_address) AS bad_mail_address, count(*) FILTER (WHERE NOT lost AND regexp_matches(text, '^[^.\n]{{1,60}}\.')) AS with_title, count(*) FILTER (WHERE NOT lost AND lang IS NOT NULL) AS with_language FROM q)
    SELECT counter, n FROM (UNPIVOT c ON records, sound, quarantined, bad_missing_text, bad_short_text, bad_wrong_length, bad_mail_address, with_title, with_language INTO NAME counter VALUE n)""",
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counters, observed while its rows were written."""
    *_, counters = _run(spark, sf_dir)
    return spark.createDataFrame(list(counters.items()), "counter string, n long")


@query(
    "generated_invites",
    """
    WITH r AS (SELECT user_id, event_id AS request_id, (user_id % 4)::INTEGER AS credits, CASE WHEN event_type <> 'error' THEN ' ' || substr(md5(event_id::VARCHAR), 1, 8) || ' ' END AS code, ts FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    n AS (SELECT *, count(code) OVER (PARTITION BY user_id ORDER BY ts, request_id) AS asked FROM r)
    SELECT user_id, request_id, CASE WHEN code IS NOT NULL AND asked <= credits THEN upper(trim(code)) END AS code, greatest(credits - asked, 0)::INTEGER AS remaining, code IS NOT NULL AND asked <= credits AS granted FROM n""",
)
def generated_invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invite codes for users' requests as long as their credits last: one call of a table function from SQL."""
    register_invites(spark)
    code = F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), F.lit(" ")))
    requests = binding.usage(spark, sf_dir).where("event_type in ('signup', 'purchase', 'error')")
    requests = requests.select("user_id", F.col("event_id").alias("request_id"), (F.col("user_id") % 4).cast("int").alias("credits"), code.alias("code"), "ts")
    return spark.sql("SELECT * FROM generated_invites(TABLE(SELECT * FROM {r}) PARTITION BY user_id ORDER BY (ts, request_id))", r=requests)


def _placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, x, y, size, text: words of conversations; a turn's lines lie 10 apart, words sway by a unit and
    begin at their offset in the line; what users say is printed larger."""
    lines = binding.lines(spark, sf_dir).select("page", "line_no", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("_l", "_line"))
    words = lines.select("page", "line_no", "role", "_l", "_line", F.posexplode(F.split("_line", " ")).alias("_n", "text")).where("text != ''")
    x = F.length(F.array_join(F.slice(F.split("_line", " "), F.lit(1), F.col("_n")), " ")) + F.when(F.col("_n") > 0, 1).otherwise(0)
    y = F.col("line_no") * 1000.0 + F.col("_l") * 10.0 + F.col("_n") % 2
    return words.select("page", x.alias("x"), y.alias("y"), F.when(F.col("role") == "user", 14).otherwise(9).alias("size"), "text")


@query(
    "word_table_labels",
    """
    WITH l AS (SELECT page, line_no, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS l FROM li),
    w AS (SELECT page, line_no, role, l, line, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS n FROM l),
    x AS (SELECT *, length(array_to_string(string_split(line, ' ')[1:n], ' ')) + CASE WHEN n > 0 THEN 1 ELSE 0 END AS x FROM w WHERE text <> ''),
    g AS (SELECT page, line_no, l, CASE WHEN x >= 90 THEN 2 WHEN x >= 40 THEN 1 ELSE 0 END AS col, bool_or(role = 'user') AS label, string_agg(text, ' ' ORDER BY x, text) AS text FROM x GROUP BY ALL),
    d AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY line_no, l) - 1 AS line FROM g),
    c AS (SELECT *, last_value(CASE WHEN label THEN text END IGNORE NULLS) OVER (PARTITION BY page, col ORDER BY line) AS carried FROM d)
    SELECT page, col::INTEGER AS "column", line::INTEGER AS line, text, carried AS label FROM c WHERE NOT label""",
    "li",
)
def word_table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three columns with the label last seen above them, read from placed words."""
    words = in_columns(words_to_lines(_placed_words(spark, sf_dir), "page", "x", "y"), "x", [40.0, 90.0])
    lines = line_texts(words, "page", "x", "text", "size")
    return carried_labels(lines, "page", F.col("size") > 12).select("page", "column", "line", "text", "label")


@query(
    "paged_orders",
    "SELECT o_custkey AS venue_id, count(*) AS events, min(o_orderkey) AS first_event, max(o_orderkey) AS last_event FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 9000 AND o_orderpriority <> '5-LOW' GROUP BY o_custkey",
)
def paged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range of keys by venue, from the pages of the table that can hold them."""
    register_paged(spark)
    rows = spark.read.format("paged").option("columns", "o_orderkey,o_custkey,o_orderpriority").load(f"{sf_dir}/orders.parquet")
    kept = rows.where((F.col("o_orderkey") >= 2000) & (F.col("o_orderkey") < 9000) & (F.col("o_orderpriority") != "5-LOW"))
    return kept.groupBy(F.col("o_custkey").alias("venue_id")).agg(F.count(F.lit(1)).alias("events"), F.min("o_orderkey").alias("first_event"), F.max("o_orderkey").alias("last_event"))


@query(
    "apply_scripts",
    r"""
    WITH p AS (SELECT l_orderkey AS event_id, l_linenumber AS position, l_partkey AS work_id, l_returnflag AS flag FROM lineitem),
    k AS (SELECT event_id, count(*) FILTER (WHERE flag <> 'R') AS kept FROM p GROUP BY event_id),
    t AS (SELECT event_id, position, '(' || event_id || ', ' || position || ', ' || work_id || ', ''' || replace(coalesce(p_name, ''), '''', '\''') || ''')' AS v FROM p LEFT JOIN part ON p_partkey = work_id WHERE flag = 'R'),
    g AS (SELECT event_id, string_agg(v, ', ' ORDER BY position, v) AS vs, count(*) AS rows FROM t GROUP BY event_id)
    SELECT g.event_id, rows, 'BEGIN IF (SELECT count(*) FROM programme WHERE event_id = ' || g.event_id || ') <> ' || kept || ' THEN SELECT raise_error(''before ' || g.event_id || '''); END IF; INSERT INTO programme (event_id, position, work_id, title) VALUES ' || vs
           || '; IF (SELECT count(*) FROM programme WHERE event_id = ' || g.event_id || ') <> ' || (kept + rows) || ' THEN SELECT raise_error(''after ' || g.event_id || '''); END IF; END' AS script
    FROM g JOIN k ON k.event_id = g.event_id""",
)
def apply_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event the script that adds its found works to a stored programme, with a check before and after."""
    rows = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("work_id"), F.col("l_returnflag").alias("flag"))
    kept = rows.groupBy("event_id").agg(F.count_if(F.col("flag") != "R").alias("kept"))
    titles = binding.works(spark, sf_dir).select("work_id", "title")
    found = rows.where("flag = 'R'").join(titles, "work_id", "left").join(kept, "event_id")
    columns = {"event_id": scripts.number(F.col("event_id")), "position": scripts.number(F.col("position")), "work_id": scripts.number(F.col("work_id")), "title": scripts.literal(F.coalesce("title", F.lit("")))}
    return scripts.row_scripts(found, "event_id", "programme", columns, ["position"], "kept")
