"""Order-dependent queries: positions, carries, runs, sessions, budgets and rotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.operators.dedup import pick_best
from veduta.operators.sequences import anchored_sizes, carry_forward, round_robin, running_budget, runs, sessions, stable_positions
from veduta.plans.registry import query


@query(
    "stable_programme_order",
    """
    WITH k AS (SELECT l_orderkey AS event_id, l_linenumber AS position, l_partkey AS work_id, l_suppkey AS artist_id, l_quantity AS quantity, l_extendedprice AS price, l_linestatus <> 'O' AS counts FROM lineitem)
    SELECT event_id, position, work_id, artist_id,
           CASE WHEN counts THEN dense_rank() OVER (PARTITION BY event_id, counts ORDER BY position) END AS stable_order,
           counts AND row_number() OVER (PARTITION BY event_id, counts, position ORDER BY work_id, artist_id, quantity, price) = 1 AS primary
    FROM k""",
)
def stable_programme_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense order of a programme over the positions that count; the first row at each is primary."""
    line = binding.table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("artist_id"), "l_quantity", "l_extendedprice", "l_linestatus")
    tie = [F.col(c) for c in ("work_id", "artist_id", "l_quantity", "l_extendedprice")]
    out = stable_positions(rows, ["event_id"], ["position"], tie, F.col("l_linestatus") != "O")
    return out.select("event_id", "position", "work_id", "artist_id", F.col("stable_order").cast("long").alias("stable_order"), "primary")


@query(
    "carry_forward_question",
    """
    SELECT page, line_no, role, max(CASE WHEN role = 'user' THEN line_no END) OVER w AS asked_at, count(CASE WHEN role = 'user' THEN 1 END) OVER w AS run
    FROM li WINDOW w AS (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "li",
)
def carry_forward_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the last question before it, and the number of its run."""
    lines = binding.lines(spark, sf_dir).select("page", "line_no", "role")
    asks = F.col("role") == "user"
    carried = carry_forward(lines, ["page"], [F.col("line_no")], asks, F.col("line_no"), "asked_at")
    return runs(carried, ["page"], [F.col("line_no")], asks, "run").withColumn("run", F.col("run").cast("long"))


@query(
    "lookahead_lines",
    "SELECT page, line_no, role, lead(role, 1) OVER w AS next_role, lead(role, 2) OVER w AS second_role FROM li WINDOW w AS (PARTITION BY page ORDER BY line_no)",
    "li",
)
def lookahead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the roles of the next two."""
    w = Window.partitionBy("page").orderBy("line_no")
    return binding.lines(spark, sf_dir).select("page", "line_no", "role", F.lead("role", 1).over(w).alias("next_role"), F.lead("role", 2).over(w).alias("second_role"))


@query(
    "continuation_merge",
    """
    WITH r AS (SELECT page, line_no, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM li)
    SELECT page, item::BIGINT AS item, string_agg(role || ':' || n, ' ' ORDER BY line_no) AS merged, sum(n)::BIGINT AS chars FROM r GROUP BY page, item""",
    "li",
)
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuation lines joined to the item they follow."""
    lines = binding.lines(spark, sf_dir).withColumn("n", F.length("text"))
    numbered = runs(lines, ["page"], [F.col("line_no")], F.col("role") == "user", "item")
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(":", "role", "n").alias("part"))))
    return numbered.groupBy("page", F.col("item").cast("long").alias("item")).agg(F.array_join(parts["part"], " ").alias("merged"), F.sum("n").cast("long").alias("chars"))


@query(
    "pending_backfill",
    """
    SELECT page, line_no, first_value(CASE WHEN role = 'assistant' THEN line_no END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS answered_at FROM li WHERE role <> 'system'""",
    "li",
)
def pending_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the next answer at or after it (back-fill)."""
    w = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lines = binding.lines(spark, sf_dir).where("role != 'system'")
    return lines.select("page", "line_no", F.first(F.when(F.col("role") == "assistant", F.col("line_no")), ignorenulls=True).over(w).alias("answered_at"))


@query(
    "running_budget_cutoff",
    """
    SELECT event_id, user_id, cents, coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before,
           coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000 AS accepted
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
)
def running_budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records accepted until a user's budget is spent."""
    rows = binding.usage(spark, sf_dir).select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return running_budget(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "cents", 50_000).drop("ts")


@query(
    "next_sort_order",
    "SELECT o_orderkey AS event_id, coalesce(max(l_linenumber) + 1, 0)::INTEGER AS next_position FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
def next_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position for the next entry of every programme: last plus one, 0 if empty."""
    last = binding.programme(spark, sf_dir).groupBy("event_id").agg(F.max("position").alias("_last"))
    events = binding.occurrences(spark, sf_dir).select("event_id")
    return events.join(last, "event_id", "left").select("event_id", F.coalesce(F.col("_last") + 1, F.lit(0)).cast("int").alias("next_position"))


@query(
    "round_robin_sources",
    "WITH s AS (SELECT source, count(*) AS records FROM documents GROUP BY source) SELECT source, records, (((row_number() OVER (ORDER BY source) - 1 - 7) % count(*) OVER () + count(*) OVER ()) % count(*) OVER ())::INTEGER AS turn FROM s",
)
def round_robin_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in the order a persisted pointer (7) visits them."""
    return round_robin(binding.articles(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("records")), "source", F.col("source"), 7)


@query(
    "last_action_wins",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def last_action_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of every user and type."""
    rows = binding.usage(spark, sf_dir)
    late = -F.unix_micros(F.col("ts").cast("timestamp"))
    return pick_best(rows.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [late, -F.col("event_id")]).drop("ts")


@query(
    "most_common_type",
    "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1",
)
def most_common_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's most common type; ties go to the one seen first."""
    counts = binding.usage(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("_seen"))
    return pick_best(counts, ["user_id"], [-F.col("n"), F.col("_seen"), F.col("event_type")]).select("user_id", "event_type", "n")


@query(
    "sessionize_30m",
    """
    WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session_no FROM g)
    SELECT user_id, session_no::BIGINT AS session_no, count(*) AS records, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, session_no""",
)
def sessionize_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that end after 30 quiet minutes."""
    rows = sessions(binding.usage(spark, sf_dir), "user_id", "ts", 1800)
    return rows.groupBy("user_id", F.col("session_no").cast("long").alias("session_no")).agg(F.count(F.lit(1)).alias("records"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(
    "tumbling_1h",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL",
)
def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and cents by hour and type."""
    by = binding.usage(spark, sf_dir).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
    out = by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "cents")


@query(
    "anchored_bursts",
    """
    WITH RECURSIVE v AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_ms(ts) // 1000 AS s, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS n FROM events),
    r AS (SELECT user_id, day, n, s AS anchor, 0 AS burst FROM v WHERE n = 1
          UNION ALL SELECT v.user_id, v.day, v.n, CASE WHEN v.s - r.anchor > 3600 THEN v.s ELSE r.anchor END, r.burst + CASE WHEN v.s - r.anchor > 3600 THEN 1 ELSE 0 END FROM r JOIN v ON v.user_id = r.user_id AND v.day = r.day AND v.n = r.n + 1)
    SELECT user_id, day, burst, count(*) AS records FROM r GROUP BY user_id, day, burst""",
)
def anchored_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the bursts of records, each within an hour of its first, and their sizes.

    The array holds one user's day."""
    seconds = F.array_sort(F.collect_list(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")))
    days = binding.usage(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(seconds.alias("s"))
    return days.select("user_id", "day", F.posexplode(anchored_sizes(F.col("s"), 3600.0)).alias("burst", "records")).withColumn("records", F.col("records").cast("long"))
