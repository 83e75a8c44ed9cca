"""State machines run as streams over the usage events, and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.plans import feeds, records  # noqa: F401 - their SQL is that of the same questions in batch
from veduta.plans.registry import SQL, query
from veduta.session import new_folder
from veduta.streaming.stateful import Invites, Jobs, Machine, RateLimit, Schedules, machine_steps, run_to_end, with_end


def _action(**names: str) -> Column:
    return F.create_map(*[F.lit(x) for event, action in names.items() for x in (event, action)])[F.col("event_type")]


def _streamed(spark: SparkSession, sf_dir: str, key: Column, name: str, action: Column, machine: Machine, last: bool = True) -> DataFrame:
    """Steps of a machine over the stream of events, from the first to the end: the last made at once, or all."""
    path = new_folder(spark, "stream")
    stream = spark.readStream.schema(binding.usage(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(key.alias(name), "ts", "event_id", action.alias("action")).where("action is not null")
    return run_to_end(machine_steps(with_end(rows, path, name, "ts", "event_id", "action"), name, "ts", "event_id", "action", machine, last=last), path)


def _latest(steps: DataFrame, key: str, *columns: str) -> DataFrame:
    return steps.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), "serial").alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


@query("schedule_states_streamed", SQL["schedule_states"])
def schedule_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every schedule after all its actions, from value state and timers."""
    action = _action(purchase="planned", signup="draft", view="edit", error="completed")
    steps = _streamed(spark, sf_dir, F.col("user_id"), "schedule_id", action, Schedules())
    return _latest(steps, "schedule_id", "status", "needs_reconfirmation", "actions")


@query("invite_claims_streamed", SQL["invite_claims"])
def invite_claims_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of invite codes in order of time, each emitted once; a code is exhausted after ten."""
    steps = _streamed(spark, sf_dir, F.col("user_id") % 40, "code", _action(signup="claim"), Invites(10), last=False)
    return steps.where("code is not null").select(F.col("id").alias("event_id"), "code", "claim", "accepted")


@query(
    "job_states_streamed",
    """
    WITH a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS action FROM events),
    b AS (SELECT *, lag(action) OVER w AS before, lag(ts) OVER w AS since, lead(ts) OVER w AS after FROM a WHERE action IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, action IN ('completed', 'failed') AS final, coalesce(before = 'in_progress' AND ts <= since + INTERVAL 12 HOUR, false) AS open FROM b)
    SELECT user_id,
           coalesce(arg_max(CASE action WHEN 'in_progress' THEN 'failed' ELSE action END, (ts, event_id)) FILTER (WHERE NOT final OR open), 'none') AS status,
           count(*) FILTER (WHERE final AND open) AS ended,
           count(*) FILTER (WHERE action = 'in_progress' AND (after IS NULL OR after > ts + INTERVAL 12 HOUR)) AS timeouts,
           count(*) FILTER (WHERE final AND NOT open) AS ignored
    FROM c GROUP BY user_id""",
)
def job_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are queued, in progress and ended; one in progress that hears nothing for twelve hours fails by timer."""
    action = _action(signup="queued", click="in_progress", purchase="completed", error="failed")
    return _latest(_streamed(spark, sf_dir, F.col("user_id"), "user_id", action, Jobs(12)), "user_id", "status", "ended", "timeouts", "ignored")


@query(
    "rate_limits_streamed",
    """
    WITH RECURSIVE p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
    r AS (SELECT user_id, min(ts) AS ts FROM p GROUP BY user_id UNION ALL SELECT r.user_id, min(p.ts) FROM r JOIN p ON p.user_id = r.user_id AND p.ts >= r.ts + INTERVAL 24 HOUR GROUP BY r.user_id, r.ts),
    k AS (SELECT user_id, max(ts) AS last, count(*) AS allowed FROM r GROUP BY user_id)
    SELECT user_id, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, allowed, (SELECT count(*) FROM p WHERE p.user_id = k.user_id) - allowed AS refused FROM k""",
)
def rate_limits_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user allowed once in 24 hours, counted from the last that was allowed."""
    steps = _latest(_streamed(spark, sf_dir, F.col("user_id"), "user_id", _action(purchase="buy"), RateLimit(24)), "user_id", "last", "allowed", "refused")
    return steps.withColumn("last", F.date_format(F.timestamp_micros("last"), "yyyy-MM-dd HH:mm:ss"))
