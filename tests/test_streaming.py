from __future__ import annotations

from pyspark.sql import functions as F

from veduta.operators.merge import insert_ignore, swap_table
from veduta.streaming import incremental, stateful


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def events(spark):
    rows = [(i, f"2024-01-01 0{i // 10}:{(i * 3) % 60:02d}:00", i % 3, f"http://X.org/{i % 4}/?i={i}") for i in range(40)]
    return spark.createDataFrame(rows, "id int, t string, user int, url string").select("id", F.to_timestamp("t").alias("ts"), "user", "url")


def test_new_urls(spark, tmp_path):
    out = run(incremental.new_urls(stream(spark, tmp_path, events(spark)), "url", "ts"), "fresh")
    assert sorted(r["canonical"] for r in out.collect()) == [f"http://x.org/{i}" for i in range(4)]


def test_windows(spark, tmp_path):
    df = events(spark)
    out = run(incremental.tumbling(stream(spark, tmp_path, df), "ts", "1 hour", "0 seconds", "user"), "hours", "complete")
    want = {(r["start"], r["user"]): r["n"] for r in incremental.tumbling(df, "ts", "1 hour", "0 seconds", "user").collect()}
    assert {(r["start"], r["user"]): r["n"] for r in out.collect()} == want and sum(want.values()) == 40
    assert sum(r["n"] for r in incremental.sliding(df, "ts", "1 hour", "30 minutes", "0 seconds").collect()) == 80
    assert sum(r["n"] for r in incremental.user_sessions(df, "ts", "user", "20 minutes", "0 seconds").collect()) == 40


def test_quota_counts_across_batches(spark, tmp_path):
    out = run(incremental.daily_quota(stream(spark, tmp_path, events(spark).repartition(3)), "user", "ts", 5), "quota")
    counts = {r["user"]: (r["n"], r["ok"]) for r in out.groupBy("user").agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok")).collect()}
    assert counts == {0: (14, 5), 1: (13, 5), 2: (13, 5)}


def test_merge_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "table")
    events(spark).where("id < 10").write.parquet(path)
    sink = incremental.merge_sink(path, lambda old, new: insert_ignore(old, new, ["id"]), swap_table)
    batch = events(spark).where("id >= 5")
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(path).count() == 40


def machine_input(spark):
    rows = [(i % 7, i, f"2024-01-0{1 + i * 37 % 9} {i * 5 % 24:02d}:{i * 11 % 60:02d}:00", ("queued", "in_progress", "completed", "failed", "in_progress")[i * 3 % 5]) for i in range(120)]
    return spark.createDataFrame(rows, "user long, id long, t string, action string").select("user", "id", F.to_timestamp("t").alias("ts"), "action")


def walked(rows, machine):
    """The machine stepped through all rows in order, in plain Python: last state by user."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        micros, state = int(r["ts"].timestamp()) * 1_000_000, out.get(r["user"], machine.start)
        limit = machine.deadline(state)
        if limit is not None and limit < micros:
            state = machine.expire(state)
        out[r["user"]] = machine.step(state, micros, r["id"], r["action"])
    return {u: machine.expire(s) if machine.deadline(s) is not None else s for u, s in out.items()}


def test_machines_do_not_depend_on_batches_or_restarts(spark, tmp_path):
    """Rows arrive out of order in several files and runs; the second run goes on from the first one's checkpoint."""
    rows = machine_input(spark)
    want = walked(rows.collect(), stateful.Jobs(12))
    assert any(s[3] for s in want.values()) and any(s[4] for s in want.values())
    for cut in (1, 3):
        source, path = str(tmp_path / f"in{cut}"), str(tmp_path / f"run{cut}")
        rows.where(F.col("id") % cut == 0).repartition(2).write.parquet(source)
        stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)  # noqa: B023, E731
        steps = lambda s: stateful.machine_steps(s, "user", "ts", "id", "action", stateful.Jobs(12), "30 days")
        stateful.run_to_end(stream(), path, steps)
        for part in range(1, cut):
            rows.where(F.col("id") % cut == part).write.mode("append").parquet(source)
            stateful.run_to_end(stream(), path, steps)
        end = rows.limit(1).select(F.lit(None).cast("long").alias("user"), F.lit(0).cast("long").alias("id"), F.timestamp_micros(F.lit(stateful.END_MICROS)).alias("ts"), F.lit("queued").alias("action"))
        end.write.mode("append").parquet(source)
        out = stateful.run_to_end(stream(), path, steps)
        last = out.where("user is not null").groupBy("user").agg(F.max_by(F.struct("status", "since", "ended", "timeouts", "ignored"), "serial").alias("s"))
        assert {r["user"]: tuple(r["s"]) for r in last.collect()} == want
        assert out.groupBy("user", "serial").count().where("count > 1").isEmpty()


class Handle:
    """State of one key, with a count of the values that go to the state server."""

    def __init__(self):
        self.values, self.sent, self.timers = [], 0, []

    def getValueState(self, *_):  # noqa: N802
        return Handle()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    def exists(self):
        return bool(self.values)

    def get(self):
        return self.values

    def update(self, value):
        self.values = value

    def put(self, values):
        self.values, self.sent = list(values), self.sent + len(values)

    def appendList(self, values):  # noqa: N802
        self.put([*self.values, *values])

    def clear(self):
        self.values = []


def test_waiting_rows_are_state_in_blocks(monkeypatch):
    row = stateful.Row("user", "at", "micros", "id", "action")
    rows = [row(5, None, i * 37 % 1000 * 1000, i, ("planned", "edit", "draft")[i % 3]) for i in range(1000)]
    want = stateful.Schedules.start
    for r in sorted(rows, key=lambda r: (r["micros"], r["id"])):
        want = stateful.Schedules().step(want, r["micros"], r["id"], r["action"])
    for size, last in ((10_000, True), (300, True), (300, False)):
        monkeypatch.setattr(stateful, "BLOCK_ROWS", size)
        machine = stateful.InOrder(stateful.Schedules(), "user", last)
        machine.init(handle := Handle())
        list(machine.handleInputRows((5,), iter(rows), handle))
        assert machine.waiting.sent == -(-1000 // size) and handle.timers == [1]
        handle.watermark = 400
        first = list(machine.handleExpiredTimer((5,), handle, None))
        handle.watermark = 2000
        second = list(machine.handleExpiredTimer((5,), handle, None))
        assert (len(first), len(second)) == ((1, 1) if last else (400, 600)) and not machine.waiting.exists()
        assert second[-1] == stateful.Row(user=5, serial=1000, status=want[0], needs_reconfirmation=want[1], actions=want[2])


def test_last_steps_give_the_same_end(spark, tmp_path):
    rows, source = machine_input(spark), str(tmp_path / "in")
    end = rows.limit(1).select(F.lit(None).cast("long").alias("user"), F.lit(0).cast("long").alias("id"), F.timestamp_micros(F.lit(stateful.END_MICROS)).alias("ts"), F.lit("queued").alias("action"))
    rows.unionByName(end).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = stateful.run_to_end(stateful.machine_steps(stream, "user", "ts", "id", "action", stateful.Jobs(12), last=True), str(tmp_path / "run"))
    last = {r["user"]: (r["status"], r["since"], r["ended"], r["timeouts"], r["ignored"]) for r in out.where("user is not null").collect()}
    assert last == walked(rows.collect(), stateful.Jobs(12)) and out.where("user is not null").count() == len(last)
