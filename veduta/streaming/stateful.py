"""State machines on streams, in the order of event time whatever the order of arrival.

Rows wait in list state, in blocks, until the watermark passes them; a timer then steps the machine of their key
through them in order. What a query has emitted therefore does not depend on how its input was cut into micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that wait are state in blocks: a value of its own for each would go to the state server by itself.
_WAITING = "block binary"
BLOCK_ROWS = 10_000
#: A row of no key, so late that the watermark passes everything before it.
END_MICROS = 4_000_000_000_000_000


class Machine:
    """A state machine: its state as a schema, a tuple to begin with, and a step.

    ``step(state, micros, id, action)`` gives the next state; ``deadline(state)`` the microsecond at which
    ``expire(state)`` is due if no row comes before (None: never)."""

    schema = ""
    start: tuple = ()

    def step(self, state: tuple, micros: int, id_: int, action: str) -> tuple:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple) -> tuple:
        return state


class InOrder(StatefulProcessor):
    """Steps a ``Machine`` per key through its rows in order of (micros, id), once the watermark has passed them.

    Every step emits the key, a serial number and the state after it; with ``last`` only the last step of
    those that a timer makes does."""

    def __init__(self, machine: Machine, key: str, last: bool = False) -> None:
        self.machine, self.last = machine, last
        self.names = [key, "serial", *[field.split()[0] for field in machine.schema.split(",")]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"serial long, {self.machine.schema}")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(micros, id_, action) for *_, micros, id_, action in rows]
        self.waiting.appendList(self._blocks(new))
        self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter(())

    def _blocks(self, rows: list[tuple]) -> list[tuple[bytes]]:
        return [(pickle.dumps(part, 5),) for part in batched(rows, BLOCK_ROWS)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(row for (block,) in self.waiting.get() for row in pickle.loads(block)) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        serial, *state = self.state.get() if self.state.exists() else (0, *self.machine.start)
        state, out, before = tuple(state), [], serial

        def emit(new: tuple) -> tuple:
            nonlocal serial
            serial += 1
            if self.last:
                out.clear()
            out.append((*key, serial, *new))
            return new

        for micros, id_, action in due:
            limit = self.machine.deadline(state)
            if limit is not None and limit < micros:
                state = emit(self.machine.expire(state))
            state = emit(self.machine.step(state, micros, id_, action))
        limit = self.machine.deadline(state)
        if limit is not None and limit < passed and not (later and later[0][0] <= limit):
            state = emit(self.machine.expire(state))
            limit = self.machine.deadline(state)
        if serial > before:
            self.state.update((serial, *state))
        if due:
            if later:
                self.waiting.put(self._blocks(later))
            else:
                self.waiting.clear()
        following = [t for t in (limit, later[0][0] if later else None) if t is not None]
        if following:
            self.handle.registerTimer(max(min(following) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return (Row(**dict(zip(self.names, values, strict=True))) for values in out)

    def close(self) -> None:
        pass


class Schedules(Machine):
    """Status of a schedule, and whether a planned one was edited since."""

    schema = "status string, needs_reconfirmation boolean, actions long"
    start = ("draft", False, 0)

    def step(self, state, micros, id_, action):
        status, edited, n = state
        if action == "edit":
            return status, edited or status == "planned", n + 1
        return action, edited and action != "planned", n + 1


class Jobs(Machine):
    """queued, in_progress, then completed or failed; a job in progress that hears nothing for ``limit`` fails.

    An end without a job in progress is ignored."""

    schema = "status string, since long, ended long, timeouts long, ignored long"
    start = ("none", 0, 0, 0, 0)

    def __init__(self, limit_hours: int) -> None:
        self.limit = limit_hours * 3_600_000_000

    def step(self, state, micros, id_, action):
        status, since, ended, timeouts, ignored = state
        if action in ("queued", "in_progress"):
            return action, micros, ended, timeouts, ignored
        return (action, micros, ended + 1, timeouts, ignored) if status == "in_progress" else (status, since, ended, timeouts, ignored + 1)

    def deadline(self, state):
        return state[1] + self.limit if state[0] == "in_progress" else None

    def expire(self, state):
        _, since, ended, timeouts, ignored = state
        return "failed", since, ended, timeouts + 1, ignored


class Invites(Machine):
    """Claims of a code, of which the first ``most`` are accepted."""

    schema = "id long, claim long, accepted boolean"
    start = (0, 0, False)

    def __init__(self, most: int) -> None:
        self.most = most

    def step(self, state, micros, id_, action):
        return id_, state[1] + 1, state[1] + 1 <= self.most


class RateLimit(Machine):
    """The last success, and how many tries came within ``hours`` of one and were refused."""

    schema = "last long, allowed long, refused long"
    start = (-(1 << 60), 0, 0)

    def __init__(self, hours: int) -> None:
        self.limit = hours * 3_600_000_000

    def step(self, state, micros, id_, action):
        last, allowed, refused = state
        return (last, allowed, refused + 1) if micros < last + self.limit else (micros, allowed + 1, refused)


def machine_steps(stream: DataFrame, key: str, ts: str, id_: str, action: str, machine: Machine, late: str = "0 seconds", last: bool = False) -> DataFrame:
    """key, serial and state after every step of every key's machine, or with ``last`` after the last of those made
    at once, which is enough for the state in the end. Rows later than ``late`` are dropped."""
    at = F.col(ts).cast("timestamp")
    rows = stream.select(key, at.alias("at"), F.unix_micros(at).alias("micros"), F.col(id_).cast("long").alias("id"), F.col(action).alias("action"))
    kind = rows.schema[key].dataType.simpleString()
    grouped = rows.withWatermark("at", late).groupBy(key)
    return grouped.transformWithState(InOrder(machine, key, last), f"{key} {kind}, serial long, {machine.schema}", "Append", "EventTime")


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Keeps state in RocksDB, as machines need it, for queries started meanwhile."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that its source holds now and reads what it has emitted.

    Output and checkpoint are under ``path``; a second run goes on where the first ended."""
    spark = stream.sparkSession
    out = prepare(stream) if prepare else stream
    with rocks_state(spark):
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def with_end(stream: DataFrame, path: str, key: str, ts: str, id_: str, action: str) -> DataFrame:
    """The stream and, from a table written under ``path``, one row of a null key that lets the watermark pass all others."""
    spark = stream.sparkSession
    end = spark.range(1).select(*[(F.timestamp_micros(F.lit(END_MICROS)) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.select(key, ts, id_, action).schema])
    end.write.mode("ignore").parquet(f"{path}/end")
    return stream.select(key, ts, id_, action).unionByName(spark.readStream.schema(end.schema).parquet(f"{path}/end"))
