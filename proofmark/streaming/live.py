"""The life of batch items as a stream: keyed state with timers.

Events of items (queued, started, finished, failed) may come late, repeated or out of
order.  An item only moves on: QUEUED, PROCESSING, then COMPLETED or ERROR, whichever
end comes first by time.  An event that would take it back, or has come before, changes
nothing, so each item passes each state at most once, whatever a source sends again.
An item that was started and doesn't end within a limit of event time ends in
ERROR.  Ended items are remembered for a while, then their state is dropped.

State lies in the state store (RocksDB), partitioned by item; a task holds the events of
one item at a time, or those of one share of the items, where they are dealt into shares.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "batch_id string, item_id string, event string, ts timestamp, overall_status string, processing_time_ms double, error_code string"
MOVES = "batch_id string, item_id string, state string, at timestamp, overall_status string, processing_time_ms double, error_code string"
#: What an event leads to, and how far along that is.
STATES = {"queued": ("QUEUED", 0), "started": ("PROCESSING", 1), "finished": ("COMPLETED", 2), "failed": ("ERROR", 2)}
TIMEOUT = "processing_timeout"
#: What a share's events and moves hold, in this order; times taken are text there, so that none and not a number stay apart.
CAME = ("batch_id", "item_id", "event", "ms", "overall_status", "processing_time_ms", "error_code")
MADE = ("batch_id", "item_id", "state", "ms", "overall_status", "processing_time_ms", "error_code")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def told(events: Iterable[tuple], step: int) -> Iterator[tuple[int, tuple]]:
    """What moves an item on from a step, of its events (kind, ms, status, time taken, error): how far along it is then, and the state, since when, and what belongs to it."""
    # Of equal times the less advanced first, then by name, so the order in which events come doesn't matter.
    for event, ms, status, took, error in sorted(events, key=lambda e: (e[1], STATES[e[0]][1], e[0], e[4] or "", e[2] or "")):
        name, to = STATES[event]
        if to > step:
            step = to
            yield to, (name, ms, status if name == "COMPLETED" else None, took if to == 2 else None, (error or "processing_exception") if name == "ERROR" else None)


class Life(StatefulProcessor):
    """Moves of one item."""

    def __init__(self, limit_ms: int, keep_ms: int):
        self.limit_ms, self.keep_ms = limit_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "step int, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get() or (-1, 0)
        step, since = before
        for step, move in told(((r.event, r.ms, r.overall_status, r.processing_time_ms, r.error_code) for r in rows), step):
            since = move[1]
            yield self._row(key, *move)
        if step != before[0]:
            self._remember(step, since, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, since = self.state.get() or (-1, 0)
        if step == 1:
            ended = since + self.limit_ms
            self._remember(2, ended)
            yield self._row(key, "ERROR", ended, None, None, TIMEOUT)
        elif step == 2:
            self.state.clear()

    def _row(self, key: tuple, state: str, ms: int, status: str | None, took: float | None, error: str | None) -> Row:
        return Row(batch_id=key[0], item_id=key[1], state=state, ms=ms, overall_status=status, processing_time_ms=took, error_code=error)

    def _remember(self, step: int, since: int, before: tuple[int, int] = (-1, 0)) -> None:
        """Each call to the store is a round trip, so the timer set before is known from the state before; one that has run out is dropped by Spark."""
        self.state.update((step, since))
        if before[0] > 0:
            self.handle.deleteTimer(self._timer(*before))
        if step > 0:
            self.handle.registerTimer(self._timer(step, since))

    def _timer(self, step: int, since: int) -> int:
        return since + (self.limit_ms if step == 1 else self.keep_ms)

    def close(self) -> None:
        pass


class Lives(Life):
    """Moves of a share of the items, whose states are one value and have one timer, the first of theirs: round trips to the store are a share's, not each item's."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("states", "batch_ids array<string>, item_ids array<string>, steps array<int>, sinces array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came: dict[tuple, list[tuple]] = {}
        for part in rows:
            for batch, item, *event in zip(*(part[name] for name in CAME), strict=True):
                came.setdefault((batch, item), []).append(event)
        states, made = self._states(), []
        timer = self._first(states)
        for item, events in came.items():
            for step, move in told(events, states.get(item, (-1, 0))[0]):
                states[item] = step, move[1]
                made.append((*item, *move))
        if made:
            self._keep(states, timer)
            yield pd.DataFrame(made, columns=MADE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached, states, made = timerValues.getCurrentWatermarkInMs(), {}, []
        for item, (step, since) in self._states().items():
            if step == 1 and self._timer(step, since) <= reached:
                step, since = 2, self._timer(step, since)
                made.append((*item, "ERROR", since, None, None, TIMEOUT))
            if step < 2 or self._timer(step, since) > reached:
                states[item] = step, since
        self._keep(states, None)
        if made:
            yield pd.DataFrame(made, columns=MADE)

    def _states(self) -> dict[tuple, tuple[int, int]]:
        batches, items, steps, sinces = self.state.get() or ((), (), (), ())
        return dict(zip(zip(batches, items, strict=True), zip(steps, sinces, strict=True), strict=True))

    def _first(self, states: dict[tuple, tuple[int, int]]) -> int | None:
        return min((self._timer(*state) for state in states.values() if state[0] > 0), default=None)

    def _keep(self, states: dict[tuple, tuple[int, int]], before: int | None) -> None:
        """``before`` is the timer that is set; one that has run out is dropped by Spark."""
        if not states:
            self.state.clear()
            return
        self.state.update(tuple(map(list, (*zip(*states), *zip(*states.values())))))
        timer = self._first(states)
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)


@contextmanager
def state_store(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Streams started within keep their state in the store that timers need, in so many parts; afterwards the session is as before."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE} | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def moves(events: DataFrame, late: str = "10 minutes", limit_minutes: float = 30, keep_minutes: float = 24 * 60, shares: int | None = None) -> DataFrame:
    """The moves of items from their events (a stream of ``EVENTS``): one row for each state that an item enters.

    Events later than ``late`` are left out; an item ends in ERROR ``limit_minutes``
    after it was started unless it has ended.  Events of unknown kinds and without a time are left out.

    An item by itself costs several round trips to the store whenever it moves.  With ``shares``
    the items are dealt by hash into so many shares, each of which is read and written
    whole when one of its items moves: far cheaper where a micro-batch moves a good part of all
    items, dearer where it moves few of very many.  The number is fixed by a checkpoint's first run.
    """
    limits = int(limit_minutes * 60_000), int(keep_minutes * 60_000)
    known = events.where(F.col("event").isin(*STATES) & F.col("ts").isNotNull()).withColumn("ms", F.unix_millis("ts"))
    out = MOVES.replace("at timestamp", "ms long")
    if shares:
        dealt = known.select(F.pmod(F.hash("batch_id", "item_id"), F.lit(shares)).alias("share"), "ts", *(F.col(c).cast("string") if c == "processing_time_ms" else c for c in CAME))
        made = dealt.withWatermark("ts", late).groupBy("share").transformWithStateInPandas(Lives(*limits), out.replace("_ms double", "_ms string"), "append", "eventTime")
    else:
        made = known.withWatermark("ts", late).groupBy("batch_id", "item_id").transformWithState(Life(*limits), out, "append", "eventTime")
    return made.select("batch_id", "item_id", "state", F.timestamp_millis("ms").alias("at"), "overall_status", F.col("processing_time_ms").cast("double").alias("processing_time_ms"), "error_code")


def arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as they arrive, JSON lines in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def follow(made: DataFrame, path: str, checkpoint: str, parts: int | None = None) -> StreamingQuery:
    """Writes moves until the source has been read; a run that was ended goes on from its checkpoint, and each move is written once.

    A micro-batch writes a folder of its own, over what an unfinished run of it left.  State lies
    in ``parts`` parts (else as many as the session's shuffles have), which its first run
    fixes: each costs a task in every micro-batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with state_store(made.sparkSession, parts):
        return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All moves written so far."""
    return spark.read.schema(f"{MOVES}, epoch long").parquet(path)


def now(made: DataFrame) -> DataFrame:
    """Each item as it stands: the row of the furthest state that it entered."""
    step = F.when(F.col("state") == "QUEUED", 0).when(F.col("state") == "PROCESSING", 1).otherwise(2)
    last = made.groupBy("batch_id", "item_id").agg(F.max_by(F.struct("state", "at", "overall_status", "processing_time_ms", "error_code"), step).alias("x"))
    return last.select("batch_id", "item_id", F.col("x.state").alias("processing_state"), "x.at", "x.overall_status", "x.processing_time_ms", "x.error_code")


def jobs(standing: DataFrame) -> DataFrame:
    """Per batch the counts of its items by state, and its own: QUEUED until an item starts, COMPLETED when none is left."""
    count = lambda s: F.count_if(F.col("processing_state") == s)
    counted = standing.groupBy("batch_id").agg(F.count("*").alias("total"), *(count(s).alias(s.lower()) for s in ("QUEUED", "PROCESSING", "COMPLETED", "ERROR")))
    state = F.when(F.col("queued") == F.col("total"), "QUEUED").when(F.col("queued") + F.col("processing") > 0, "PROCESSING").otherwise("COMPLETED")
    return counted.withColumn("state", state)
