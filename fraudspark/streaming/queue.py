"""The queue of flagged events on a stream: once each, in order per account, nothing lost.

Each account keeps the messages it has met (forgotten after ``remember_ms``), and holds new ones
until its newest event is ``delay_ms`` older, or until a timer says that none has come for
``idle_ms``. Held messages leave in the order of their events and are numbered. One that is older
than what has left cannot keep the order any more: it is late and goes to a sink of its own, as
messages met before do.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fraudspark.streaming.jobs import PROVIDER, ROCKSDB, write_batch

QUEUED, LATE, DOUBLED = "queued", "late", "doubled"
FATES = (QUEUED, LATE, DOUBLED)
MESSAGE = ["txn_id", "user_id", "ts_ms", "score", "model_version"]
MESSAGE_SCHEMA = "txn_id string, user_id string, ts_ms bigint, score double, model_version string"
OUT_SCHEMA = f"{MESSAGE_SCHEMA}, fate string, place bigint"
HELD_SCHEMA = "txn_id string, ts_ms bigint, score double, model_version string"
MINUTE = 60_000


class AccountQueue(StatefulProcessor):
    def __init__(self, delay_ms: int, idle_ms: int, remember_ms: int):
        self.delay_ms, self.idle_ms, self.remember_ms = delay_ms, idle_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.met = handle.getMapState("met", "txn_id string", "ts_ms bigint", self.remember_ms)
        self.held = handle.getListState("held", HELD_SCHEMA)
        self.clock = handle.getValueState("clock", "newest bigint, left bigint, place bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "txn_id"], ignore_index=True)
        newest, left, place = self._clock()
        again = batch["txn_id"].duplicated().to_numpy()
        for i, txn in enumerate(batch["txn_id"]):
            again[i] = again[i] or self.met.containsKey((txn,))
        fresh = batch[~again]
        for txn, ts in zip(fresh["txn_id"], fresh["ts_ms"], strict=True):
            self.met.updateValue((txn,), (int(ts),))
        late = fresh["ts_ms"] < left
        yield self._out(key, batch[again], DOUBLED)
        yield self._out(key, fresh[late], LATE)
        newest = max(newest, int(batch["ts_ms"].max()))
        yield self._leave(key, fresh[~late], newest, left, place, newest - self.delay_ms)
        if self.held.exists():
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, left, place = self._clock()
        yield self._leave(key, None, newest, left, place, newest)

    def close(self) -> None:
        pass

    def _clock(self) -> tuple[int, int, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (-(1 << 62), -(1 << 62), 0)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _leave(
        self, key, more: pd.DataFrame | None, newest: int, left: int, place: int, upto: int
    ) -> pd.DataFrame:
        """Messages of events up to a time leave, the others are held."""
        held = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=_HELD)
        if more is not None and len(more):
            held = more[_HELD] if held.empty else pd.concat([held, more[_HELD]])
        held = held.sort_values(["ts_ms", "txn_id"], ignore_index=True)
        go = held["ts_ms"] <= upto
        out, rest = held[go], held[~go]
        if len(rest):
            self.held.put([tuple(r) for r in rest.astype(object).itertuples(index=False)])
        else:
            self.held.clear()
        if len(out):
            left = max(left, int(out["ts_ms"].max()))
        self.clock.update((newest, left, place + len(out)))
        return self._out(key, out, QUEUED, place)

    def _out(self, key, rows: pd.DataFrame, fate: str, place: int = 0) -> pd.DataFrame:
        numbers = range(place + 1, place + 1 + len(rows)) if fate == QUEUED else [None] * len(rows)
        out = rows.assign(user_id=key[0], fate=fate, place=pd.Series(numbers, rows.index, "Int64"))
        return out[[*MESSAGE, "fate", "place"]]


_HELD = [f.split()[0] for f in HELD_SCHEMA.split(", ")]


def in_order(
    messages: DataFrame, delay_ms: int = MINUTE, idle_ms: int = 1000, remember_ms: int = 24 * 60 * MINUTE
) -> DataFrame:
    """Every message of a stream of MESSAGE columns with its ``fate`` and, if it is queued, its
    ``place`` in its account. ``delay_ms`` is event time, the others are processing time."""
    messages.sparkSession.conf.set(PROVIDER, ROCKSDB)
    return (
        messages.select(*MESSAGE)
        .groupBy("user_id")
        .transformWithStateInPandas(
            AccountQueue(delay_ms, idle_ms, remember_ms), OUT_SCHEMA, "append", "processingTime"
        )
    )


def sink_writer(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: a folder for each fate."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                for fate in FATES:
                    write_batch(batch.where(F.col("fate") == fate).drop("fate"), f"{root}/{fate}", batch_id)
        finally:
            batch.unpersist()

    return write


def start_queue(ordered: DataFrame, root: str) -> StreamingQuery:
    return (
        ordered.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(sink_writer(root))
        .start()
    )


def read_sink(spark: SparkSession, root: str, fate: str) -> DataFrame:
    schema = OUT_SCHEMA.replace(", fate string", "")
    return spark.read.schema(schema).parquet(f"{root}/{fate}/batch_id=*")


def run_queue(ordered: DataFrame, root: str, messages: int, patience_s: float = 300) -> None:
    """Runs the queue until ``messages`` have a fate. Timers let go of the last ones, so the stream
    has no last batch of its own; it is stopped when all are accounted for."""
    spark = ordered.sparkSession
    nothing = spark.createDataFrame([], OUT_SCHEMA.replace(", fate string", ""))
    for fate in FATES:  # a fate that no message meets has a sink too
        write_batch(nothing, f"{root}/{fate}", -1)
    query = start_queue(ordered, root)
    try:
        until = time.monotonic() + patience_s
        while sum(read_sink(spark, root, f).count() for f in FATES) < messages:
            if query.exception() is not None:
                raise query.exception()
            if time.monotonic() > until:
                raise TimeoutError(f"not all of {messages} messages have a fate")
            time.sleep(0.5)
    finally:
        query.stop()
