"""Operators with state of their own on streams (transformWithState): rows of a key are held until the
watermark has passed them and are taken in the order of their times, whatever the order of arrival.

State lies in the RocksDB store, each variable by name, and can be read as a table (state_rows). Rows that
the watermark has passed when they arrive are dropped by Spark. `late` bounds what a key holds back.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from ..operators.reservoirs import draw
from ..session import own_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What a row needs: a key, its time in microseconds, an id that orders equal times, and what it holds.
ROW = "us long, id long, payload string"


class InOrder(StatefulProcessor):
    """Holds rows back until their times have passed, then gives them to take(), sorted.

    One timer a key is set, at the first row held back or at what take() asks for.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, part = None, []
        for r in rows:
            if key[0] is None:
                continue  # the marker of a stream's end
            first = r.us if first is None else min(first, r.us)
            part.append((r.us, r.id, r.payload))
            if len(part) == 1024:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted(r for r in held if r[0] <= passed)
        rest = [r for r in held if r[0] > passed]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        yield from self.take(key[0], ready, passed, bool(rest))

    def close(self) -> None:
        pass


class Capsules(InOrder):
    """The rows of capsules(): a window goes out when the next one opens. The last one of a key goes out
    when the watermark is `idle` beyond its last time, and ends at that time + `tail` if that is sooner;
    rows that come later still begin anew."""

    def __init__(self, width: int, k: int, tail: int, idle: int):
        self.width, self.k, self.tail, self.idle = width, k, tail, idle

    def open(self, handle) -> None:
        self.frames = handle.getListState("frames", "us long")

    def window(self, key: int, frames: list[int], last: bool) -> Row:
        n, idx = len(frames), frames[0] // self.width
        picks = range(n) if n < self.k else sorted({round(i * (n - 1) / (self.k - 1)) for i in range(self.k)})
        pts = [frames[i] / 1e6 for i in picks]
        end = (idx + 1) * self.width
        if last and self.tail:
            end = min(end, frames[-1] + self.tail)
        more = self.k - len(pts)
        return Row(key=key, idx=idx, s=idx * self.width / 1e6, e=end / 1e6, n_frames=n, pts=pts + [None] * more, valid=[True] * len(pts) + [False] * more)

    def take(self, key, ready: list[tuple], passed: int, more: bool) -> Iterator[Row]:
        frames = [r[0] for r in self.frames.get()] if self.frames.exists() else []
        before = len(frames)
        for us, _, _ in ready:
            if frames and us == frames[-1]:
                continue
            if frames and us // self.width != frames[0] // self.width:
                yield self.window(key, frames, False)
                frames, before = [], 0
                self.frames.clear()
            frames.append(us)
        if frames and not more and passed >= frames[-1] + self.idle:
            yield self.window(key, frames, True)
            self.frames.clear()
        elif frames:
            if len(frames) > before:
                self.frames.appendList([(us,) for us in frames[before:]])
            self.handle.registerTimer((frames[-1] + self.idle) // 1000 + 1)


class Reservoir(InOrder):
    """The rows of reservoir_steps(): Algorithm R with k slots of at most `cap` bytes, and after each row the
    hash of what is held. Slots and the count of rows are state; draws come from the count alone."""

    def __init__(self, k: int, cap: int, seed: int):
        self.k, self.cap, self.seed = k, cap, seed

    def open(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long")
        self.slots = handle.getMapState("slots", "slot int", "id long, payload string")

    def take(self, key, ready: list[tuple], passed: int, more: bool) -> Iterator[Row]:
        if not ready:
            return
        n = self.seen.get()[0] if self.seen.exists() else 0
        slots = {k[0]: tuple(v) for k, v in self.slots.iterator()} if n else {}
        changed = set()
        for _, item, payload in ready:
            if len(payload.encode()) > self.cap:
                yield Row(key=key, item=item, n=None, slot=None, prefix_hash=None)
                continue
            n += 1
            at = n - 1 if n <= self.k else draw(self.seed, key, n)
            if at < self.k:
                slots[at] = (item, payload)
                changed.add(at)
            text = f'{{"seen":{n},"slots":[{",".join(slots[i][1] for i in sorted(slots))}]}}'
            yield Row(key=key, item=item, n=n, slot=at if at < self.k else None, prefix_hash=hashlib.sha256(text.encode()).hexdigest())
        self.seen.update((n,))
        for at in changed:
            self.slots.updateValue((at,), slots[at])


def timed(rows: DataFrame, key: str, t: str, late: str, item: str | None = None, payload: str | None = None) -> DataFrame:
    """(key, at, us, id, payload) with a watermark on `at`."""
    us = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{t}` as timestamp_ntz))")
    out = rows.select(
        F.col(key).cast("long").alias("key"), F.col(t).cast("timestamp").alias("at"), us.alias("us"),
        (F.col(item) if item else F.lit(0)).cast("long").alias("id"), (F.col(payload) if payload else F.lit("")).alias("payload"),
    )
    return out.where("us is not null").withWatermark("at", late)


def capsule_stream(rows: DataFrame, key: str, t: str, width: float, k: int = 4, tail: float = 0.0, idle: float | None = None, late: str = "0 seconds") -> DataFrame:
    """capsules() on a stream; keys as `key`. idle (a width by default): how long after its last time a key is taken to have ended."""
    unit = lambda x: round(x * 1e6)
    made = Capsules(unit(width), k, unit(tail), unit(width if idle is None else idle))
    out = "key long, idx long, s double, e double, n_frames long, pts array<double>, valid array<boolean>"
    return timed(rows, key, t, late).groupBy("key").transformWithState(made, out, "Append", "EventTime")


def reservoir_stream(rows: DataFrame, key: str, t: str, item: str, payload: str, k: int, cap: int, seed: int = 17, late: str = "0 seconds") -> DataFrame:
    """key, item, n, slot, prefix_hash of each row in order of time and item; n null: refused for its size."""
    out = "key long, item long, n long, slot int, prefix_hash string"
    return timed(rows, key, t, late, item, payload).groupBy("key").transformWithState(Reservoir(k, cap, seed), out, "Append", "EventTime")


def ended(rows: DataFrame, t: str, at: str = "2200-01-01 00:00:00") -> DataFrame:
    """A stream with a marker of its end behind it: a row without key, far in time, that lets all timers
    go off. For streams that are read to their end in one micro-batch."""
    spark = rows.sparkSession
    folder = f"{own_dir(spark)}/stream-end-{hashlib.sha256(rows.schema.json().encode()).hexdigest()[:12]}"
    marker = [F.lit(at).cast(f.dataType).alias(f.name) if f.name == t else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*marker).write.mode("overwrite").parquet(folder)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))


def with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query under the state store that named state needs; the session's setting stays as it was."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, old)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream yields for all that is there now, as Parquet under `path`; further calls with the same
    folders go on where this one ended."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with_rocks(spark, writer.start).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A named state of a stopped stream as a table."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def slot_usage(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, slots, bytes, largest of the reservoirs that a stream's checkpoint holds."""
    size = F.octet_length("user_map_value.payload")
    rows = state_rows(spark, checkpoint, "slots").groupBy(F.col("key.key").alias("key"))
    return rows.agg(F.count(F.lit(1)).alias("slots"), F.sum(size).alias("bytes"), F.max(size).cast("long").alias("largest"))


def checked_usage(usage: DataFrame, k: int, cap: int) -> DataFrame:
    """slot_usage(), or an error at the first key with more slots, or a larger one, than it may have."""
    why = F.when(F.col("slots") > k, "more slots than allowed").when(F.col("largest") > cap, "a slot is larger than allowed").when(F.col("bytes") > k * cap, "more bytes than allowed")
    return usage.where(F.when(why.isNull(), True).otherwise(F.raise_error(why).cast("boolean")))


def watched(writer: DataStreamWriter, *, finished: Callable[[StreamingQuery], bool], deadline: float, poll: float = 2.0) -> str:
    """Runs a stream that takes what becomes available, until `finished` says so ("finished") or `deadline`
    seconds are over ("deadline"); either way the running micro-batch is completed, and the checkpoint
    takes up there. A failed query raises."""
    spark = writer._spark
    query = with_rocks(spark, writer.trigger(processingTime=f"{poll} seconds").start)
    end = time.monotonic() + deadline
    try:
        while True:
            if query.awaitTermination(max(0.05, min(poll, end - time.monotonic()))):
                return "finished"
            if finished(query):
                return "finished"
            if time.monotonic() >= end:
                return "deadline"
    finally:
        if query.isActive:
            query.stop()
