"""Hold and release: rows of a stream wait in keyed state until event time has passed them, then leave in total order.

A key's rows wait in a MapState, packed by the stretch of event time in which they may leave. Event time is cut into slots;
a timer of the key fires when the watermark passes its earliest waiting slot, and the slots that have passed are handed to
the operator as ordered frames, one stretch after the other: a task holds the rows of one batch or of one stretch of a key,
never all that waits. Whatever the layout and order of the files, an operator so sees the same rows in the
same order, as long as no row comes later than the hold (the watermark delay). A row of a slot that its key has already
released cannot take its place any more: it leaves at once, marked ``late``, for a side table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from matchloom.plans.durable import fresh_path

#: Milliseconds of event time whose waiting rows are kept and released together (at least one slot).
STRETCH = 30 * 86_400_000
#: Rows of a key that are gathered from the batches of Spark before they are dealt to their stretches.
GATHER = 50_000
#: Before any release, and the event time that closes a finished stream.
NEVER, END = -(2**62), "3000-01-01 00:00:00"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_pandas()


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of about GATHER rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= GATHER:
            yield pd.concat(some, ignore_index=True)
            some, n = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


def milliseconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def shaped(rows: pd.DataFrame, names: Sequence[str], late: bool) -> pd.DataFrame:
    """The named columns, nulls where a row has none, and the mark of late rows."""
    out = pd.DataFrame({c: rows[c] if c in rows else pd.Series([None] * len(rows), index=rows.index, dtype=object) for c in names})
    out["late"] = late
    return out


class InOrder(StatefulProcessor):
    """Base of operators that take a key's rows in event-time order; subclasses define ``open``, ``take`` and perhaps ``due``."""

    def __init__(self, when: str, order: Sequence[str], names: Sequence[str], slot_seconds: int):
        self.when, self.order, self.names, self.slot = when, list(order), list(names), 1000 * int(slot_seconds)

    def open(self, handle) -> None:
        """Register the operator's own state."""

    def take(self, key: tuple, rows: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """Output of released rows; ``now`` is the watermark in milliseconds."""
        raise NotImplementedError

    def due(self, rows: pd.DataFrame) -> pd.Series:
        """The watermark (milliseconds) at which each row may leave: the end of its slot."""
        return (milliseconds(rows[self.when]) // self.slot + 1) * self.slot

    @property
    def stretch(self) -> int:
        return self.slot * max(1, STRETCH // self.slot)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, part long", "due long, rows binary")
        self.mark = handle.getValueState("mark", "released long, next long, parts long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        for arrived in gathered(rows):
            released, upcoming, parts = self.mark.get() if self.mark.exists() else (NEVER, None, 0)
            timed = arrived[arrived[self.when].notna()]
            ends = self.due(timed)
            held = timed[ends > released].assign(_due=ends[ends > released])
            late = arrived.drop(held.index)
            for place, part in held.groupby(held["_due"] // self.stretch):
                self.waiting.updateValue((int(place), parts), (int(part["_due"].min()), packed(part.reset_index(drop=True))))
            if len(held):
                first = int(held["_due"].min())
                if upcoming is None or first < upcoming:
                    self.handle.registerTimer(first)
                    upcoming = first
                self.mark.update((released, upcoming, parts + 1))
            if len(late):
                yield shaped(late.reset_index(drop=True), self.names, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        released, _, parts = self.mark.get() if self.mark.exists() else (NEVER, None, 0)
        places: dict[int, list[int]] = {}
        for place, part in list(self.waiting.keys()):
            places.setdefault(place, []).append(part)
        passed = sorted(place for place in places if place * self.stretch <= now)
        ahead = min((place for place in places if place * self.stretch > now), default=None)
        following = [] if ahead is None else [self.waiting.getValue((ahead, part))[0] for part in places[ahead]]
        ready, until = None, now
        for place in passed:
            # What waited before this stretch is taken as of its end, as if the watermark had stopped there.
            if ready is not None:
                yield from self.after(key, ready, until)
                ready = None
            found = []
            for part in sorted(places[place]):
                due, data = self.waiting.getValue((place, part))
                if due > now:
                    following.append(due)
                    continue
                rows = unpacked(data)
                found.append(rows[rows["_due"] <= now])
                rest = rows[rows["_due"] > now]
                if len(rest):
                    following.append(int(rest["_due"].min()))
                    self.waiting.updateValue((place, part), (following[-1], packed(rest.reset_index(drop=True))))
                else:
                    self.waiting.removeKey((place, part))
            if found:
                ready = pd.concat(found, ignore_index=True).drop(columns="_due").sort_values(self.order, kind="mergesort").reset_index(drop=True)
                until = (place + 1) * self.stretch - 1
        upcoming = min(following, default=None)
        if upcoming is not None:
            self.handle.registerTimer(upcoming)
        self.mark.update((max(released, now), upcoming, parts))
        yield from self.after(key, ready, now)

    def after(self, key: tuple, rows: pd.DataFrame | None, now: int) -> Iterator[pd.DataFrame]:
        """What a timer leads to; by default the released rows are taken."""
        if rows is not None:
            yield from self.take(key, rows, now)


class Clock:
    """A small stream beside a finished one that moves event time to its end, so that all that waits is released.

    The tick moves the watermark; timers fire in the micro-batch without data that Spark runs after it by default.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, fresh_path(spark, "clock")
        self._tick("1970-01-01 00:00:00")

    def _tick(self, at: str) -> None:
        self.spark.sql(f"SELECT TIMESTAMP '{at}' AS tick").coalesce(1).write.mode("append").parquet(self.path)

    def close(self) -> None:
        self._tick(END)

    def beside(self, rows: DataFrame, when: str) -> DataFrame:
        ticks = self.spark.readStream.schema("tick timestamp").parquet(self.path)
        return rows.withColumn("_tick", F.lit(False)).unionByName(ticks.select(F.col("tick").alias(when), F.lit(True).alias("_tick")), allowMissingColumns=True)


def held(rows: DataFrame, keys: Sequence[str], when: str, hold: str, processor: StatefulProcessor, schema: str | T.StructType, clock: Clock | None = None) -> DataFrame:
    """Rows of ``processor`` by ``keys``, run on a stream whose rows come at most ``hold`` of event time out of order."""
    timed = (clock.beside(rows, when) if clock else rows).withWatermark(when, hold)
    if clock:
        # As it names the event time, this filter stays above the watermark, which so sees the ticks.
        timed = timed.filter(~F.col("_tick") | F.col(when).isNull()).drop("_tick")
    # As a plain column the event time brings late rows to the processor, which marks them instead of losing them.
    plain = timed.withColumn("_when", F.timestamp_micros(F.unix_micros(when))).drop(when).withColumnRenamed("_when", when)
    return plain.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def run_available(stream: DataFrame, label: str, clock: Clock | None = None) -> DataFrame:
    """Drain what is available into a parquet table of the shared folder and read it back; a clock is closed at the end."""
    spark = stream.sparkSession
    out, offsets = fresh_path(spark, label), fresh_path(spark, f"{label}-offsets")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for closing in (False, True)[: 2 if clock else 1]:
            if closing:
                clock.close()
            writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", offsets)
            writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(out)
