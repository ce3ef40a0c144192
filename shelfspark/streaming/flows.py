"""Streaming forms: price changes, hourly minima and circuit breakers over event streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

#: Files of a micro-batch.
FILES_AT_ONCE = 64
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, its timestamps in UTC."""
    ship(spark)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", FILES_AT_ONCE).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_min(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Smallest known price of each hour, with a watermark that ends an hour's state."""
    price = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("long")
    return stream.withColumn("price", price).where("price > 0").withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.min("price").alias("low")).select(F.col("window.start").alias("hour"), "low")


def price_changes(stream: DataFrame) -> DataFrame:
    """Change-only prices: each listing keeps its last fetched price as state; rows of a batch are taken in time order."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        keep = []
        for price in rows["price"].tolist():
            keep.append((before is None or before != price) and price > 0)
            before = price
        state.update((int(before),))
        yield rows[keep][["event_id", "user_id", "price"]]

    price = F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("long")
    rows = stream.select("event_id", "user_id", "ts", price.alias("price"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, price long", "price long", "append", GroupStateTimeout.NoTimeout)


BREAKER_EVENTS = "user_id long, at timestamp, kind string, run long, mean long"


class Breaker(StatefulProcessor):
    """A source's circuit breaker as keyed state with timers.

    State: consecutive failures, mean latency, time of the last attempt and until when the breaker is open (milliseconds; 0: closed).
    A timer closes it when the watermark has passed that time; another drops the state of a source that has been silent for long.
    """

    def __init__(self, opens_at: int, open_ms: int, idle_ms: int, keep: float, new: float):
        self.opens_at, self.open_ms, self.idle_ms, self.keep, self.new = opens_at, open_ms, idle_ms, keep, new

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "run long, mean long, last long, until long")

    def log(self, key, rows: list[tuple[int, str, int, int]]) -> pd.DataFrame:
        at = pd.to_datetime([r[0] for r in rows], unit="ms", utc=True)
        return pd.DataFrame({"user_id": [key[0]] * len(rows), "at": at, "kind": [r[1] for r in rows], "run": [r[2] for r in rows], "mean": pd.array([r[3] for r in rows], dtype="Int64")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, mean, last, until = self.state.get() if self.state.exists() else (0, None, None, 0)
        # what a batch has of a source is put in the order of its full times, not of their milliseconds; only four numbers of each attempt are kept
        parts = [[b[c].to_numpy(kind) for c, kind in (("us", np.int64), ("event_id", np.int64), ("ok", bool), ("value", float))] for b in rows]
        us, event, good, values = (np.concatenate(p) for p in zip(*parts))
        place = np.lexsort((values, good, event, us))
        out = []
        for at, ok, value in zip((us[place] // 1000).tolist(), good[place].tolist(), values[place].tolist()):
            if until and at >= until:
                out.append((until, "expired", run, mean))
                until = 0
            if last is not None and at - last > self.idle_ms:
                run, mean = 0, None
            if math.isfinite(value):
                mean = math.floor(value + 0.5) if mean is None else math.floor(self.keep * mean + self.new * value + 0.5)
            run, last = 0 if ok else run + 1, at
            if ok and until:
                out.append((at, "closed", run, mean))
                until = 0
            elif run >= self.opens_at:
                out.append((at, "extended" if until else "opened", run, mean))
                until = at + self.open_ms
        self.state.update((run, mean, last, until))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until:
            self.handle.registerTimer(until)
        self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield self.log(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        run, mean, last, until = self.state.get() if self.state.exists() else (0, None, 0, 0)
        if until and now >= until:
            self.state.update((run, mean, last, 0))
            yield self.log(key, [(until, "expired", run, mean)])
        if now >= last + self.idle_ms:
            self.state.clear()

    def close(self) -> None:
        pass


def breaker_log(stream: DataFrame, opens_at: int = 3, minutes: int = 5, idle_hours: int = 6, keep: float = 0.8, new: float = 0.2, late: str = "10 minutes") -> DataFrame:
    """(user_id, at, kind, run, mean): when breakers open, stay open for longer, are closed by a success, or expire.

    stream: events with ts, user_id, event_type and value (the latency). An attempt fails if its type is error; one without a time
    doesn't count, one without a finite latency leaves the mean. Attempts of one time go by event_id, failures first, then by latency. State lies in RocksDB (stateful()).
    """
    ok = F.coalesce(F.col("event_type") != "error", F.lit(True))
    rows = stream.where("ts is not null").withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit((1 << 63) - 1)).alias("event_id"), ok.alias("ok"), F.coalesce("value", F.lit(float("nan"))).alias("value"))
    processor = Breaker(opens_at, minutes * 60_000, idle_hours * 3_600_000, keep, new)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, BREAKER_EVENTS, "append", "EventTime")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which operators with timers need; the setting is put back after."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def part(batch: DataFrame, path: str, number: int) -> None:
    """Writes a micro-batch as its own part of a table; a batch that runs again replaces its part."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(spark: SparkSession, path: str, keys: list[str], *order: str) -> DataFrame:
    """The last version of each key over all parts, by the columns of `order` and then by batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*order, "batch")).alias("row")).select("row.*")


def drained(stream: DataFrame, folder: str, keys: list[str] | None = None) -> DataFrame:
    """All that a stream gives for the files there are: run to its end into a table under folder, and read back.

    With keys, the stream's rows are updates of keyed aggregates: each key's last one counts, and the state of what the
    watermark has passed is freed.
    """
    spark, path = stream.sparkSession, f"{folder}/data"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if keys is None:
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    writer.outputMode("update").foreachBatch(lambda batch, number: part(batch, path, number)).start().awaitTermination()
    return latest(spark, path, keys)
