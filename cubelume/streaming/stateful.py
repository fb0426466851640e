"""Streams with state of their own: count windows with a maximum age, and bounded captures, as stateful processors.

State is in the state store (RocksDB), so that it is there after a restart, is as large as what is pending and no larger, and moves with its key. Times are event times: a
timer fires when the watermark passes it, so that runs over the same rows agree however they are cut into micro-batches but for what is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Lets this session's streams keep the state that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _watermarked(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)


class _CountWindows(StatefulProcessor):
    def __init__(self, size: int, age_ms: int | None, min_variance: float) -> None:
        self.size, self.age_ms, self.min_variance = size, age_ms, min_variance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n long")
        self.pending = handle.getListState("pending", "value double, at long")

    def _out(self, key: tuple, values: list[float], aged: bool) -> dict:
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + 1,))
        mean = sum(values) / len(values)
        variance = sum((v - mean) ** 2 for v in values) / len(values)
        return {"key": key[0], "batch": n, "n": len(values), "mean": mean, "least": min(values), "most": max(values), "aged": aged, "varied": variance >= self.min_variance}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        first, out = (held[0][1] if held else None), []
        d = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable")
        for value, us in zip(d["value"], d["us"], strict=True):
            held.append((float(value), int(us)))
            if len(held) == self.size:
                out.append(self._out(key, [v for v, _ in held], False))
                held = []
        if held:
            self.pending.put(held)
        else:
            self.pending.clear()
        if self.age_ms and (held[0][1] if held else None) != first:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(held[0][1] // 1000 + self.age_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        if held:
            self.pending.clear()
            yield pd.DataFrame([self._out(key, [v for v, _ in held], True)])

    def close(self) -> None:
        pass


def aged_count_windows(stream: DataFrame, by: str, value: Column, size: int, late: str = "0 seconds", age_ms: int | None = None, min_variance: float = 0.0, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Streaming: key, batch, n, mean, least, most, aged, varied as soon as `size` rows of a key are there, in order of time within a micro-batch.

    age_ms: what is pending goes out as it is (aged) once the watermark is that far behind its first row. varied: whether a batch's variance reaches
    min_variance. Rows that come later than `late` behind the newest are dropped; so are rows without a time or a value; null keys are a key."""
    kind = dict(stream.dtypes)[by]
    rows = _watermarked(stream, ts, late).where(F.col("at").isNotNull() & value.isNotNull())
    rows = rows.select(F.col(by).alias("key"), "at", value.cast("double").alias("value"), F.unix_micros("at").alias("us"), F.col(tie).cast("long").alias("tie"))
    schema = f"key {kind}, batch long, n long, mean double, least double, most double, aged boolean, varied boolean"
    return rows.groupBy("key").transformWithStateInPandas(_CountWindows(size, age_ms, min_variance), schema, "append", "EventTime")


class _Capture(StatefulProcessor):
    def __init__(self, most: int, reset_ms: int | None) -> None:
        self.most, self.reset_ms = most, reset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "n int, round int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, turn = self.taken.get() if self.taken.exists() else (0, 0)
        d = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable").head(self.most - n)
        if not len(d):
            return
        if n == 0 and self.reset_ms:
            self.handle.registerTimer(int(d["us"].iloc[0]) // 1000 + self.reset_ms)
        self.taken.update((n + len(d), turn))
        yield pd.DataFrame({"key": key[0], "id": d["tie"], "slot": range(n, n + len(d)), "round": turn})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, turn = self.taken.get() if self.taken.exists() else (0, 0)
        self.taken.update((0, turn + 1))
        return iter(())

    def close(self) -> None:
        pass


def bounded_capture(stream: DataFrame, by: str, most: int, late: str = "0 seconds", reset_ms: int | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Streaming: key, id, slot, round of the first `most` rows of each key; what comes when the buffer is full is ignored. reset_ms: the
    buffer is empty again once the watermark is that far behind its first row (the next round)."""
    kind = dict(stream.dtypes)[by]
    rows = _watermarked(stream, ts, late).where(F.col("at").isNotNull())
    rows = rows.select(F.col(by).alias("key"), "at", F.unix_micros("at").alias("us"), F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("key").transformWithStateInPandas(_Capture(most, reset_ms), f"key {kind}, id long, slot int, round int", "append", "EventTime")
