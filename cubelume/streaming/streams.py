"""Streams of events and frames, and the same by batch: count windows, time windows, sessions, gates and bounded captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import numbered


def batches_of(df: DataFrame, size: int, *order: str, out: str = "batch") -> DataFrame:
    """df with the number of the count window of `size` rows each row is in, by a total order: rows are numbered by ranges, which are
    written once, so that no task has more than its range."""
    return numbered(df, *order, out="__n").withColumn(out, F.expr(f"(__n - 1) div {size}").cast("long")).drop("__n")


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", per_trigger: int = 1) -> DataFrame:
    """The table's folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/{table}.parque[t]")


def tumbling(events: DataFrame, size: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    """start, n, total by windows of time; late: how long rows may come after."""
    e = events.withColumn("at", F.col(ts).cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy(F.window("at", size)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    e = events.withColumn("at", F.col(ts).cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy(F.window("at", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, *by: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    e = events.withColumn("at", F.col(ts).cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    return e.groupBy(*by, F.session_window("at", gap)).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def captured(frames: DataFrame, most: int, *by: str, order: str = "ts") -> DataFrame:
    """The first `most` rows of each group: what a bounded buffer takes before it is full."""
    return frames.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(order, "event_id")) - 1).where(F.col("slot") < most)


def count_windows(stream: DataFrame, by: str, value: Column, size: int, age_ms: int | None = None) -> DataFrame:
    """Streaming: (by, batch, n, mean, least, most) as soon as `size` rows of a group are there; what is pending lives in the state
    store and is there after a restart. age_ms: a pending batch this old (processing time) goes out as it is."""

    def feed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, pending = state.get if state.exists else (0, [])
        pending, out = list(pending), []
        if state.hasTimedOut:
            if pending:
                out.append((key[0], number, len(pending), sum(pending) / len(pending), min(pending), max(pending)))
                number, pending = number + 1, []
        for f in frames:
            for v in f["value"]:
                pending.append(float(v))
                if len(pending) == size:
                    out.append((key[0], number, size, sum(pending) / size, min(pending), max(pending)))
                    number, pending = number + 1, []
        state.update((number, pending))
        if age_ms and pending:
            state.setTimeoutDuration(age_ms)
        yield pd.DataFrame(out, columns=[by, "batch", "n", "mean", "least", "most"])

    kind = dict(stream.dtypes)[by]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if age_ms else GroupStateTimeout.NoTimeout
    rows = stream.select(by, value.cast("double").alias("value"))
    return rows.groupBy(by).applyInPandasWithState(feed, f"{by} {kind}, batch long, n long, mean double, least double, most double", "number long, pending array<double>", "append", timeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is into a table in memory (tests and small results)."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return stream.sparkSession.table(name)
