"""Streams with state: files are added between runs from one checkpoint, as after restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cubelume.streaming import stateful as S

SCHEMA = "user string, event_id long, ts timestamp, value double"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """feed(rows) adds a file of (user, id, seconds, value) and runs the stream to its end; all of its output so far, as tuples."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    S.with_state_store(spark)

    def run(make, rows):
        df = spark.createDataFrame([(u, i, T0 + timedelta(seconds=s), v) for u, i, s, v in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        make(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)

    yield run
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_batch_goes_on_after_a_restart_and_ages(feed):
    make = lambda s: S.aged_count_windows(s, "user", F.col("value"), 3, age_ms=60_000, min_variance=0.1)
    assert feed(make, [("a", 1, 0, 1.0), ("a", 2, 1, 2.0), ("b", 3, 1, 5.0)]) == []
    done = [("a", 0, 3, 2.0, 1.0, 3.0, False, True)]
    assert feed(make, [("a", 4, 2, 3.0), ("a", 5, 3, 7.0)]) == done  # the pending two were there
    aged = [("a", 1, 1, 7.0, 7.0, 7.0, True, False), ("b", 0, 1, 5.0, 5.0, 5.0, True, False)]
    got = feed(make, [("c", 6, 200, 1.0)])
    assert got == sorted(done + aged, key=str)
    assert feed(make, [("a", 7, 201, 1.0), ("a", 8, 202, 1.0), ("a", 9, 203, 1.0)])[2] == ("a", 2, 3, 1.0, 1.0, 1.0, False, False)


def test_late_rows_are_dropped(feed):
    make = lambda s: S.aged_count_windows(s, "user", F.col("value"), 2, late="10 seconds")
    feed(make, [("a", 1, 100, 1.0)])
    assert feed(make, [("b", 9, 101, 1.0)]) == []
    assert feed(make, [("a", 2, 50, 9.0)]) == []  # 51 seconds behind the newest
    assert feed(make, [("a", 3, 95, 3.0)]) == [("a", 0, 2, 2.0, 1.0, 3.0, False, True)]


def test_a_buffer_of_81(feed):
    make = lambda s: S.bounded_capture(s, "user", 81, reset_ms=1_000_000)
    got = feed(make, [("a", i, i, 0.0) for i in range(50)] + [("b", 500, 7, 0.0)])
    assert len(got) == 51
    got = feed(make, [("a", i, i, 0.0) for i in range(50, 120)])
    assert sorted((r[1], r[2]) for r in got if r[0] == "a") == [(i, i) for i in range(81)]
    assert len(feed(make, [("a", 130, 130, 0.0)])) == len(got)  # full
    feed(make, [("z", 900, 5_000, 0.0)])
    assert ("a", 6000, 0, 1) in feed(make, [("a", 6000, 6_000, 0.0)])
