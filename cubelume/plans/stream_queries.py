"""Queries over event time: batch twins of what streaming/ does on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.cubes import load
from ..streaming import streams as T
from .registry import query


def _us(c: str):
    return F.unix_micros(c).alias(f"{c}_us")


@query("q_tumble", "SELECT CAST(epoch_us(ts) // 2700000000 * 2700000000 AS BIGINT) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_tumble(spark, d):
    return T.tumbling(load(spark, d, "events"), "45 minutes").select(_us("start"), "n", F.round("total", 4).alias("total"))


@query("q_slide", "SELECT CAST(epoch_us(ts) // 1800000000 * 1800000000 - k * 1800000000 AS BIGINT) AS start_us, count(*) AS n FROM events, range(2) t(k) GROUP BY 1")
def q_slide(spark, d):
    return T.sliding(load(spark, d, "events"), "1 hour", "30 minutes").select(_us("start"), "n")


@query("q_session", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) + 7200000000 AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def q_session(spark, d):
    return T.sessions(load(spark, d, "events"), "2 hours", "user_id").select("user_id", _us("start"), _us("end"), "n")


@query("q_capture_window", "SELECT user_id, event_id AS id, CAST(k - 1 AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 81")
def q_capture_window(spark, d):
    return T.captured(load(spark, d, "events"), 81, "user_id").select("user_id", F.col("event_id").alias("id"), "slot")


@query("q_frame_groups", "SELECT user_id, CAST((k - 1) // 9 AS INT) AS grp, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 81 GROUP BY 1, 2")
def q_frame_groups(spark, d):
    c = T.captured(load(spark, d, "events"), 81, "user_id")
    return c.groupBy("user_id", F.floor(F.col("slot") / 9).cast("int").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
