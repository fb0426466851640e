"""Queries of summaries: galleries, captures, commonest indices, statistics of frames, look-ups in a cube."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import nearest as N
from ..operators import palettes as P
from ..sources import files as S
from ..sources.cubes import CELLS, VOXEL, from_rows, load, voxels
from .cube_queries import cells
from .palette_queries import LUT, palette
from .registry import query

_PLACES = {"date_newest": "created DESC", "date_oldest": "created", "size_smallest": "bytes", "size_largest": "bytes DESC", "frame_count": "frames DESC"}


@query("q_gallery_orders", f"""WITH n AS (SELECT l_orderkey AS id, count(*) AS frames FROM lineitem GROUP BY l_orderkey), i AS (SELECT id, o_orderdate AS created, o_totalprice AS bytes, frames FROM n JOIN orders ON o_orderkey = id WHERE frames * 40 >= 128),
 p AS (SELECT id, {", ".join(f"row_number() OVER (ORDER BY {o}, id) AS {c}" for c, o in _PLACES.items())} FROM i) SELECT id, {", ".join(f"CAST({c} AS INT) AS {c}" for c in _PLACES)} FROM p WHERE least({", ".join(_PLACES)}) <= 20""")
def q_gallery_orders(spark, d):
    """Orders as items of 40 columns a line: the large ones and their places in the five orders, of the first 20 of each."""
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("frames"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("bytes"))
    return S.places(S.gallery(n.join(o, "id").withColumn("width", F.col("frames") * 40), "large"), "id", S.gallery_orders(), 20)


@query("q_gallery_small", "WITH n AS (SELECT l_orderkey AS id, count(*) AS frames FROM lineitem GROUP BY l_orderkey) SELECT id, frames, o_totalprice AS bytes FROM n JOIN orders ON o_orderkey = id WHERE frames * 40 <= 80")
def q_gallery_small(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("frames"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("bytes"))
    return S.gallery(n.join(o, "id").withColumn("width", F.col("frames") * 40), "small", "size_smallest").select("id", "frames", "bytes")


@query("q_capture_statistics", """WITH s AS (SELECT user_id, count(*) AS frames, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds FROM events GROUP BY user_id)
 SELECT user_id, frames, 81 AS target, frames >= 81 AS complete, round(seconds, 6) AS seconds, round(CASE WHEN seconds > 0 THEN frames / seconds ELSE 0 END, 9) AS fps FROM s""")
def q_capture_statistics(spark, d):
    s = S.capture_statistics(load(spark, d, "events"), "user_id", "ts", 81)
    return s.withColumns({"seconds": F.round("seconds", 6), "fps": F.round("fps", 9)})


@query("q_common_indices", f"""WITH {LUT}, k AS (SELECT idx, count(*) AS n FROM voxel v JOIN lut ON v.r // 16 = kr AND v.g // 16 = kg AND v.b // 16 = kb GROUP BY idx), t AS (SELECT * FROM k ORDER BY n DESC, idx LIMIT 5)
 SELECT (SELECT string_agg('[' || idx || ']=' || n, ', ' ORDER BY n DESC, idx) FROM t) AS common, (SELECT count(*) FROM pal WHERE greatest(r, g, b) > 5) AS not_black""")
def q_common_indices(spark, d):
    p = palette(spark, d)
    return P.most_common(N.by_lookup(voxels(spark, d), p), 5).crossJoin(P.not_black(p))  # a row each


_SHOWN = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, round(sum({c})::DOUBLE / count(*), 6) AS mean_{c}, round(sqrt((count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::DOUBLE) / count(*), 6) AS deviation_{c}" for c in "rgb")


@query("q_rgb_summary", f"WITH {VOXEL} SELECT f, count(*) AS n, count(DISTINCT r * 65536 + g * 256 + b) AS colours, {_SHOWN} FROM voxel GROUP BY f")
def q_rgb_summary(spark, d):
    return C.rgb_summary(voxels(spark, d), "f")


@query("q_cell_weights", f"WITH {CELLS} SELECT v.f, CAST(sum(c.w) AS BIGINT) AS w, max(c.w) AS most FROM voxel v JOIN cells c ON c.cell = v.f // 9 * 81 + v.y // 9 * 9 + v.x // 9 GROUP BY v.f")
def q_cell_weights(spark, d):
    return C.with_cell_weight(voxels(spark, d), cells(spark, d)).groupBy("f").agg(F.sum("cell_weight").alias("w"), F.max("cell_weight").alias("most"))


@query("q_lookup", f"WITH {CELLS}, k AS (SELECT event_id AS id, CAST(event_id % 11 AS INT) - 1 AS t, CAST(event_id // 11 % 11 AS INT) - 1 AS y, CAST(user_id % 11 AS INT) - 1 AS x FROM events) SELECT id, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(w, 0) AS w FROM k LEFT JOIN cells USING (t, y, x)")
def q_lookup(spark, d):
    """A place of the cube for each event, some beyond its edges."""
    key = [F.col("event_id") % 11, F.expr("event_id div 11") % 11, F.col("user_id") % 11]
    k = load(spark, d, "events").select(F.col("event_id").alias("id"), *[(v - 1).cast("int").alias(c) for v, c in zip(key, "tyx", strict=True)])
    return C.looked_up(k, cells(spark, d)).select("id", "r", "g", "b", "w")


@query("q_whole_capture", f"WITH {VOXEL} SELECT count(DISTINCT f) AS found, 81 - count(DISTINCT f) AS missing, CAST(0 AS BIGINT) AS beyond, count(DISTINCT f) = 81 AS exact FROM voxel")
def q_whole_capture(spark, d):
    return C.whole_capture(voxels(spark, d))


@query("q_stride_frames", """WITH h AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
 p AS (SELECT doc_id, list_transform(range(64), lambda i: CASE WHEN (i // 8 * 36 + i % 8 * 4 + 3) * 2 <= len(h) THEN substr(h, (i // 8 * 36 + i % 8 * 4 + 2) * 2 + 1, 2) || substr(h, (i // 8 * 36 + i % 8 * 4 + 1) * 2 + 1, 2) || substr(h, (i // 8 * 36 + i % 8 * 4) * 2 + 1, 2) ELSE '000000' END) AS p FROM h)
 SELECT doc_id, sha256(unhex(array_to_string(p, ''))) AS sha, len(list_filter(p, lambda x: x = '000000')) AS black FROM p""")
def q_stride_frames(spark, d):
    """The bytes of each text as 8 x 8 pixels in rows of 36 bytes."""
    rgb = from_rows(F.col("text").cast("binary"), 8, 8, 36)
    digits = F.hex("rgb")
    black = F.size(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(digits, i * 6 + 1, F.lit(6)) == "000000")).cast("long")
    return load(spark, d, "documents").select("doc_id", rgb.alias("rgb")).select("doc_id", F.sha2("rgb", 256).alias("sha"), black.alias("black"))
