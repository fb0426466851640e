"""Queries over the voxel view and its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import pack
from ..operators import cells as C
from ..operators import spatial as S
from ..operators import windows as W
from ..runtime import kept
from ..sources.cubes import CELLS, FILLED, GRADIENT, VOXEL, dense_cube, filled, voxels
from .registry import query


def cells(spark: SparkSession, d: str) -> DataFrame:
    return C.centroids(voxels(spark, d))


@query("q_centroid", f"WITH {CELLS} SELECT cell, t, y, x, r, g, b, w, n FROM cells")
def q_centroid(spark, d):
    return cells(spark, d)


@query("q_cell_stats", f"WITH {CELLS} SELECT count(*) AS cells, count(*) FILTER (w > 0) AS non_zero, CAST(sum(w) AS BIGINT) AS total, round(avg(w), 6) AS mean, min(w) FILTER (w > 0) AS least, max(w) AS most FROM cells")
def q_cell_stats(spark, d):
    return C.tensor_stats(cells(spark, d))


@query("q_frame_stats", f"WITH {VOXEL} SELECT f, count(*) AS n, round(avg((r + g + b) / 3.0::DOUBLE), 6) AS mean, round(stddev_pop((r + g + b) / 3.0::DOUBLE), 6) AS deviation, count(DISTINCT r * 65536 + g * 256 + b) AS colours FROM voxel GROUP BY f")
def q_frame_stats(spark, d):
    return C.frame_stats(voxels(spark, d))


@query("q_center_sample", f"WITH {VOXEL} SELECT * FROM voxel WHERE f % 9 = 4 AND y % 9 = 4 AND x % 9 = 4")
def q_center_sample(spark, d):
    return C.centre_sample(voxels(spark, d))


@query("q_systematic_sample", f"WITH {VOXEL} SELECT * FROM voxel WHERE (y * 81 + x) % 4 = 0")
def q_systematic_sample(spark, d):
    return voxels(spark, d).where((F.col("y") * 81 + F.col("x")) % 4 == 0)


for _axis, _rest in (("f", "y, x"), ("y", "f, x"), ("x", "f, y")):

    @query(f"q_slice_{ {'f': 'xy', 'y': 'xt', 'x': 'yt'}[_axis] }", f"WITH {VOXEL} SELECT {_rest}, r, g, b FROM voxel WHERE {_axis} = 40")
    def _q_slice(spark, d, axis=_axis):
        return S.plane(voxels(spark, d), axis, 40)


@query("q_pixel_conservation", f"WITH {CELLS} SELECT CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS voxels, CAST(sum(n) AS BIGINT) AS in_cells, (SELECT count(*) FROM lineitem) = sum(n) AS passed FROM cells")
def q_pixel_conservation(spark, d):
    total = voxels(spark, d).agg(F.count("*").alias("voxels"))
    return cells(spark, d).agg(F.sum("n").alias("in_cells")).crossJoin(total).select("voxels", "in_cells", (F.col("voxels") == F.col("in_cells")).alias("passed"))


@query("q_checks", f"""WITH {CELLS} SELECT 'index_formula' AS "check", count(*) FILTER (cell <> t * 81 + y * 9 + x) AS failures FROM cells
 UNION ALL SELECT 'channel_range', count(*) FILTER (least(r, g, b) < 0 OR greatest(r, g, b) > 255) FROM cells
 UNION ALL SELECT 'weight_positive', count(*) FILTER (w <= 0) FROM cells UNION ALL SELECT 'cells_missing', 729 - count(*) FROM cells
 UNION ALL SELECT 'weights_apart', CAST(max(w) >= 1000 * min(w) AS BIGINT) FROM cells""")
def q_checks(spark, d):
    c = cells(spark, d)
    rgb = [F.col(x) for x in "rgb"]
    one = c.agg(
        F.count_if(F.col("cell") != C.cell_key(F.col("t"), F.col("y"), F.col("x"))).alias("index_formula"),
        F.count_if((F.least(*rgb) < 0) | (F.greatest(*rgb) > 255)).alias("channel_range"),
        F.count_if(F.col("w") <= 0).alias("weight_positive"),
        (F.lit(729).cast("long") - F.count("*")).alias("cells_missing"),
        (F.max("w") >= 1000 * F.min("w")).cast("long").alias("weights_apart"),
    )
    return one.unpivot([], one.columns, "check", "failures")


MOVE = """, m AS (SELECT *, coalesce(sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) / 441.67::DOUBLE, 0) AS motion FROM (
 SELECT *, lag(r) OVER w AS pr, lag(g) OVER w AS pg, lag(b) OVER w AS pb FROM cells WINDOW w AS (PARTITION BY y, x ORDER BY t)))"""


@query("q_motion", f"WITH {CELLS}{MOVE} SELECT cell, round(motion, 9) AS motion, round(coalesce(motion - lag(motion) OVER (PARTITION BY y, x ORDER BY t), 0), 9) AS gradient FROM m")
def q_motion(spark, d):
    return C.motion(cells(spark, d)).select("cell", F.round("motion", 9).alias("motion"), F.round("gradient", 9).alias("gradient"))


EDGE = """, e AS (SELECT t, sqrt((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS d FROM (
 SELECT t, r, g, b, lead(r) OVER w AS pr, lead(g) OVER w AS pg, lead(b) OVER w AS pb FROM cells WINDOW w AS (PARTITION BY t, y ORDER BY x)
 UNION ALL SELECT t, r, g, b, lead(r) OVER w AS pr, lead(g) OVER w AS pg, lead(b) OVER w AS pb FROM cells WINDOW w AS (PARTITION BY t, x ORDER BY y)) WHERE pr IS NOT NULL)"""
VAR = "(var_pop(r) + var_pop(g) + var_pop(b)) / 195075.0::DOUBLE"
IMPORTANCE = (
    CELLS + MOVE + EDGE + f""", spatial AS (SELECT 't' AS axis, v.t AS slice, 0.6 * variance + 0.4 * edge AS raw FROM (SELECT t, {VAR} AS variance FROM cells GROUP BY t) v
 JOIN (SELECT t, avg(d) / 441.67::DOUBLE AS edge FROM e GROUP BY t) g ON v.t = g.t),
 temporal AS (SELECT 'x' AS axis, v.x AS slice, 0.7 * motion + 0.3 * variance AS raw FROM (SELECT x, avg(motion) AS motion FROM m WHERE t > 0 GROUP BY x) k
 JOIN (SELECT x, avg(v) AS variance FROM (SELECT x, y, {VAR} AS v FROM cells GROUP BY x, y) GROUP BY x) v ON k.x = v.x),
 importance AS (SELECT axis, CAST(slice AS INT) AS slice, round(raw, 9)::DOUBLE AS raw FROM (SELECT * FROM spatial UNION ALL SELECT * FROM temporal))"""
)


def importance(spark, d) -> DataFrame:
    c = cells(spark, d)
    return C.spatial_importance(c).unionByName(C.temporal_importance(c)).withColumn("raw", F.round("raw", 9))


@query("q_edge_density", f"WITH {CELLS}{EDGE} SELECT t, round(avg(d) / 441.67::DOUBLE, 9) AS edge FROM e GROUP BY t")
def q_edge_density(spark, d):
    return C.edge_density(cells(spark, d)).withColumn("edge", F.round("edge", 9))


@query("q_importance", f"""WITH {IMPORTANCE}, s AS (SELECT *, exp((raw - max(raw) OVER (PARTITION BY axis)) / 0.5::DOUBLE) AS e FROM importance)
 SELECT axis, slice, round(raw, 6) AS raw, round(e / sum(e) OVER (PARTITION BY axis), 6) AS softmax, CAST(row_number() OVER (PARTITION BY axis ORDER BY raw DESC, slice) AS INT) AS rank FROM s""")
def q_importance(spark, d):
    out = W.ranked(W.softmax(importance(spark, d), "raw", "axis", temperature=0.5), "raw", "axis", key="slice")
    return out.select("axis", "slice", F.round("raw", 6).alias("raw"), F.round("softmax", 6).alias("softmax"), "rank")


@query("q_anchor_budget", f"WITH {IMPORTANCE} SELECT axis, slice, CAST(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY slice IN (0, 4, 8) DESC, raw DESC, slice) AS pick FROM importance) WHERE pick <= 6")
def q_anchor_budget(spark, d):
    return W.anchored(importance(spark, d), "raw", "slice", "axis", budget=W.split_budget(12)[0]).select("axis", "slice", "pick")


@query("q_interpolate", f"""WITH {CELLS}, k AS (SELECT t, y, x, CASE WHEN t IN (0, 4, 6) THEN r END::DOUBLE AS v, CASE WHEN t IN (0, 4, 6) THEN t END AS o FROM cells),
 s AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER z AS v1, last_value(o IGNORE NULLS) OVER a AS o0, first_value(o IGNORE NULLS) OVER z AS o1 FROM k
 WINDOW a AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT t, y, x, round(coalesce(v, v0 + (v1 - v0) * ((t - o0)::DOUBLE / (o1 - o0)), v0, v1), 6) AS filled FROM s""")
def q_interpolate(spark, d):
    k = cells(spark, d).withColumn("v", F.when(F.col("t").isin(0, 4, 6), F.col("r").cast("double")))
    return W.interpolated(k, "v", "t", "y", "x").select("t", "y", "x", F.round("filled", 6).alias("filled"))


@query("q_neighbour_coherence", f"""WITH {CELLS}, n AS (SELECT a.cell, a.t, a.y, a.x, a.r, a.g, a.b, count(*) AS k, sum(c.r) AS sr, sum(c.g) AS sg, sum(c.b) AS sb FROM cells a
 JOIN cells c ON abs(a.t - c.t) + abs(a.y - c.y) + abs(a.x - c.x) = 1 GROUP BY ALL)
 SELECT cell, t, y, x, CAST(k AS INT) AS neighbours, round(sqrt((r - sr::DOUBLE / k) * (r - sr::DOUBLE / k) + (g - sg::DOUBLE / k) * (g - sg::DOUBLE / k) + (b - sb::DOUBLE / k) * (b - sb::DOUBLE / k)), 6) AS gap FROM n""")
def q_neighbour_coherence(spark, d):
    return C.neighbour_mean(cells(spark, d))


@query("q_region_stats", f"""WITH {CELLS} SELECT y, x, round(avg((r + g + b) / 765.0::DOUBLE), 6) AS mean, round(least(1.0, var_pop((r + g + b) / 765.0::DOUBLE) * 4), 6) AS variance,
 CASE WHEN sum(r) >= sum(g) AND sum(r) >= sum(b) THEN 'r' WHEN sum(g) >= sum(b) THEN 'g' ELSE 'b' END AS dominant FROM cells GROUP BY y, x""")
def q_region_stats(spark, d):
    return C.region_stats(cells(spark, d), "y", "x")


@query("q_tile_motion", f"WITH {CELLS}{MOVE} SELECT y, x, round(avg(motion) FILTER (t > 0), 6) AS motion, round({VAR}, 6) AS variance FROM m GROUP BY y, x")
def q_tile_motion(spark, d):
    m = C.motion(cells(spark, d))
    return m.groupBy("y", "x").agg(F.round(F.avg(F.when(F.col("t") > 0, F.col("motion"))), 6).alias("motion"), F.round(C.colour_variance(), 6).alias("variance"))


@query("q_stability", f"WITH {CELLS}{MOVE} SELECT cell, round(1 - CASE WHEN max(motion) OVER (PARTITION BY t) > 0 THEN motion / max(motion) OVER (PARTITION BY t) ELSE 0 END, 6) AS stability FROM m")
def q_stability(spark, d):
    from pyspark.sql import Window

    top = F.max("motion").over(Window.partitionBy("t"))
    return C.motion(cells(spark, d)).select("cell", F.round(1 - F.when(top > 0, F.col("motion") / top).otherwise(0.0), 6).alias("stability"))


@query("q_motion_rank", f"WITH {CELLS}{MOVE} SELECT cell, round(motion, 6) AS motion FROM (SELECT *, round(motion, 9) AS k FROM m) ORDER BY k DESC, cell LIMIT 20")
def q_motion_rank(spark, d):
    return C.motion(cells(spark, d)).withColumn("k", F.round("motion", 9)).orderBy(F.desc("k"), "cell").limit(20).select("cell", F.round("motion", 6).alias("motion"))


@query("q_lineage", f"WITH {VOXEL} SELECT f, CAST(f // 9 AS INT) AS layer, CAST(f % 9 AS INT) AS \"offset\", CAST(f // 9 * 81 + i AS INT) AS cell FROM (SELECT DISTINCT f FROM voxel), range(81) b(i)")
def q_lineage(spark, d):
    return C.lineage(voxels(spark, d).select("f").distinct())


@query("q_presence_entropy", f"""WITH {VOXEL}, k AS (SELECT r // 32 * 64 + g // 32 * 8 + b // 32 AS colour, f // 9 * 81 + y // 9 * 9 + x // 9 AS cell, count(*) AS n FROM voxel GROUP BY ALL),
 p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY colour) AS p FROM k)
 SELECT CAST(colour AS INT) AS colour, round(-sum(p * log2(p)), 8) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 8) AS normalised, -sum(p * log2(p)) < 6.0 AS localised FROM p GROUP BY colour""")
def q_presence_entropy(spark, d):
    v = voxels(spark, d)
    colour = (F.floor(F.col("r") / 32) * 64 + F.floor(F.col("g") / 32) * 8 + F.floor(F.col("b") / 32)).cast("int")
    counts = v.groupBy(colour.alias("colour"), C.cell_key(C.at("f"), C.at("y"), C.at("x")).alias("cell")).agg(F.count("*").alias("n"))
    return W.entropy(counts, "n", "colour").withColumn("localised", F.col("entropy") < 6.0)


@query("q_rollup_marginals", f"WITH {VOXEL} SELECT CAST(f // 9 AS INT) AS t, CAST(y // 9 AS INT) AS y9, CAST(x // 9 AS INT) AS x9, count(*) AS n, CAST(sum(r) AS BIGINT) AS r FROM voxel GROUP BY ROLLUP (f // 9, y // 9, x // 9)")
def q_rollup_marginals(spark, d):
    v = voxels(spark, d)
    return v.rollup(C.at("f").alias("t"), C.at("y").alias("y9"), C.at("x").alias("x9")).agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@query("q_digest_hist", f"WITH {VOXEL} SELECT CAST(f // 9 AS INT) AS t, CAST(least(8, floor((r * 299 + g * 587 + b * 114) * 9 / 255000.0::DOUBLE)) AS INT) AS bin, count(*) AS n FROM voxel GROUP BY ALL")
def q_digest_hist(spark, d):
    light = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) * 9 / 255000.0
    return voxels(spark, d).groupBy(C.at("f").alias("t"), F.least(F.lit(8), F.floor(light)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("q_weight_entropy", f"WITH {CELLS}, p AS (SELECT w, w::DOUBLE / sum(w) OVER () AS p FROM cells) SELECT round(avg(w), 4) AS mean, CAST(list_sort(list(w))[CAST(floor(count(*) / 2) AS INT) + 1] AS BIGINT) AS upper_median, min(w) AS least, max(w) AS most, round(stddev_pop(w), 4) AS deviation, round(-sum(p * log2(p)), 8) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 8) AS balance FROM p")
def q_weight_entropy(spark, d):
    s = W.shares(cells(spark, d), "w")
    ordered = F.sort_array(F.collect_list("w"))  # 729 numbers at most
    h = -F.sum(F.col("share") * F.log2("share"))
    return s.agg(F.round(F.avg("w"), 4).alias("mean"), F.element_at(ordered, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("upper_median"), F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.stddev_pop("w"), 4).alias("deviation"), F.round(h, 8).alias("entropy"), F.round(h / F.log2(F.count("*")), 8).alias("balance"))


@query("q_thresholds", f"WITH {CELLS} SELECT t, round(avg(r), 6) AS mean, CAST(list_sort(list(r))[CAST(floor(count(*) / 2) AS INT) + 1] AS INT) AS median, CAST(list_sort(list(r))[CAST(floor(count(*) * 0.75) AS INT) + 1] AS INT) AS percentile, round(avg(r) + 1.5 * stddev_pop(r), 6) AS mean_plus FROM cells GROUP BY t")
def q_thresholds(spark, d):
    ordered = F.sort_array(F.collect_list("r"))  # 81 numbers a slice
    n = F.count("*")
    return cells(spark, d).groupBy("t").agg(F.round(F.avg("r"), 6).alias("mean"), F.element_at(ordered, (F.floor(n / 2) + 1).cast("int")).alias("median"), F.element_at(ordered, (F.floor(n * 0.75) + 1).cast("int")).alias("percentile"), F.round(F.avg("r") + 1.5 * F.stddev_pop("r"), 6).alias("mean_plus"))


@query("q_merge_weights", f"""WITH {IMPORTANCE}, q AS (SELECT slice AS t, raw AS q FROM importance WHERE axis = 't'), k AS (SELECT slice AS x, raw AS k FROM importance WHERE axis = 'x'), mw AS (SELECT * FROM q, k)
 SELECT t, x, 'geometric' AS strategy, round(sqrt(q * k), 6) AS weight FROM mw UNION ALL SELECT t, x, 'multiply', round(q * k, 6) FROM mw UNION ALL SELECT t, x, 'average', round((q + k) / 2, 6) FROM mw
 UNION ALL SELECT t, x, 'max', round(greatest(q, k), 6) FROM mw UNION ALL SELECT t, x, 'min', round(least(q, k), 6) FROM mw""")
def q_merge_weights(spark, d):
    from ..functions.scoring import STRATEGIES, merged

    i = importance(spark, d)
    q, k = (i.where(F.col("axis") == a).select(F.col("slice").alias(a), F.col("raw").alias(n)) for a, n in (("t", "q"), ("x", "k")))
    both = q.crossJoin(F.broadcast(k))  # 9 by 9
    wide = both.select("t", "x", *[F.round(merged(s, F.col("q"), F.col("k")), 6).alias(s) for s in STRATEGIES])
    return wide.unpivot(["t", "x"], list(STRATEGIES), "strategy", "weight")


@query("q_attention_balance", f"""WITH {CELLS}{MOVE}, s AS (SELECT t, y, x, (r + g + b + 1) / 766.0::DOUBLE AS q FROM cells), k AS (SELECT x AS kx, t * 9 + y AS at, motion + 0.01::DOUBLE AS k FROM m),
 p AS (SELECT t, y, x, pow(q, 0.3 + t * 0.05::DOUBLE) * pow(k, 1 - (0.3 + t * 0.05::DOUBLE)) * (q * k / sqrt(0.8::DOUBLE)) AS v FROM s JOIN k ON s.x = k.kx AND s.t * 9 + s.y = k.at)
 SELECT t, y, x, round(v / sum(v) OVER (), 9) AS weight FROM p""")
def q_attention_balance(spark, d):
    from ..functions.scoring import power_blend

    m = C.motion(cells(spark, d))
    spatial = m.select("t", "y", "x", ((F.col("r") + F.col("g") + F.col("b") + 1) / 766.0).alias("q"))
    temporal = m.select(F.col("x").alias("kx"), (F.col("t") * 9 + F.col("y")).alias("at"), (F.col("motion") + 0.01).alias("k"))
    joined = spatial.join(temporal, (F.col("x") == F.col("kx")) & (F.col("t") * 9 + F.col("y") == F.col("at")))
    v = joined.select("t", "y", "x", power_blend(F.col("q"), F.col("k"), 0.3 + F.col("t") * 0.05, 0.8).alias("v"))
    return W.shares(v, "v").select("t", "y", "x", F.round("share", 9).alias("weight"))


@query("q_overrides", f"WITH {CELLS} SELECT cell, CASE WHEN cell % 100 = 7 THEN 1 ELSE r END AS r, cell % 100 = 7 AS locked FROM cells")
def q_overrides(spark, d):
    own = spark.range(729).where(F.col("id") % 100 == 7).select(F.col("id").cast("int").alias("cell"), F.lit(1).alias("own"))
    return cells(spark, d).join(F.broadcast(own), "cell", "left").select("cell", F.coalesce("own", "r").alias("r"), F.col("own").isNotNull().alias("locked"))


@query("q_crop_resize", "WITH src AS (SELECT CAST(i // 12000 AS INT) AS f, CAST(i // 120 % 100 AS INT) AS y, CAST(i % 120 AS INT) AS x FROM range(24000) t(i)), px AS (SELECT f, y, x, CAST((x * 7 + f) % 256 AS INT) AS r, CAST(y * 5 % 256 AS INT) AS g, CAST((x + y) % 256 AS INT) AS b FROM src), o AS (SELECT CAST(i // 81 AS INT) AS oy, CAST(i % 81 AS INT) AS ox FROM range(6561) t(i)) SELECT f, oy AS y, ox AS x, r, g, b FROM o JOIN px ON px.y = least(99, (oy * 2 + 1) * 100 // 162) AND px.x = least(109, 10 + (ox * 2 + 1) * 100 // 162)")
def q_crop_resize(spark, d):
    i = F.col("id")
    px = spark.range(24_000).select(F.floor(i / 12_000).cast("int").alias("f"), (F.floor(i / 120) % 100).cast("int").alias("y"), (i % 120).cast("int").alias("x"))
    px = px.withColumns({"r": (F.col("x") * 7 + F.col("f")) % 256, "g": F.col("y") * 5 % 256, "b": (F.col("x") + F.col("y")) % 256})
    return S.crop_resize(px, 120, 100)


@query("q_box_downsample", f"WITH {FILLED} SELECT f, CAST(y * 27 // 81 AS INT) AS y, CAST(x * 27 // 81 AS INT) AS x, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM cube GROUP BY f, y * 27 // 81, x * 27 // 81")
def q_box_downsample(spark, d):
    return S.box(filled(spark, d), 81, 27)


@query("q_multi_resolution", f"""WITH {FILLED}, s AS (SELECT 'small' AS size, 40 AS n UNION ALL SELECT 'medium', 64 UNION ALL SELECT 'tiny', 20)
 SELECT size, f, CAST(y * n // 81 AS INT) AS y, CAST(x * n // 81 AS INT) AS x, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM cube, s GROUP BY size, f, y * n // 81, x * n // 81""")
def q_multi_resolution(spark, d):
    cube = filled(spark, d)
    out = [S.box(cube, 81, n).withColumn("size", F.lit(name)) for name, n in (("small", 40), ("medium", 64), ("tiny", 20))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("q_bilinear")
def q_bilinear(spark, d):
    return S.bilinear(filled(spark, d), 81, 40)


@query("q_lanczos3")
def q_lanczos3(spark, d):
    return S.lanczos3(filled(spark, d), 81, 40)


@query("q_synthetic_gradient", f"WITH {GRADIENT} SELECT f, count(*) AS n, count(DISTINCT r * 65536 + g * 256 + b) AS colours, CAST(sum(r + g + b) AS BIGINT) AS light FROM cube GROUP BY f")
def q_synthetic_gradient(spark, d):
    c = dense_cube(spark, "gradient")
    return c.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct(pack(F.col("r"), F.col("g"), F.col("b"), None)).alias("colours"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("light"))


@query("q_ssim", f"""WITH {FILLED}, p AS (SELECT f, y, x, (r * 299 + g * 587 + b * 114) / 1000.0::DOUBLE AS u, (r // 16 * 16 * 299 + g // 16 * 16 * 587 + b // 16 * 16 * 114) / 1000.0::DOUBLE AS v FROM cube),
 w AS (SELECT CAST(i // 19 AS INT) AS wy, CAST(i % 19 AS INT) AS wx FROM range(361) t(i)),
 s AS (SELECT f, wy, wx, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS vu, var_pop(v) AS vv, covar_pop(u, v) AS c FROM p JOIN w ON y BETWEEN wy * 4 AND wy * 4 + 7 AND x BETWEEN wx * 4 AND wx * 4 + 7 GROUP BY ALL)
 SELECT f, round(avg((2 * mu * mv + 6.5025::DOUBLE) * (2 * c + 58.5225::DOUBLE) / ((mu * mu + mv * mv + 6.5025::DOUBLE) * (vu + vv + 58.5225::DOUBLE))), 6) AS ssim, count(*) AS windows FROM s GROUP BY f""")
def q_ssim(spark, d):
    a = kept(filled(spark, d), "cube")
    b = a.select("f", "y", "x", *[(F.floor(F.col(c) / 16) * 16).cast("int").alias(c) for c in "rgb"])
    return S.ssim(a, b)


STONES = """, s AS (SELECT t, y, x, CASE WHEN (r + g + b) / 765.0::DOUBLE >= 0.51 THEN 'black' WHEN (r + g + b) / 765.0::DOUBLE <= 0.49 THEN 'white' ELSE 'empty' END AS stone FROM cells),
 c AS (SELECT t, y, x, stone, CAST(y * 9 + x AS INT) AS id FROM s),
 reach(t, id, other) AS (SELECT t, id, id FROM c UNION SELECT k.t, k.id, b.id FROM reach k JOIN c a ON a.t = k.t AND a.id = k.other JOIN c b ON b.t = a.t AND b.stone = a.stone AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
 grp AS (SELECT c.t, c.y, c.x, c.stone, CAST(m.grp AS INT) AS grp FROM c JOIN (SELECT t, id, min(other) AS grp FROM reach GROUP BY t, id) m ON c.t = m.t AND c.id = m.id)"""


def stones(spark, d) -> DataFrame:
    from ..functions.color import brightness
    from ..functions.scoring import stone

    light = brightness(F.col("r"), F.col("g"), F.col("b"))
    return cells(spark, d).select("t", "y", "x", stone(light, 0.51, 0.49).alias("stone"))


@query("q_components", f"WITH RECURSIVE {CELLS}{STONES} SELECT t, y, x, stone, grp FROM grp")
def q_components(spark, d):
    return S.components(stones(spark, d), "stone").select("t", "y", "x", "stone", F.col("group").alias("grp"))


@query("q_liberties", f"""WITH RECURSIVE {CELLS}{STONES} SELECT a.t, a.grp, count(DISTINCT b.y * 9 + b.x) AS liberties FROM grp a LEFT JOIN grp b ON a.t = b.t AND b.stone = 'empty' AND abs(a.y - b.y) + abs(a.x - b.x) = 1
 WHERE a.stone <> 'empty' GROUP BY a.t, a.grp""")
def q_liberties(spark, d):
    return S.liberties(S.components(stones(spark, d), "stone"), "stone").withColumnRenamed("group", "grp")


@query("q_cube_stats", f"WITH RECURSIVE {CELLS}{STONES} SELECT t, count(*) FILTER (stone = 'black') AS black, count(*) FILTER (stone = 'white') AS white, count(*) FILTER (stone = 'empty') AS empty, count(DISTINCT grp) AS groups FROM grp GROUP BY t")
def q_cube_stats(spark, d):
    g = S.components(stones(spark, d), "stone")
    return g.groupBy("t").agg(*[F.count_if(F.col("stone") == s).alias(s) for s in ("black", "white", "empty")], F.count_distinct("group").alias("groups"))


@query("q_seeding", f"""WITH {CELLS}{MOVE}, v AS (SELECT t, y, x, round(motion * (0.5 + 0.5 * (r + g + b) / 765.0::DOUBLE), 9)::DOUBLE AS v FROM m),
 n AS (SELECT *, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE v END AS u FROM v WINDOW w AS (PARTITION BY t)),
 s AS (SELECT *, CASE WHEN u >= 0.65 THEN 'black' WHEN u <= 0.35 THEN 'white' ELSE 'empty' END AS stone FROM n),
 k AS (SELECT *, row_number() OVER (PARTITION BY t, stone ORDER BY CASE WHEN stone = 'black' THEN -v ELSE v END, y * 9 + x) AS rank FROM s WHERE stone <> 'empty')
 SELECT t, y, x, stone, CAST(row_number() OVER (PARTITION BY t ORDER BY rank, stone) AS INT) AS move FROM k""")
def q_seeding(spark, d):
    from pyspark.sql import Window

    from ..functions.color import brightness
    from ..functions.scoring import stone

    m = C.motion(cells(spark, d)).withColumn("v", F.round(F.col("motion") * (0.5 + 0.5 * brightness(F.col("r"), F.col("g"), F.col("b"))), 9))
    s = W.min_max(m, "v", "t", out="u").withColumn("stone", stone(F.col("u"), 0.65, 0.35)).where("stone <> 'empty'")
    place = F.col("y") * 9 + F.col("x")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("t", "stone").orderBy(F.when(F.col("stone") == "black", -F.col("v")).otherwise(F.col("v")), place)))
    return s.select("t", "y", "x", "stone", F.row_number().over(Window.partitionBy("t").orderBy("rank", "stone")).alias("move"))
