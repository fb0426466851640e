"""Queries over digests of cells, colour spaces, palettes by place and time, resamplers and measures of importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import digests as D
from ..operators import grouped as G
from ..operators import nearest as N
from ..operators import spatial as S
from ..runtime import kept
from ..sources.cubes import CELLS, FILLED, VOXEL, filled, voxels
from .cube_queries import MOVE, cells
from .registry import query

DIGEST = FILLED + """, px AS (SELECT *, CAST(f // 9 * 81 + y // 9 * 9 + x // 9 AS INT) AS cell, f % 9 AS o, r * 299 + g * 587 + b * 114 AS luma, greatest(r, g, b) AS top, least(r, g, b) AS low FROM cube),
 pm AS (SELECT *, top - low AS d, CASE WHEN top + low <= 255 THEN top + low ELSE 510 - top - low END AS whole, CASE WHEN o > 0 THEN abs(luma - lag(luma) OVER (PARTITION BY y, x ORDER BY f)) ELSE 0 END AS moved FROM px),
 pb AS (SELECT cell, o, luma, moved, least(8, luma * 9 // 255000) AS lb, CASE WHEN d > 0 THEN least(8, d * 9 // whole) ELSE 0 END AS sb, CASE WHEN d * 10 > whole THEN least(8, CASE WHEN top = r AND g >= b THEN (g - b) * 9
 WHEN top = r THEN (g - b) * 9 + d * 54 WHEN top = g THEN (b - r) * 9 + d * 18 ELSE (r - g) * 9 + d * 36 END // (d * 6)) END AS hb FROM pm),
 ph AS (SELECT cell, 'luminance' AS feature, lb AS k FROM pb UNION ALL SELECT cell, 'saturation', sb FROM pb UNION ALL SELECT cell, 'hue', hb FROM pb WHERE hb IS NOT NULL),
 hc AS (SELECT cell, feature, k, count(*) AS n FROM ph GROUP BY cell, feature, k), ht AS (SELECT cell, feature, sum(n) AS n FROM hc GROUP BY cell, feature),
 hg AS (SELECT c.cell, e.feature, CAST(i AS INT) AS k, coalesce(hc.n::DOUBLE / ht.n::DOUBLE, 0) AS value FROM range(729) c(cell), range(9) t(i), (VALUES ('luminance'), ('hue'), ('saturation')) e(feature)
 LEFT JOIN hc ON hc.cell = c.cell AND hc.feature = e.feature AND hc.k = i LEFT JOIN ht ON ht.cell = c.cell AND ht.feature = e.feature),
 fr AS (SELECT cell, CAST(o AS INT) AS k, sum(moved)::DOUBLE / 255000.0::DOUBLE / count(*) AS change, (max(luma) - min(luma)) / 255000.0::DOUBLE AS contrast FROM pb GROUP BY cell, o)"""


def table_digests(spark, d):
    return D.digests(filled(spark, d))


@query("q_cell_digest", f"""WITH {DIGEST} SELECT CAST(cell AS INT) AS cell, feature, k, round(value, 6) AS value FROM hg UNION ALL SELECT cell, 'change', k, round(change, 6) FROM fr UNION ALL SELECT cell, 'contrast', k, round(contrast, 6) FROM fr
 UNION ALL SELECT cell, 'stability', k, round(1 - change / greatest(max(change) OVER (PARTITION BY cell), 0.001::DOUBLE), 6) FROM fr""")
def q_cell_digest(spark, d):
    return D.digest_values(table_digests(spark, d))


@query("q_top_cells", f"""WITH {DIGEST}, v AS (SELECT 'activity' AS measure, cell, round(sum(change) / 9, 9) AS value FROM fr GROUP BY cell UNION ALL SELECT 'contrast', cell, round(sum(contrast) / 9, 9) FROM fr GROUP BY cell
 UNION ALL SELECT 'luminance', CAST(cell AS INT), round(sum(value * k / 8.0::DOUBLE), 9) FROM hg WHERE feature = 'luminance' GROUP BY cell), o AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, cell) AS rank FROM v)
 SELECT measure, cell, round(value, 6) AS value, CAST(rank AS INT) AS rank FROM o WHERE rank <= 10""")
def q_top_cells(spark, d):
    return D.top_cells(table_digests(spark, d))


@query("q_sample_cells", f"WITH {CELLS} SELECT cell, r, g, b, n FROM cells WHERE (t IN (0, 8) AND y IN (0, 8) AND x IN (0, 8)) OR (t = 4 AND y = 4 AND x = 4)")
def q_sample_cells(spark, d):
    return D.sample_cells(cells(spark, d)).select("cell", "r", "g", "b", "n")


SPACE = VOXEL + """, k AS (SELECT r * 65536 + g * 256 + b AS argb, y // 9 * 9 + x // 9 AS tile, f // 9 AS t FROM voxel), kt AS (SELECT argb, tile, count(*)::DOUBLE AS n FROM k GROUP BY argb, tile), kl AS (SELECT argb, t, count(*)::DOUBLE AS n FROM k GROUP BY argb, t),
 es AS (SELECT argb, round(-sum(n / total * log2(n / total)), 8) + 0.0 AS h, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(n) OVER (PARTITION BY argb) AS total FROM kt) GROUP BY argb),
 et AS (SELECT argb, round(-sum(n / total * log2(n / total)), 8) + 0.0 AS h FROM (SELECT *, sum(n) OVER (PARTITION BY argb) AS total FROM kl) GROUP BY argb),
 space AS (SELECT CAST(argb AS BIGINT) AS argb, n, es.h AS spatial, et.h AS temporal, es.h < 2.0 AS localised, et.h < 1.5 AS transient FROM es JOIN et USING (argb))"""


@query("q_colour_space", f"WITH {SPACE} SELECT * FROM space")
def q_colour_space(spark, d):
    return D.colour_space(voxels(spark, d))


DUAL = """, sp AS (SELECT r * 65536 + g * 256 + b AS argb, sum(1 + (y // 9 * 9 + x // 9) % 7) AS score FROM voxel GROUP BY 1 ORDER BY score DESC, argb LIMIT 256), tp AS (SELECT r * 65536 + g * 256 + b AS argb, sum(1 + f % 5) AS score FROM voxel GROUP BY 1 ORDER BY score DESC, argb LIMIT 256)"""


def dual(v):
    return D.dual_palettes(v, 1 + (C.at("y") * 9 + C.at("x")) % 7, 1 + F.col("f") % 5)


@query("q_dual_palettes", f"WITH {VOXEL}{DUAL} SELECT 'spatial' AS palette, CAST(argb AS BIGINT) AS argb, CAST(score AS BIGINT) AS score FROM sp UNION ALL SELECT 'temporal', CAST(argb AS BIGINT), CAST(score AS BIGINT) FROM tp")
def q_dual_palettes(spark, d):
    one, two = (p.withColumn("palette", F.lit(n)) for n, p in zip(("spatial", "temporal"), dual(voxels(spark, d)), strict=True))
    return one.unionByName(two)


@query("q_colour_report", f"""WITH {SPACE}{DUAL} SELECT count(*) AS colours, round(count(*) / 59049.0::DOUBLE, 9) AS density, count(*) FILTER (NOT localised) AS "global", count(*) FILTER (localised) AS localised, count(*) FILTER (NOT transient) AS stable,
 count(*) FILTER (transient) AS transient, (SELECT count(*) FROM sp) AS spatial, (SELECT count(*) FROM tp) AS temporal, (SELECT count(*) FROM sp JOIN tp USING (argb)) AS exact FROM space""")
def q_colour_report(spark, d):
    v = voxels(spark, d)
    return D.colour_report(D.colour_space(v), *dual(v))


@query("q_dual_palette_flow")
def q_dual_palette_flow(spark, d):
    """From a cube to a GIF: digest, colour space, palettes by place and by time, their merge, indices of all 81 frames, the file and its
    check. One row: the report's numbers, those of the merge, and what the file holds."""
    cube = kept(filled(spark, d), "cube")
    spatial, temporal = dual(cube)
    merged = D.merged_palettes(spatial, temporal)
    rows = [(r.idx, r.argb, r.r, r.g, r.b, r.kind) for r in merged.collect()]  # 256 at most, used by the steps that follow
    final = spark.createDataFrame(rows, merged.schema)
    rasters = G.rasters(N.nearest(cube, final).select("f", "y", "x", "idx")).withColumn("part", F.lit(0))
    files = G.gifs(rasters, ["part"], G.argb_list(final), 81, 81)
    checked = files.select(G.gif_report(F.col("gif")).alias("r")).select("r.valid", "r.width", "r.height", "r.frames")
    kinds = final.agg(F.count("*").alias("final"), F.count_if(F.col("kind") == 1).alias("similar"))
    cells_ = D.digests(cube).agg(F.count("*").alias("cells"))
    out = D.colour_report(D.colour_space(cube), spatial, temporal)
    for one in (kinds, cells_, checked):  # one row each
        out = out.crossJoin(one)
    return out


@query("q_resamplers")
def q_resamplers(spark, d):
    """f, method, y, x, r, g, b by each method of large and small reductions, and by the one that suits the scale."""
    cube, out = kept(filled(spark, d), "cube"), None
    for method, n in (("bicubic", 27), ("mitchell", 16), ("hermite", 40), ("two_stage", 16), (None, 9), (None, 60)):
        p = S.resampled(cube, 81, n, method).withColumn("method", F.lit(method or f"auto_{S.resampler(81, n)}"))
        out = p if out is None else out.unionByName(p)
    return out


@query("q_importance_metrics", f"""WITH {CELLS}{MOVE}, v AS (SELECT cell, motion, (r + g + b) / 765.0::DOUBLE AS light, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END AS pure,
 (var_pop(r) OVER w + var_pop(g) OVER w + var_pop(b) OVER w) / 195075.0::DOUBLE AS variance FROM m WINDOW w AS (PARTITION BY y, x))
 SELECT cell, 'brightness' AS metric, round(light, 6) AS value FROM v UNION ALL SELECT cell, 'saturation', round(pure, 6) FROM v UNION ALL SELECT cell, 'motion', round(motion, 6) FROM v
 UNION ALL SELECT cell, 'variance', round(variance, 6) FROM v UNION ALL SELECT cell, 'combined', round((light + pure) / 2, 6) FROM v""")
def q_importance_metrics(spark, d):
    c, out = cells(spark, d), None
    for metric in C.METRICS:
        one = C.importance_by(c, metric).select("cell", F.lit(metric).alias("metric"), F.round("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
