"""Queries over palettes: histograms, nearest colours, set operations, merges, codecs and quantisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import RAMPS, hex_of, luma_milli, pack, unpack
from ..operators import digests as D
from ..operators import grouped as G
from ..operators import matching as M
from ..operators import nearest as N
from ..operators import palettes as P
from ..operators import spatial as S
from ..operators import trees as T
from ..operators import windows as W
from ..runtime import kept
from ..sources.cubes import CELLS, FILLED, VOXEL, filled, load, voxels
from .cube_queries import cells
from .registry import query

HIST = VOXEL + ", hist AS (SELECT r * 65536 + g * 256 + b AS argb, CAST(sum(1 + f % 9) AS BIGINT) AS weight, count(*) AS n, r, g, b FROM voxel GROUP BY r, g, b)"
PAL = HIST + """, pal AS (SELECT CAST(row_number() OVER (ORDER BY r * 299 + g * 587 + b * 114, argb) - 1 AS INT) AS idx, CAST(argb AS BIGINT) AS argb, r, g, b, weight FROM (SELECT * FROM hist ORDER BY weight DESC, argb LIMIT 64))"""
NEAR = PAL + """, dc AS (SELECT DISTINCT r, g, b FROM voxel), nn AS (SELECT r, g, b, arg_min(idx, d * 1000 + idx) AS idx, min(d) AS dist FROM (
 SELECT c.r, c.g, c.b, p.idx, (c.r - p.r) * (c.r - p.r) + (c.g - p.g) * (c.g - p.g) + (c.b - p.b) * (c.b - p.b) AS d FROM dc c, pal p) GROUP BY r, g, b)"""
LUT = PAL + """, centre AS (SELECT CAST(i // 256 AS INT) AS kr, CAST(i // 16 % 16 AS INT) AS kg, CAST(i % 16 AS INT) AS kb FROM range(4096) t(i)), lut AS (SELECT kr, kg, kb, arg_min(idx, d * 1000 + idx) AS idx FROM (
 SELECT kr, kg, kb, idx, (kr * 16 + 8 - r) * (kr * 16 + 8 - r) + (kg * 16 + 8 - g) * (kg * 16 + 8 - g) + (kb * 16 + 8 - b) * (kb * 16 + 8 - b) AS d FROM centre, pal) GROUP BY kr, kg, kb)"""


def palette(spark, d, k: int = 64) -> DataFrame:
    return P.top(P.histogram(voxels(spark, d), 1 + F.col("f") % 9), k)


def colours(spark, d) -> DataFrame:
    """All colours with their weights, from one scan and one shuffle, written once (at most a row for each of 256³) for queries that take a palette from them and meet it again."""
    return kept(P.colours(voxels(spark, d), 1 + F.col("f") % 9), "colours")


@query("q_weighted_hist_topk", f"WITH {PAL} SELECT idx, argb, r, g, b, weight FROM pal")
def q_weighted_hist_topk(spark, d):
    return palette(spark, d)


@query("q_bucket_palette", f"""WITH {VOXEL}, m AS (SELECT CAST(r // 32 * 32 + g // 32 * 4 + b // 64 AS INT) AS bucket, CAST(floor(avg(r)) AS INT) AS r, CAST(floor(avg(g)) AS INT) AS g, CAST(floor(avg(b)) AS INT) AS b, count(*) AS n FROM voxel GROUP BY ALL),
 e AS (SELECT CAST(i AS INT) AS bucket, CAST(i // 32 * 32 + 16 AS INT) AS cr, CAST(i // 4 % 8 * 32 + 16 AS INT) AS cg, CAST(i % 4 * 64 + 32 AS INT) AS cb FROM range(256) t(i))
 SELECT e.bucket, coalesce(r, cr) AS r, coalesce(g, cg) AS g, coalesce(b, cb) AS b, coalesce(n, 0) AS n, CAST(row_number() OVER (ORDER BY cr * 299 + cg * 587 + cb * 114, e.bucket) - 1 AS INT) AS idx FROM e LEFT JOIN m ON e.bucket = m.bucket""".replace("GROUP BY ALL", "GROUP BY r // 32 * 32 + g // 32 * 4 + b // 64"))
def q_bucket_palette(spark, d):
    return P.bucket_palette(voxels(spark, d))


@query("q_nearest", f"WITH {NEAR} SELECT r, g, b, idx, CAST(dist AS BIGINT) AS dist FROM nn")
def q_nearest(spark, d):
    c = colours(spark, d)
    return N.best(c, P.top(c, 64))


EVEN = "pal AS (SELECT CAST(row_number() OVER (ORDER BY r, g, b) - 1 AS INT) AS idx, r, g, b FROM (SELECT r, g, b FROM voxel WHERE f % 2 = 0 GROUP BY r, g, b ORDER BY count(*) DESC, r, g, b LIMIT 2048))"


@query("q_nearest_large", f"WITH {VOXEL}, {EVEN}, {NEAR[len(PAL) + 2:]} SELECT r, g, b, idx, CAST(dist AS BIGINT) AS dist FROM nn".replace("d * 1000 + idx", "d * 10000 + idx"))
def q_nearest_large(spark, d):
    """All colours against the 2 048 that the even frames have most of."""
    even = voxels(spark, d).where("f % 2 = 0").groupBy("r", "g", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r", "g", "b").limit(2048)
    p = even.withColumn("idx", F.row_number().over(Window.orderBy("r", "g", "b")) - 1)
    return N.best(voxels(spark, d).select("r", "g", "b").distinct(), p)


@query("q_lut_map", f"WITH {LUT} SELECT f, idx, count(*) AS n FROM voxel v JOIN lut l ON v.r // 16 = kr AND v.g // 16 = kg AND v.b // 16 = kb GROUP BY f, idx")
def q_lut_map(spark, d):
    return N.by_lookup(voxels(spark, d), palette(spark, d)).groupBy("f", "idx").agg(F.count("*").alias("n"))


@query("q_lut_vs_nn", f"WITH {NEAR}, {LUT[len(PAL) + 2:]} SELECT count(*) AS colours, count(*) FILTER (n.idx <> l.idx) AS differ FROM nn n JOIN lut l ON n.r // 16 = kr AND n.g // 16 = kg AND n.b // 16 = kb")
def q_lut_vs_nn(spark, d):
    c = colours(spark, d)
    p = kept(P.top(c, 64), "palette")
    exact = N.best(c, p).withColumnRenamed("idx", "exact")
    return N.by_lookup(exact, p).agg(F.count("*").alias("colours"), F.count_if(F.col("idx") != F.col("exact")).alias("differ"))


@query("q_reconstruct_error", f"""WITH {NEAR}, e AS (SELECT abs(v.r - p.r) AS er, abs(v.g - p.g) AS eg, abs(v.b - p.b) AS eb FROM voxel v JOIN nn USING (r, g, b) JOIN pal p ON nn.idx = p.idx)
 SELECT count(*) AS n, round(sum(er * er + eg * eg + eb * eb)::DOUBLE / (3.0 * count(*)), 6) AS mse, round(10 * log10(65025.0::DOUBLE / (sum(er * er + eg * eg + eb * eb)::DOUBLE / (3.0 * count(*)))), 6) AS psnr,
 round(sum(er + eg + eb)::DOUBLE / (3.0 * count(*)), 6) AS mean_error, max(greatest(er, eg, eb)) AS largest, round(count(*) FILTER (greatest(er, eg, eb) <= 25)::DOUBLE / count(*), 6) AS close FROM e""")
def q_reconstruct_error(spark, d):
    p = kept(palette(spark, d), "palette")
    return N.errors(N.reconstructed(N.nearest(voxels(spark, d), p), p))


@query("q_quantisation_error", f"WITH {NEAR} SELECT f, round(avg(sqrt(dist::DOUBLE)), 6) AS error, avg(sqrt(dist::DOUBLE)) > 20 AS over FROM voxel JOIN nn USING (r, g, b) GROUP BY f")
def q_quantisation_error(spark, d):
    e = N.nearest(voxels(spark, d), palette(spark, d)).groupBy("f").agg(F.avg(F.sqrt(F.col("dist").cast("double"))).alias("e"))
    return e.select("f", F.round("e", 6).alias("error"), (F.col("e") > 20).alias("over"))


@query("q_cell_mode", f"""WITH {LUT}, k AS (SELECT v.f // 9 * 81 + v.y // 9 * 9 + v.x // 9 AS cell, idx, count(*) AS k FROM voxel v JOIN lut l ON v.r // 16 = kr AND v.g // 16 = kg AND v.b // 16 = kb GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k DESC, idx) AS rank, sum(k) OVER (PARTITION BY cell) AS n FROM k)
 SELECT CAST(cell AS INT) AS cell, CAST(n AS BIGINT) AS n, max(idx) FILTER (rank = 1) AS dominant, max(idx) FILTER (rank = 2) AS secondary, round(1 - max(k) FILTER (rank = 1)::DOUBLE / n, 9) AS variance,
 string_agg(idx || ':' || k, ' ' ORDER BY rank) AS top FROM o WHERE rank <= 4 GROUP BY cell, n""")
def q_cell_mode(spark, d):
    from ..operators.cells import at, cell_key, mode_of_cells

    v = N.by_lookup(voxels(spark, d), palette(spark, d))
    return mode_of_cells(v.select(cell_key(at("f"), at("y"), at("x")).alias("cell"), "idx"))


@query("q_index_stats", f"WITH {LUT} SELECT v.f, count(DISTINCT idx) AS used, min(idx) AS least, max(idx) AS most FROM voxel v JOIN lut l ON v.r // 16 = kr AND v.g // 16 = kg AND v.b // 16 = kb GROUP BY v.f")
def q_index_stats(spark, d):
    return N.by_lookup(voxels(spark, d), palette(spark, d)).groupBy("f").agg(F.count_distinct("idx").alias("used"), F.min("idx").alias("least"), F.max("idx").alias("most"))


@query("q_hist_l1", f"""WITH {LUT}, h AS (SELECT v.f, idx, count(*) AS n FROM voxel v JOIN lut l ON v.r // 16 = kr AND v.g // 16 = kg AND v.b // 16 = kb GROUP BY v.f, idx)
 SELECT coalesce(a.f, b.f + 1) AS f, CAST(sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS BIGINT) AS l1 FROM (SELECT * FROM h WHERE f > 0) a FULL JOIN (SELECT * FROM h WHERE f < 80) b ON a.f = b.f + 1 AND a.idx = b.idx GROUP BY 1""")
def q_hist_l1(spark, d):
    h = N.by_lookup(voxels(spark, d), palette(spark, d)).groupBy("f", "idx").agg(F.count("*").alias("n"))
    before = h.where("f < 80").select((F.col("f") + 1).alias("f"), "idx", F.col("n").alias("m"))
    both = h.where("f > 0").join(before, ["f", "idx"], "full")
    return both.groupBy("f").agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))).alias("l1"))


@query("q_palette_luma_order", f"WITH {PAL}, o AS (SELECT idx, r * 299 + g * 587 + b * 114 AS luma, lag(r * 299 + g * 587 + b * 114) OVER (ORDER BY idx) AS before FROM pal) SELECT count(*) AS n, count(*) FILTER (luma < before) AS out_of_order FROM o")
def q_palette_luma_order(spark, d):
    p = palette(spark, d).withColumn("luma", luma_milli(F.col("r"), F.col("g"), F.col("b")))
    return p.withColumn("before", F.lag("luma").over(Window.orderBy("idx"))).agg(F.count("*").alias("n"), F.count_if(F.col("luma") < F.col("before")).alias("out_of_order"))


SIDES = HIST.replace("voxel GROUP BY r, g, b)", "voxel WHERE f < 40 GROUP BY r, g, b)") + """, late AS (SELECT r * 65536 + g * 256 + b AS argb, count(*) AS n FROM voxel WHERE f >= 40 GROUP BY r, g, b),
 a AS (SELECT CAST(argb AS BIGINT) AS argb, n AS score FROM hist ORDER BY n DESC, argb LIMIT 256), b AS (SELECT CAST(argb AS BIGINT) AS argb, n AS score FROM late ORDER BY n DESC, argb LIMIT 256)"""


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    out = []
    for cond in ("f < 40", "f >= 40"):
        h = P.histogram(voxels(spark, d).where(cond))
        out.append(h.orderBy(F.desc("n"), "argb").limit(256).select("argb", F.col("n").alias("score")))
    return tuple(out)


@query("q_palette_intersect", f"WITH {SIDES} SELECT a.argb, a.score + b.score AS score FROM a JOIN b ON a.argb = b.argb")
def q_palette_intersect(spark, d):
    return P.intersection(*sides(spark, d))


@query("q_palette_anti", f"WITH {SIDES} SELECT * FROM a WHERE argb NOT IN (SELECT argb FROM b)")
def q_palette_anti(spark, d):
    return P.only(*sides(spark, d))


@query("q_palette_symdiff", f"WITH {SIDES} SELECT argb, 'a' AS side FROM a WHERE argb NOT IN (SELECT argb FROM b) UNION ALL SELECT argb, 'b' FROM b WHERE argb NOT IN (SELECT argb FROM a)")
def q_palette_symdiff(spark, d):
    return P.symmetric_difference(*sides(spark, d))


@query("q_palette_union", f"WITH {SIDES} SELECT argb FROM a UNION SELECT argb FROM b")
def q_palette_union(spark, d):
    a, b = sides(spark, d)
    return a.select("argb").union(b.select("argb")).distinct()


@query("q_palette_intersect_all", f"WITH {SIDES} SELECT argb FROM a INTERSECT SELECT argb FROM b")
def q_palette_intersect_all(spark, d):
    a, b = sides(spark, d)
    return a.select("argb").intersect(b.select("argb"))


@query("q_interleave", f"""WITH {SIDES}, k AS (SELECT argb, score, row_number() OVER (ORDER BY score DESC, argb) AS rank, 0 AS side FROM a UNION ALL SELECT argb, score, row_number() OVER (ORDER BY score DESC, argb), 1 FROM b)
 SELECT argb, score, CAST(rank AS INT) AS rank, CAST(side AS INT) AS side, CAST(row_number() OVER (ORDER BY rank, side) AS INT) AS seq FROM k""")
def q_interleave(spark, d):
    return W.interleaved(*sides(spark, d), "score", "argb")


@query("q_transitions", f"""WITH {VOXEL}, h AS (SELECT DISTINCT f, r * 65536 + g * 256 + b AS argb FROM voxel)
 SELECT coalesce(a.f, b.f + 1) AS f, count(*) FILTER (a.f IS NULL OR b.f IS NULL) AS changed, count(*) AS "of", round(1 - count(*) FILTER (a.f IS NULL OR b.f IS NULL)::DOUBLE / count(*), 6) AS stability
 FROM (SELECT * FROM h WHERE f > 0) a FULL JOIN (SELECT * FROM h WHERE f < 80) b ON a.f = b.f + 1 AND a.argb = b.argb GROUP BY 1""")
def q_transitions(spark, d):
    return P.transitions(voxels(spark, d))


@query("q_global_palette", f"""WITH {VOXEL}, k AS (SELECT f, r * 65536 + g * 256 + b AS argb, count(*) AS n FROM voxel GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, argb) AS rank FROM k)
 SELECT CAST(argb AS BIGINT) AS argb, count(*) AS frames FROM o WHERE rank <= 16 GROUP BY argb ORDER BY frames DESC, argb LIMIT 256""".replace("GROUP BY ALL", "GROUP BY f, r * 65536 + g * 256 + b"))
def q_global_palette(spark, d):
    k = P.argb(voxels(spark, d)).groupBy("f", "argb").agg(F.count("*").alias("n"))
    per = W.ranked(k, "n", "f", key="argb").where("rank <= 16")
    return per.groupBy("argb").agg(F.count("*").alias("frames")).orderBy(F.desc("frames"), "argb").limit(256)


@query("q_palette_quality", f"WITH {PAL} SELECT count(DISTINCT CAST(r > 127 AS INT) * 4 + CAST(g > 127 AS INT) * 2 + CAST(b > 127 AS INT)) / 8.0::DOUBLE AS coverage, count(DISTINCT argb) AS colours, round(count(DISTINCT argb)::DOUBLE / count(*), 6) AS diversity FROM pal")
def q_palette_quality(spark, d):
    return P.quality(palette(spark, d))


@query("q_palette_stats", f"""WITH {PAL} SELECT count(DISTINCT argb) AS colours, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, round((avg(r) - avg(b)) / 255, 6) AS warmth,
 round((greatest(avg(r), avg(g), avg(b)) - least(avg(r), avg(g), avg(b))) / greatest(avg(r), avg(g), avg(b)), 6) AS saturation, max(r) - min(r) >= 100 AND max(g) - min(g) >= 100 AND max(b) - min(b) >= 100 AS spread FROM pal""")
def q_palette_stats(spark, d):
    m = palette(spark, d).agg(F.count_distinct("argb").alias("colours"), *[F.avg(c).alias(f"m{c}") for c in "rgb"], *[(F.max(c) - F.min(c)).alias(f"w{c}") for c in "rgb"])
    top, low = F.greatest("mr", "mg", "mb"), F.least("mr", "mg", "mb")
    return m.select("colours", *[F.round(f"m{c}", 6).alias(c) for c in "rgb"], F.round((F.col("mr") - F.col("mb")) / 255, 6).alias("warmth"), F.round((top - low) / top, 6).alias("saturation"), (F.least("wr", "wg", "wb") >= 100).alias("spread"))


@query("q_padded_palette", f"WITH {PAL} SELECT CAST(i AS INT) AS idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM range(256) t(i) LEFT JOIN pal ON i = idx")
def q_padded_palette(spark, d):
    return P.padded(palette(spark, d))


@query("q_pack_unpack", f"WITH {VOXEL} SELECT r, g, b, CAST(4278190080 + r * 65536 + g * 256 + b AS BIGINT) AS argb, '#' || upper(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0')) AS hex, true AS same FROM voxel")
def q_pack_unpack(spark, d):
    c = [F.col(x) for x in "rgb"]
    v = voxels(spark, d).select(*c, pack(*c).alias("argb"), hex_of(*c).alias("hex"))
    back = unpack(F.col("argb"))
    return v.withColumn("same", (back[0] == c[0]) & (back[1] == c[1]) & (back[2] == c[2]))


@query("q_allocation", f"""WITH {CELLS}, s AS (SELECT t, y, CAST(sum(w) AS BIGINT) AS w FROM cells GROUP BY t, y), k AS (SELECT t * 9 + y AS key, w, CASE WHEN floor(w * 256::DOUBLE / sum(w) OVER ()) = 0 AND w > 0 THEN 1 ELSE floor(w * 256::DOUBLE / sum(w) OVER ()) END AS a FROM s),
 x AS (SELECT *, 256 - sum(a) OVER () AS d, count(*) OVER () AS n, row_number() OVER (ORDER BY w DESC, key) - 1 AS up, sum(CAST(a > 1 AS INT)) OVER (ORDER BY w, key ROWS UNBOUNDED PRECEDING) AS down FROM k)
 SELECT CAST(key AS INT) AS key, CAST(a + CASE WHEN d > 0 THEN greatest(floor((d - 1 - up) / n) + 1, 0) WHEN d < 0 AND a > 1 AND down <= -d THEN -1 ELSE 0 END AS BIGINT) AS allocated FROM x""")
def q_allocation(spark, d):
    s = cells(spark, d).groupBy("t", "y").agg(F.sum("w").alias("w")).select((F.col("t") * 9 + F.col("y")).cast("int").alias("key"), "w")
    return W.largest_remainder(s, "w", "key", 256).select("key", "allocated")


@query("q_frame_binding", f"WITH {VOXEL}, fs AS (SELECT DISTINCT f FROM voxel) SELECT f, 'cycle' AS how, CAST(2 + f % 5 AS INT) AS ref FROM fs UNION ALL SELECT f, 'uniform', 3 FROM fs UNION ALL SELECT f, 'identity', f FROM fs")
def q_frame_binding(spark, d):
    f = voxels(spark, d).select("f").distinct()
    out = [P.bound(f, n, how, low=2, uniform=3).withColumn("how", F.lit(how)) for how, n in (("cycle", 5), ("uniform", 5), ("identity", 81))]
    return out[0].unionByName(out[1]).unionByName(out[2])


BANK = "bank AS (SELECT CAST(p_partkey AS INT) AS ref, p_name AS name, p_brand AS brand FROM part), fr AS (SELECT CAST(l_orderkey % 81 AS INT) AS f, CAST(l_partkey + l_linenumber % 3 AS INT) AS ref FROM lineitem)"


def bank_and_frames(spark, d) -> tuple[DataFrame, DataFrame]:
    bank = load(spark, d, "part").select(F.col("p_partkey").cast("int").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    frames = load(spark, d, "lineitem").select((F.col("l_orderkey") % 81).cast("int").alias("f"), (F.col("l_partkey") + F.col("l_linenumber") % 3).cast("int").alias("ref"))
    return bank, frames


@query("q_dangling_refs", f"WITH {BANK} SELECT ref, f FROM fr WHERE ref NOT IN (SELECT ref FROM bank)")
def q_dangling_refs(spark, d):
    bank, frames = bank_and_frames(spark, d)
    return P.dangling(frames, bank)


@query("q_remap", f"WITH {BANK} SELECT f, CAST((SELECT max(ref) + 1 FROM bank) - ref AS INT) AS ref FROM fr WHERE ref IN (SELECT ref FROM bank)")
def q_remap(spark, d):
    bank, frames = bank_and_frames(spark, d)
    backwards = bank.select("ref").crossJoin(F.broadcast(bank.agg((F.max("ref") + 1).alias("end")))).select("ref", (F.col("end") - F.col("ref")).cast("int").alias("new_ref"))
    return P.remapped(frames.join(bank.select("ref"), "ref", "left_semi"), backwards).select("f", "ref")


@query("q_bank_union", f"WITH {BANK} SELECT ref, name FROM bank UNION ALL SELECT ref + (SELECT max(ref) + 1 FROM bank), name FROM bank")
def q_bank_union(spark, d):
    bank, _ = bank_and_frames(spark, d)
    bank = bank.select("ref", "name")
    return P.banks_united(bank, bank, (8, 8))[0]


@query("q_stream_concat", f"WITH {BANK} SELECT f, ref FROM fr UNION ALL SELECT f + 81, ref + (SELECT max(ref) + 1 FROM bank) FROM fr WHERE f < 20")
def q_stream_concat(spark, d):
    bank, frames = bank_and_frames(spark, d)
    _, offset = P.banks_united(bank, bank, (8, 8))
    return P.streams_joined(frames, frames.where("f < 20"), offset).select("f", "ref")


@query("q_distances", f"WITH {PAL} SELECT a.idx, b.idx AS other, CAST((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) AS BIGINT) AS dist FROM pal a JOIN pal b ON a.idx < b.idx")
def q_distances(spark, d):
    return N.distances(palette(spark, d))


@query("q_luma_index", f"WITH {PAL} SELECT CAST(i AS INT) AS y, arg_min(idx, abs(i * 1000 - (r * 299 + g * 587 + b * 114)) * 1000 + idx) AS idx FROM range(256) t(i), pal GROUP BY i")
def q_luma_index(spark, d):
    return N.index_by_luma(spark.range(256).select(F.col("id").cast("int").alias("y")), palette(spark, d))


@query("q_luma_histogram", f"WITH {VOXEL} SELECT CAST((r * 299 + g * 587 + b * 114) // 1000 AS INT) AS luma, count(*) AS n FROM voxel GROUP BY 1")
def q_luma_histogram(spark, d):
    return voxels(spark, d).groupBy(F.floor(luma_milli(F.col("r"), F.col("g"), F.col("b")) / 1000).cast("int").alias("luma")).agg(F.count("*").alias("n"))


@query("q_ramps")
def q_ramps(spark, d):
    out = None
    for name in RAMPS:
        p = P.ramp_palette(spark, name).withColumn("name", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


@query("q_ramp_linear", "SELECT CAST(i AS INT) AS idx, CAST(i AS INT) AS r, CAST(i AS INT) AS g, CAST(i AS INT) AS b FROM range(256) t(i)")
def q_ramp_linear(spark, d):
    return P.ramp_palette(spark, "linear")


@query("q_ramp_sepia", "SELECT CAST(i AS INT) AS idx, CAST(floor(least(255.0, round(i * 1.2::DOUBLE, 9))) AS INT) AS r, CAST(floor(round(i * 0.9::DOUBLE, 9)) AS INT) AS g, CAST(floor(round(i * 0.6::DOUBLE, 9)) AS INT) AS b FROM range(256) t(i)")
def q_ramp_sepia(spark, d):
    return P.ramp_palette(spark, "sepia")


@query("q_palette_roles")
def q_palette_roles(spark, d):
    return P.roles(palette(spark, d))


@query("q_similar_pairs")
def q_similar_pairs(spark, d):
    a, b = sides(spark, d)
    return P.similar_pairs(a, b).withColumn("delta", F.round("delta", 6))


@query("q_palette_merge")
def q_palette_merge(spark, d):
    """Exact pairs, then greedy similar ones, then the rest one by one from each side, to 256, in order of luminance."""
    return D.merged_palettes(*sides(spark, d))


ONE = "one AS (SELECT 0 AS \"all\", r, g, b, {n} AS n FROM {t} GROUP BY r, g, b)"


@query("q_octree", f"WITH {CELLS}, {ONE.format(n='count(*)', t='cells')}, {T.octree_sql('one', '\"all\"', 64)}")
def q_octree(spark, d):
    return T.octree(cells(spark, d).withColumn("all", F.lit(0)), ["all"], 64)


@query("q_octree_weighted", f"WITH {CELLS}, {ONE.format(n='sum(greatest(1, least(10, w // 4000000)))', t='cells')}, {T.octree_sql('one', '\"all\"', 64)}")
def q_octree_weighted(spark, d):
    c = cells(spark, d).withColumns({"all": F.lit(0), "times": F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("w") / 4_000_000))).cast("long")})
    return T.octree(c, ["all"], 64, "times")


@query("q_octree_per_frame", f"WITH {VOXEL}, one AS (SELECT f, r, g, b, count(*) AS n FROM voxel GROUP BY f, r, g, b), {T.octree_sql('one', 'f', 16)}")
def q_octree_per_frame(spark, d):
    return T.octree(voxels(spark, d), ["f"], 16)


@query("q_median_cut")
def q_median_cut(spark, d):
    return T.median_cut(voxels(spark, d), ["f"], 16)


@query("q_farthest_points")
def q_farthest_points(spark, d):
    p = kept(palette(spark, d, 256), "palette")
    scored = p.crossJoin(F.broadcast(p.agg(F.max("weight").alias("top")))).withColumn("score", F.col("weight") / F.col("top"))
    return M.spread(scored, 16).select("pick", "idx", "r", "g", "b")


@query("q_spread_colours")
def q_spread_colours(spark, d):
    """64 of all colours that lie far from each other."""
    colours = P.argb(voxels(spark, d).select("r", "g", "b").distinct()).withColumn("score", F.lit(0.0))
    return M.spread(colours, 64, "argb").select("pick", "argb", "r", "g", "b")


@query("q_dither")
def q_dither(spark, d):
    small = S.box(filled(spark, d), 81, 27)
    return G.dithered(small, G.argb_list(palette(spark, d, 16)), 27)


@query("q_dither_adaptive")
def q_dither_adaptive(spark, d):
    small = S.box(filled(spark, d), 81, 27).withColumn("weight", (F.col("x") + F.col("y")) / 54.0)
    return G.dithered(small, G.argb_list(palette(spark, d, 16)), 27, "weight")


def raster(spark, d) -> DataFrame:
    return G.rasters(N.by_lookup(filled(spark, d), palette(spark, d)).select("f", "y", "x", "idx"))


@query("q_lzw_roundtrip", f"WITH {PAL} SELECT doc_id, octet_length(encode(text)) AS n, true AS same FROM documents WHERE strlen(text) > 0".replace(f"WITH {PAL} ", ""))
def q_lzw_roundtrip(spark, d):
    t = load(spark, d, "documents").where(F.octet_length("text") > 0).select("doc_id", F.col("text").cast("binary").alias("bytes"))
    back = G.lzw_decoded(G.lzw_encoded(F.col("bytes")))
    return t.select("doc_id", F.octet_length("bytes").cast("long").alias("n"), (back == F.col("bytes")).alias("same"))


@query("q_compression_stats")
def q_compression_stats(spark, d):
    c = raster(spark, d).select(F.octet_length("indices").alias("raw"), F.octet_length(G.lzw_encoded(F.col("indices"))).alias("coded"))
    return c.agg(F.sum("raw").alias("raw"), F.sum("coded").alias("coded"), F.round(F.sum("coded") / F.sum("raw"), 6).alias("ratio"), F.sum(F.ceil(F.col("coded") / 255)).alias("sub_blocks"), F.count_if(F.col("coded") == 0).alias("empty"))


@query("q_gif_roundtrip", f"WITH {FILLED} SELECT 0 AS part, true AS valid, max(x) + 1 AS width, max(y) + 1 AS height, CAST(count(DISTINCT f) AS INT) AS frames FROM cube")
def q_gif_roundtrip(spark, d):
    files = G.gifs(raster(spark, d).withColumn("part", F.lit(0)), ["part"], G.argb_list(palette(spark, d)), 81, 81)
    r = files.select("part", G.gif_report(F.col("gif")).alias("r"))
    return r.select("part", "r.valid", "r.width", "r.height", "r.frames")


@query("q_all_pixels_octree", f"WITH {VOXEL}, {ONE.format(n='count(*)', t='voxel')}, {T.octree_sql('one', '\"all\"', 256)}")
def q_all_pixels_octree(spark, d):
    return T.octree(voxels(spark, d).withColumn("all", F.lit(0)), ["all"], 256)
