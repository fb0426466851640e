"""Queries of rewards, content scores, genes, vectors and colour science."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import scoring as R
from ..functions import vectors as V
from ..operators import cells as C
from ..operators import windows as W
from ..operators.neighbours import all_neighbours, knn
from ..operators.ordered import running, trailing_max
from ..sources.cubes import CELLS, REWARD, VOXEL, load, rewards, voxels
from .cube_queries import EDGE, MOVE, cells
from .registry import query

SCORES = REWARD + """, p AS (SELECT *, 0.7 * ssim + 0.3 / (1 + delta_e / 10) AS perceptual,
 greatest(0.0, least(1.0, coalesce(rating / 5.0::DOUBLE, 0.6) * CASE WHEN edited THEN 0.8 ELSE 1.0 END * CASE WHEN accepted THEN 1.2 ELSE 0.8 END))::DOUBLE AS usr,
 CASE WHEN bytes <= 0 THEN 1.0 ELSE least(1.0, 2.0 / (1 + bytes / 512000.0::DOUBLE)) END::DOUBLE AS compression FROM reward),
 s AS (SELECT *, 0.45 * perceptual + 0.35 * usr + 0.20 * compression AS total FROM p)"""


def scored(spark, d) -> DataFrame:
    r = rewards(spark, d)
    r = r.withColumns({"perceptual": R.perceptual_score(F.col("ssim"), F.col("delta_e")), "user": R.user_score(F.col("rating"), F.col("edited"), F.col("accepted")), "compression": R.compression_score(F.col("bytes"))})
    return r.withColumn("total", R.total_reward(F.col("perceptual"), F.col("user"), F.col("compression")))


@query("q_reward_events", f"WITH {SCORES} SELECT id, round(perceptual, 6) AS perceptual, round(usr, 6) AS \"user\", round(compression, 6) AS compression, round(total, 6) AS total, CASE WHEN round(total, 6) >= 0.8 THEN 'excellent' WHEN round(total, 6) >= 0.6 THEN 'good' WHEN round(total, 6) >= 0.4 THEN 'acceptable' ELSE 'poor' END AS tier FROM s")
def q_reward_events(spark, d):
    s = scored(spark, d)
    return s.select("id", *[F.round(c, 6).alias(c) for c in ("perceptual", "user", "compression", "total")], R.tier(F.round("total", 6)).alias("tier"))


@query("q_reward_batches", f"""WITH {SCORES}, o AS (SELECT *, (row_number() OVER (ORDER BY ts, id) - 1) // 10 AS batch FROM s)
 SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, round(avg(total), 6) AS mean, round(var_pop(total), 6) AS variance, round(min(total), 6) AS least, round(max(total), 6) AS most, count(rating) AS rated FROM o GROUP BY batch""")
def q_reward_batches(spark, d):
    from ..streaming.streams import batches_of

    b = batches_of(scored(spark, d), 10, "ts", "id")
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean"), F.round(F.var_pop("total"), 6).alias("variance"), F.round(F.min("total"), 6).alias("least"), F.round(F.max("total"), 6).alias("most"), F.count("rating").alias("rated"))


@query("q_reward_breakdown", f"WITH {SCORES} SELECT content, count(*) AS n, round(sum(total), 4) AS total FROM s WHERE content IS NOT NULL GROUP BY content")
def q_reward_breakdown(spark, d):
    return scored(spark, d).where("content IS NOT NULL").groupBy("content").agg(F.count("*").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("q_sample_gate", f"WITH {SCORES}, g AS (SELECT *, (row_number() OVER (ORDER BY ts, id) - 1) // 10 AS batch FROM s WHERE round(total, 9) >= 0.1) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(id) AS first_id FROM g GROUP BY batch")
def q_sample_gate(spark, d):
    from ..streaming.streams import batches_of

    g = scored(spark, d).where(F.round("total", 9) >= 0.1)
    return batches_of(g, 10, "ts", "id").groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("q_ewma", f"WITH {SCORES}, o AS (SELECT content, list(total ORDER BY ts, id) AS v FROM s WHERE content IS NOT NULL GROUP BY content) SELECT content, round(list_reduce(list_prepend(0.5::DOUBLE, v), lambda q, x: q * 0.9 + x * 0.1), 9) AS ewma, CAST(len(v) AS BIGINT) AS n FROM o")
def q_ewma(spark, d):
    return W.folded(scored(spark, d).where("content IS NOT NULL"), "total", ["ts", "id"], "content", alpha=0.1).withColumn("ewma", F.round("ewma", 9))


@query("q_momentum", f"""WITH {SCORES}, o AS (SELECT content, list({{'v': total, 'x': 0.0::DOUBLE, 's': 0.0::DOUBLE}} ORDER BY ts, id) AS l FROM s WHERE content IS NOT NULL GROUP BY content),
 m AS (SELECT content, list_reduce(list_prepend({{'v': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 's': 0.0::DOUBLE}}, l), lambda q, e: {{'v': q.v * 0.9 + e.v, 'x': q.x + (q.v * 0.9 + e.v) * 0.01, 's': q.s * 0.9 + e.v * e.v * (1 - 0.9::DOUBLE)}}) AS q FROM o)
 SELECT content, round(q.v, 8) AS velocity, round(q.x, 8) AS position, round(q.s, 8) AS fisher FROM m""")
def q_momentum(spark, d):
    m = W.momentum(scored(spark, d).where("content IS NOT NULL"), "total", ["ts", "id"], "content")
    return m.select("content", *[F.round(c, 8).alias(c) for c in ("velocity", "position", "fisher")])


@query("q_fitness", """SELECT s_suppkey AS id, round(0.6 * ((s_suppkey * 37 % 100) / 100.0::DOUBLE) + 0.3 * ln(s_nationkey + 1.0::DOUBLE) / 10 + 0.1 * least(1.0, (s_suppkey % 15) / 10.0::DOUBLE), 9) AS fitness FROM supplier""")
def q_fitness(spark, d):
    s = load(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.round(R.fitness((F.col("s_suppkey") * 37 % 100) / 100.0, F.col("s_nationkey"), F.col("s_suppkey") % 15), 9).alias("fitness"))


@query("q_gene_pool", """WITH g AS (SELECT s_suppkey AS id, s_nationkey AS kind, round(0.6 * ((s_suppkey * 37 % 100) / 100.0::DOUBLE) + 0.3 * ln(s_nationkey + 1.0::DOUBLE) / 10 + 0.1 * least(1.0, (s_suppkey % 15) / 10.0::DOUBLE), 9) AS f FROM supplier),
 o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY f DESC, id) AS k FROM g) SELECT kind, count(*) AS n, round(avg(f), 6) AS mean, max(id) FILTER (k = 1) AS best FROM o GROUP BY kind""")
def q_gene_pool(spark, d):
    s = load(spark, d, "supplier")
    g = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind"), F.round(R.fitness((F.col("s_suppkey") * 37 % 100) / 100.0, F.col("s_nationkey"), F.col("s_suppkey") % 15), 9).alias("f"))
    return g.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean"), F.max_by("id", F.struct("f", -F.col("id"))).alias("best"))


@query("q_share_codes", "SELECT s_suppkey AS id, 'cube://g/' || substr(sha256(s_name), 1, 8) || lpad(CAST(least(99, s_suppkey % 120) AS VARCHAR), 2, '0') AS code FROM supplier")
def q_share_codes(spark, d):
    s = load(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("cube://g/"), F.substring(F.sha2("s_name", 256), 1, 8), F.lpad(F.least(F.lit(99), F.col("s_suppkey") % 120).cast("string"), 2, "0")).alias("code"))


COLOURS = "v AS (SELECT DISTINCT CAST(r * 65536 + g * 256 + b AS INT) AS i, r, g, b FROM voxel)"


def colours(spark, d) -> DataFrame:
    """i, r, g, b: the distinct colours of the table, by number."""
    return voxels(spark, d).select("r", "g", "b").distinct().withColumn("i", K.pack(*(F.col(c) for c in "rgb"), None).cast("int"))


@query("q_soft_stones", f"WITH {VOXEL}, {COLOURS}" + """, f AS (SELECT i, (r + g + b) / 765.0::DOUBLE AS l, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)::DOUBLE ELSE 0 END AS s, greatest(r, g, b) / 255.0::DOUBLE AS e, r, g, b FROM v),
 q AS (SELECT *, 0.6 * l + 0.4 * e AS x, 0.7 * (1 - l) AS y, 0.5 - abs(l - 0.5) * 0.3 + s * 0.2 AS z FROM f), e AS (SELECT *, exp((x - greatest(x, y, z)) / 0.5) AS ex, exp((y - greatest(x, y, z)) / 0.5) AS ey, exp((z - greatest(x, y, z)) / 0.5) AS ez FROM q)
 SELECT CAST(i AS INT) AS i, round(ex / (ex + ey + ez), 9) AS black, round(ey / (ex + ey + ez), 9) AS white, round(ez / (ex + ey + ez), 9) AS empty,
 (['white','white','empty','white','empty','empty','empty','empty','black','white','empty','empty','empty','empty','empty','empty','empty','black','empty','empty','black','empty','empty','black','black','black','black'])[CAST(least(2, r // 85) * 9 + least(2, g // 85) * 3 + least(2, b // 85) + 1 AS INT)] AS codon,
 CASE WHEN r < 85 THEN 'black' WHEN r < 170 THEN 'white' ELSE 'empty' END AS of_index FROM e""")
def q_soft_stones(spark, d):
    v = colours(spark, d)
    c = [F.col(x) for x in "rgb"]
    p = R.soft_stones(K.brightness(*c), K.saturation(*c), F.greatest(*c) / 255.0, 0.6, 0.3, 0.5)
    return v.select("i", *[F.round(x, 9).alias(n) for x, n in zip(p, ("black", "white", "empty"), strict=True)], R.codon_stone(*c).alias("codon"), R.stone_of_index(F.col("r")).alias("of_index"))


@query("q_value_head", """WITH v AS (SELECT event_id, (event_id % 17) / 4.0::DOUBLE AS a, (event_id % 13) / 4.0::DOUBLE AS b, (event_id % 5) / 4.0::DOUBLE AS c FROM events), e AS (SELECT *, exp(a - greatest(a, b, c)) AS x, exp(b - greatest(a, b, c)) AS y, exp(c - greatest(a, b, c)) AS z FROM v)
 SELECT event_id AS id, round(x / (x + y + z), 9) AS win, round(y / (x + y + z), 9) AS loss, round(z / (x + y + z), 9) AS draw, round((x - y) / (x + y + z), 9) AS expected, round((1 - (x - y) / (x + y + z)) / 2, 9) AS weight FROM e""")
def q_value_head(spark, d):
    i = F.col("event_id")
    e = load(spark, d, "events").select(i.alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("k"), (i % m / 4.0).alias("v")) for n, m in (("win", 17), ("loss", 13), ("draw", 5))])).alias("o")).select("id", "o.k", "o.v")
    p = W.softmax(e, "v", "id").groupBy("id").agg(*[F.max(F.when(F.col("k") == n, F.col("softmax"))).alias(n) for n in ("win", "loss", "draw")])
    ex = F.col("win") - F.col("loss")
    return p.select("id", *[F.round(n, 9).alias(n) for n in ("win", "loss", "draw")], F.round(ex, 9).alias("expected"), F.round(R.ownership_weight(ex), 9).alias("weight"))


HSV = """hsv AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN top = r THEN ((g - b) / d) % 6 WHEN top = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h0, CASE WHEN top > 0 THEN d / top ELSE 0 END AS s, top / 255.0::DOUBLE AS v FROM (
 SELECT *, greatest(r, g, b)::DOUBLE AS top, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS d FROM cells))"""


def in_hsv(df: DataFrame) -> DataFrame:
    h, s, v = K.hsv(F.col("r"), F.col("g"), F.col("b"))
    return df.withColumns({"h": h, "s": s, "v": v})


@query("q_hsv_circular", f"""WITH {CELLS}, {HSV}, a AS (SELECT t, CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END * 2 * pi() AS a FROM hsv WHERE s > 0.1), z AS (SELECT t, sum(sin(a)) AS y, sum(cos(a)) AS x, count(*) AS n FROM a GROUP BY t)
 SELECT t, round((atan2(y, x) / (2 * pi()) + 1) % 1, 6) AS hue, round(1 - sqrt(x * x + y * y) / n, 6) AS spread FROM z""")
def q_hsv_circular(spark, d):
    from ..operators.stats import circular

    return circular(in_hsv(cells(spark, d)).where("s > 0.1"), "h", "t").select("t", F.round("hue", 6).alias("hue"), F.round("spread", 6).alias("spread"))


@query("q_color_uniqueness", f"WITH {VOXEL} SELECT f, round(count(DISTINCT r // 8 * 1024 + g // 8 * 32 + b // 8)::DOUBLE / count(*), 6) AS uniqueness FROM voxel GROUP BY f")
def q_color_uniqueness(spark, d):
    q = sum((F.floor(F.col(c) / 8) * s for c, s in zip("rgb", (1024, 32, 1), strict=True)), F.lit(0))
    return voxels(spark, d).groupBy("f").agg(F.round(F.count_distinct(q) / F.count("*"), 6).alias("uniqueness"))


FEATURES = f"""{CELLS}{MOVE}{EDGE}, {HSV}, ft AS (SELECT round(avg(v), 6) AS mean_v, round(var_pop(v), 6) AS var_v, round(avg(s), 6) AS mean_s, round(var_pop(s), 6) AS var_s FROM hsv),
 ang AS (SELECT sum(sin(a)) AS y, sum(cos(a)) AS x, count(*) AS n FROM (SELECT CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END * 2 * pi() AS a FROM hsv WHERE s > 0.1)),
 cnt AS (SELECT round(count(DISTINCT r // 8 * 1024 + g // 8 * 32 + b // 8)::DOUBLE / count(*), 6) AS unq FROM cells), mot AS (SELECT round(avg(motion) FILTER (t > 0), 6) AS motion FROM m), edg AS (SELECT round(avg(d) / 441.67::DOUBLE, 6) AS edge FROM (
 SELECT sqrt((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b)) AS d FROM cells a JOIN cells b ON a.t = 4 AND b.t = 4 AND a.y < 8 AND a.x < 8 AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)))),
 feat AS (SELECT mean_v, var_v, mean_s, var_s, CASE WHEN n > 0 THEN round((atan2(y, x) / (2 * pi()) + 1) % 1, 6) ELSE 0 END AS hue, CASE WHEN n > 0 THEN round(1 - sqrt(x * x + y * y) / n, 6) ELSE 0 END AS spread, edge, motion, unq FROM ft, ang, cnt, mot, edg)"""


def features(spark, d) -> DataFrame:
    from ..operators.stats import content_features

    return content_features(cells(spark, d))


@query("q_content_features", f"WITH {FEATURES} SELECT mean_v, var_v, mean_s, var_s, hue, spread AS hue_spread, edge, motion, unq AS \"unique\" FROM feat")
def q_content_features(spark, d):
    return features(spark, d)


@query("q_content_scores", f"""WITH {FEATURES}, sc AS (
 SELECT 'nature' AS kind, CASE WHEN hue BETWEEN 0.2 AND 0.5 THEN 0.3 ELSE 0 END + CASE WHEN mean_s BETWEEN 0.3 AND 0.7 THEN 0.25 ELSE 0 END + CASE WHEN var_v > 0.02 THEN 0.2 ELSE 0 END + CASE WHEN spread > 0.3 THEN 0.15 ELSE 0 END + CASE WHEN motion < 0.15 THEN 0.1 ELSE 0 END AS p FROM feat
 UNION ALL SELECT 'portrait', CASE WHEN hue <= 0.1 OR hue >= 0.9 THEN 0.35 ELSE 0 END + CASE WHEN mean_s BETWEEN 0.2 AND 0.5 THEN 0.25 ELSE 0 END + CASE WHEN spread < 0.2 THEN 0.2 ELSE 0 END + CASE WHEN mean_v BETWEEN 0.3 AND 0.7 THEN 0.1 ELSE 0 END + CASE WHEN edge < 0.25 THEN 0.1 ELSE 0 END FROM feat
 UNION ALL SELECT 'action', CASE WHEN motion > 0.3 THEN 0.4 WHEN motion > 0.15 THEN 0.2 ELSE 0 END + CASE WHEN var_v > 0.03 THEN 0.2 ELSE 0 END + CASE WHEN unq > 0.3 THEN 0.15 ELSE 0 END + CASE WHEN mean_s > 0.3 THEN 0.15 ELSE 0 END + CASE WHEN spread > 0.3 THEN 0.1 ELSE 0 END FROM feat
 UNION ALL SELECT 'urban', CASE WHEN mean_s < 0.3 THEN 0.3 ELSE 0 END + CASE WHEN hue BETWEEN 0.5 AND 0.7 THEN 0.2 ELSE 0 END + CASE WHEN edge BETWEEN 0.2 AND 0.4 THEN 0.2 ELSE 0 END + CASE WHEN motion < 0.1 THEN 0.15 ELSE 0 END + CASE WHEN var_v BETWEEN 0.01 AND 0.04 THEN 0.15 ELSE 0 END FROM feat
 UNION ALL SELECT 'abstract', CASE WHEN var_s > 0.04 THEN 0.25 ELSE 0 END + CASE WHEN spread > 0.5 THEN 0.25 ELSE 0 END + CASE WHEN unq > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN var_v > 0.04 THEN 0.15 ELSE 0 END + CASE WHEN motion < 0.2 THEN 0.15 ELSE 0 END FROM feat
 UNION ALL SELECT 'low_light', CASE WHEN mean_v < 0.25 THEN 0.5 WHEN mean_v < 0.35 THEN 0.25 ELSE 0 END + CASE WHEN mean_s < 0.3 THEN 0.25 ELSE 0 END + CASE WHEN var_v < 0.02 THEN 0.15 ELSE 0 END + CASE WHEN edge < 0.2 THEN 0.1 ELSE 0 END FROM feat
 UNION ALL SELECT 'text', CASE WHEN mean_s < 0.15 THEN 0.3 ELSE 0 END + CASE WHEN edge > 0.4 THEN 0.3 ELSE 0 END + CASE WHEN unq < 0.2 THEN 0.2 ELSE 0 END + CASE WHEN var_v > 0.05 THEN 0.1 ELSE 0 END + CASE WHEN motion < 0.05 THEN 0.1 ELSE 0 END FROM feat
 UNION ALL SELECT 'animation', CASE WHEN mean_s > 0.7 THEN 0.35 WHEN mean_s > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN var_s < 0.02 THEN 0.2 ELSE 0 END + CASE WHEN edge > 0.35 THEN 0.2 ELSE 0 END + CASE WHEN unq < 0.3 THEN 0.15 ELSE 0 END + CASE WHEN spread > 0.4 THEN 0.1 ELSE 0 END FROM feat),
 r AS (SELECT kind, round(p::DOUBLE, 6) AS points, sum(round(p::DOUBLE, 6)) OVER () AS total FROM sc)
 SELECT kind, points, round(CASE WHEN total > 0 THEN points / total ELSE points END, 6) AS share, CAST(row_number() OVER (ORDER BY points DESC, kind) AS INT) AS rank FROM r""")
def q_content_scores(spark, d):
    from ..operators.stats import classified

    return classified(features(spark, d))


@query("q_delta_e")
def q_delta_e(spark, d):
    """Mean CIEDE2000 between each cell and the one before in time."""
    s = C.step(cells(spark, d), "t").where("pr IS NOT NULL")
    s = s.select("t", *[v.alias(f"{n}{i}") for i, side in enumerate(("", "p")) for v, n in zip(K.lab(*C.rgb(side)), "lab", strict=True)])
    s = K.with_delta_e2000(s, ("l0", "a0", "b0"), ("l1", "a1", "b1"), "delta")
    return s.groupBy("t").agg(F.round(F.avg("delta"), 6).alias("delta_e"))


@query("q_lab", f"WITH {VOXEL}, {COLOURS}" + """,
 l AS (SELECT i, CASE WHEN r / 255.0::DOUBLE > 0.04045 THEN pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE r / 255.0::DOUBLE / 12.92 END * 100 AS r, CASE WHEN g / 255.0::DOUBLE > 0.04045 THEN pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE g / 255.0::DOUBLE / 12.92 END * 100 AS g, CASE WHEN b / 255.0::DOUBLE > 0.04045 THEN pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE b / 255.0::DOUBLE / 12.92 END * 100 AS b FROM v),
 x AS (SELECT i, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 95.047 AS x, (r * 0.2126729 + g * 0.7151522 + b * 0.0721750) / 100 AS y, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 108.883 AS z FROM l),
 f AS (SELECT i, CASE WHEN x > 0.008856 THEN pow(x, 1.0::DOUBLE / 3) ELSE 7.787 * x + 16.0::DOUBLE / 116 END AS x, CASE WHEN y > 0.008856 THEN pow(y, 1.0::DOUBLE / 3) ELSE 7.787 * y + 16.0::DOUBLE / 116 END AS y, CASE WHEN z > 0.008856 THEN pow(z, 1.0::DOUBLE / 3) ELSE 7.787 * z + 16.0::DOUBLE / 116 END AS z FROM x)
 SELECT i, round(116 * y - 16, 6) AS l, round(500 * (x - y), 6) AS a, round(200 * (y - z), 6) AS b FROM f""")
def q_lab(spark, d):
    v = colours(spark, d)
    out = K.lab(*(F.col(c) for c in "rgb"))
    return v.select("i", *[F.round(x, 6).alias(n) for x, n in zip(out, "lab", strict=True)])


@query("q_contrast", f"WITH {VOXEL}, {COLOURS}" + """,
 l AS (SELECT i, 0.2126 * CASE WHEN r / 255.0::DOUBLE <= 0.03928 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g / 255.0::DOUBLE <= 0.03928 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END + 0.0722 * CASE WHEN b / 255.0::DOUBLE <= 0.03928 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS l FROM v)
 SELECT i, round(l, 6) AS luminance, round(1.05 / (l + 0.05), 6) AS on_white, CASE WHEN 1.05 / (l + 0.05) > 4.5 THEN 'white' ELSE 'black' END AS text FROM l""")
def q_contrast(spark, d):
    v = colours(spark, d).withColumn("l", K.relative_luminance(*(F.col(c) for c in "rgb")))
    return v.select("i", F.round("l", 6).alias("luminance"), F.round(K.contrast_ratio(F.col("l"), F.lit(1.0)), 6).alias("on_white"), K.text_on(F.col("l")).alias("text"))


@query("q_mood", f"""WITH {CELLS}, {HSV}, a AS (SELECT t, avg(CASE WHEN h0 < 0 THEN h0 + 1 ELSE h0 END) AS h, avg(s) AS s, avg(v) AS v FROM hsv GROUP BY t)
 SELECT t, CASE WHEN s > 0.6 AND (h < 0.15 OR h > 0.85) THEN 'vibrant sunset' WHEN s > 0.6 AND h > 0.45 AND h < 0.75 THEN 'electric neon' WHEN s < 0.3 AND v > 0.7 THEN 'pastel dream' WHEN s < 0.3 AND v < 0.3 THEN 'moody noir' WHEN (h < 0.15 OR h > 0.85) AND v > 0.7 THEN 'warm summer' WHEN h > 0.45 AND h < 0.75 AND v < 0.3 THEN 'deep ocean' WHEN s < 0.2 THEN 'vintage film' ELSE 'balanced' END AS mood,
 CASE WHEN h < 0.05 OR h >= 0.95 THEN 'Ruby' WHEN h < 0.15 THEN 'Amber' WHEN h < 0.25 THEN 'Gold' WHEN h < 0.40 THEN 'Emerald' WHEN h < 0.50 THEN 'Cyan' WHEN h < 0.65 THEN 'Sapphire' WHEN h < 0.75 THEN 'Violet' WHEN h < 0.85 THEN 'Magenta' ELSE 'Rose' END AS hue FROM a""")
def q_mood(spark, d):
    a = in_hsv(cells(spark, d)).groupBy("t").agg(F.avg("h").alias("h"), F.avg("s").alias("s"), F.avg("v").alias("v"))
    return a.select("t", K.mood(F.col("h"), F.col("s"), F.col("v")).alias("mood"), K.hue_name(F.col("h")).alias("hue"))


@query("q_quality_tiers", "SELECT event_id AS id, CASE WHEN event_id % 4 >= 3 OR event_id % 1200 > 900 THEN 'minimal' WHEN event_id % 4 = 2 OR event_id % 100 / 100.0::DOUBLE < 0.15 THEN 'low' WHEN event_id % 4 = 1 OR event_id % 100 / 100.0::DOUBLE < 0.3 THEN 'medium' ELSE 'high' END AS tier FROM events")
def q_quality_tiers(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select(i.alias("id"), R.quality_setting(i % 4, i % 1200, i % 100 / 100.0).alias("tier"))


# ---- vectors
KNN = """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT query, vec_id AS neighbour, list_transform(range(1, len(q) + 1), lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i])) AS dd,
 list_sum(list_transform(range(1, len(q) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)) AS dt, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n1, sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x))) AS n2 FROM embeddings JOIN q ON vec_id <> query),
 s AS (SELECT query, neighbour, round(sqrt(list_sum(dd)) * (2 - dt / (n1 * n2)), 6) AS score FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, neighbour) AS rank FROM s) SELECT query, neighbour, score, CAST(rank AS INT) AS rank FROM o WHERE rank <= 5"""


@query("q_knn_embeddings", KNN)
def q_knn_embeddings(spark, d):
    return knn(load(spark, d, "embeddings"), "id % 100 = 0", 5, digits=6)


@query("q_knn_all", KNN.replace("WHERE vec_id % 100 = 0", "").replace(", 6) AS score", ", 9) AS score"))
def q_knn_all(spark, d):
    """The five nearest of every vector."""
    return all_neighbours(load(spark, d, "embeddings"), 5)


@query("q_label_centroid", "WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(v::DOUBLE), 6) AS mean, count(*) AS n FROM x GROUP BY label, i")
def q_label_centroid(spark, d):
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


def pairs_of_vectors(spark, d) -> DataFrame:
    e = load(spark, d, "embeddings")
    a = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id")


@query("q_vector_lerp", "SELECT a.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE * 0.75 + b.embedding[i]::DOUBLE * 0.25) * (i % 3))), 6) AS digest, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0")
def q_vector_lerp(spark, d):
    p = pairs_of_vectors(spark, d).withColumn("l", V.lerp(F.col("a"), F.col("b"), 0.25))
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3).cast("double"))
    return p.select("id", F.round(V.dot(F.col("l"), weights), 6).alias("digest"), F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"))


@query("q_vector_merges")
def q_vector_merges(spark, d):
    p, a, b = pairs_of_vectors(spark, d), F.col("a"), F.col("b")
    shown = lambda c: F.round(V.norm(c), 6)
    return p.select("id", shown(V.slerp(a, b, 0.3)).alias("slerp"), shown(V.ties(a, b, 0.6)).alias("ties"), shown(V.crossover(a, b, F.col("id"), 0.5)).alias("crossover"), shown(V.mutated(a, F.col("id"), 0.1, 0.05)).alias("mutated"), shown(V.soup(F.array(a, b))).alias("soup"), shown(V.clipped(a, 0.5)).alias("clipped"), F.round(V.penalty(a, b, F.transform(a, lambda x: F.abs(x.cast("double"))), 0.4), 6).alias("penalty"))


@query("q_low_rank", "WITH e AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings) SELECT vec_id, list_transform(range(8), lambda i: round((s * (i % 3) - 0.5::DOUBLE * s * (i % 2)) * 0.5::DOUBLE, 6)) AS out FROM e")
def q_low_rank(spark, d):
    e = load(spark, d, "embeddings")
    rows = F.array(V.scaled(F.col("embedding"), F.lit(1.0)), V.scaled(F.col("embedding"), F.lit(-0.5)))
    up = F.array(*[F.array(F.lit(float(i % 3)), F.lit(float(i % 2))) for i in range(8)])
    return e.select("vec_id", F.transform(V.low_rank(rows, up, F.col("embedding"), 0.5), lambda x: F.round(x, 6)).alias("out"))


def samples(spark, d) -> DataFrame:
    """Scored samples with the variances of their nine slices of weights."""
    return scored(spark, d).withColumn("variances", F.array(*[F.col("id") * (2 * t + 3) % 100 / 400.0 for t in range(9)]))


@query("q_gene_gradients", f"""WITH {SCORES}, o AS (SELECT *, (row_number() OVER (ORDER BY ts, id) - 1) // 10 AS batch, count(*) OVER () AS every FROM s WHERE round(total, 9) >= 0.1)
 SELECT CAST(batch AS BIGINT) AS batch, content, count(*) AS n, round(avg((total - 0.5) * CASE WHEN (id * 3 % 100) / 400.0::DOUBLE > 0.1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END), 12) AS first_slice,
 round(avg((total - 0.5) * CASE WHEN (id * 19 % 100) / 400.0::DOUBLE > 0.1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END), 12) AS last_slice, round(avg((total - 0.5) * 0.02::DOUBLE), 12) AS temperature, round(avg((perceptual - 0.5) * 0.01::DOUBLE), 12) AS black, round(avg(power((total - 0.5) * 0.1::DOUBLE, 2)), 12) AS importance
 FROM o WHERE content IS NOT NULL AND batch < every // 10 GROUP BY batch, content""")
def q_gene_gradients(spark, d):
    from ..operators.training import batch_gradients

    g = batch_gradients(samples(spark, d), "content", "ts", "id")
    at = lambda i: F.round(F.col("gradient")[i], 12)
    return g.select("batch", "content", "n", at(0).alias("first_slice"), at(8).alias("last_slice"), at(9).alias("temperature"), at(10).alias("black"), F.round(F.col("importance")[0], 12).alias("importance"))


@query("q_gene_training")
def q_gene_training(spark, d):
    """The parameters of each content type's gene after all whole batches."""
    from ..operators.training import batch_gradients, trained

    return trained(batch_gradients(samples(spark, d), "content", "ts", "id"), "content")


# ---- sessions
@query("q_session_analytics", """WITH m AS (SELECT conv_id, role, strlen(text) AS n, turn, CASE WHEN turn % 3 = 0 THEN turn % 5 + 1 END AS rating FROM conversations)
 SELECT conv_id, count(*) AS moves, count(*) FILTER (role = 'user') AS asked, round(count(*) FILTER (role = 'user')::DOUBLE / count(*), 6) AS share, round(avg(rating), 6) AS rating, CAST(sum(n) AS BIGINT) AS bytes, min(turn) AS first_turn, max(turn) AS last_turn FROM m GROUP BY conv_id""")
def q_session_analytics(spark, d):
    m = load(spark, d, "conversations").select("conv_id", "role", F.octet_length("text").alias("n"), "turn", F.when(F.col("turn") % 3 == 0, F.col("turn") % 5 + 1).alias("rating"))
    asked = F.count_if(F.col("role") == "user")
    return m.groupBy("conv_id").agg(F.count("*").alias("moves"), asked.alias("asked"), F.round(asked / F.count("*"), 6).alias("share"), F.round(F.avg("rating"), 6).alias("rating"), F.sum("n").alias("bytes"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("q_preference", """WITH m AS (SELECT user_id, event_id % 81 AS place FROM events), f AS (SELECT user_id, count(*) FILTER (place // 9 BETWEEN 2 AND 6 AND place % 9 BETWEEN 2 AND 6) AS centre, count(*) AS n, count(*) FILTER (place // 9 < 4) AS early, count(*) FILTER (place // 9 > 4) AS late FROM m GROUP BY user_id)
 SELECT user_id, round((2 * centre - n)::DOUBLE / n, 6) AS centre_vs_edge, round(CASE WHEN early + late > 0 THEN (early - late)::DOUBLE / (early + late) ELSE 0 END, 6) AS begin_vs_end FROM f""")
def q_preference(spark, d):
    p = F.col("event_id") % 81
    row, column = F.floor(p / 9), p % 9
    f = load(spark, d, "events").groupBy("user_id").agg(F.count_if(row.between(2, 6) & column.between(2, 6)).alias("c"), F.count("*").alias("n"), F.count_if(row < 4).alias("e"), F.count_if(row > 4).alias("l"))
    ends = F.col("e") + F.col("l")
    return f.select("user_id", F.round((2 * F.col("c") - F.col("n")) / F.col("n"), 6).alias("centre_vs_edge"), F.round(F.when(ends > 0, (F.col("e") - F.col("l")) / ends).otherwise(0.0), 6).alias("begin_vs_end"))


@query("q_think_time", "SELECT event_id AS id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS gap_us FROM events")
def q_think_time(spark, d):
    e = load(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return running(e.select("user_id", "ts", "event_id", "us"), ["user_id"], ["ts", "event_id"], before=("lag", "us")).select(F.col("event_id").alias("id"), (F.col("us") - F.col("before")).alias("gap_us"))


@query("q_monotonic", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (us < before) AS backwards, count(*) FILTER (us - before > 100000) AS slow FROM e GROUP BY user_id")
def q_monotonic(spark, d):
    e = load(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = running(e.select("user_id", "event_id", "us"), ["user_id"], ["event_id"], before=("lag", "us"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("us") < F.col("before")).alias("backwards"), F.count_if(F.col("us") - F.col("before") > 100_000).alias("slow"))


@query("q_trailing_rate", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def q_trailing_rate(spark, d):
    return W.trailing_count(load(spark, d, "events"), 3600, "user_id").select(F.col("event_id").alias("id"), "recent")


@query("q_running_peak", "SELECT event_id AS id, max(value) OVER w AS peak, max(value) OVER l AS recent_peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def q_running_peak(spark, d):
    e = running(load(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], peak=("max", "value"))
    return trailing_max(e, ["user_id"], ["ts", "event_id"], "value", 100, "recent_peak").select(F.col("event_id").alias("id"), "peak", "recent_peak")


@query("q_slice_variance", f"WITH {CELLS} SELECT t, round(var_samp(w / 1000000.0::DOUBLE), 4) AS variance FROM cells GROUP BY t")
def q_slice_variance(spark, d):
    return cells(spark, d).groupBy("t").agg(F.round(F.var_samp(F.col("w") / 1e6), 4).alias("variance"))
