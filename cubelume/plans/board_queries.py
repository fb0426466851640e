"""Queries of boards, bindings of palettes to frames, and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import brightness, saturation
from ..functions.scoring import fitness, stone
from ..functions.vectors import dot
from ..operators import boards as B
from ..operators import cells as C
from ..operators import nearest as N
from ..operators import palettes as P
from ..operators import spatial as S
from ..operators.ordered import running
from ..operators.windows import shares
from ..sources.cubes import CELLS, FILLED, VOXEL, filled, load, voxels
from .cube_queries import cells
from .palette_queries import NEAR, palette
from .registry import query


@query("q_trace", f"WITH {FILLED} SELECT string_agg(f || ':' || r || ',' || g || ',' || b, ' ' ORDER BY f) AS trace FROM cube WHERE y = 10 AND x = 20")
def q_trace(spark, d):
    t = S.trace(filled(spark, d), 10, 20)
    one = lambda e: F.concat(e["f"].cast("string"), F.lit(":"), F.concat_ws(",", *[e[c].cast("string") for c in "rgb"]))
    return t.select(F.array_join(F.transform("trace", one), " ").alias("trace"))


@query("q_even_frames", f"WITH {VOXEL}, p AS (SELECT CAST(i AS INT) AS pick, CAST(i * 81 // 10 AS INT) AS f FROM range(10) t(i)) SELECT pick AS f, count(*) AS n, CAST(sum(r) AS BIGINT) AS r FROM voxel JOIN p USING (f) GROUP BY pick")
def q_even_frames(spark, d):
    return S.evenly(voxels(spark, d), 10).groupBy("f").agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@query("q_range_lineage", f"WITH {CELLS} SELECT c.cell, count(*) AS n, CAST(sum(v.r) AS BIGINT) AS r FROM cells c JOIN voxel v ON v.f BETWEEN c.t * 9 AND c.t * 9 + 8 AND v.y BETWEEN c.y * 9 AND c.y * 9 + 8 AND v.x BETWEEN c.x * 9 AND c.x * 9 + 8 GROUP BY c.cell")
def q_range_lineage(spark, d):
    of = P.sources_of_cells(cells(spark, d))
    v = voxels(spark, d).withColumn("cell", C.cell_key(C.at("f"), C.at("y"), C.at("x")))
    inside = F.col("f").between(F.col("f_first"), F.col("f_last"))
    return v.join(F.broadcast(of), "cell").where(inside).groupBy("cell").agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@query("q_conveyor", f"WITH {NEAR} SELECT f, CAST((idx + f * 3) % 64 AS INT) AS idx, count(*) AS n FROM voxel JOIN nn USING (r, g, b) GROUP BY 1, 2")
def q_conveyor(spark, d):
    return P.conveyor(N.nearest(voxels(spark, d), palette(spark, d)), 64, 3).groupBy("f", "idx").agg(F.count("*").alias("n"))


@query("q_hybrid_palettes", f"WITH {NEAR}, e AS (SELECT f, avg(sqrt(dist::DOUBLE)) AS error FROM voxel JOIN nn USING (r, g, b) GROUP BY f) SELECT f FROM e WHERE error > 30 ORDER BY f LIMIT 4")
def q_hybrid_palettes(spark, d):
    e = N.nearest(voxels(spark, d), palette(spark, d)).groupBy("f").agg(F.avg(F.sqrt(F.col("dist").cast("double"))).alias("error"))
    return P.override_frames(e, 30.0, 4)


def boards(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    m = C.motion(cells(spark, d)).withColumns({"light": brightness(*rgb), "saturation": saturation(*rgb)})
    return m.withColumn("stone", stone(F.col("light"), 0.51, 0.49))


@query("q_feature_planes", f"""WITH {CELLS} SELECT t, count(*) AS places, count(*) FILTER ((r + g + b) / 765.0::DOUBLE >= 0.51) AS black, round(sum((r + g + b) / 765.0::DOUBLE), 4) AS light FROM cells GROUP BY t""")
def q_feature_planes(spark, d):
    p = F.explode("planes").alias("p")
    return B.feature_planes(boards(spark, d)).select("t", p).groupBy("t").agg(F.count("*").alias("places"), F.count_if(F.col("p")[1] == 1).alias("black"), F.round(F.sum(F.col("p")[4]), 4).alias("light"))


def _view(view: str, key: str) -> str:
    m = {c: f"(sum({c} * w)::DOUBLE / sum(w)::DOUBLE)" for c in "rgb"}
    spread = " + ".join(f"(sum({c} * {c})::DOUBLE - 2 * {m[c]} * sum({c})::DOUBLE + count(*) * {m[c]} * {m[c]})" for c in "rgb")
    return f"SELECT '{view}' AS view, {key} AS k, ({m['r']} + {m['g']} + {m['b']}) / 765.0::DOUBLE AS i, round(least(1.0::DOUBLE, ({spread}) / (count(*) * 3) / 16384.0::DOUBLE), 9) AS v FROM cells WHERE w > 0 GROUP BY k"


@query("q_board_views", f"""WITH {CELLS}, s AS ({_view("spatial", "y * 9 + x")} UNION ALL {_view("temporal", "t")}),
 b AS (SELECT w.view, CAST(p AS INT) AS place, coalesce(i, 0) AS i, coalesce(v, 0) AS v FROM (SELECT unnest(['spatial', 'temporal']) AS view) w CROSS JOIN range(81) t(p) LEFT JOIN s ON s.view = w.view AND s.k = CASE WHEN w.view = 'spatial' THEN p ELSE p // 9 END)
 SELECT view, CAST(plane AS INT) AS plane, place, round(CASE plane WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN (v > 0.5)::INT WHEN 2 THEN (v < 0.25)::INT WHEN 3 THEN i WHEN 4 THEN v WHEN 5 THEN i * v ELSE 0 END, 6) AS value FROM b CROSS JOIN range(22) t(plane)
 UNION ALL SELECT w.view, 22, CAST(p AS INT), round(CASE WHEN p > 0 THEN 0.0::DOUBLE WHEN w.view = 'spatial' THEN 5.5::DOUBLE / 14 ELSE 7.0::DOUBLE / 14 END, 6) FROM (SELECT unnest(['spatial', 'temporal']) AS view) w CROSS JOIN range(19) t(p)""")
def q_board_views(spark, d):
    """All 22 planes of the cube's two views, and their 19 numbers as plane 22."""
    c = cells(spark, d)
    e = B.encoded(B.place_stats(c, "spatial").unionByName(B.place_stats(c, "temporal")))
    layers = e.select("view", F.posexplode(F.concat("planes", F.array("globals"))).alias("plane", "v"))
    return layers.select("view", "plane", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("q_game_planes", """WITH m AS (SELECT user_id AS game, CAST(event_id % 81 AS INT) AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 c AS (SELECT *, CASE WHEN k % 2 = 1 THEN 0 ELSE 1 END AS white, row_number() OVER (PARTITION BY game ORDER BY k DESC) AS back FROM m),
 h AS (SELECT *, row_number() OVER (PARTITION BY game, white ORDER BY k) AS nth FROM c WHERE back <= 10), e AS (SELECT game, max(k) AS n, game % 2 AS odd FROM m GROUP BY game)
 SELECT game, CAST(1 + arg_max(white, k) AS INT) AS plane, place, 1.0::DOUBLE AS value FROM c GROUP BY game, place
 UNION ALL SELECT game, CAST(2 + 5 * white + nth AS INT), place, 1.0::DOUBLE FROM h WHERE nth <= 5
 UNION ALL SELECT game, 22, 0, CASE WHEN odd = 1 THEN 7.0::DOUBLE ELSE 5.5::DOUBLE END / 14 FROM e UNION ALL SELECT game, 22, 1, odd::DOUBLE FROM e UNION ALL SELECT game, 22, 2, (n % 2)::DOUBLE FROM e""")
def q_game_planes(spark, d):
    """Each user's events as a game: the stones on its board, its last moves by colour, and its numbers."""
    e = load(spark, d, "events").select(F.col("user_id").alias("game"), "ts", "event_id")
    m = running(e, ["game"], ["ts", "event_id"], k=("count", F.lit(1)))
    moves = m.select("game", "k", (F.col("event_id") % 81).cast("int").alias("place"), F.when(F.col("k") % 2 == 1, "black").otherwise("white").alias("colour"))
    return B.game_planes(moves, "game", F.when(F.col("game") % 2 == 1, 7.0).otherwise(5.5))


@query("q_gene_choice", """WITH pool AS (SELECT s_suppkey AS id, s_nationkey % 5 AS kind, round(0.6::DOUBLE * ((s_suppkey * 37 % 100) / 100.0::DOUBLE) + 0.3::DOUBLE * ln(s_nationkey + 1.0::DOUBLE) / 10 + 0.1::DOUBLE * least(1.0::DOUBLE, (s_suppkey % 15) / 10.0::DOUBLE), 9) AS fitness FROM supplier),
 best AS (SELECT kind, id FROM pool QUALIFY row_number() OVER (PARTITION BY kind ORDER BY fitness DESC, id) = 1), general AS (SELECT id AS any_id FROM pool ORDER BY fitness DESC, id LIMIT 1),
 n AS (SELECT o_custkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS kind, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT id, kind, n::DOUBLE / sum(n) OVER (PARTITION BY id) AS score FROM n),
 r AS (SELECT s.*, coalesce(best.id, any_id) AS gene, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, s.kind) AS at FROM s LEFT JOIN best USING (kind) CROSS JOIN general),
 t AS (SELECT a.id, a.kind AS first, a.gene AS x, b.gene AS y, CASE WHEN a.score < 0.6::DOUBLE AND coalesce(b.score > 0.2::DOUBLE, false) THEN 'blend' ELSE 'special' END AS choice FROM r a LEFT JOIN r b ON b.id = a.id AND b.at = 2 WHERE a.at = 1)
 SELECT id, first, choice, round(list_sum(list_transform(range(1, 10), lambda i: i * CASE WHEN choice = 'blend' THEN (x * i % 97) / 97.0::DOUBLE + ((y * i % 97) / 97.0::DOUBLE - (x * i % 97) / 97.0::DOUBLE) * 0.3::DOUBLE ELSE (x * i % 97) / 97.0::DOUBLE END)), 6) AS digest FROM t""")
def q_gene_choice(spark, d):
    """Each customer's orders by priority as shares of five kinds of content, and the weights that are chosen or blended for them."""
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("kind")).agg(F.count("*").alias("n"))
    scores = shares(n, "n", "id").select("id", "kind", F.col("share").alias("score"))
    places = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("double"))
    return B.chosen(scores, pool(spark, d), "id").select("id", "first", "choice", F.round(dot(F.col("weights"), places), 6).alias("digest"))


@query("q_scored_boards")
def q_scored_boards(spark, d):
    s = B.scored(B.feature_planes(boards(spark, d)))
    return s.select("t", F.transform("policy", lambda x: F.round(x, 9)).alias("policy"), F.transform("value", lambda x: F.round(x, 9)).alias("value"))


def pool(spark, d):
    s = load(spark, d, "supplier")
    weights = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: (F.col("s_suppkey") * i % 97) / 97.0)
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("kind"), F.round(fitness((F.col("s_suppkey") * 37 % 100) / 100.0, F.col("s_nationkey"), F.col("s_suppkey") % 15), 9).alias("fitness"), weights.alias("weights"))


@query("q_evolve")
def q_evolve(spark, d):
    return B.evolved(pool(spark, d), "kind")
