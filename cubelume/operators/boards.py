"""Boards of a cube as planes of features, a scorer to plug in, and the choice and mixing of weight vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Planes of a view or game, places of a board, and numbers of a board as a whole.
VIEW_PLANES, PLACES, GLOBALS = 22, 81, 19
# fixed values: the variance from which a place is one's own (below its half it is the other's), what komi is divided by, komi of the views,
# moves that are looked back on, and planes of each colour's moves
STONE, KOMI_UNIT, KOMI, MOVES, HISTORY = 0.5, 14.0, {"spatial": 5.5, "temporal": 7.0}, 10, 5
#: Planes of a place: on the board, own, other, empty, light, saturation, motion, and nine of the row it is in, one hot.
PLANES = 7 + 9


def feature_planes(cells: DataFrame, stone: str = "stone") -> DataFrame:
    """t and PLANES x 81 numbers of each layer, in order of place; cells: t, y, x, stone, light, saturation, motion."""
    s = F.col(stone)
    base = [F.lit(1.0), (s == "black").cast("double"), (s == "white").cast("double"), (s == "empty").cast("double"), F.col("light"), F.col("saturation"), F.col("motion")]
    one_hot = [(F.col("y") == i).cast("double") for i in range(9)]
    e = cells.select("t", F.struct((F.col("y") * 9 + F.col("x")).alias("place"), F.array(*base, *one_hot).alias("v")).alias("e"))
    return e.groupBy("t").agg(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["v"]).alias("planes"))  # 81 places a layer


def plain_scorer(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scorer that stands in for a model: policy by light x (0.5 + motion), value logits by stones. planes: 81 x PLANES."""
    raw = planes[:, 4] * (0.5 + planes[:, 6])
    policy = np.exp((raw - raw.max()) / 0.5)
    return policy / policy.sum(), np.array([planes[:, 1].sum(), planes[:, 2].sum(), planes[:, 3].sum()]) / len(planes)


def scored(planes: DataFrame, scorer: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = plain_scorer) -> DataFrame:
    """t, policy (81), value (3): a scorer of one's own is any function of 81 x PLANES numbers."""

    def each(s: pd.Series) -> pd.DataFrame:
        found = [scorer(np.array([list(v) for v in p])) for p in s]
        return pd.DataFrame({"policy": [f[0].tolist() for f in found], "value": [f[1].tolist() for f in found]})

    out = F.pandas_udf(each, "policy array<double>, value array<double>")(F.col("planes"))
    return planes.select("t", out.alias("o")).select("t", "o.policy", "o.value")


def evolved(pool: DataFrame, by: str, rate: float = 0.2, step: float = 0.1) -> DataFrame:
    """by, parents and a child of the two fittest of each group: crossed over, then mutated, both by hash of the parents' ids.
    pool: by, id, fitness, weights."""
    two = pool.groupBy(by).agg(F.max_by(F.struct("id", "weights"), F.struct("fitness", -F.col("id"))).alias("a"))
    rest = pool.join(two.select(by, F.col("a.id").alias("first")), by).where(F.col("id") != F.col("first"))
    second = rest.groupBy(by).agg(F.max_by(F.struct("id", "weights"), F.struct("fitness", -F.col("id"))).alias("b"))
    p = two.join(second, by).withColumn("key", F.concat_ws("-", F.col("a.id").cast("string"), F.col("b.id").cast("string")))
    child = p.withColumn("child", V.crossover(F.col("a.weights"), F.col("b.weights"), F.col("key"), 0.5))
    return child.select(by, F.col("a.id").alias("mother"), F.col("b.id").alias("father"), V.mutated(F.col("child"), F.col("key"), rate, step).alias("weights"))


def place_stats(cells: DataFrame, view: str) -> DataFrame:
    """view, place, intensity, variance, w, dominant (0, 1, 2: r, g, b; else null) of all 81 places of a cube.

    spatial: a place (y, x) over all layers; temporal: a row is a layer over all its places, which share its weight. Means are weighted, the variance is that of
    the cells of any weight about the weighted mean, as a share of 128², and at most 1. Sums are whole numbers in one pass; a place without any cell has zeros."""
    by = ["y", "x"] if view == "spatial" else ["t"]
    w = F.col("w")
    sums = [f.alias(f"{k}{c}") for c in "rgb" for k, f in (("s", F.sum(F.col(c).cast("long") * w)), ("a", F.sum(F.col(c).cast("long"))), ("q", F.sum(F.col(c).cast("long") * F.col(c))))]
    s = cells.where(w > 0).groupBy(*by).agg(F.sum("w").alias("w"), F.count("*").alias("n"), *sums)
    m = {c: F.col(f"s{c}") / F.col("w") for c in "rgb"}

    def spread(c: str) -> Column:
        return F.col(f"q{c}") - 2 * m[c] * F.col(f"a{c}") + F.col("n") * m[c] * m[c]

    variance = F.least(F.lit(1.0), (spread("r") + spread("g") + spread("b")) / (F.col("n") * 3) / (128.0 * 128.0))
    found = [((m["r"] + m["g"] + m["b"]) / 765.0).alias("intensity"), F.round(variance, 9).alias("variance"), F.when((m["r"] > m["g"]) & (m["r"] > m["b"]), 0).when(m["g"] > m["b"], 1).otherwise(2).alias("dominant")]
    if view == "spatial":
        s = s.select((F.col("y") * 9 + F.col("x")).alias("place"), "w", *found)
    else:
        s = s.select(F.explode(F.sequence(F.col("t") * 9, F.col("t") * 9 + 8)).alias("place"), (F.col("w") / 9).alias("w"), *found[:2], F.lit(None).cast("int").alias("dominant"))
    board = cells.sparkSession.range(PLACES).select(F.col("id").cast("int").alias("place"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("intensity", "variance", "w")]
    return board.join(F.broadcast(s), "place", "left").select(F.lit(view).alias("view"), "place", *zero, "dominant")  # 81 rows


def encoded(stats: DataFrame) -> DataFrame:
    """view, planes (22 of 81 numbers in order of place) and globals (19): mask, own, other, intensity, variance and their product; further ones are zero."""
    v, i = F.col("variance"), F.col("intensity")
    planes = [F.lit(1.0), (v > STONE).cast("double"), (v < STONE / 2).cast("double"), i, v, i * v]
    g = stats.groupBy("view").agg(F.sort_array(F.collect_list(F.struct("place", F.array(*planes).alias("v")))).alias("e"))  # 81 places a view
    none = F.array_repeat(F.lit(0.0), PLACES)

    def layer(k: int) -> Column:
        return F.transform("e", lambda x: x["v"][k])

    layers = F.array(*[layer(k) for k in range(len(planes))], *[none] * (VIEW_PLANES - len(planes)))
    komi = F.element_at(F.create_map(*[F.lit(x) for kv in KOMI.items() for x in kv]), F.col("view")) / KOMI_UNIT
    return g.select("view", layers.alias("planes"), F.concat(F.array(komi), F.array_repeat(F.lit(0.0), GLOBALS - 1)).alias("globals"))


def game_planes(moves: DataFrame, game: str, komi: Column) -> DataFrame:
    """game, plane, place, value: what isn't zero on the planes of each game after its last move, besides plane 0, which is one everywhere.

    moves: game, k (from 1), place, colour (black or white). Plane 1: places whose last stone is black, 2: white. 3 to 7 and 8 to 12: black and white
    moves among the last ten of a game, the first five of a colour, oldest first. Plane 22 stands for the numbers of a game as a whole: komi / 14, rules
    (1 from a komi of 7 on), who is to play (1: white). A long game is cut to its last moves in each task before it is shuffled."""
    black = F.col("colour") == "black"
    last = moves.groupBy(game, "place").agg(F.max_by("colour", "k").alias("colour"))
    stones = last.select(game, F.when(black, 1).otherwise(2).alias("plane"), "place", F.lit(1.0).alias("value"))
    late = moves.withColumn("back", F.row_number().over(Window.partitionBy(game).orderBy(F.desc("k")))).where(F.col("back") <= MOVES)
    nth = F.row_number().over(Window.partitionBy(game, "colour").orderBy("k"))
    history = late.withColumn("nth", nth).where(F.col("nth") <= HISTORY).select(game, (F.when(black, 2).otherwise(2 + HISTORY) + F.col("nth")).cast("int").alias("plane"), "place", F.lit(1.0).alias("value"))
    whole = moves.groupBy(game).agg(F.max_by("colour", "k").alias("colour")).withColumn("komi", komi)
    numbers = F.array(F.col("komi") / KOMI_UNIT, (F.col("komi") >= 7).cast("double"), black.cast("double"))
    return stones.unionByName(history).unionByName(whole.select(game, F.lit(VIEW_PLANES).alias("plane"), F.posexplode(numbers).alias("place", "value")))


def chosen(scores: DataFrame, pool: DataFrame, item: str, active: list[float] | None = None, sure: float = 0.6, second: float = 0.2, weight: float = 0.7) -> DataFrame:
    """item, first, choice (active, special, blend) and weights: of each kind of content the fittest of the pool; from a share of `sure` on that of the first
    kind; below it, if the second kind has more than `second`, first + (1 - weight) * (second - first); else that of the first. A kind that the pool lacks
    takes the fittest of all. A vector in use (active) comes before all.

    scores: item, kind, score; equal scores go by kind. pool: id, kind, fitness, weights. Only two rows an item are shuffled from each task."""
    best = F.max_by("weights", F.struct("fitness", -F.col("id")))
    kinds, general = pool.groupBy("kind").agg(best.alias("w")), pool.agg(best.alias("general"))
    at = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("score"), "kind"))
    two = scores.withColumn("at", at).where("at <= 2").join(kinds, "kind", "left").crossJoin(F.broadcast(general))  # one row
    one = F.struct("kind", "score", F.coalesce("w", "general").alias("w"))
    g = two.groupBy(item).agg(F.max(F.when(F.col("at") == 1, one)).alias("a"), F.max(F.when(F.col("at") == 2, one)).alias("b"))
    a, b = F.col("a"), F.col("b")
    blend = (a["score"] < sure) & F.coalesce(b["score"] > second, F.lit(False))
    mixed = F.zip_with(a["w"], b["w"], lambda x, y: x + (y - x) * (1.0 - weight))
    if active is not None:
        return g.select(item, a["kind"].alias("first"), F.lit("active").alias("choice"), F.array(*[F.lit(float(x)) for x in active]).alias("weights"))
    return g.select(item, a["kind"].alias("first"), F.when(blend, "blend").otherwise("special").alias("choice"), F.when(blend, mixed).otherwise(a["w"]).alias("weights"))
