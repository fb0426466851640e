"""Analytic operators: softmax, ranks, normalisation, interpolation, folds, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def softmax(df: DataFrame, value: str, *by: str, temperature: float = 1.0, out: str = "softmax") -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp((F.col(value) - F.max(value).over(w)) / temperature)
    return df.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def ranked(df: DataFrame, score: str, *by: str, key: str, out: str = "rank") -> DataFrame:
    """1 for the largest score; ties by key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key)))


def min_max(df: DataFrame, value: str, *by: str, out: str = "scaled") -> DataFrame:
    """To 0 to 1; unchanged where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value)))


def shares(df: DataFrame, value: str, *by: str, out: str = "share") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))


def entropy(df: DataFrame, weight: str, *by: str) -> DataFrame:
    """Entropy (bits) of the weights of each group, and that as a share of the largest."""
    p = F.col("share")
    e = shares(df, weight, *by).where(p > 0).groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("h"), F.count("*").alias("k"))
    return e.select(*by, F.round("h", 8).alias("entropy"), F.round(F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0), 8).alias("normalised"))


def anchored(df: DataFrame, score: str, slice_: str, *by: str, budget: int, anchors: tuple[int, ...] = (0, 4, 8)) -> DataFrame:
    """The anchors always, then by score, up to the budget (at least the anchors)."""
    w = Window.partitionBy(*by).orderBy(F.col(slice_).isin(*anchors).desc(), F.desc(score), slice_)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= max(budget, len(anchors)))


def split_budget(budget: int) -> tuple[int, int]:
    """Clamped to 6 to 18; for the two axes."""
    budget = max(6, min(18, budget))
    first = max(3, budget // 2)
    return first, budget - first


def interpolated(df: DataFrame, value: str, order: str, *by: str, fallback: Column | None = None, out: str = "filled") -> DataFrame:
    """Nulls of value become the straight line between the nearest known on both sides; at an end the nearest; none known: the fallback.
    Rows of a group are followed in parts, so that a group may hold any number of them."""
    at = F.when(F.col(value).isNotNull(), F.col(order))
    d = running(df, list(by), [order], __v0=("last", value), __v1=("next", value), __o0=("last", at), __o1=("next", at))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * ((F.col(order) - F.col("__o0")) / (F.col("__o1") - F.col("__o0")))
    known = F.coalesce(F.col(value), line, "__v0", "__v1", fallback if fallback is not None else F.lit(None))
    return d.withColumn(out, known).drop("__v0", "__v1", "__o0", "__o1")


def interleaved(a: DataFrame, b: DataFrame, score: str, key: str) -> DataFrame:
    """Two ranked lists one by one: side 0 before side 1 at each rank."""
    sides = [d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).withColumn("side", F.lit(i)) for i, d in enumerate((a, b))]
    both = sides[0].unionByName(sides[1])
    return both.withColumn("seq", F.row_number().over(Window.orderBy("rank", "side")))


def _blocks(df: DataFrame, order: list[str], value: str, by: tuple[str, ...], block: Column) -> tuple[DataFrame, Column]:
    """df grouped by by and block, and the values of a group in order."""
    named = df.withColumn("__block", block)
    return named.groupBy(*by, "__block"), F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v"))))


def hours(ts: str) -> Column:
    """Number of the hour: a block for folds in order of time."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 3_600_000_000)


def folded(df: DataFrame, value: str, order: list[str], *by: str, alpha: float, start: float = 0.5, out: str = "ewma", block: Column | None = None) -> DataFrame:
    """q <- (1 - alpha) q + alpha value in order, one number for each group.

    block is a number that never falls in that order (hours of a time, by default of the first of order): each block of a group is folded
    on its own to one row, and blocks are put together from their sums and lengths, so that a group may hold any number of rows."""
    groups, items = _blocks(df, order, value, by, hours(order[0]) if block is None else block)
    keep = 1 - alpha
    part = groups.agg(F.aggregate(items, F.lit(0.0), lambda q, e: q * keep + e["__v"] * alpha).alias("s"), F.count("*").alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("__block", "s", "n")))
    whole = F.aggregate(parts, F.lit(float(start)), lambda q, e: q * F.pow(F.lit(keep), e["n"]) + e["s"])
    return part.groupBy(*by).agg(whole.alias(out), F.sum("n").alias("n"))


def momentum(df: DataFrame, value: str, order: list[str], *by: str, decay: float = 0.9, rate: float = 0.01, block: Column | None = None) -> DataFrame:
    """v <- decay v + g; x <- x + rate v; and a running mean of g² (decay again), in order; by blocks as folded().

    A block of n rows that starts with v adds decay + ... + decay^n times v to the sum of its velocities."""
    groups, items = _blocks(df, order, value, by, hours(order[0]) if block is None else block)

    def state(v: Column, x: Column, s: Column) -> Column:
        return F.struct(v.alias("v"), x.alias("x"), s.alias("s"))

    def move(q: Column, e: Column) -> Column:
        v = q["v"] * decay + e["__v"]
        return state(v, q["x"] + v * rate, q["s"] * decay + e["__v"] * e["__v"] * (1 - decay))

    def follow(q: Column, e: Column) -> Column:
        left = F.pow(F.lit(decay), e["n"])
        run = (1 - left) * (decay / (1 - decay)) if decay != 1 else e["n"].cast("double")
        return state(q["v"] * left + e["q"]["v"], q["x"] + q["v"] * run * rate + e["q"]["x"], q["s"] * left + e["q"]["s"])

    zero = state(*[F.lit(0.0)] * 3)
    part = groups.agg(F.aggregate(items, zero, move).alias("q"), F.count("*").alias("n"))
    whole = part.groupBy(*by).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("__block", "n", "q"))), zero, follow).alias("q"))
    return whole.select(*by, F.col("q.v").alias("velocity"), F.col("q.x").alias("position"), F.col("q.s").alias("fisher"))


def trailing_count(df: DataFrame, seconds: int, *by: str, ts: str = "ts", out: str = "recent") -> DataFrame:
    """Rows of the group in the seconds up to and with each row's."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("__us", us).withColumn(out, F.count("*").over(Window.partitionBy(*by).orderBy("__us").rangeBetween(-seconds * 1_000_000, 0))).drop("__us")


def largest_remainder(df: DataFrame, weight: str, key: str, total: int, out: str = "allocated") -> DataFrame:
    """Floor shares, at least 1 where there is weight; what is missing goes one by one to the heaviest, what is too much is taken
    from the lightest that have more than 1 (once each)."""
    every = Window.partitionBy(F.lit(1))
    base = F.floor(F.col(weight) * total / F.sum(weight).over(every))
    d = df.withColumn("__a", F.when((base == 0) & (F.col(weight) > 0), 1).otherwise(base).cast("long"))
    d = d.withColumn("__d", F.lit(total) - F.sum("__a").over(every)).withColumn("__n", F.count("*").over(every))
    d = d.withColumn("__up", F.row_number().over(Window.orderBy(F.desc(weight), key)) - 1)
    can = (F.col("__a") > 1).cast("int")
    d = d.withColumn("__down", F.sum(can).over(Window.orderBy(weight, key).rowsBetween(Window.unboundedPreceding, 0)))
    more = F.floor((F.col("__d") - 1 - F.col("__up")) / F.col("__n")) + 1
    change = F.when(F.col("__d") > 0, F.greatest(more, F.lit(0))).when((F.col("__d") < 0) & (can == 1) & (F.col("__down") <= -F.col("__d")), -1).otherwise(0)
    return d.withColumn(out, (F.col("__a") + change).cast("long")).drop("__a", "__d", "__n", "__up", "__down")
