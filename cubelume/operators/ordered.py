"""Numbers, ranks and running values in an order, without a window over all rows of a key.

Rows are dealt by ranges of (key, order), sorted there, numbered and written once, so that every later step sees the same parts. Each part is worked on by
itself; a key that goes on from one part to the next hands on one row of sums. At most one key crosses each border, so what is handed on is
fewer rows than there are parts, and is broadcast. A key may thus hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import kept

_PART_BITS = 33  # of monotonically_increasing_id()
#: What running() can follow: up to a row (max, min, sum, count, last known), before it (lag), and from it on (next known).
KINDS = ("max", "min", "sum", "count", "last", "lag", "next")


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in that order over all parts, written, with __id (rising in the order) and __part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [_column(c) for c in order]
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    return kept(rows.withColumn("__part", F.shiftright("__id", _PART_BITS).cast("int")), "dealt")


def numbered(df: DataFrame, *order: str | Column, out: str = "n") -> DataFrame:
    """df with the number of each row in the whole order, from 1. The order is total, or equal rows are numbered as they come to stand."""
    rows = dealt(df, *order)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a part
    at = F.col("__id").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return rows.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + at + 1).drop("__id", "__part", "__before")


def running(df: DataFrame, by: list[str], order: list[str | Column], **wanted: tuple[str, str | Column]) -> DataFrame:
    """df with a column for each of wanted, name=(kind, value), following the rows of each key (by, nulls are a key) in that order.

    Equal to windows over the key: max, min, sum, count and last (the last known value) up to a row, lag (the value before), next (the first known value
    from a row on). The order is total within a key."""
    values = {f"__v_{name}": _column(v) for name, (_, v) in wanted.items()}
    rows = dealt(df.withColumns(values), *by, *order)
    w = Window.partitionBy("__part", *by).orderBy("__id")
    up, down, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), F.col("__id")
    folds = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    local, chunk = {}, []
    for name, (kind, _) in wanted.items():
        v = F.col(f"__v_{name}")
        if kind in folds:
            local[f"__l_{name}"] = folds[kind](v).over(up)
            chunk.append(folds[kind](v).alias(f"__s_{name}"))
        elif kind == "lag":
            local[f"__l_{name}"] = F.lag(v).over(w)
            chunk.append(F.max_by(v, whole).alias(f"__s_{name}"))
        elif kind in ("last", "next"):
            local[f"__l_{name}"] = (F.last if kind == "last" else F.first)(v, True).over(up if kind == "last" else down)
            chunk.append((F.max_by if kind == "last" else F.min_by)(F.when(v.isNotNull(), v), F.when(v.isNotNull(), whole)).alias(f"__s_{name}"))
        else:
            raise ValueError(f"{kind} isn't one of {KINDS}")
    chunks = rows.groupBy(*by, "__part").agg(*chunk)
    over = Window.partitionBy(*by).orderBy("__part")
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    carried = {}
    for name, (kind, _) in wanted.items():
        s = F.col(f"__s_{name}")
        total = F.sum if kind == "count" else folds.get(kind)
        carried[f"__c_{name}"] = total(s).over(before) if total else F.lag(s).over(over) if kind == "lag" else F.last(s, True).over(before) if kind == "last" else F.first(s, True).over(after)
    carried["__chunks"] = F.count("*").over(Window.partitionBy(*by))
    borders = chunks.withColumns(carried).where("__chunks > 1")  # only keys of several parts: at most one for each border
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    borders = borders.select(*keys, F.col("__part").alias("__p"), *[f"__c_{name}" for name in wanted])
    same = (F.col("__part") == F.col("__p")) & F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    met = rows.withColumns(local | {"__first": F.row_number().over(w)}).join(F.broadcast(borders), same, "left")
    out = {}
    for name, (kind, _) in wanted.items():
        here, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind in ("max", "min"):
            out[name] = (F.greatest if kind == "max" else F.least)(here, carry)
        elif kind == "sum":
            out[name] = F.when(here.isNotNull() | carry.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        elif kind == "count":
            out[name] = here + F.coalesce(carry, F.lit(0))
        else:
            out[name] = F.when(F.col("__first") == 1, carry).otherwise(here) if kind == "lag" else F.coalesce(here, carry)
    return met.withColumns(out).select(*df.columns, *[n for n in wanted if n not in df.columns])


def trailing_max(df: DataFrame, by: list[str], order: list[str | Column], value: str, rows: int, out: str = "recent") -> DataFrame:
    """df with the largest value of each row and the rows - 1 before it in its key.

    Rows of a key stand in blocks of `rows`; a row's stretch is the block up to it and the end of the block before, so that two running
    maxima within blocks give it."""
    n = running(df, by, order, __n=("count", F.lit(1))).withColumns({"__block": F.expr(f"(__n - 1) div {rows}"), "__at": (F.col("__n") - 1) % rows})
    w = Window.partitionBy(*by, "__block").orderBy("__at")
    n = kept(n.withColumns({"__own": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__rest": F.max(value).over(w.rowsBetween(1, Window.unboundedFollowing))}), "blocks")
    before = n.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], (F.col("__block") + 1).alias("__b"), F.col("__at").alias("__a"), F.col("__rest").alias("__back")).where("__back IS NOT NULL")
    same = (F.col("__block") == F.col("__b")) & (F.col("__at") == F.col("__a"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return n.join(before, same, "left").withColumn(out, F.greatest("__own", "__back")).select(*df.columns, out)
