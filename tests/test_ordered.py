"""Numbers and running values by parts against windows, with a key that holds half of all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cubelume.operators import ordered as O
from cubelume.operators import windows as W


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(1)
    keys = ["hot"] * 600 + [dice.choice(["a", "b", None, *map(str, range(40))]) for _ in range(600)]
    out = [(i, k, dice.randrange(300), dice.choice([None, dice.uniform(-5, 5), dice.uniform(-5, 5)])) for i, k in enumerate(keys)]
    dice.shuffle(out)
    return spark.createDataFrame(out, "id long, k string, t long, v double").cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    one, two = ({tuple(str(x) for x in r): 0 for r in d.select(sorted(d.columns)).collect()} for d in (a, b))
    assert one.keys() == two.keys()


def test_running_values(rows):
    got = O.running(rows, ["k"], ["t", "id"], top=("max", "v"), low=("min", "v"), n=("count", "v"), known=("last", "v"), before=("lag", "v"), ahead=("next", "v"), whole=("sum", F.col("id")))
    w = Window.partitionBy("k").orderBy("t", "id")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumns({"top": F.max("v").over(up), "low": F.min("v").over(up), "n": F.count("v").over(up), "known": F.last("v", True).over(up), "before": F.lag("v").over(w), "ahead": F.first("v", True).over(down), "whole": F.sum("id").over(up)})
    same(got, want)
    assert got.count() == rows.count()


def test_of_all_rows_and_of_none(rows):
    got = O.running(rows, [], ["t", "id"], top=("max", "v"))
    same(got, rows.withColumn("top", F.max("v").over(Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0))))
    assert O.running(rows.limit(0), ["k"], ["id"], top=("max", "v")).count() == 0 and O.numbered(rows.limit(0), "id").count() == 0
    with pytest.raises(ValueError, match="median"):
        O.running(rows, ["k"], ["id"], x=("median", "v"))


def test_numbers(rows):
    same(O.numbered(rows, F.desc("t"), "id"), rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("t"), "id"))))


@pytest.mark.parametrize("n", [1, 7, 100])
def test_trailing_maximum(rows, n):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(1 - n, 0)
    same(O.trailing_max(rows, ["k"], ["t", "id"], "v", n), rows.withColumn("recent", F.max("v").over(w)))


def test_no_part_holds_the_hot_key(rows):
    parts = O.dealt(rows, "k", "t", "id").groupBy("__part").count().collect()
    assert len(parts) > 4 and max(p["count"] for p in parts) < 450


def test_interpolation_by_parts(spark, rows):
    at = rows.select("k", "id", "v")
    got = {(r.k, r.id): r.filled for r in W.interpolated(at, "v", "id", "k", fallback=F.lit(-1.0)).collect()}
    known = {}
    for r in at.orderBy("id").collect():
        known.setdefault(r.k, []).append((r.id, r.v))
    for k, items in known.items():
        have = [(i, v) for i, v in items if v is not None]
        for i, v in items:
            before, after = [h for h in have if h[0] <= i][-1:], [h for h in have if h[0] >= i][:1]
            if v is not None or not have:
                want = v if have else -1.0
            elif before and after:
                want = before[0][1] + (after[0][1] - before[0][1]) * (i - before[0][0]) / (after[0][0] - before[0][0])
            else:
                want = (before or after)[0][1]
            assert got[k, i] == pytest.approx(want)
