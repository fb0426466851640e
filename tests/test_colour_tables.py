"""Palettes and colours from one table of colours."""

from collections import Counter

import duckdb
import pytest

from cubelume.operators import nearest as N
from cubelume.operators import palettes as P
from cubelume.plans import catalog
from cubelume.plans.palette_queries import palette
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_nearest", "q_lut_vs_nn"])
def test_voxels_are_read_once(spark, sf_dir, name):
    """The query reads the colours that were written, and deals out nothing for them again."""
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.inputFiles() and all("/kept-" in f for f in df.inputFiles())
    assert "Exchange hashpartitioning" not in plan_of(df)


def test_a_palette_sorts_no_table_of_colours(spark, sf_dir):
    for df in (palette(spark, sf_dir), palette(spark, sf_dir).select("idx", "r", "g", "b").where("r IS NOT NULL")):
        assert "TakeOrderedAndProject(limit=64" in plan_of(df) and "rangepartitioning" not in plan_of(df)


def test_colours_of_negative_and_missing_channels(spark):
    rows = [(0, 255, 255, 255), (1, 255, 255, 255), (2, -255, -1, 0), (3, 0, 0, 0), (4, -1, 255, -255), (5, 0, -1, 255), (6, None, 1, 1), (7, 2, None, 2), (8, -255, -1, 0)]
    found = P.colours(spark.createDataFrame(rows, "f int, r int, g int, b int"), 1 + F.col("f")).collect()
    want = Counter()
    for f, *c in rows:
        want[None if None in c else tuple(c)] += 1 + f
    assert {None if r.r is None else (r.r, r.g, r.b): r.weight for r in found} == want and len(found) == len(want)
    assert all(r.argb == (None if r.r is None else r.r * 65536 + r.g * 256 + r.b) for r in found)
    small = P.top(spark.createDataFrame(found, "r int, g int, b int, weight long, argb long").where("r IS NOT NULL"), 2).collect()
    assert [tuple(r)[2:] for r in small] == [(-255, -1, 0, 12), (0, -1, 255, 6)]


def test_nearest_colours_of_negative_keys_are_those_of_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT CAST(i * 7919 - 400000 AS BIGINT) AS l_orderkey, CAST(i * 31 % 977 - 400 AS BIGINT) AS l_partkey, CAST(i * 13 % 101 - 50 AS BIGINT) AS l_suppkey, CAST(i % 7 + 1 AS INT) AS l_linenumber
     FROM (SELECT i % 400 + (i % 3) * (i // 400) AS i FROM range(1500) t(i))) TO '{tmp_path}/lineitem.parquet' (FORMAT PARQUET)""")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(catalog.ORACLE["q_nearest"]).fetchall()
    found = [tuple(r) for r in catalog.QUERIES["q_nearest"](spark, str(tmp_path)).collect()]
    assert min(min(x[:3]) for x in want) < 0 and sorted(found) == sorted(want)


def test_batches_of_many_pieces(spark):
    """Pieces of 1 024 rows, one of them with colours beyond a byte, leave each row with its own palette colour."""
    v = spark.range(0, 5000, 1, 1).selectExpr("cast(id as int) AS f", "cast(id % 256 as int) AS r", "cast(id * 7 % 256 as int) AS g", "cast(if(id = 3000, 900, id * 31 % 256) as int) AS b")
    p = [(3 * i, i * 37 % 256, i * 91 % 256, i * 53 % 256) for i in range(40)]
    found = N.nearest(v, spark.createDataFrame(p, "idx int, r int, g int, b int")).collect()
    assert len(found) == 5000
    for x in found:
        assert (x.dist, x.idx) == min(((x.r - r) ** 2 + (x.g - g) ** 2 + (x.b - b) ** 2, i) for i, r, g, b in p) and x.r == x.f % 256
