"""Octrees and median cuts of colours by sums in Spark, for groups with any number of colours.

A colour's path through the octree is its bits, three a level, in one number; a node is a prefix of it. Folding goes from the deepest level
up, so that all levels below some depth are folded whole, all above it aren't touched, and one level's nodes are folded in order until few enough leaves are left.
Which level that is follows from the number of nodes of each level, and only that level's nodes (8 k at most) and their parents (k) are ranked.

Boxes of a median cut are cut in rounds: sums and bounds of each new box, weights by value of its longest axis, and the order of the colours of one value only. A round cuts
all boxes that the next cuts may fall on, so that k boxes take some log k rounds; which cuts count is decided from the boxes (some k rows a group). Where there are few boxes and
colours are bytes, the cuts so far go to the tasks, which find each row's box and count its values by themselves: rows are written once, and neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import luma_milli
from ..runtime import kept

LEVELS = 8
#: Nodes of this depth are what the counts of deeper levels are dealt by: each holds 4 096 colours at most.
DEALT = 4
GROUPS_BROADCAST = 10_000


def _code(lowest_bit_first: bool):
    """The path as a number, the first level in its highest bits."""
    total = F.lit(0).cast("long")
    for level in range(LEVELS):
        i = level if lowest_bit_first else LEVELS - 1 - level
        for c, at in zip("rgb", (2, 1, 0), strict=True):
            total = total + F.shiftleft(F.shiftright(c, i).bitwiseAND(1).cast("long"), 3 * (LEVELS - 1 - level) + at)
    return total


def node_counts(colours: DataFrame, by: list[str]) -> DataFrame:
    """by..., n1 to n8: nodes of each depth, from distinct colours with their code."""
    top, before = F.shiftright("code", 3 * (LEVELS - DEALT)).alias("top"), F.lag("code").over(Window.partitionBy(*by, "top").orderBy("code"))
    near = colours.select(*by, top, "code").withColumn("before", before)
    deep = range(DEALT + 1, LEVELS + 1)
    new = {d: F.sum(F.coalesce((F.shiftright("code", 3 * (LEVELS - d)) != F.shiftright("before", 3 * (LEVELS - d))).cast("long"), F.lit(1))) for d in deep}
    per = near.groupBy(*by, "top").agg(*[new[d].alias(f"n{d}") for d in deep])
    high = [F.count_distinct(F.shiftright("top", 3 * (DEALT - d))).alias(f"n{d}") for d in range(1, DEALT + 1)]
    return per.groupBy(*by).agg(*high, *[F.sum(f"n{d}").alias(f"n{d}") for d in deep])


def octree(df: DataFrame, by: list[str], k: int, weight: str | None = None, lowest_bit_first: bool = False) -> DataFrame:
    """by..., idx, r, g, b: up to k colours of each group. Leaves are colours' 8 levels of bits; while there are more than k, the deepest
    node whose luminance x count is least folds its leaves. By count, then by the sums. lowest_bit_first keeps an old order of levels.

    Defined results: rows without a colour aren't counted; a group of k colours or fewer keeps them; null groups are groups."""
    n = F.sum(weight).cast("long") if weight else F.count("*")
    known = df.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    colours = kept(known.groupBy(*by, "r", "g", "b").agg(n.alias("n")).withColumn("code", _code(lowest_bit_first)), "octree-colours")
    counts = node_counts(colours, by)
    depth, over = F.lit(LEVELS + 1), F.lit(None).cast("long")
    for d in range(LEVELS, 0, -1):
        depth, over = F.when(F.col(f"n{d}") > k, d).otherwise(depth), F.when(F.col(f"n{d}") > k, F.col(f"n{d}") - k).otherwise(over)
    levels = kept(counts.select(*[F.col(c).alias(f"__{c}") for c in by], depth.alias("depth"), over.alias("over")), "octree-levels")
    few = levels.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    met = colours.join(F.broadcast(levels) if few else levels, same) if by else colours.crossJoin(F.broadcast(levels))  # one row
    met = met.drop(*[f"__{c}" for c in by])
    prefix = F.expr(f"shiftright(code, 3 * ({LEVELS} - least(depth, {LEVELS})))").alias("node")
    sums = [*[F.sum(F.col(c).cast("long") * F.col("n")).alias(c) for c in "rgb"], F.sum("n").alias("n")]
    nodes = met.groupBy(*by, "depth", "over", prefix).agg(*sums).withColumn("parent", F.shiftright("node", 3))
    family = Window.partitionBy(*by, "parent")
    nodes = nodes.withColumns({f"p{c}": F.sum(c).over(family) for c in "rgbn"} | {"children": F.count("*").over(family), "child": F.row_number().over(family.orderBy("node"))})
    order = Window.partitionBy(*by).orderBy(luma_milli(F.col("pr"), F.col("pg"), F.col("pb")), "parent", "node").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sum(F.when(F.col("child") == 1, F.col("children") - 1).otherwise(0)).over(order) - (F.col("children") - 1)  # leaves fewer once the parents before are folded
    nodes = nodes.withColumn("folds", (F.col("depth") <= LEVELS) & (gone < F.col("over")))
    leaves = nodes.where("NOT coalesce(folds, false) OR child = 1").select(*by, *[F.when(F.col("folds"), F.col(f"p{c}")).otherwise(F.col(c)).alias(c) for c in "rgbn"])
    idx = (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "r", "g", "b")) - 1).cast("int").alias("idx")
    return leaves.select(*by, idx, *[F.expr(f"CAST({c} div n AS INT)").alias(c) for c in "rgb"])


def octree_sql(colours: str, by: str, k: int) -> str:
    """The same as SQL (the highest bit first): colours is a relation of by, r, g, b, n, a row a colour."""
    bits = " + ".join(f"(((r >> {i} & 1) * 4 + (g >> {i} & 1) * 2 + (b >> {i} & 1)) << {3 * i})" for i in range(LEVELS))
    return f"""oc AS (SELECT {by}, r, g, b, n, CAST({bits} AS BIGINT) AS code FROM {colours}), ol AS (SELECT {by}, d, count(DISTINCT code >> (3 * ({LEVELS} - d))) AS nd FROM oc, range(1, {LEVELS + 1}) t(d) GROUP BY {by}, d),
 os AS (SELECT {by}, coalesce(min(d) FILTER (nd > {k}), {LEVELS + 1}) AS depth, min(nd) FILTER (nd > {k}) - {k} AS over FROM ol GROUP BY {by}),
 oh AS (SELECT {by}, depth, over, code >> (3 * ({LEVELS} - least(depth, {LEVELS}))) AS node, sum(r * n) AS r, sum(g * n) AS g, sum(b * n) AS b, sum(n) AS n FROM oc JOIN os USING ({by}) GROUP BY {by}, depth, over, node),
 op AS (SELECT {by}, depth, over, node >> 3 AS parent, sum(r) AS r, sum(g) AS g, sum(b) AS b, sum(n) AS n, count(*) AS children FROM oh GROUP BY {by}, depth, over, parent),
 og AS (SELECT *, depth <= {LEVELS} AND coalesce(sum(children - 1) OVER (PARTITION BY {by} ORDER BY r * 299 + g * 587 + b * 114, parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < over AS folds FROM op),
 leaf AS (SELECT {by}, r, g, b, n FROM og WHERE folds UNION ALL SELECT oh.{by}, oh.r, oh.g, oh.b, oh.n FROM oh JOIN og ON oh.{by} = og.{by} AND oh.node >> 3 = og.parent WHERE NOT coalesce(og.folds, false))
 SELECT {by}, CAST(row_number() OVER (PARTITION BY {by} ORDER BY n DESC, r, g, b) - 1 AS INT) AS idx, CAST(r // n AS INT) AS r, CAST(g // n AS INT) AS g, CAST(b // n AS INT) AS b FROM leaf"""


# ---- median cut
BOX = "g string, box string, width int, axis int, cut long, n long, r long, g_ long, b long"


def _measured(colours: DataFrame) -> DataFrame:
    """colours (g, box, cr, cg, cb, n) -> BOX: sums, the longest axis (the first of equals), and the key of the last colour of its lower half. The key
    of a colour is its value on the axis and then the colour; the upper half has one colour at least."""
    c = [F.col(f"c{x}") for x in "rgb"]
    wide = [F.max(x) - F.min(x) for x in c]
    stats = colours.groupBy("g", "box").agg(F.sum("n").alias("n"), *[F.sum(x.cast("long") * F.col("n")).alias(a) for x, a in zip(c, ("r", "g_", "b"), strict=True)], *[w.alias(f"w{i}") for i, w in enumerate(wide)])
    width = F.greatest("w0", "w1", "w2")
    stats = kept(stats.withColumn("width", width).withColumn("axis", F.when(F.col("w0") == width, 0).when(F.col("w1") == width, 1).otherwise(2)), "box-sums")
    cut = _beside(colours, stats.where("width > 0").select("g", "box", "axis", F.col("n").alias("of")), ["g", "box"])
    cut = cut.select("g", "box", "of", "n", F.element_at(F.array(*c), F.col("axis") + 1).alias("value"), (c[0] * 65536 + c[1] * 256 + c[2]).alias("rgb"))
    values = cut.groupBy("g", "box", "value").agg(F.sum("n").alias("n"), F.max("of").alias("of"))
    w = Window.partitionBy("g", "box")
    run = F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("run", run).withColumn("last", F.max("value").over(w)).where("run * 2 >= of").groupBy("g", "box").agg(F.min(F.struct("value", (F.col("run") - F.col("n")).alias("before"), "last")).alias("v"))
    values = kept(values.select("g", "box", F.col("v.value").alias("at"), "v.before", "v.last"), "box-values")
    tied = _beside(cut, values, ["g", "box"]).where(F.col("value") == F.col("at"))
    run = F.col("before") + F.sum("n").over(w.orderBy("rgb").rowsBetween(Window.unboundedPreceding, 0))
    tied = tied.withColumn("run", run).withColumn("end", (F.col("at") == F.col("last")) & (F.col("rgb") == F.max("rgb").over(w))).where("run * 2 >= of")
    cuts = tied.groupBy("g", "box").agg(F.min(F.struct(F.shiftleft(F.col("at").cast("long"), 24).bitwiseOR(F.col("rgb").cast("long")).alias("key"), "end")).alias("k"))
    cuts = cuts.select("g", "box", F.when(F.col("k.end"), F.col("k.key") - 1).otherwise(F.col("k.key")).alias("cut"))
    return stats.join(cuts, ["g", "box"], "left").select("g", "box", "width", "axis", "cut", "n", "r", "g_", "b")


def _beside(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of a row a box, which is broadcast where it is seen to be small."""
    return rows.join(F.broadcast(few) if few.limit(BOXES_BROADCAST + 1).count() <= BOXES_BROADCAST else few, on, how)


BOXES_BROADCAST = 100_000


def _followed(boxes: pd.DataFrame, k: int) -> tuple[list[str], list[str]]:
    """The boxes that are left when the widest (the first of equals) is cut until there are k, as far as cuts are known; and those to cut next."""
    width = dict(zip(boxes.box, boxes.width, strict=True))
    leaves = [""]
    while len(leaves) < k:
        best = max(range(len(leaves)), key=lambda i: (width[leaves[i]], -i))
        at = leaves[best]
        if width[at] == 0:
            return leaves, []
        if at + "0" not in width:
            uncut = sorted((x for x in leaves if width[x] > 0 and x + "0" not in width), key=lambda x: (-width[x], x))
            return leaves, uncut[: k - len(leaves)]
        leaves[best : best + 1] = [at + "0", at + "1"]
    return leaves, []


class _Cuts:
    """The cuts of a forest so far, for tasks: a node's axis (less than 0: it isn't cut), the key of the last colour of its lower half, and its halves."""

    def __init__(self, groups: int):
        self.axis, self.cut, self.halves = np.full(groups, -1), np.zeros(groups, np.int64), np.zeros((groups, 2), np.int64)
        self.of = [(g, "") for g in range(groups)]

    def add(self, node: int, axis: int, cut: int) -> list[int]:
        new = [len(self.of), len(self.of) + 1]
        self.of += [(self.of[node][0], self.of[node][1] + half) for half in "01"]
        self.axis, self.cut, self.halves = np.r_[self.axis, -1, -1], np.r_[self.cut, 0, 0], np.r_[self.halves, [[0, 0]] * 2]
        self.axis[node], self.cut[node], self.halves[node] = axis, cut, new
        return new

    def boxes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each row of packed voxels: the node each voxel is in, and the three channels."""
        for b in batches:
            for groups, colours in zip(b.column("groups"), b.column("colours"), strict=True):
                yield self._of(np.frombuffer(groups.as_buffer(), np.int32).astype(np.int64), np.frombuffer(colours.as_buffer(), np.int32).astype(np.int64))

    def _of(self, node: np.ndarray, rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255])
        while len(at := np.flatnonzero(self.axis[node] >= 0)):
            here = node[at]
            node[at] = self.halves[here, ((c[self.axis[here], at] << 24 | rgb[at]) > self.cut[here]).astype(int)]
        return node, c


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch of voxels (group, rgb) a row, which is read many times."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy().astype(np.int32).tobytes()], pa.binary()) for c in ("group", "rgb")], ["groups", "colours"])


def _measured_in_place(rows: DataFrame, cuts: _Cuts, new: list[int]) -> dict[int, tuple]:
    """node -> width, axis, cut, n, r, g, b of new boxes, as in _measured: one scan for the values of all axes, one for the colours of one value only."""
    slot = np.full(len(cuts.of), -1)
    slot[new] = np.arange(len(new))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(sums: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at // 768), pa.array(at // 256 % 3), pa.array(at % 256), pa.array(sums)], ["slot", "axis", "value", "n"])

        whole = np.zeros(len(new) * 768, np.int64) if len(new) <= HELD else None
        for node, c in cuts.boxes(batches):
            inside = np.flatnonzero(slot[node] >= 0)
            at = slot[node[inside]] * 768 + np.array([[0], [256], [512]]) + c[:, inside]
            if whole is not None:
                np.add.at(whole, at.ravel(), 1)
            else:
                few, sums = np.unique(at.ravel(), return_counts=True)
                yield cells(sums, few)
        if whole is not None and len(at := np.flatnonzero(whole)):
            yield cells(whole[at], at)

    def box(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        axes = [d[d.axis == i].sort_values("value") for i in range(3)]
        wide = [int(x.value.iloc[-1] - x.value.iloc[0]) for x in axes]
        axis, n = wide.index(max(wide)), int(axes[0].n.sum())
        run = axes[axis].n.cumsum()
        at = int(np.argmax((run * 2 >= n).to_numpy()))
        v = axes[axis].value
        return pd.DataFrame([[key[0], max(wide), axis, n, *(int((x.value * x.n).sum()) for x in axes), int(v.iloc[at]), int(run.iloc[at] - axes[axis].n.iloc[at]), int(v.iloc[-1])]], columns=[c.split()[0] for c in PLACED.split(", ")])

    counts = rows.mapInArrow(values, "slot long, axis long, value long, n long").groupBy("slot", "axis", "value").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r for r in counts.groupBy("slot").applyInPandas(box, PLACED).collect()}  # a row a box
    axis, value = np.full(len(new), -1), np.full(len(new), -1)
    for i, r in found.items():
        if r["width"]:
            axis[i], value[i] = r["axis"], r["at"]

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, c in cuts.boxes(batches):
            i = slot[node]
            tied = np.flatnonzero((i >= 0) & (axis[i] >= 0) & (c[axis[i], np.arange(len(i))] == value[i]))
            rgb = c[0, tied] * 65536 + c[1, tied] * 256 + c[2, tied]
            both, n = np.unique(i[tied] << 24 | rgb, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 24), pa.array(both & 0xFFFFFF), pa.array(n)], ["slot", "rgb", "n"])

    tied = rows.mapInArrow(ties, "slot long, rgb long, n long").groupBy("slot", "rgb").agg(F.sum("n").alias("n"))
    places = rows.sparkSession.createDataFrame([(i, r["before"], r["n"]) for i, r in found.items()], "slot long, before long, of long")
    w = Window.partitionBy("slot")
    run = F.col("before") + F.sum("n").over(w.orderBy("rgb").rowsBetween(Window.unboundedPreceding, 0))
    tied = tied.join(F.broadcast(places), "slot").withColumns({"run": run, "top": F.max("rgb").over(w)}).where("run * 2 >= of")
    first = {r["slot"]: r for r in tied.groupBy("slot").agg(F.min("rgb").alias("rgb"), F.max("top").alias("top")).collect()}  # a row a box
    out = {}
    for i, r in found.items():
        cut = None
        if r["width"]:
            t = first[i]
            cut = (r["at"] << 24 | t["rgb"]) - (r["at"] == r["last"] and t["rgb"] == t["top"])
        out[new[i]] = (r["width"], r["axis"], cut, r["n"], r["r"], r["g"], r["b"])
    return out


PACKED = "groups binary, colours binary"
PLACED = "slot long, width long, axis long, n long, r long, g long, b long, at long, before long, last long"
#: Boxes whose values a task counts in an array of its own (6 kB each).
HELD = 2048


def _cut_in_place(rows: DataFrame, groups: int, k: int) -> list[tuple]:
    """rows (PACKED), colours bytes -> group, idx, r, g, b. The driver has the boxes, 2 k a group."""
    cuts, known, new = _Cuts(groups), {}, list(range(groups))
    boxes: list[dict] = [{} for _ in range(groups)]
    while new:
        known |= _measured_in_place(rows, cuts, new)
        for node in new:
            g, box = cuts.of[node]
            boxes[g][box] = node
        new = []
        for g in range(groups):
            shown = pd.DataFrame({"box": list(boxes[g]), "width": [known[x][0] for x in boxes[g].values()]})
            for box in _followed(shown, k)[1]:
                node = boxes[g][box]
                new += cuts.add(node, known[node][1], known[node][2])
    out = []
    for g in range(groups):
        shown = pd.DataFrame({"box": list(boxes[g]), "width": [known[x][0] for x in boxes[g].values()]})
        for idx, box in enumerate(_followed(shown, k)[0]):
            n, *sums = known[boxes[g][box]][3:]
            out.append((g, idx, *(x // n for x in sums)))
    return out


def median_cut(df: DataFrame, by: list[str], k: int, weight: str | None = None) -> DataFrame:
    """by..., idx, r, g, b: means of up to k boxes of each group, in the order of their cuts: the widest box is cut at its weighted median
    until there are k.

    Defined results: rows without a colour aren't counted; boxes of one colour aren't cut; null groups are groups."""
    known = df.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    most = BOXES_BROADCAST // (2 * k)
    bounds = known.groupBy(*by).agg(F.min(F.least("r", "g", "b")).alias("__low"), F.max(F.greatest("r", "g", "b")).alias("__high")).limit(most + 1).collect()
    bounds = [x for x in bounds if x["__low"] is not None]
    if weight or len(bounds) > most or any(x["__low"] < 0 or x["__high"] > 255 for x in bounds):
        return _median_cut_by_joins(df, by, k, weight)
    spark, kinds = df.sparkSession, [T.StructField(f"__{c}", df.schema[c].dataType) for c in by]
    groups = spark.createDataFrame([(i, *(x[c] for c in by)) for i, x in enumerate(bounds)], T.StructType([T.StructField("group", T.IntegerType()), *kinds]))
    met = known.join(F.broadcast(groups), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else known.withColumn("group", F.lit(0))
    rows = kept(met.select("group", F.expr("CAST(r * 65536 + g * 256 + b AS INT)").alias("rgb")).mapInArrow(_packed, PACKED), "box-colours")
    found = spark.createDataFrame(_cut_in_place(rows, len(bounds), k), "group int, idx int, r int, g int, b int")
    return found.join(F.broadcast(groups), "group").select(*[F.col(f"__{c}").alias(c) for c in by], "idx", "r", "g", "b")


def _median_cut_by_joins(df: DataFrame, by: list[str], k: int, weight: str | None = None) -> DataFrame:
    """The same with any number of groups, weights and any colours."""
    n = F.sum(weight).cast("long") if weight else F.count("*")
    known = df.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL")
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")  # never null, so that it joins
    counts = known.groupBy(*by, "r", "g", "b").agg(n.alias("n"))
    colours = kept(counts.select(group.alias("g"), *[F.col(c).alias(f"c{c}") for c in "rgb"], "n", F.lit("").alias("box"), F.lit(True).alias("new")), "box-colours")
    boxes = None
    while True:
        found = kept(_measured(colours.where("new")), "boxes")
        boxes = found if boxes is None else boxes.unionByName(found)

        def wanted(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"g": key[0], "box": _followed(d, k)[1]}, columns=["g", "box"]).astype(str)

        cuts = kept(boxes.groupBy("g").applyInPandas(wanted, "g string, box string").join(boxes.select("g", "box", "axis", "cut"), ["g", "box"]), "box-cuts")
        if cuts.isEmpty():
            break
        rows = _beside(colours, cuts, ["g", "box"], "left")  # boxes that aren't cut now may be later
        value = F.element_at(F.array(*[F.col(f"c{c}") for c in "rgb"]), F.col("axis") + 1).cast("long")
        key = F.shiftleft(value, 24).bitwiseOR((F.col("cr") * 65536 + F.col("cg") * 256 + F.col("cb")).cast("long"))
        colours = kept(rows.select("g", "cr", "cg", "cb", "n", F.concat("box", F.when(key <= F.col("cut"), "0").when(key > F.col("cut"), "1").otherwise("")).alias("box"), F.col("cut").isNotNull().alias("new")), "box-colours")

    def means(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        at = d.set_index("box").loc[_followed(d, k)[0]]
        return pd.DataFrame({"g": key[0], "idx": range(len(at)), "r": (at.r // at.n).to_numpy(), "g_": (at.g_ // at.n).to_numpy(), "b": (at.b // at.n).to_numpy()})

    out = boxes.groupBy("g").applyInPandas(means, "g string, idx int, r int, g_ int, b int")
    kinds = dict(df.dtypes)
    parts = F.from_json("g", ", ".join(f"`{c}` {kinds[c]}" for c in by)) if by else None
    return out.select(*[parts[c].alias(c) for c in by], "idx", "r", F.col("g_").alias("g"), "b")
