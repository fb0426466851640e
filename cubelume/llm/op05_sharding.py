"""Sharding by best-fit-decreasing bin packing.

Rows of one text are an indivisible group. Groups, in order of size, enter the bin whose remaining capacity is the
tightest that still holds them; bins stand in a balanced search tree by remaining capacity. pack() minimises the
number of bins of a given capacity; shard() seeks the smallest capacity at which a given number of bins suffices.

Groups of one size are interchangeable, so the driver packs runs: each distinct size with the number of groups that have it. That is
exactly what packing the groups one by one gives, and what the driver holds is bounded by the distinct sizes, not by the documents. Spark then
numbers the groups of a size, in blocks of a hash, and deals them to the bins by number. Slots are numbered in blocks of a hash of the id.

Defined results: null text is the empty text; size = UTF-8 bytes + 8; repeated rows are rows of their own (of one group, as all of one text); a group larger than
the capacity is alone in a bin of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, table, written

SHARDS = 24
#: The capacity is sought to one part in this.
GRAIN = 65_536
ROWS_A_BLOCK = 20_000
#: Distinct sizes up to this many are broadcast with their bins (some 50 B each); beyond it Spark joins by shuffle.
BROADCAST_SIZES = 200_000


class Bins:
    """A treap of (remaining capacity, bin); priorities come from the bin's number, so runs agree."""

    def __init__(self) -> None:
        self.root: list | None = None

    def _split(self, t: list | None, key: tuple[int, int]) -> tuple:
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, (key[1] * 0x9E3779B1 + key[0] * 0x85EBCA6B) & 0xFFFFFFFF, None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of the least remaining capacity >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        up, t = None, right
        while t[2] is not None:
            up, t = t, t[2]
        if up is None:
            right = t[3]
        else:
            up[2] = t[3]
        self.root = self._merge(left, right)
        return t[0]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """runs: (size, how many groups have it), sizes in descending order -> for each run (bin, how many go there), in order. None if more than
    `most` bins would be needed. After a group is put into the tightest bin that holds it, that bin is the tightest one for the
    next group of that size as long as it holds it, so that a run goes bin by bin, as its groups one by one would."""
    bins, used, out = Bins(), 0, []
    for size, left in runs:
        placed = []
        while left:
            hit = bins.take(size)
            if hit is None:
                if most is not None and used == most:
                    return None
                hit, used = (max(capacity, size), used), used + 1
            n = min(left, hit[0] // size)
            placed.append((hit[1], n))
            bins.add((hit[0] - n * size, hit[1]))
            left -= n
        out.append(placed)
    return out


def into(runs: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Bins 0 to n - 1 at the least capacity, to one part in GRAIN, at which n suffice."""
    low = max(-(-sum(size * k for size, k in runs) // n), runs[0][0] if runs else 0, 1)
    if (best := best_fit_decreasing(runs, low, n)) is not None:
        return best
    step = max(1, low // GRAIN)
    a, b = 0, 1
    while (best := best_fit_decreasing(runs, low + b * step, n)) is None:
        a, b = b, b * 2
    while b - a > 1:
        m = (a + b) // 2
        if (got := best_fit_decreasing(runs, low + m * step, n)) is None:
            a = m
        else:
            b, best = m, got
    return best


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(col(docs, "text"), F.lit(""))
    return docs.select(col(docs, "doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def assign(rows: DataFrame, pack) -> DataFrame:
    """rows (h, text_crc32, size, ...) with shard: pack(runs in descending order of size) gives the bins of the runs."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("h", "text_crc32", "size").agg((F.count("*") * F.first("size")).alias("bytes")), "shard-groups")
    runs = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toLocalIterator()]
    placed = [(size, [k for k, _ in p], list(accumulate(n for _, n in p)), max(1, math.ceil(n / ROWS_A_BLOCK))) for (size, n), p in zip(runs, pack(runs), strict=True)]
    bins = written(spark.createDataFrame(placed, "bytes long, bins array<int>, upto array<long>, blocks long"), "shard-bins")
    side = F.broadcast(bins) if len(runs) <= BROADCAST_SIZES else bins
    # groups of one size are numbered in blocks by hash, and a bin takes a range of the numbers
    dealt = groups.join(side, "bytes").withColumn("block", F.pmod("h", "blocks"))
    at = Window.partitionBy("bytes").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("bytes", "block").count().where("bytes IS NOT NULL").withColumn("first", F.coalesce(F.sum("count").over(at), F.lit(0))).drop("count")
    nth = F.row_number().over(Window.partitionBy("bytes", "block").orderBy("h", "text_crc32", "size")) - 1
    dealt = dealt.withColumn("nth", nth).join(first, ["bytes", "block"])
    behind = F.size(F.filter("upto", lambda x: x <= F.col("first") + F.col("nth")))
    homes = dealt.select("h", "text_crc32", "size", F.get("bins", behind).alias("shard"))
    return rows.join(homes, ["h", "text_crc32", "size"])


def with_slots(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """slot numbers the rows of each shard from 0 without gaps: blocks by a hash of the id, then by id."""
    blocks = max(1, math.ceil(n_rows / (n_shards * ROWS_A_BLOCK)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    at = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "block").count().withColumn("first", F.coalesce(F.sum("count").over(at), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "h")
    return rows.withColumn("in_block", F.row_number().over(order) - 1).join(first, ["shard", "block"]).withColumn("slot", (F.col("first") + F.col("in_block")).cast("long"))


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: n_shards shards of sizes as near equal as whole groups allow."""
    rows = written(sized(docs), "shard-rows")
    placed = written(assign(rows, lambda runs: into(runs, n_shards)).select("doc_id", "size", "text_crc32", "h", "shard"), "shard-placed")
    return with_slots(placed, rows.count(), n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def pack(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, size, text_crc32, shard: as few shards of `capacity` bytes as best fit decreasing finds."""
    rows = written(sized(docs), "shard-rows")
    return assign(rows, lambda runs: best_fit_decreasing(runs, capacity)).select("doc_id", "size", "text_crc32", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
QUERIES = {"op5_sharding": op5_sharding}
