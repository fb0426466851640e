"""Hash trees over rows with a whole number for a key: levels of hashes, FAN keys to a node, so that no row holds a group."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import kept

FAN_BITS = 4


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, ""), 256)


def hash_tree(rows: DataFrame, key: str, data: str | Column, *by: str, levels: int = 8) -> DataFrame:
    """by..., level, node, hash: level 0 are SHA-256 of data by key (rows of one key are one node: the hash of their hashes in order), a node of level n + 1 is
    the hash of the hashes of the nodes of level n with node >> FAN_BITS, in their order. At the last level stands the root, node 0.

    A node has 2^FAN_BITS children at most, so any number of rows makes no large group. Rows without key or data aren't in the tree. Keys of 2^(FAN_BITS levels)
    or more, or below 0, are an error."""
    top = 1 << (FAN_BITS * levels)
    ok = F.when((F.col(key) >= 0) & (F.col(key) < top), F.col(key)).otherwise(F.raise_error(F.lit(f"keys of a tree of {levels} levels are 0 to {top - 1}")).cast("long"))
    value = F.col(data) if isinstance(data, str) else data
    leaves = rows.where(F.col(key).isNotNull() & value.isNotNull()).select(*by, ok.cast("long").alias("node"), F.sha2(value.cast("binary"), 256).alias("hash"))
    hashes = F.sort_array(F.collect_list("hash"))
    level = kept(leaves.groupBy(*by, "node").agg(F.when(F.count("*") == 1, F.first("hash")).otherwise(_joined(hashes)).alias("hash")), "leaves")
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels + 1):
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"])
        level = level.groupBy(*by, F.shiftright("node", FAN_BITS).alias("node")).agg(_joined(children).alias("hash"))
        level = kept(level, "nodes") if n == 1 else level  # the next ones are ever smaller
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select(*by, "level", "node", "hash")


def roots(tree: DataFrame, *by: str) -> DataFrame:
    """by..., rows (leaves), root."""
    last = F.max_by("hash", "level")
    return tree.groupBy(*by).agg(F.count_if(F.col("level") == 0).alias("leaves"), last.alias("root"))


def proofs(tree: DataFrame, keys: DataFrame, *by: str, levels: int = 8) -> DataFrame:
    """keys (by..., node) -> by..., node, level, at, hashes: for each level from 1 the children of the node above the key, and which of them is its own."""
    wanted = keys.select(*by, F.col("node").alias("leaf"))
    out = None
    for n in range(1, levels + 1):
        own = F.shiftright("leaf", FAN_BITS * (n - 1))
        nodes = tree.where(F.col("level") == n - 1).withColumn("parent", F.shiftright("node", FAN_BITS)).drop("level")
        met = wanted.withColumn("parent", F.shiftright("leaf", FAN_BITS * n)).withColumn("own", own).join(nodes, [*by, "parent"])
        one = met.groupBy(*by, "leaf").agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"), F.max("own").alias("own"))
        one = one.select(*by, F.col("leaf").alias("node"), F.lit(n).alias("level"), F.array_position(F.transform("c", lambda x: x["node"]), F.col("own")).cast("int").alias("at"), F.transform("c", lambda x: x["hash"]).alias("hashes"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("at") > 0)


def proved(data: bytes, steps: list[tuple[int, list[str]]], root: str) -> bool:
    """Whether data is a leaf under root: steps (at from 1, hashes of the children) from level 1 up."""
    h = hashlib.sha256(data).hexdigest()
    for at, hashes in steps:
        if hashes[at - 1] != h:
            return False
        h = hashlib.sha256("".join(hashes).encode()).hexdigest()
    return h == root
