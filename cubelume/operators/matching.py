"""One-to-one matching and spread choices over any number of rows: rounds and core-sets, nothing collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import kept

#: Points that one task chooses from.
ROWS_A_TASK = 200_000


def one_to_one(pairs: DataFrame, a: str = "a", b: str = "b", distance: str = "delta") -> DataFrame:
    """Pairs in which no a and no b stands twice: for each a in order its nearest b that is still free (ties by b).

    In the order of (a, distance, b) a pair is taken as soon as it is the first of its a and of its b: nothing before it can touch it. A round
    takes all such pairs and drops their rivals; the first pair of all is always one of them, so that rounds end. Pairs with a null are no pairs."""
    left = kept(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(distance).isNotNull()).withColumn("__d", F.round(distance, 9)), "pairs")
    taken = None
    while not left.isEmpty():
        first_b = left.groupBy(a).agg(F.min(F.struct("__d", b)).alias("m")).select(a, F.col(f"m.{b}").alias(b))
        first_a = left.groupBy(b).agg(F.min(a).alias(a))
        found = left.join(first_b, [a, b], "left_semi").join(first_a, [a, b], "left_semi")
        found = kept(found.groupBy(a, b).agg(F.min("__d").alias("__d"), F.min(distance).alias(distance)), "matched")
        taken = found if taken is None else taken.unionByName(found)
        left = kept(left.join(found.select(a), a, "left_anti").join(found.select(b), b, "left_anti"), "pairs")
    return (left.select(a, b, distance) if taken is None else taken.select(a, b, distance))


def _spread(points: np.ndarray, score: np.ndarray, k: int) -> list[int]:
    """Places of k points: the best score first, then always the one of largest (least distance to the chosen) * (1 + score); the first of equals."""
    if not len(points):
        return []
    chosen = [int(score.argmax())]
    gap = np.sqrt(((points - points[chosen[0]]) ** 2).sum(1))
    while len(chosen) < min(k, len(points)):
        value = np.round(gap * (1 + score), 9)
        value[chosen] = -1
        chosen.append(int(value.argmax()))
        gap = np.minimum(gap, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
    return chosen


def spread(points: DataFrame, k: int, key: str = "idx", coordinates: tuple[str, ...] = ("r", "g", "b"), score: str = "score") -> DataFrame:
    """pick (from 0) and the columns key, coordinates and score of k points that lie far from each other.

    Points are dealt to tasks by a hash of the key; each task chooses k of its own, and one task chooses k of these. Where all points fit one
    task (ROWS_A_TASK) that is the exact choice; else, with equal scores, no point is farther from the chosen ones than four times what
    the best choice of k could do (each task's choice covers its points within twice that, and the last choice covers those). Points with a null
    aren't chosen; keys are unique, and decide ties."""
    names = [key, *coordinates, score]
    rows = points.select(*names).dropna()
    parts = max(1, -(-rows.count() // ROWS_A_TASK))
    kinds = dict(rows.dtypes)
    schema = "pick int, " + ", ".join(f"{n} {kinds[n]}" for n in names)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = pd.concat([pd.DataFrame(columns=names), *(b for b in batches if len(b))]).sort_values(key, kind="stable")
        at = _spread(d[list(coordinates)].to_numpy(float), d[score].to_numpy(float), k)
        out = d.iloc[at][names].copy()
        out.insert(0, "pick", range(len(at)))
        yield out

    few = rows.repartition(parts, key).mapInPandas(choose, schema).drop("pick")
    return few.repartition(1).mapInPandas(choose, schema) if parts > 1 else rows.repartition(1).mapInPandas(choose, schema)
