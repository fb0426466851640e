"""A stream of frames into GIF files: one file each group, begun, appended to batch by batch, and ended.

State lies in a folder that the driver and the executors share: what each batch appends is a file of its own, named by the batch's
number, so that a batch that is run again replaces what it wrote (exactly once). end() puts the parts together.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gif


def appender(to: str, width: int, height: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: frames (clip, f, delay, indices) become coded blocks."""

    def coded(s: pd.DataFrame) -> pd.Series:
        return pd.Series([gif.frame_bytes(gif.Frame(bytes(i), int(d)), width, height) for d, i in s.itertuples(index=False)])

    def append(batch: DataFrame, number: int) -> None:
        block = F.pandas_udf(coded, "binary")(F.struct("delay", "indices"))
        batch.select("clip", "f", block.alias("block"), F.sha2("indices", 256).alias("sha")).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return append


def end(spark: SparkSession, to: str, palette: list[tuple[int, int, int]], width: int, height: int) -> DataFrame:
    """clip, frames, gif: the whole files, frames in order of f."""
    start = gif.head(width, height, palette)

    def joined(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("f")
        return pd.DataFrame([(key[0], len(d), start + b"".join(map(bytes, d.block)) + b"\x3b")], columns=["clip", "frames", "gif"])

    parts = spark.read.parquet(to)
    return parts.select("clip", "f", "block").groupBy("clip").applyInPandas(joined, f"clip {dict(parts.dtypes)['clip']}, frames int, gif binary")


def intact(spark: SparkSession, to: str, frames: DataFrame) -> DataFrame:
    """Frames (clip, f) whose hash in the store isn't that of the source, or that are on one side only: none."""
    want = frames.select("clip", "f", F.sha2("indices", 256).alias("want"))
    return want.join(spark.read.parquet(to).select("clip", "f", "sha"), ["clip", "f"], "full").where(~F.col("want").eqNullSafe(F.col("sha"))).select("clip", "f")
