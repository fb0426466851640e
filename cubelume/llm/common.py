"""What the operators of this subpackage share: scratch tables, column names, text batches, hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ready as _ready
from ..runtime import shared_dir

#: Rows and bytes of a batch of texts that is handed to a Python worker (a longer text is a batch of its own).
ROWS_A_BATCH, BYTES_A_BATCH = 1_000, 16 << 20
#: Sizes of up to this many groups (languages, labels) are broadcast.
GROUPS_BROADCAST = 10_000
_live: dict[str, list[str]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and has the session hand them texts in batches of bounded rows and bytes."""
    for name, most in (("maxRecordsPerBatch", ROWS_A_BATCH), ("maxBytesPerBatch", BYTES_A_BATCH)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return _ready(spark)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder, which drop_scratch() deletes."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/cubelume-{app}/{tag}-{uuid.uuid4().hex[:12]}"
    _live.setdefault(app, []).append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage is cut and a lost executor costs nothing of it."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    return len(_live.get(spark.sparkContext.applicationId, []))


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables written since a mark but for the last `keep`; only when no DataFrame over them is still to be read."""
    paths = _live.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    for path in gone:
        with contextlib.suppress(Exception):
            _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if (spark := SparkSession.getActiveSession()) is not None:
            drop_scratch(spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have (compared as Spark does, without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return df[f"`{name}`"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def first_by_hash(rows: DataFrame, group: str, key: str, k: Column) -> DataFrame:
    """rows with `turn`, 1 to k in each group by a hash of key. Of large groups only the rows of small hashes (4 k + 50 are
    expected) go into the ranking, so that no task ranks a group however large it is; that fewer than k are among these
    has a chance below 1e-9."""
    h, sizes = F.xxhash64(key), rows.groupBy(group).agg(F.count("*").alias("__n"))
    few = sizes.limit(GROUPS_BROADCAST + 1).count() <= GROUPS_BROADCAST  # else a shuffle join
    sized = rows.join(F.broadcast(sizes) if few else sizes, group)
    some = sized.where(h.cast("double") / float(1 << 64) + 0.5 < (4 * k + 50) / F.col("__n")).drop("__n")
    return some.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(h, key))).where(F.col("turn") <= k)


def trim() -> None:
    """Gives freed memory back to the system, between batches in Python workers."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of about `most` characters at most, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
