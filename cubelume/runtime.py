"""What Python workers need, the folder that driver and executors share, and tables that are kept there."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_kept: dict[str, list[str]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver found it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir (or that was set on the context). Only where neither is set and the
    master is local, as in tests, a temporary one; elsewhere executors wouldn't see it, so that its lack is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="cubelume-")).as_uri())
        base = context.getCheckpointDir()
    return base.rstrip("/")


def kept(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it is computed once, and a lost executor costs nothing of it. Deleted at exit."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/cubelume-{app}/kept-{tag}-{uuid.uuid4().hex[:12]}"
    _kept.setdefault(app, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):
        if (spark := SparkSession.getActiveSession()) is not None:
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            for path in _kept.pop(spark.sparkContext.applicationId, []):
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
