"""The library without the corpus operators' folders and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

from conftest import DATA

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "cubelume", tmp_path / "cubelume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    code = (
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']\n"
        "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        f"assert all(q[n](s, {DATA!r}).count() for n in ('q_centroid', 'q_nearest', 'q_running_peak', 'q_cell_mode'))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr
