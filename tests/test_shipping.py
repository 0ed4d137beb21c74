"""Executors get the package from the session: nothing on their path, another working folder."""

import os
import subprocess
import sys
import time
from pathlib import Path

from furrow.session import RELEASE_CONF, stored

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config(
    "spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
assert entry.queries()["x11_best_lag"](spark, "/root/testdata/sf0.001").count() == 500
assert not [f for f in __import__("os").listdir(".") if "spark-warehouse" in f]
print("done")
"""


def test_python_functions_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    entry = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(entry), str(tmp_path / "warehouse")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200
    )
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]


def test_broadcast_goes_by_bytes(spark):
    """Wide rows are too many sooner than narrow ones."""
    from furrow.session import BROADCAST_BYTES, broadcast_if_small

    df = spark.range(BROADCAST_BYTES // 2000)
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(df, 1000)) and "broadcast" not in plan(broadcast_if_small(df, 4000))


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a stored table shuffled goes from the disk when it is written; the session's own setting stays."""
    dirs = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}

    before, setting = files(), spark.conf.get(RELEASE_CONF)
    found = stored(spark.range(1000).selectExpr("id", "id % 7 as k").repartition(5, "id").groupBy("k").count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(RELEASE_CONF) == setting and found.count() == 7
