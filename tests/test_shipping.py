"""Python workers import the package whatever the driver's working directory."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.queries()["sequence_ratio"](spark, "/root/testdata/sf0.001").count())
"""


def test_udf_query_runs_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="pricelens-cwd-")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr[-2000:]
    assert any(line.startswith("ROWS ") and int(line.split()[1]) > 0 for line in out.stdout.splitlines())
