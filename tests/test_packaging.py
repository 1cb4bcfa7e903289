"""The package reaches workers that don't see the repository."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.addPyFile(sys.argv[3])
from trackuse.operators.density import dbscan
cells = spark.createDataFrame([(x, 0) for x in range(9)], "gx bigint, gy bigint")
print("CLUSTERS", dbscan(cells, 1, 2).select("site_id").distinct().collect()[0][0])
"""


def test_clustering_from_another_folder_with_the_shipped_package(tmp_path):
    package = shutil.make_archive(f"{tmp_path}/trackuse", "zip", ROOT, "trackuse")
    script = tmp_path / "job.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, str(script), ROOT, f"{tmp_path}/shared", package],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "CLUSTERS 1" in run.stdout, run.stderr[-2000:]
