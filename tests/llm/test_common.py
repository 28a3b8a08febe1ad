import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
from iolens.llm.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001").count(), spark.conf.get("spark.checkpoint.dir", None))
"""


def test_a_session_without_a_shared_folder(tmp_path):
    root = Path(__file__).resolve().parents[2]
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200 None" in done.stdout, done.stderr[-2000:]
