import os
import pathlib
import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from strandmill import session
from strandmill.llm.queries import QUERIES
for name in ("p1_found", "p6_found", "p7_mix", "p3_bounds"):
    assert QUERIES[name](spark, sys.argv[1]).count() > 0, name
print("FOLDER", session.shared_dir(spark))
"""


def test_queries_on_a_stock_session(data, tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([str(pathlib.Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", CODE, data], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert not os.path.exists(run.stdout.split("FOLDER ")[1].strip())
