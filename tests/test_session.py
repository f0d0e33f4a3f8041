import os
import pathlib
import subprocess
import sys

import pytest

from strandmill import session

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from strandmill import session
from strandmill.plans.queries import QUERIES
from strandmill.sources import textfiles
t = session.materialize(spark.range(9), "t")
assert t.count() == 9
assert QUERIES["streaming_calls"](spark, sys.argv[1]).count() > 0
textfiles.single_file(t.selectExpr("cast(id as string) as value").orderBy("id"), sys.argv[2])
print("FOLDER", session.shared_dir(spark))
"""


def test_intermediate_tables_without_a_named_folder(data, tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([str(pathlib.Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])}
    run = subprocess.run([sys.executable, "-c", CODE, data, str(tmp_path / "out.txt")], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    assert (tmp_path / "out.txt").read_text().split() == [str(i) for i in range(9)]
    folder = run.stdout.split("FOLDER ")[1].strip()
    assert not os.path.exists(folder)


def test_a_cluster_must_name_the_folder():
    class Context:
        applicationId, master = "app-none", "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_discard(spark):
    t = session.materialize(spark.range(5), "t")
    folder = t.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder)
    session.discard(t)
    assert not os.path.exists(folder)
