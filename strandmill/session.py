"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session's application.

    Functions inside tasks are found by module name; so the executors need the
    package whatever folder the driver was started from.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped_to:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandmill-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped_to.add(app)


#: folder of each application, where it was chosen here
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, reachable by every executor.

    The session names the parent in ``spark.checkpoint.dir``. Where that is unset,
    a local master gets a fresh temporary folder, remembered for the application;
    any other master is an error, since a folder of one machine won't do there.
    The folder is deleted when the driver ends.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app in _own_dirs:
        return _own_dirs[app]
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="strandmill-")
    folder = f"{given.rstrip('/')}/strandmill-{app}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    _own_dirs[app] = folder
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Runs a job at once. Cuts the lineage: what follows survives lost executors
    and may read the rows several times without repeating the work before.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote; nothing may read it any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given parquet tables; columns are pruned by what follows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blank_trimmed(column):
    """``column`` without outer white space of any kind (not only spaces)."""
    from pyspark.sql import functions as F

    return F.regexp_replace(column, r"^\s+|\s+$", "")
