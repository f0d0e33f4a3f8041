"""FASTQ as a Spark data source: byte ranges of plain files, whole gzip files.

A range starts reading at the first record that begins in it. A line that
starts with ``@`` begins a record when the line two further starts with ``+``;
a quality line may start with ``@`` too, but then the second line after it is a
sequence. So files split without a pre-pass, and nothing passes the driver.

Rows: file, byte_offset (of the record in the unpacked file), name (with its
``@``), seq, qual. Order in a file is that of byte_offset; a trailing partial
record is dropped; an empty file has no rows.
"""

from __future__ import annotations

import gzip
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, byte_offset bigint, name string, seq string, qual string"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end of a packed file


def records(f, start: int, end: int | None):
    """Records of the open binary file that begin in [start, end)."""
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())  # the rest of the line that holds byte start - 1
    window: list[tuple[int, bytes]] = []

    def fill(n: int) -> bool:
        nonlocal at
        while len(window) < n:
            line = f.readline()
            if not line:
                return False
            window.append((at, line.rstrip(b"\r\n")))
            at += len(line)
        return True

    if start:
        while fill(3) and not (window[0][1].startswith(b"@") and window[2][1].startswith(b"+")):
            window.pop(0)
    while fill(4):
        offset = window[0][0]
        if end is not None and offset >= end:
            return
        yield offset, *(x.decode("utf-8", "replace") for x in (window[0][1], window[1][1], window[3][1]))
        window.clear()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self):
        out = []
        for path, size in self.files:
            if path.endswith(".gz"):
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        with gzip.open(part.path, "rb") if part.end is None else open(part.path, "rb") as f:
            for offset, name, seq, qual in records(f, part.start, part.end):
                yield part.path, offset, name, seq, qual


class FastqSource(DataSource):
    """Reads the files (path and size) named in its option ``files``; see ``read_fastq``."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that match ``path`` (patterns, split at commas), by name.

    Listed through Hadoop's file system. Tasks open the files themselves, so they
    must lie in a folder that all machines mount; another file system is an error, and
    so is a pattern without a match.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = []
    for one in path.split(","):
        where = hadoop.Path(one)
        if where.getFileSystem(conf).getUri().getScheme() != "file":
            raise ValueError(f"FASTQ files must lie in a folder that all machines mount: {one}")
        found = where.getFileSystem(conf).globStatus(where)
        if not found:
            raise FileNotFoundError(one)
        out += [(f.getPath().toUri().getPath(), f.getLen()) for f in found]
    return sorted(out)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("files", json.dumps(listed(spark, path))).option("splitBytes", split_bytes).load()


def with_read_idx(records_: DataFrame) -> DataFrame:
    """Dense index from 0 in order of file and offset.

    Counts by 64 MB range first (one row a range), so the running sum is over
    ranges and the ranks are taken inside each range, not over the whole set.
    """
    keyed = records_.withColumn("__part", F.floor(F.col("byte_offset") / (64 << 20)))
    sizes = keyed.groupBy("file", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("file", "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("file", "__part").orderBy("byte_offset")) - 1
    return keyed.withColumn("__r", rank).join(before, ["file", "__part"]).withColumn("read_idx", F.col("__before") + F.col("__r")).drop("__part", "__r", "__before")


def bare_name(name: str = "name") -> F.Column:
    """Without all leading ``@``."""
    return F.ltrim(F.col(name), F.lit("@"))
