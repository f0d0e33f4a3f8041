"""Incremental site counts: an extension, the reference has no streams.

Calls are counted by site and hour of call with a watermark, so state is dropped
once an hour can get no more rows; late rows beyond it are left out by design.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def site_counts(calls: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """(chrom, window start, calls, meth_count, coverage) of a batch or a stream of calls."""
    clean = calls.where("chrom is not null and called_ts is not null").withColumn("chrom", F.lower(F.trim("chrom")))
    if clean.isStreaming:
        clean = clean.withWatermark("called_ts", late)
    w = F.window("called_ts", window)
    return clean.groupBy("chrom", w.alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.sum("meth_count").alias("meth_count"), F.sum("coverage").alias("coverage")).select("chrom", F.col("w.start").alias("day"), "calls", "meth_count", "coverage")


def replay_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The calls table as a stream, run until all that is there is counted."""
    path = f"{folder}/calls.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    # a folder of files streams as it is; of a single file the pattern names it alone
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    stream = source.parquet(f"{folder}/[c]alls.parquet" if is_file else path)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    q = site_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
