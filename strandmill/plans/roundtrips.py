"""Queries that write given tables in each file format and read them back.

Files are written by the tasks below the session's shared folder, when a query
is built; what the scan returns is then compared with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pileup, sampling
from ..session import read_table, shared_dir
from ..sources import fastq, textfiles
from . import views


def written(lines: DataFrame, **options) -> str:
    folder = f"{shared_dir(lines.sparkSession)}/files-{uuid.uuid4().hex}"
    lines.write.options(**options).text(folder)
    return folder


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    return textfiles.fastq_lines(views.clean_reads(spark, d).where("name is not null"))


def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    return fastq.read_fastq(spark, f"{written(_fastq(spark, d))}/part-*", 1 << 20).select("name", "seq", "qual")


def fastq_gzip_scan(spark: SparkSession, d: str) -> DataFrame:
    return fastq.read_fastq(spark, f"{written(_fastq(spark, d), compression='gzip')}/part-*").select(fastq.bare_name().alias("bare"), "seq", "qual")


def fastq_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers in order of the file."""
    path = textfiles.single_file(_fastq(spark, d), f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}.fastq")
    return fastq.with_read_idx(fastq.read_fastq(spark, path, 1 << 20)).select("read_idx", "name")


def head_reads(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(views.seq_reads(spark, d).select("read_idx", "seq"), 1000)


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, seq): 64 blocks of the derived genome a contig."""
    x = F.array_sort(F.collect_list(F.struct("block_id", "seq")))
    return views.blocks(spark, d).groupBy(F.concat(F.lit("ctg"), F.floor(F.col("block_id") / 64)).alias("chrom")).agg(F.array_join(F.transform(x, lambda b: b["seq"]), "").alias("seq"))


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    return textfiles.read_fasta(spark, written(textfiles.fasta_lines(contigs(spark, d)))).select("chrom", "seq", F.col("length").cast("bigint").alias("length"))


def fasta_flat(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 1,024 bases of a scanned file."""
    return textfiles.read_fasta_blocks(spark, written(textfiles.fasta_lines(contigs(spark, d))))


def sam_scan(spark: SparkSession, d: str) -> DataFrame:
    return textfiles.read_sam(spark, written(textfiles.sam_lines(views.sam(spark, d)))).select(*textfiles.SAM_FIELDS)


def bed4_scan(spark: SparkSession, d: str) -> DataFrame:
    b = read_table(spark, d, "bed_sites")
    lines = b.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.col("methylated").cast("string")).alias("value"))
    return textfiles.read_bed(spark, written(lines), textfiles.BED4)


def bed7_scan(spark: SparkSession, d: str) -> DataFrame:
    calls = pileup.call_ref_anchored(views.sam(spark, d), views.genome(spark, d))
    return textfiles.read_bed(spark, written(textfiles.bed7_lines(calls)))


def perbase_file(spark: SparkSession, d: str) -> DataFrame:
    """The per-base table with its byte-order mark, header and quoted qualities, read back."""
    path = textfiles.write_per_base(pileup.per_base(views.sam(spark, d)), f"{shared_dir(spark)}/perbase-{uuid.uuid4().hex}.csv")
    schema = "chrom string, pos bigint, strand string, converted_quals string, converted_count bigint, unconverted_quals string, unconverted_count bigint, unconverted_rate double"
    got = spark.read.schema(schema).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return got.fillna("", ["converted_quals", "unconverted_quals"])


def results_file(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    textfiles.write_results(views.results(spark, d), folder)
    return textfiles.read_results(spark, f"{folder}/results_json").select("sample", "aligner", "f1_score", "precision", "recall", "accuracy")


QUERIES = {f.__name__: f for f in (fastq_scan, fastq_gzip_scan, fastq_indexed, head_reads, fasta_scan, fasta_flat, sam_scan, bed4_scan, bed7_scan, perbase_file, results_file)}
