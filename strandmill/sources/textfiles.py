"""FASTA, SAM, BED and result files: scans and sinks.

Scans are Spark's own text and CSV readers, so files split and compressed ones
unpack by suffix. Sinks write a folder of parts in order; ``single_file`` then
joins the parts into one file by streaming bytes, without holding rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

BED4 = "chrom string, start bigint, end bigint, methylated int"
BED7 = "chrom string, start bigint, end bigint, level double, meth_count bigint, unmeth_count bigint, coverage bigint"
SAM_FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
SAM_INTS = frozenset(("flag", "pos", "mapq", "pnext", "tlen"))


# ------------------------------------------------------------------ scans
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq, length): first word of the header, upper case.

    A record is what lies between two line-starting ``>``; of equal names the
    last wins; contigs without bases are left out.
    """
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    lines = F.split(F.regexp_replace(F.ltrim(F.col("value"), F.lit(">")), "\r", ""), "\n", 2)
    parts = records.select("at", F.regexp_extract(lines[0], r"^\s*(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")).alias("seq"))
    parts = parts.where("chrom <> ''")
    return parts.groupBy("chrom").agg(F.max_by("seq", "at").alias("seq")).where("seq <> ''").withColumn("length", F.length("seq"))


def fasta_blocks(contigs: DataFrame, block: int = 1024) -> DataFrame:
    """(chrom, block_id, seq): equal pieces, the form in which joins want a genome."""
    n = F.ceil(F.col("length") / block).cast("int")
    return contigs.select("chrom", F.col("seq").alias("__s"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block_id")).select("chrom", F.col("block_id").cast("long").alias("block_id"), F.substring("__s", F.col("block_id") * block + 1, F.lit(block)).alias("seq"))


def read_fasta_blocks(spark: SparkSession, path: str, block: int = 1024) -> DataFrame:
    """(chrom, block_id, seq): a FASTA file as pieces of ``block`` bases, no contig in one row.

    Same rules as ``read_fasta``. Lines get their place by running sums inside each
    file split; what a split adds to each contig (a row a contig and split) is
    summed up over the file to where the split's lines begin.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), F.upper(F.regexp_replace("value", r"\s", "")).alias("s"), F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("head"))
    inside = Window.partitionBy("file", "split").orderBy("id")
    lines = lines.withColumn("part", F.count("head").over(inside)).withColumn("n", F.when(F.col("head").isNull(), F.length("s")).otherwise(0))
    upto = F.sum("n").over(Window.partitionBy("file", "split", "part").orderBy("id"))
    lines = lines.withColumn("off", upto - F.col("n"))
    # one row for each contig that a split holds a piece of
    pieces = lines.groupBy("file", "split", "part").agg(F.max("head").alias("head"), F.sum("n").alias("n"))
    along = Window.partitionBy("file").orderBy("split", "part")
    pieces = pieces.withColumn("contig", F.count("head").over(along)).withColumn("chrom", F.last("head", ignorenulls=True).over(along)).where("chrom <> ''")
    own = Window.partitionBy("file", "contig").orderBy("split", "part")
    pieces = pieces.withColumn("base", F.sum("n").over(own) - F.col("n"))
    # of equal names the last wins
    last = pieces.groupBy("chrom").agg(F.max(F.struct("file", "contig")).alias("k")).select("chrom", "k.*")
    pieces = pieces.join(last, ["chrom", "file", "contig"], "left_semi").select("file", "split", "part", "chrom", "base")
    placed = lines.where("n > 0").join(pieces, ["file", "split", "part"]).select("chrom", "s", (F.col("base") + F.col("off")).alias("at"))
    cut = placed.withColumn("block_id", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.length("s") - 1) / block))))
    first = F.greatest(F.lit(0), F.col("block_id") * block - F.col("at"))
    piece = F.substring("s", (first + 1).cast("int"), (F.least((F.col("block_id") + 1) * block - F.col("at"), F.length("s")) - first).cast("int"))
    whole = cut.select("chrom", "block_id", F.struct("at", piece.alias("x")).alias("p")).groupBy("chrom", "block_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("chrom", "block_id", F.array_join(F.transform("p", lambda x: x["x"]), "").alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Eleven fields, optional tags as a map, and line_no (rising, not dense); short and header lines are skipped."""
    rows = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).where(~F.startswith("value", F.lit("@")))
    f = F.split("value", "\t")
    rows = rows.withColumn("f", f).where(F.size("f") >= 11)
    fields = [F.expr(f"try_cast(f[{i}] as bigint)").alias(n) if n in SAM_INTS else F.col("f")[i].alias(n) for i, n in enumerate(SAM_FIELDS)]
    more = F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    tags = F.map_from_entries(F.transform(more, lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, F.lit(6), F.length(t)).alias("value"))))
    return rows.select("line_no", *fields, tags.alias("tags"))


def read_bed(spark: SparkSession, path: str, schema: str = BED7) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file: JSON lines, {"results": [...]} or a plain list."""
    raw = spark.read.json(path)
    if "_corrupt_record" in raw.columns:  # a document of more than one line
        raw = spark.read.option("multiLine", True).json(path)
    if "results" in raw.columns:
        return raw.select(F.explode("results").alias("r")).select("r.*")
    return raw


# ------------------------------------------------------------------ sinks
def save_lines(lines: DataFrame, path: str, first: bytes = b"") -> str:
    """A folder of ordered parts, written by the tasks, where ``path`` ends with a slash; else one file."""
    if path.endswith("/"):
        lines.write.mode("overwrite").text(path)
        return path
    return single_file(lines, path, first)


def single_file(lines: DataFrame, path: str, first: bytes = b"") -> str:
    """One file from a frame of one string column, in the frame's order.

    Parts are written by the tasks and joined by copying streams between file
    systems, so any folder that Spark can reach will do and no row is held.
    """
    spark = lines.sparkSession
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    lines.write.text(folder)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    files, place = source.getFileSystem(conf), target.getFileSystem(conf)
    place.setWriteChecksum(False)
    out = place.create(target, True)
    try:
        if first:
            out.write(bytearray(first))
        for part in sorted(s.getPath().toString() for s in files.listStatus(source)):
            if part.rpartition("/")[2].startswith("part-"):
                read = files.open(hadoop.fs.Path(part))
                hadoop.io.IOUtils.copyBytes(read, out, conf, False)
                read.close()
    finally:
        out.close()
    return path


def fastq_lines(reads: DataFrame, order: str = "read_idx") -> DataFrame:
    name = F.when(F.startswith("name", F.lit("@")), F.col("name")).otherwise(F.concat(F.lit("@"), F.col("name")))
    return reads.orderBy(order).select(F.concat_ws("\n", name, "seq", F.lit("+"), "qual").alias("value"))


def fasta_lines(contigs: DataFrame, width: int = 80) -> DataFrame:
    """A row a contig: its header and lines of ``width`` letters."""
    n = F.ceil(F.length("seq") / width).cast("int")
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("seq", i * width + 1, F.lit(width)))
    return contigs.orderBy("chrom").select(F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), F.array_join(lines, "\n")).alias("value"))


def sam_header(contigs: list[tuple[str, int]], program: str = "strandmill") -> bytes:
    rows = ["@HD\tVN:1.6\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs), f"@PG\tID:{program}\tPN:{program}"]
    return ("\n".join(rows) + "\n").encode()


def sam_lines(sam: DataFrame) -> DataFrame:
    tags = [F.concat(F.lit(f"{t}:i:"), F.col(t).cast("string")) for t in ("NM", "AS") if t in sam.columns]
    return sam.orderBy("line_no").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in SAM_FIELDS], *tags).alias("value"))


def bed7_lines(sites: DataFrame) -> DataFrame:
    level = F.format_string("%.4f", F.bround("level", 4))
    return sites.orderBy("chrom", "pos").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), level, *[F.col(c).cast("string") for c in ("meth_count", "unmeth_count", "coverage")]).alias("value"))


# fixed values: header of the per-base table
PER_BASE_HEADER = "ref,pos,strand,convertedBaseQualities,convertedBaseCount,unconvertedBaseQualities,unconvertedBaseCount,未转化率"


def write_per_base(sites: DataFrame, path: str) -> str:
    """UTF-8 with a byte-order mark; qualities are quoted, since they may hold commas and quotes."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = sites.orderBy("chrom", "pos", "strand").select(F.concat_ws(",", "chrom", F.col("pos").cast("string"), "strand", quoted("converted_quals"), F.col("converted_count").cast("string"), quoted("unconverted_quals"), F.col("unconverted_count").cast("string"), F.format_string("%.6f", "unconverted_rate")).alias("value"))
    return save_lines(rows, path, ("﻿" + PER_BASE_HEADER + "\n").encode())


def write_results(results: DataFrame, folder: str) -> None:
    """Results as JSON lines and as CSV."""
    results.write.mode("overwrite").json(f"{folder}/results_json")
    results.write.mode("overwrite").option("header", True).csv(f"{folder}/results_csv")
