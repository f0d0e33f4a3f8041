"""Sequencing-shaped views over the given tables.

Everything is derived by Spark from the tables, so it grows with them: a
reference genome from ``part`` (32 bases a part, md5 digits as letters), its
methylation truth, alignments of ``reads`` to it, reads cut from it for the
aligner, and clean calls, truth and multi-sample results from ``calls`` and
``bed_sites``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..session import read_table

HEX, NT = "0123456789abcdef", "ACGTACGTACGTACGT"
BLOCK = 32


def dna(text: Column) -> Column:
    return F.translate(F.md5(text), HEX, NT)


def h2(text: Column) -> Column:
    """First two md5 digits: a share of hex "00" to "ff"."""
    return F.substring(F.md5(text), 1, 2)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("block_id"), dna(F.concat(F.lit("g:"), F.col("p_partkey").cast("string"))).alias("seq"))


def genome_length(spark: SparkSession, d: str) -> int:
    return BLOCK * read_table(spark, d, "part").count()


def genome(spark: SparkSession, d: str) -> DataFrame:
    bases = blocks(spark, d).select("block_id", F.posexplode(F.split("seq", "")).alias("i", "base"))
    return bases.select(F.lit("chr_sim").alias("chrom"), (F.col("block_id") * BLOCK + F.col("i")).alias("pos"), "base")


def truth(spark: SparkSession, d: str) -> DataFrame:
    sites = genome(spark, d).where("base = 'C'")
    return sites.select("chrom", "pos", F.when(h2(F.concat(F.lit("m:"), F.col("pos").cast("string"))) < "b3", 1).otherwise(0).alias("methylated"))


def seq_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a sequence, in upper case, whatever their quality string."""
    r = read_table(spark, d, "reads").withColumn("seq", F.upper(F.trim("seq")))
    return r.where("seq <> ''").select("read_idx", "library", "mate", "name", "seq", "qual")


def qual_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a quality string, whatever their sequence."""
    return read_table(spark, d, "reads").where("length(qual) > 0").select("read_idx", "library", "qual")


def clean_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads with sequence and quality of one length: those that can be aligned."""
    return seq_reads(spark, d).where("length(seq) = length(qual)")


def sam(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of the clean reads at hashed places, with varied flags and CIGARs."""
    g = genome_length(spark, d)
    i, n = F.col("read_idx"), F.length("seq").cast("string")
    kind = i % 7
    cigar = (
        F.when(kind == 1, "5S45M").when(kind == 2, "20M2I28M").when(kind == 3, "25M3D25M").when(kind == 4, "30S20M").when(kind == 5, "10M5N40M").when(kind == 6, "25=25X").otherwise(F.concat(n, F.lit("M")))
    )
    flag = F.when(i % 20 == 0, 4).when(i % 20 == 1, 16).when(i % 20 == 2, 163).when(i % 20 == 3, 83).otherwise(0)
    return clean_reads(spark, d).select(
        i.alias("line_no"),
        F.split_part(F.ltrim(F.col("name"), F.lit("@")), F.lit(" "), F.lit(1)).alias("qname"),
        flag.alias("flag"),
        F.lit("chr_sim").alias("rname"),
        ((i * 7919) % (g - 200) + 1).alias("pos"),
        ((i * 37) % 61).alias("mapq"),
        cigar.alias("cigar"),
        F.when(i % 11 == 0, "chr_other").otherwise("=").alias("rnext"),
        ((i * 7919) % (g - 200) + 151).alias("pnext"),
        ((i * 53) % 1500).alias("tlen"),
        "seq",
        "qual",
    )


def genome_reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_idx, start0, seq): 50 bases of the genome for each event, every other one fully converted."""
    g = genome_length(spark, d)
    placed = read_table(spark, d, "events").select(F.col("event_id").alias("read_idx"), ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % (g - 96)).alias("start0"))
    # runs of blocks with the next two; by the size of the part file Spark would broadcast them
    some, x = 8, F.col("block_id")
    runs = blocks(spark, d).select(F.explode(F.array_distinct(F.array(F.floor(x / some), F.floor((x - 2) / some)))).alias("run"), F.struct("block_id", "seq").alias("b")).groupBy("run").agg(F.array_sort(F.collect_list("b")).alias("b"))
    # a run without a gap is one text; only others stay lists
    whole, first = F.size(F.array_distinct(F.transform("b", lambda y, i: y["block_id"] - i))) == 1, F.col("b")[0]["block_id"]
    runs = runs.select("run", (first * BLOCK).alias("since"), F.when(whole, F.array_join(F.transform("b", lambda y: y["seq"]), "")).alias("text"), F.when(~whole, F.col("b")).alias("b"))
    at = F.floor(F.col("start0") / BLOCK)
    cut = placed.withColumn("run", F.floor(at / some)).join(runs.hint("shuffle_hash"), "run")
    three = F.filter("b", lambda y: y["block_id"].between(at, at + 2))
    inside = (at * BLOCK >= F.col("since")) & ((at + 3) * BLOCK <= F.col("since") + F.length("text"))
    apart = F.substring(F.array_join(F.transform(three, lambda y: y["seq"]), ""), (F.col("start0") % BLOCK + 1).cast("int"), F.lit(50))
    raw = F.when(inside, F.substring("text", (F.col("start0") - F.col("since") + 1).cast("int"), F.lit(50))).when(F.size(three) == 3, apart)
    # a read needs all three blocks
    cut = cut.select("read_idx", "start0", raw.alias("raw")).where("raw is not null")
    raw = F.col("raw")
    return cut.select("read_idx", "start0", F.when(F.col("read_idx") % 2 == 0, F.translate(raw, "C", "T")).otherwise(raw).alias("seq"))


def clean_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls with a usable contig, level from 0 to 1 and coverage; one row a delivery repeated."""
    c = read_table(spark, d, "calls").where("chrom is not null and not isnan(level) and level between 0 and 1 and coverage > 0")
    c = c.select("aligner", F.coalesce("sample", F.lit("none")).alias("sample"), F.lower(F.trim("chrom")).alias("chrom"), "pos", F.bround("level", 4).alias("level"), "meth_count", "unmeth_count", "coverage")
    return c.distinct()


def bed_truth(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bed_sites")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each sample and aligner: the multi-sample comparison rows."""
    m = evaluate.metrics(clean_calls(spark, d), bed_truth(spark, d), ["sample", "aligner"])
    number = F.regexp_extract("sample", "(\\d+)$", 1)
    return m.select(
        "sample", F.substring("sample", 5, 3).alias("grp"), F.when(F.pmod(F.expr("coalesce(try_cast(nullif(regexp_extract(sample, '([0-9]+)$', 1), '') as int), 0)"), F.lit(2)) == 0, "ct").otherwise("ag").alias("conversion"), "aligner", "f1_score", "precision", "recall", "accuracy", "sites_overlap"
    )
