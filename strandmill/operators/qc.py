"""Read quality metrics.

Position-wise metrics explode one base a row but reduce in the same stage
(map-side combine to reads' length times five letters a task). The reference
leaves thresholds open; ours: an overrepresented sequence has 0.1 % of the
reads, the grade is PASS for a mean quality of 28 or more without adapters in
over 5 % of the reads, WARNING from 20, else FAIL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import qualities
from .adapters import ADAPTERS

BASES = "ACGTN"


def totals(reads: DataFrame) -> DataFrame:
    """All rows count as reads; those without a sequence, or with a quality of another length, are told apart."""
    usable = F.coalesce(F.trim("seq") != "", F.lit(False))
    return reads.agg(
        F.count(F.lit(1)).alias("total_reads"), F.coalesce(F.sum(F.when(usable, F.length(F.trim("seq")))), F.lit(0)).alias("total_bases"),
        F.count_if(~usable).alias("without_seq"), F.count_if(usable & ~F.coalesce(F.length(F.trim("seq")) == F.length("qual"), F.lit(False))).alias("without_qual"),
    )


def base_percent(reads: DataFrame) -> DataFrame:
    n = F.sum(F.length("seq"))
    count = lambda b: F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit(""))))
    return reads.agg(*[F.bround(100.0 * F.try_divide(count(b), n), 4).alias(f"pct_{b.lower()}") for b in BASES])


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("reads"))


def length_summary(reads: DataFrame) -> DataFrame:
    """mean, min, max, N50, from the histogram: the window sees one row a length."""
    h = length_histogram(reads)
    down = Window.orderBy(F.desc("length"))
    cum = h.withColumn("upto", F.sum(F.col("length") * F.col("reads")).over(down)).withColumn("bases", F.sum(F.col("length") * F.col("reads")).over(Window.partitionBy()))
    return cum.agg(
        F.bround(F.sum(F.col("length") * F.col("reads")) / F.sum("reads"), 4).alias("mean_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.max(F.when(F.col("upto") * 2 >= F.col("bases"), F.col("length"))).alias("n50"),
    )


def gc_histogram(reads: DataFrame) -> DataFrame:
    gc = F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return reads.where("length(seq) > 0").groupBy(F.floor(100 * gc / F.length("seq")).cast("int").alias("gc")).agg(F.count(F.lit(1)).alias("reads"))


def read_quality(reads: DataFrame) -> DataFrame:
    """Reads by floored mean quality."""
    q = qualities(F.col("qual"))
    mean = F.aggregate(q, F.lit(0), lambda a, x: a + x) / F.size(q)
    return reads.where("length(qual) > 0").groupBy(F.floor(mean).cast("int").alias("mean_quality")).agg(F.count(F.lit(1)).alias("reads"))


def per_base_quality(reads: DataFrame) -> DataFrame:
    """By position: mean, quartiles, 10th and 90th percentile, extremes.

    Exact, since a quality has few values: counts by (position, value) first,
    then percentiles over those counts, so nothing large meets in one task.
    """
    counts = reads.select(F.posexplode(qualities(F.col("qual"))).alias("position", "q")).groupBy("position", "q").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("position").orderBy("q")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("position")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col("q")))
    return ranked.groupBy("position").agg(
        F.bround(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 4).alias("mean"), at(0.5).alias("med"), at(0.25).alias("q1"), at(0.75).alias("q3"), at(0.1).alias("lower"), at(0.9).alias("upper"), F.min("q").alias("min"), F.max("q").alias("max")
    )


def per_base_content(reads: DataFrame) -> DataFrame:
    bases = reads.where("length(seq) > 0").select(F.posexplode(F.split("seq", "")).alias("position", "base"))
    return bases.groupBy("position").agg(*[F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in BASES])


def overrepresented(reads: DataFrame, share: float = 0.001, top: int = 20) -> DataFrame:
    counted = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count").alias("n"))
    out = counted.join(F.broadcast(total)).where(F.col("count") >= F.col("n") * share)
    return out.select(F.col("seq").alias("sequence"), "count", F.bround(100.0 * F.col("count") / F.col("n"), 4).alias("pct")).orderBy(F.desc("count"), "sequence").limit(top)


def adapter_content(reads: DataFrame) -> DataFrame:
    """Share of reads that hold the first 12 letters of each adapter: one pass, nine counters."""
    names = {a: s[:12] for a, s in ADAPTERS.items()}
    one = reads.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains("seq", F.lit(s))).alias(a) for a, s in names.items()])
    long = one.unpivot("n", list(names), "adapter", "reads")
    return long.select("adapter", "reads", F.bround(100.0 * F.try_divide("reads", "n"), 4).alias("pct"))


def grade(quals: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row from the reads that have a quality and those that have a sequence."""
    q = read_quality(quals).agg((F.sum(F.col("mean_quality") * F.col("reads")) / F.sum("reads")).alias("quality"))
    a = adapter_content(seqs).agg(F.max("pct").alias("adapter_pct"))
    g = F.when((F.col("quality") >= 28) & (F.col("adapter_pct") <= 5), "PASS").when(F.col("quality") >= 20, "WARNING").otherwise("FAIL")
    return q.join(F.broadcast(a)).select(F.bround("quality", 4).alias("quality"), "adapter_pct", g.alias("grade"))
