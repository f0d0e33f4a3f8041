"""UMI detection, extraction and deduplication.

Deduplication is one aggregation by UMI with map-side combine (a UMI that a
third of all reads carry is one row a task) and a semi join on the read index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: header patterns in the order in which they are tried, with the group that holds the UMI
PATTERNS = {
    "standard": (r"^@([^\s]+)\s+.*?(UMI|umi|BX:Z:)([ATCGNatcgn]+)", 3),
    "illumina_v3": (r"^@([^:]+:[^:]+:[^:]+:[^:]+:[^:]+:[^:]+:[^:]+)\s+.*?([ATCGN]{8,16})$", 2),
    "simple": (r"^@([^\s]+)_([ATCGN]{8,16})(?:_|\s)", 2),
}


#: reads in which ends should differ, and their length
DRAWN, END = 200, 8


def detect(reads: DataFrame) -> DataFrame:
    """(library, location, pattern, length): how each library carries its UMI, from all its reads.

    The first header pattern that over half of a library's reads match, with the
    most frequent length of its UMIs (the longer one of a tie); else inline where of
    ``DRAWN`` reads drawn at random over half would differ in the ``END`` letters at
    that end, as the counts of all ends tell; else none. Null names match nothing.
    """
    headers = [F.regexp_extract("name", p, g) for p, g in PATTERNS.values()]
    matched = [F.coalesce(F.col("name").rlike(p), F.lit(False)) for p, _ in PATTERNS.values()]
    lengths = reads.select("library", *[F.when(m, F.length(h)).alias(n) for n, m, h in zip(PATTERNS, matched, headers)])
    # one row a library and combination of lengths, so that modes are taken from counts
    counted = lengths.groupBy("library", *PATTERNS).agg(F.count(F.lit(1)).alias("n"))
    shares = [(F.sum(F.when(F.col(n).isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias(n) for n in PATTERNS]
    by_header = counted.groupBy("library").agg(*shares)
    unfolded = counted.unpivot(["library", "n"], list(PATTERNS), "pattern", "length").where("length is not null").groupBy("library", "pattern", "length").agg(F.sum("n").alias("n"))
    modes = unfolded.groupBy("library", "pattern").agg(F.max_by("length", F.struct("n", "length")).alias("length"))
    ends = reads.where(F.length("seq") >= END).select("library", F.explode(F.array(F.struct(F.lit("front").alias("side"), F.substring("seq", 1, END).alias("end")), F.struct(F.lit("back").alias("side"), F.expr(f"right(seq, {END})").alias("end")))).alias("e"))
    each = ends.groupBy("library", "e").agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("library", "e.side").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    differ = F.sum(1 - F.pow(1 - share, F.least(F.col("all"), F.lit(DRAWN)))) / F.least(F.first("all"), F.lit(DRAWN))
    drawn = each.select("library", "e.side", "n").join(total, ["library", "side"]).groupBy("library", "side").agg(differ.alias("differ"))
    sides = drawn.groupBy("library").agg(*[F.max(F.when(F.col("side") == x, F.col("differ"))).alias(x) for x in ("front", "back")])
    pattern = F.coalesce(*[F.when(F.col(n) > 0.5, n) for n in PATTERNS])
    location = F.when(pattern.isNotNull(), "header").when(F.col("front") > 0.5, "inline_5prime").when(F.col("back") > 0.5, "inline_3prime").otherwise("none")
    told = by_header.join(sides, "library", "left").select("library", location.alias("location"), pattern.alias("pattern"))
    return told.join(modes, ["library", "pattern"], "left").select("library", "location", "pattern", "length")


def standard(umi: Column) -> Column:
    """Upper case, other letters as N; null under four letters."""
    u = F.regexp_replace(F.upper(F.trim(umi)), "[^ATCG]", "N")
    return F.when(F.length(u) >= 4, u)


def from_header(name: Column) -> Column:
    """By the first pattern that matches."""
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, g)) for p, g in PATTERNS.values()])


def extract(reads: DataFrame, location: Column, length: Column) -> DataFrame:
    """Adds ``umi_found`` by location: header, or ``length`` letters of either end."""
    inline = length > 0
    found = F.when(location == "header", from_header(F.col("name"))).when((location == "inline_5prime") & inline, F.substring("seq", F.lit(1), length)).when((location == "inline_3prime") & inline, F.substring("seq", F.greatest(F.length("seq") - length + 1, F.lit(1)), length))
    return reads.withColumn("umi_found", standard(found))


def keepers(reads: DataFrame, umi: str = "umi") -> DataFrame:
    """(umi, read_idx, copies): the first read of each UMI."""
    return reads.where(F.col(umi).isNotNull()).groupBy(umi).agg(F.min("read_idx").alias("read_idx"), F.count(F.lit(1)).alias("copies"))


def dedup(reads: DataFrame, umi: str = "umi") -> DataFrame:
    """First read of each UMI; reads without a UMI are dropped."""
    return reads.join(keepers(reads, umi).select("read_idx"), "read_idx", "left_semi")


def stats(reads: DataFrame, umi: str = "umi") -> DataFrame:
    """Totals over reads that carry a UMI, and the duplication rate."""
    s = keepers(reads, umi).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("reads_with_umi"), F.count(F.lit(1)).alias("unique_umis"), F.count_if(F.col("copies") > 1).alias("duplicate_groups"), F.count_if(F.col("copies") == 1).alias("singleton_groups")
    )
    rate = F.coalesce(1 - F.try_divide(F.col("unique_umis").cast("double"), F.col("reads_with_umi").cast("double")), F.lit(0.0))
    return s.withColumn("reads_after_dedup", F.col("unique_umis")).withColumn("duplication_rate", F.bround(rate, 4))


#: consensus of duplicates: as in the original, the first read stands for its group
consensus = dedup
