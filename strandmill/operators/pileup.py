"""Per-site counts under three calling conventions.

Bases are counted per site. Where the reference is asked, reads meet it as pieces and
not base by base. ``kept`` are target bases, ``converted`` converted ones; the
conventions differ in which of them is called methylated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conversion import parse_conversion
from ..functions.sequence import aligned_bases, aligned_pieces, flag_set


def mapped(sam: DataFrame) -> DataFrame:
    return sam.where(~flag_set(F.col("flag"), 4))


#: reference positions that make one row of the join: as many as a long has bits
RUN = 64


def call_ref_anchored(sam: DataFrame, genome: DataFrame, conversion: str = "ct", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sites whose reference is the target: kept = methylated, depth of any base; apart for each of ``keys``.

    Pieces of reads meet runs of the genome, which know their target positions as bits, and only
    bases at those become rows. Tasks then have all pieces of a run, or a part of them where
    it is deep, and count before they send a row a site.
    """
    c = parse_conversion(conversion)
    # only M emits; = X P neither emit nor advance here
    pieces = aligned_pieces(mapped(sam), [*keys, "rname"], RUN, emit="M", ref_ops="MDN", read_ops="MIS")
    own = genome.where(F.col("base") == c.target).select("chrom", F.floor(F.col("pos") / RUN).alias("run"), F.pmod("pos", F.lit(RUN)).cast("int").alias("at"))
    # runs grow with the genome: not to be taken for small from the size of the files it comes from
    runs = own.groupBy("chrom", "run").agg(F.expr("bit_or(shiftleft(1L, at))").alias("targets")).hint("merge")
    met = pieces.withColumnRenamed("rname", "chrom").join(runs, ["chrom", "run"])
    at = F.expr("filter(sequence(0, length(letters) - 1), i -> (shiftrightunsigned(targets, off + i) & 1L) = 1L)")
    told = met.select(*keys, "chrom", "run", "off", "letters", F.explode(at).alias("i"))
    bases = told.select(*keys, "chrom", (F.col("run") * RUN + F.col("off") + F.col("i")).alias("pos"), F.substring(F.col("letters"), F.col("i") + 1, F.lit(1)).alias("base"))
    sites = bases.groupBy(*keys, "chrom", "pos").agg(F.count_if(F.col("base") == c.target).alias("meth_count"), F.count_if(F.col("base") == c.converted).alias("unmeth_count"), F.count(F.lit(1)).alias("coverage"))
    return sites.select(*keys, "chrom", "pos", F.bround(F.col("meth_count") / F.col("coverage"), 4).alias("level"), "meth_count", "unmeth_count", "coverage")


def _stranded(sam: DataFrame, conversion: str, min_qual: int, keep: list[str], by_read_offset: bool = False) -> DataFrame:
    """Bases with strand, class (kept or converted) and quality.

    The quality is looked up at the aligned ordinal, which is shifted behind clips
    and insertions, or at the base's own offset in the read.
    """
    c = parse_conversion(conversion)
    strand = F.when(flag_set(F.col("flag"), 16), "-").otherwise("+")
    rows = mapped(sam).withColumn("strand", strand)
    bases = aligned_bases(rows, [*keep, "rname", "strand"], qual="read" if by_read_offset else "ordinal")
    bases = bases.where((F.col("ref_pos") >= 0) & F.col("q").isNotNull() & (F.ascii("q") - 33 >= min_qual))
    plus = F.col("strand") == "+"
    kept = F.col("base") == F.when(plus, c.target).otherwise(c.complement_target)
    converted = F.col("base") == F.when(plus, c.converted).otherwise(c.complement_converted)
    return bases.withColumn("kept", kept).withColumn("converted", converted).where(kept | converted)


def call_universal(sam: DataFrame, conversion: str = "ct", min_qual: int = 20, min_cov: int = 5, by_read_offset: bool = False) -> DataFrame:
    """No reference; strand by flag 16; converted = methylated."""
    sites = _stranded(sam, conversion, min_qual, [], by_read_offset).groupBy(F.col("rname").alias("chrom"), F.col("ref_pos").alias("pos")).agg(F.count_if("converted").alias("meth_count"), F.count_if("kept").alias("unmeth_count"))
    total = F.col("meth_count") + F.col("unmeth_count")
    return sites.where(total >= min_cov).select("chrom", "pos", F.bround(F.col("meth_count") / total, 4).alias("level"), "meth_count", "unmeth_count", total.alias("coverage"))


#: lines whose qualities at a site are put together by one task
LINES = 1 << 16


def per_base(sam: DataFrame, conversion: str = "ct", min_qual: int = 0, by_read_offset: bool = False) -> DataFrame:
    """By (chrom, 1-based pos, strand): ordered quality strings and counts of both classes.

    Strings are first made for ranges of ``LINES`` lines, then joined, so a deep site
    is worked on by many tasks; only its final strings meet in one row.
    """
    b = _stranded(sam, conversion, min_qual, ["line_no"], by_read_offset)
    site = [F.col("rname").alias("chrom"), (F.col("ref_pos") + 1).alias("pos"), "strand"]
    # line in its range, place in the read, quality and class as one number: sorted as such
    packed = F.pmod("line_no", F.lit(LINES)) * F.lit(1 << 46) + F.col("aligned_idx") * F.lit(1 << 9) + F.ascii("q") * 2 + F.col("converted").cast("int")
    parts = b.groupBy(*site, F.floor(F.col("line_no") / LINES).alias("part")).agg(F.sort_array(F.collect_list(packed.cast("bigint"))).alias("x"))
    told = lambda bit: F.array_join(F.transform(F.filter("x", lambda x: x.bitwiseAND(F.lit(1)) == bit), lambda x: F.char(F.shiftright(x, 1).bitwiseAND(F.lit(255)))), "")
    parts = parts.select("chrom", "pos", "strand", F.struct("part", told(1).alias("yes"), told(0).alias("no")).alias("s"))
    sites = parts.groupBy("chrom", "pos", "strand").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "")
    sites = sites.select("chrom", "pos", "strand", text("yes").alias("converted_quals"), text("no").alias("unconverted_quals"))
    n = lambda c: F.length(c).cast("bigint")
    return sites.select(
        "chrom", "pos", "strand", "converted_quals", n("converted_quals").alias("converted_count"), "unconverted_quals", n("unconverted_quals").alias("unconverted_count"),
        F.bround(n("unconverted_quals") / (n("unconverted_quals") + n("converted_quals")), 6).alias("unconverted_rate"),
    )
