"""The flagship flow as one lazy plan: reads, seeds, hits, sites, scores, ranks.

``sample`` is a column, so many samples are one job; files appear only at the
ends. The aligner contract is a pair of functions on DataFrames, so another
aligner's SAM or BED enters through the scans.

Contigs lie on one axis of blocks, with room between them, so that a place on the
axis is one number for the joins; hits are put back onto their contig by block.
"""

from __future__ import annotations

import shutil
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import adapters, align, correct, evaluate, pileup, simulate, umi
from ..session import materialize
from ..sources import textfiles


class Aligner(Protocol):
    name: str

    def align(self, reads: DataFrame, blocks: DataFrame, genome_length: int) -> DataFrame: ...

    def call(self, sam: DataFrame, genome: DataFrame) -> DataFrame: ...


class SeedExtend:
    """The built-in aligner."""

    name = "seed_extend"

    def __init__(self, read_length: int, conversion: str = "ct", k: int | None = None):
        self.read_length, self.conversion = read_length, conversion
        tiers = ((40, 8), (60, 10), (80, 12), (120, 14))
        self.k = k or next((v for most, v in tiers if read_length < most), 16)

    @property
    def reach(self) -> int:
        """Bases from a hit's start that are looked at."""
        return self.read_length + max(50, 2 * self.read_length)

    def align(self, reads: DataFrame, blocks: DataFrame, genome_length: int) -> DataFrame:
        return align.to_sam(reads, align.align(reads, blocks, genome_length, self.read_length, self.k, self.conversion))

    def align_contigs(self, reads: DataFrame, axis: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """SAM rows of reads against an axis of contigs (``contig_axis``)."""
        end = (axis.agg(F.max("block_id")).first()[0] or 0) * BLOCK + BLOCK
        hits = align.align(reads, axis.select("block_id", "seq"), max(end, self.read_length), self.read_length, self.k, self.conversion).drop("chrom")
        placed = hits.join(axis.select(F.col("block_id").alias("__b"), "chrom", "shift"), F.floor(F.col("start") / BLOCK) == F.col("__b"))
        return align.to_sam(reads, placed.withColumn("start", F.col("start") - F.col("shift")), keep)

    def call(self, sam: DataFrame, genome: DataFrame) -> DataFrame:
        return pileup.call_ref_anchored(sam, genome, self.conversion)


class Scanned:
    """Another program's output as an aligner: its SAM file, or the BED7 file of its calls."""

    def __init__(self, name: str, sam: str | None = None, bed: str | None = None, conversion: str = "ct"):
        if not (sam or bed):
            raise ValueError(f"{name}: give a SAM or a BED file")
        self.name, self.sam, self.bed, self.conversion = name, sam, bed, conversion

    def calls(self, spark: SparkSession, genome: DataFrame) -> DataFrame:
        if self.bed:
            return textfiles.read_bed(spark, self.bed).select("chrom", F.col("start").alias("pos"), "level", "meth_count", "unmeth_count", "coverage")
        return pileup.call_ref_anchored(textfiles.read_sam(spark, self.sam), genome, self.conversion)


REGISTRY = {SeedExtend.name: SeedExtend}
# fixed values: programs whose SAM or BED output can be read in
EXTERNAL = ("bwameth.py", "bsbolt", "bsmap", "walt", "abismal", "batmeth2", "basal", "hisat-3n", "bismark", "bs_seeker2-align.py")


def available_tools() -> dict[str, bool]:
    return {name: shutil.which(name) is not None for name in EXTERNAL}


def blocks_of(genome: DataFrame, block: int = 32) -> DataFrame:
    """(block_id, seq) of a one-contig genome of single bases."""
    return genome.groupBy(F.floor(F.col("pos") / block).alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


BLOCK = 32


def contig_axis(blocks: DataFrame, reach: int) -> DataFrame:
    """(block_id, chrom, shift, seq): the blocks of all contigs on one axis, contigs more than ``reach`` bases apart."""
    room = -(-reach // BLOCK) + 2
    sizes = blocks.groupBy("chrom").agg((F.max("block_id") + 1 + room).alias("n"))
    # one row a contig
    before = F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(sizes.select("chrom", before.alias("first")), "chrom")
    return placed.select((F.col("first") + F.col("block_id")).alias("block_id"), "chrom", (F.col("first") * BLOCK).alias("shift"), "seq")


def bases_of(axis: DataFrame) -> DataFrame:
    """(chrom, pos, base) of an axis."""
    each = axis.select("chrom", (F.col("block_id") * BLOCK - F.col("shift")).alias("at"), F.posexplode(F.split("seq", "")).alias("i", "base"))
    return each.select("chrom", (F.col("at") + F.col("i")).alias("pos"), "base")


def preprocess(reads: DataFrame, s: Settings) -> DataFrame:
    """Trimmed and deduplicated reads, as far as the settings ask for it; mates stay together."""
    if s.adapters.trim:
        first = s.adapters.first
        if first is None:
            most = adapters.detect(reads.where("mate = 1")).orderBy(F.desc("reads")).first()
            first = most["adapter"] if most else None
        if first:
            second = adapters.ADAPTERS[s.adapters.second] if s.adapters.second else None
            reads = adapters.trim_mates(reads, adapters.ADAPTERS[first], second, s.conversion, min_overlap=s.adapters.min_overlap, max_error=s.adapters.max_error)
    if s.umi.dedup:
        one = reads.where("mate = 1").withColumn("library", F.col("sample"))
        where = F.lit(s.umi.location)
        if s.umi.location == "auto":
            one = one.join(umi.detect(one).select("library", "location"), "library", "left")
            where = F.col("location")
        keyed = umi.extract(one, where, F.lit(s.umi.length)).where("umi_found is not null")
        # a UMI belongs to its sample; the second mate follows the first
        kept = umi.keepers(keyed.withColumn("umi", F.concat_ws("|", "sample", "umi_found"))).select("read_idx")
        reads = reads.join(kept, "read_idx", "left_semi")
    return reads


def correct_reads(sam: DataFrame, s: Settings, labelled: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(reads kept, reads rejected as unconverted): the read strategies in order."""
    c, rejected = s.correction, None
    for name in c.strategies:
        if name == "mapq":
            sam = correct.filter_mapq(sam, c.min_mapq)
        elif name == "clip":
            sam = correct.filter_clip(sam, c.max_clip)
        elif name == "pair":
            sam = correct.filter_pair(sam, c.max_insert)
        elif name == "unconverted":
            sam, rejected = correct.split_unconverted(sam, s.conversion, c.max_unconverted)
            sam, rejected = sam.drop("unconverted"), rejected.drop("unconverted")
        elif name == "model":
            if labelled is None:
                raise ValueError("the model strategy needs labelled reads")
            sam = sam.join(correct.model_filter(sam, labelled, c.threshold, s.conversion).select("line_no"), "line_no", "left_semi")
        elif name not in ("consensus", "context"):
            raise ValueError(f"no strategy: {name}")
    return sam, rejected


def correct_sites(calls: DataFrame, genome: DataFrame, read_length: int, s: Settings) -> DataFrame:
    """Calls with levels set by the site strategies in order."""
    c = s.correction
    for name in c.strategies:
        if name == "consensus":
            calls = correct.consensus_level(calls, c.min_depth, c.high, c.low).withColumn("level", F.col("consensus_level")).drop("consensus_level")
        elif name == "context":
            sites = calls.select("chrom", "pos", "meth_count", "coverage").groupBy("chrom", "pos").agg(F.sum("meth_count").alias("meth_count"), F.sum("coverage").alias("coverage"))
            told = correct.context_posterior(correct.site_motifs(sites, genome, correct.flank_for(read_length))).select("chrom", "pos", "posterior")
            calls = calls.join(told, ["chrom", "pos"], "left").withColumn("level", F.coalesce("posterior", "level")).drop("posterior")
    return calls


def run(spark: SparkSession, reads: DataFrame, contigs: DataFrame, truth: DataFrame | None, settings: Settings, labelled: DataFrame | None = None, others: tuple[Scanned, ...] = ()) -> dict[str, DataFrame]:
    """Everything from reads to ranks: {reads, sam, rejected, calls, scores, ranking}.

    ``reads``: read_idx (one for both mates, unique over samples), mate, name, seq,
    qual and, for more than one, sample; null seq or qual are left out. ``contigs``:
    chrom, seq, length, or blocks of ``BLOCK`` bases: chrom, block_id, seq. ``truth``: chrom, pos, methylated. A sample without calls has
    a row with status ``no_output``. ``others`` are scanned outputs of other aligners,
    for a run of one sample. Alignments are written once and read by what
    follows.
    """
    if "sample" not in reads.columns:
        reads = reads.withColumn("sample", F.lit("all"))
    reads = reads.withColumn("mate", F.coalesce("mate", F.lit(1))).where("seq is not null and qual is not null").select("sample", "read_idx", "mate", "name", F.upper("seq").alias("seq"), "qual")
    samples = reads.select("sample").distinct()
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 1
    own = SeedExtend(longest, settings.conversion, settings.aligner.seed_length)
    blocks = contigs if "block_id" in contigs.columns else textfiles.fasta_blocks(contigs, BLOCK)
    axis = materialize(contig_axis(blocks, own.reach), "contigs")
    ready = preprocess(reads, settings)
    # positional mates: both are aligned as they are
    first, second = (own.align_contigs(ready.where(F.col("mate") == m), axis, ("sample",)) for m in (1, 2))
    sam = materialize(align.join_mates(first, second) if settings.mode == "pe" else first, "alignments")
    kept, rejected = correct_reads(sam, settings, labelled)
    genome = bases_of(axis)
    calls = pileup.call_ref_anchored(kept, genome, settings.conversion, ("sample",)).where(F.col("coverage") >= settings.min_cov)
    calls = correct_sites(calls, genome, longest, settings).withColumn("aligner", F.lit(own.name))
    for other in others:
        one = other.calls(spark, genome).where(F.col("coverage") >= settings.min_cov).withColumn("aligner", F.lit(other.name))
        calls = calls.unionByName(one.join(F.broadcast(samples.limit(1))).select(*calls.columns))
    out = {"reads": ready, "sam": kept, "calls": calls}
    if rejected is not None:
        out["rejected"] = rejected
    if truth is not None:
        scores = evaluate.metrics(calls, truth, ["sample", "aligner"])
        names = spark.createDataFrame([(own.name,), *((o.name,) for o in others)], "aligner string")
        known = samples.join(F.broadcast(names)).join(calls.groupBy("sample", "aligner").agg(F.count(F.lit(1)).alias("sites_called")), ["sample", "aligner"], "left")
        status = F.when(F.col("sites_called").isNull(), "no_output").when(F.col("sites_overlap").isNull(), "no_overlap").otherwise("ok")
        out["scores"] = known.join(scores, ["sample", "aligner"], "left").withColumn("status", status)
        out["ranking"] = evaluate.ranked(evaluate.metrics(calls, truth, ["aligner"]))
    return out


def run_simulated(spark: SparkSession, settings: Settings) -> DataFrame:
    """Ranked scores of the built-in and four mock aligners on simulated reads."""
    s = settings.simulation
    made = simulate.simulate_reads(spark, s.genome_length, s.num_reads, s.read_length, methylation_rate=s.methylation_rate, error_rate=s.error_rate, conversion_rate=s.conversion_rate, conversion=settings.conversion, mode=settings.mode, seed=settings.seed)
    contigs = blocks_of(made["genome"]).withColumn("chrom", F.lit("chr_sim"))
    calls = run(spark, made["reads"], contigs, made["truth"], settings)["calls"].drop("sample")
    every = calls.unionByName(align.mock_call(made["genome"], settings.conversion[0].upper()).select(*calls.columns))
    return evaluate.ranked(evaluate.metrics(every, made["truth"], ["aligner"]))


def run_batch(spark: SparkSession, samples: list[tuple[dict, Settings]]) -> DataFrame:
    """(sample, group, conversion, aligner, scores..., status) of simulated samples; one that fails has its error as status."""
    rows = []
    for who, settings in samples:
        try:
            for r in run_simulated(spark, settings).collect():
                rows.append((who["sample"], who["group"], settings.conversion, r["aligner"], r["f1_score"], r["precision"], r["recall"], r["accuracy"], r["sites_overlap"], "ok"))
        except Exception as e:  # noqa: BLE001 - a sample's failure is part of the result
            rows.append((who["sample"], who["group"], settings.conversion, None, None, None, None, None, None, f"error: {e}"[:200]))
    return spark.createDataFrame(rows, "sample string, grp string, conversion string, aligner string, f1_score double, precision double, recall double, accuracy double, sites_overlap bigint, status string")
