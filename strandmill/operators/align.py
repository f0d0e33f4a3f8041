"""Seed-and-extend alignment of converted reads.

Seeds are three-letter k-mers as base-3 codes. Votes of the seeds for places are
counted in ``places``, task by task, where the best few candidates of a read get their stretch of
the genome too. Scores are numpy over Arrow batches of many reads.

Hits of a seed grow with the genome: about its length over 3**k. With the seed
lengths by read length (8 to 16) that suits small genomes; ``seed_length_for`` gives
one that keeps hits few for a larger one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conversion import parse_conversion, three_letter_code
from ..functions.sequence import kmer_code
from . import places


def seed_length(read_length: Column) -> Column:
    return F.when(read_length < 40, 8).when(read_length < 60, 10).when(read_length < 80, 12).when(read_length < 120, 14).otherwise(16)


def seed_length_for(genome_length: int, hits: int = 1) -> int:
    """Least k with about ``hits`` random places of a code in the genome."""
    k = 8
    while 3**k * hits < genome_length:
        k += 1
    return k


def seed_step(read_length: int, k: int) -> int:
    return max(1, read_length // 10) if read_length < 100 else max(1, k // 2)


def max_candidates(read_length: int, most: int = 10) -> int:
    return min(most, 5) if read_length < 100 else most


def ref_seed_index(blocks: DataFrame, k: int, conversion: str = "ct", block: int = 32, chrom: str = "chr_sim") -> DataFrame:
    """(chrom, pos, code) of every k-mer (k up to ``block`` + 1); blocks meet their right neighbour."""
    right = blocks.select((F.col("block_id") - 1).alias("block_id"), F.substring("seq", 1, k - 1).alias("tail"))
    long = blocks.join(right, "block_id", "left").select("block_id", three_letter_code(F.concat("seq", F.coalesce("tail", F.lit(""))), conversion).alias("digits"))
    last = F.least(F.lit(block), F.length("digits") - k + 1)
    at = long.where(last > 0).select("block_id", "digits", F.explode(F.sequence(F.lit(0), last - 1)).alias("i"))
    return at.select(F.lit(chrom).alias("chrom"), (F.col("block_id") * block + F.col("i")).alias("pos"), kmer_code(F.substring("digits", F.col("i") + 1, F.lit(k))).alias("code"))


def read_seeds(reads: DataFrame, k: int, step: int, conversion: str = "ct") -> DataFrame:
    """(read_idx, seed_start, code); reads shorter than k have none."""
    digits = reads.where(F.length("seq") >= k).select("read_idx", three_letter_code(F.col("seq"), conversion).alias("digits"))
    at = digits.select("read_idx", "digits", F.explode(F.sequence(F.lit(0), F.length("digits") - k, F.lit(step))).alias("seed_start"))
    return at.select("read_idx", "seed_start", kmer_code(F.substring("digits", F.col("seed_start") + 1, F.lit(k))).alias("code"))


def score_matrix(conversion: str) -> np.ndarray:
    """[ref, read] over A C G T: 1 equal, 0 for the pair of the conversion, else -1."""
    c = parse_conversion(conversion)
    m = np.full((4, 4), -1, np.int32)
    np.fill_diagonal(m, 1)
    a, b = "ACGT".index(c.target), "ACGT".index(c.converted)
    m[a, b] = m[b, a] = 0
    return m


def _places_of(conversion: str) -> np.ndarray:
    """A number for each byte: equal letters differ by 0, the pair of the conversion by 1, others by more."""
    c = parse_conversion(conversion)
    rest = [b for b in "ACGT" if b not in (c.target, c.converted)]
    t = np.zeros(256, np.int8)
    at = dict(zip((c.target, c.converted, *rest), (10, 11, 20, 30)))
    t[:] = at["A"]  # other letters count as A
    for b, n in at.items():
        t[ord(b)] = t[ord(b.lower())] = n
    return t


def _columns(texts: pa.Array, table: np.ndarray, pad: int, kind) -> np.ndarray:
    """A column a string, ``pad`` after its end."""
    data, offsets = places.bytes_of(texts)
    size = np.diff(offsets)
    out = np.full((len(size), int(size.max(initial=0))), pad, np.int8)
    out[np.arange(out.shape[1]) < size[:, None]] = table[data]
    return np.ascontiguousarray(out.T, kind)


def local_scores(reads: list[str] | pa.Array, regions: list[str] | pa.Array, conversion: str = "ct", gap_open: int = -4, gap_extend: int = -1) -> np.ndarray:
    """Best local score of each pair, pairs side by side.

    Gaps in the read extend at ``gap_extend``; a gap that skips reference bases
    is one base long at most, at ``gap_open``. A letter scores 1 less its
    distance, -1 at least, as in ``score_matrix``; padding ends each string, so what
    reaches it only loses.
    """
    reads, regions = (x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in (reads, regions))
    table = _places_of(conversion)
    # the smallest integers that no score can leave: it is at most a read's length
    rows, least = int(np.diff(places.bytes_of(reads)[1]).max(initial=0)), min(gap_open, gap_extend)
    kind = np.int8 if rows <= 100 and least >= -20 else np.int16 if rows < 5000 and least > -5000 else np.int32
    x, y = _columns(reads, table, 60, kind), _columns(regions, table, 100, kind)
    cols, p = y.shape
    # m is never below 0, so gaps that are count for nothing, however low
    m, best = np.zeros((cols + 1, p), kind), np.zeros((cols + 1, p), kind)
    opened, gap = np.full((cols + 1, p), gap_open, kind), np.full((cols + 1, p), gap_open, kind)
    before, apart = np.empty((cols, p), kind), np.empty((cols, p), kind)
    # rows in place of numbers: numpy takes the least of two arrays ten times as fast
    two, minus = np.full(p, 2, kind), np.full(p, -1, kind)
    for i in range(rows):
        np.maximum(m[:-1], gap[:-1], out=before)
        np.maximum(before[1:], opened[:-2], out=before[1:])
        gap += kind(gap_extend)
        np.maximum(gap, opened, out=gap)
        np.subtract(y, x[i], out=apart)
        np.abs(apart, out=apart)
        np.minimum(apart, two, out=apart)
        before -= apart
        np.maximum(before, minus, out=before)
        np.add(before, kind(1), out=m[1:])
        np.add(m, kind(gap_open), out=opened)
        np.maximum(best, m, out=best)
    return best.max(axis=0).astype(np.int32)


#: columns of a candidate after its seq and region are looked at
SCORED = "read_idx long, chrom string, start long, seeds long, cand_rank int"


def gapped(conversion: str = "ct", gap_open: int = -4, gap_extend: int = -1, block: int = 512):
    """Function of a batch: its gapped scores."""

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        s, r = batch.column("seq"), batch.column("region")
        return np.concatenate([np.zeros(0, np.int32), *(local_scores(s.slice(a, block), r.slice(a, block), conversion, gap_open, gap_extend) for a in range(0, len(s), block))])

    return scores


def ungapped(name: str, conversion: str = "ct"):
    """Function of a batch: its ``mismatches``, letters that differ after the read's converted base is
    written as the target, or ``score``, that of the same matrix without gaps."""
    return lambda batch: _side_by_side(batch, conversion, name)


def told(values, name: str, best: bool = False, scored: str = SCORED) -> tuple:
    """(function of a batch, schema) for ``places.candidates``: ``values`` of a batch as ``name`` in place of seq
    and region; ``best`` keeps one row a read, that of the highest value, the better candidate on ties.
    ``scored`` are the columns that leave the task."""
    sent = [c.split()[0] for c in scored.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = values(batch)
        keep = [c for c in batch.schema.names if c in sent]
        batch = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(value)], names=[*keep, name])
        if best:
            read = batch.column("read_idx").to_numpy()
            order = np.lexsort((batch.column("cand_rank").to_numpy(), -value, read))
            batch = batch.take(pa.array(order[places.first_of(read[order], 1)]))
        return batch

    return run, f"{scored}, {name} int"


def _side_by_side(batch: pa.RecordBatch, conversion: str, name: str) -> np.ndarray:
    """Mismatches or ungapped score of the columns seq and region."""
    c = parse_conversion(conversion)
    (x, xo), (y, yo) = (places.bytes_of(batch.column(n)) for n in ("seq", "region"))
    xs, ys = np.diff(xo), np.diff(yo)
    most = max(xs.max(initial=0), ys.max(initial=0))
    if len(xs) and (xs == most).all() and (ys == most).all():
        a, b, x_at, both = x.reshape(-1, most), y.reshape(-1, most), True, True
    else:
        wide = np.arange(most)
        x_at, y_at = wide < xs[:, None], wide < ys[:, None]
        a, b = np.zeros(x_at.shape, np.uint8), np.zeros(y_at.shape, np.uint8)
        a[x_at], b[y_at] = x, y
        both = x_at & y_at
    target, converted = ord(c.target), ord(c.converted)
    if name == "mismatches":
        differ = np.where(a == converted, np.uint8(target), a) != b
        return np.count_nonzero(differ & x_at, axis=1).astype(np.int32)
    equal, pair = a == b, ((a == target) & (b == converted)) | ((a == converted) & (b == target))
    return (np.count_nonzero(equal & both, axis=1) - np.count_nonzero(~(equal | pair) & both, axis=1)).astype(np.int32)


def compared(regions: DataFrame, name: str, conversion: str = "ct") -> DataFrame:
    """Adds ``ungapped`` values; drops seq and region."""
    keep = [c for c in regions.columns if c not in ("seq", "region")]
    kinds = dict(regions.dtypes)
    run = told(ungapped(name, conversion), name, scored=", ".join(keep))[0]
    return regions.mapInArrow(lambda batches: map(run, batches), ", ".join([*(f"{c} {kinds[c]}" for c in keep), f"{name} int"]))


def best_hit(scored: DataFrame) -> DataFrame:
    """Highest score of each read; the better candidate on ties."""
    top = scored.groupBy("read_idx").agg(F.max_by(F.struct(*[c for c in scored.columns if c != "read_idx"]), F.struct("score", -F.col("cand_rank"))).alias("__t"))
    return top.select(*["read_idx" if c == "read_idx" else F.col(f"__t.{c}").alias(c) for c in scored.columns])


def align(reads: DataFrame, blocks: DataFrame, genome_length: int, read_length: int, k: int, conversion: str = "ct") -> DataFrame:
    """Best gapped hit of each read that has one."""
    band = max(50, 2 * read_length)
    found = places.candidates(reads, blocks, genome_length, read_length, k, seed_step(read_length, k), max_candidates(read_length), conversion=conversion, region=read_length + band, finish=told(gapped(conversion), "score", best=True))
    return best_hit(found.drop("seeds"))


def to_sam(reads: DataFrame, hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alignment rows, unmapped reads with flag 4; ``keep`` names further columns of the reads."""
    both = reads.join(hits.select("read_idx", "chrom", "start", "score"), "read_idx", "left")
    ok = F.col("start").isNotNull()
    return both.select(
        F.col("read_idx").alias("line_no"), F.ltrim(F.col("name"), F.lit("@")).alias("qname"), F.when(ok, 0).otherwise(4).alias("flag"), F.coalesce("chrom", F.lit("*")).alias("rname"), F.coalesce(F.col("start") + 1, F.lit(0)).alias("pos"),
        F.when(ok, 60).otherwise(0).alias("mapq"), F.when(ok, F.concat(F.length("seq"), F.lit("M"))).otherwise("*").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", "qual", F.col("score").alias("AS"), *keep,
    )


def join_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Flags 99 and 147 for pairs, 77 where the first mate is unmapped; a second without a first has no row."""
    one = first.withColumn("flag", F.when(F.col("flag") == 4, 77).otherwise(99))
    placed = first.where("flag <> 4").select("line_no")
    return one.unionByName(second.where("flag <> 4").join(placed, "line_no", "left_semi").withColumn("flag", F.lit(147)))


# fixed values: shares of right calls by mock aligner
MOCKS = {"mock_perfect": 0.98, "mock_good": 0.88, "mock_medium": 0.75, "mock_poor": 0.55}


def _share(*parts: Column) -> Column:
    """0..65535 from the first four md5 digits of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 4), 16, 10).cast("int")


def mock_align(reads: DataFrame, genome_length: int, read_length: int) -> DataFrame:
    """Every read at a hashed place."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("read_idx").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return reads.select("read_idx", (at % (genome_length - read_length) + 1).alias("pos"), F.lit(60).alias("mapq"), F.lit(f"{read_length}M").alias("cigar"))


def mock_call(genome: DataFrame, target: str = "C") -> DataFrame:
    """Calls of four mock aligners at every target base; they never see the truth.

    With chance ``accuracy`` a site is methylated with chance 0.7, else 0.3.
    """
    mocks = F.array(*[F.struct(F.lit(n).alias("aligner"), F.lit(int(a * 65536)).alias("sharp")) for n, a in MOCKS.items()])
    sites = genome.where(F.col("base") == target).select("chrom", "pos", F.explode(mocks).alias("k")).select("chrom", "pos", "k.aligner", "k.sharp")
    pos = F.col("pos").cast("string")
    sharp = _share(F.lit("n"), F.col("aligner"), pos) < F.col("sharp")
    meth = _share(F.lit("m"), F.col("aligner"), pos) < F.when(sharp, int(0.7 * 65536)).otherwise(int(0.3 * 65536))
    return sites.select("aligner", "chrom", "pos", F.when(meth, 0.85).otherwise(0.12).alias("level"), F.when(meth, 8).otherwise(1).alias("meth_count"), F.when(meth, 2).otherwise(9).alias("unmeth_count"), F.lit(10).alias("coverage"))
