"""Read simulation as columns: genome, truth, conversion, errors, fragments.

Every random choice is a hash of the position or read and the seed, so a
simulated set is the same on any cluster and may be made in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conversion import Conversion, parse_conversion
from ..functions.sequence import reverse_complement


def chance(seed: int, *parts: Column) -> Column:
    """Uniform in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, mean: float, sd: float, *parts: Column) -> Column:
    """Normal by Box-Muller on two hashes."""
    u, v = F.greatest(chance(seed, *parts), F.lit(1e-12)), chance(seed + 7919, *parts)
    return mean + sd * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def pick_base(u: Column) -> Column:
    return F.substring(F.lit("ACGT"), (F.floor(u * 4) + 1).cast("int"), F.lit(1))


def random_genome(spark: SparkSession, length: int, seed: int = 42, chrom: str = "chr_sim") -> DataFrame:
    return spark.range(length).select(F.lit(chrom).alias("chrom"), F.col("id").alias("pos"), pick_base(chance(seed, F.lit("g"), F.col("id"))).alias("base"))


def truth_sites(genome: DataFrame, conversion: "str | Conversion" = "ct", rate: float = 0.7, seed: int = 42) -> DataFrame:
    c = parse_conversion(conversion)
    return genome.where(F.col("base") == c.target).select("chrom", "pos", (chance(seed, F.lit("m"), F.col("pos")) < rate).cast("int").alias("methylated"))


def convert_base(base: Column, methylated: Column, u: Column, conversion: "str | Conversion", rate: float = 0.99) -> Column:
    """Target and its complement by one rule: converted unless methylated, each with chance ``rate``."""
    c = parse_conversion(conversion)
    hit = (~methylated & (u < rate)) | (methylated & (u >= 0.99))
    return F.when((base == c.target) & hit, c.converted).when((base == c.complement_target) & hit, c.complement_converted).otherwise(base)


def substitute(base: Column, u: Column, v: Column, rate: float = 0.01) -> Column:
    """One of the three other bases with chance ``rate``."""
    others = F.array_except(F.array(*[F.lit(b) for b in "ACGT"]), F.array(base))
    return F.when((u < rate) & base.isin(*"ACGT"), F.get(others, F.floor(v * 3).cast("int"))).otherwise(base)


def quality_symbol(seed: int, *parts: Column) -> Column:
    return F.char(33 + F.greatest(F.lit(2), F.least(F.lit(41), F.floor(normal(seed, 30, 5, *parts)).cast("int"))))


def simulate_reads(
    spark: SparkSession,
    genome_length: int = 1_000_000,
    num_reads: int = 50_000,
    read_length: int = 100,
    fragment_mean: float = 300,
    fragment_sd: float = 50,
    methylation_rate: float = 0.7,
    error_rate: float = 0.01,
    conversion_rate: float = 0.99,
    conversion: str = "ct",
    mode: str = "pe",
    seed: int = 42,
) -> dict[str, DataFrame]:
    """{genome, truth, reads}: reads (read_idx, mate, name, seq, qual).

    A read's bases are joined to the genome by position, in blocks of the
    genome's own partitioning, and put together again per read.
    """
    c = parse_conversion(conversion)
    g = random_genome(spark, genome_length, seed)
    truth = truth_sites(g, c, methylation_rate, seed)
    r = F.col("read_idx")
    length = F.greatest(F.lit(2 * read_length + 20), F.floor(normal(seed + 1, fragment_mean, fragment_sd, r)).cast("long"))
    frag = spark.range(num_reads).select(F.col("id").alias("read_idx")).withColumn("flen", F.least(length, F.lit(genome_length)))
    frag = frag.withColumn("start", F.floor(chance(seed + 2, r) * F.greatest(F.lit(1), F.lit(genome_length) - F.col("flen"))).cast("long"))
    if mode == "pe":
        mates = F.array(F.struct(F.lit(1).alias("mate"), F.col("start").alias("from")), F.struct(F.lit(2).alias("mate"), (F.col("start") + F.col("flen") - read_length).alias("from")))
    else:
        mates = F.array(F.struct(F.lit(1).alias("mate"), (F.col("start") + F.floor(chance(seed + 3, r) * (F.col("flen") - read_length + 1))).cast("long").alias("from")))
    cut = frag.select("read_idx", F.explode(mates).alias("m")).select("read_idx", "m.mate", F.explode(F.sequence(F.col("m.from"), F.col("m.from") + read_length - 1)).alias("pos"), F.col("m.from").alias("from"))
    bases = cut.join(g.join(truth, ["chrom", "pos"], "left"), "pos")
    key = (r, F.col("mate"), F.col("pos"))
    made = substitute(convert_base(F.col("base"), F.coalesce("methylated", F.lit(0)) == 1, chance(seed + 4, *key), c, conversion_rate), chance(seed + 5, *key), chance(seed + 6, *key), error_rate)
    whole = bases.select("read_idx", "mate", "pos", made.alias("b"), quality_symbol(seed + 8, *key).alias("q")).groupBy("read_idx", "mate").agg(F.array_sort(F.collect_list(F.struct("pos", "b", "q"))).alias("x"))
    seq = F.array_join(F.transform("x", lambda x: x["b"]), "")
    name = F.concat(F.lit("@sim_read_"), r, F.concat(F.lit("/"), F.col("mate")) if mode == "pe" else F.lit(""))
    reads = whole.select("read_idx", "mate", name.alias("name"), F.when(F.col("mate") == 2, reverse_complement(seq)).otherwise(seq).alias("seq"), F.array_join(F.transform("x", lambda x: x["q"]), "").alias("qual"))
    return {"genome": g, "truth": truth, "reads": reads}
