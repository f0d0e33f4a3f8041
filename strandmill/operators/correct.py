"""Read-level filters, site-level smoothing and motif statistics.

The reference states these only by name and threshold; details are ours:
mates on the same contig have rnext ``=`` or the read's own rname, ``*`` passes;
the context prior is the mean level of a motif's sites worth ``strength`` reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conversion import parse_conversion
from ..functions.sequence import cigar_ops
from ..session import materialize

# fixed values: IUPAC letters
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def filter_mapq(sam: DataFrame, least: int = 20) -> DataFrame:
    return sam.where(F.col("mapq") >= least)


def clip_fraction(sam: DataFrame) -> DataFrame:
    clipped = F.aggregate(F.filter(cigar_ops(F.col("cigar")), lambda o: o["op"] == "S"), F.lit(0), lambda a, o: a + o["len"])
    return sam.withColumn("clip_fraction", F.coalesce(F.try_divide(clipped.cast("double"), F.length("seq").cast("double")), F.lit(0.0)))


def filter_clip(sam: DataFrame, most: float = 0.5) -> DataFrame:
    return clip_fraction(sam).where(F.col("clip_fraction") <= most).drop("clip_fraction")


def filter_pair(sam: DataFrame, most: int = 1000) -> DataFrame:
    same = F.col("rnext").isin("=", "*") | (F.col("rnext") == F.col("rname"))
    return sam.where(same & (F.abs("tlen") <= most))


def split_unconverted(sam: DataFrame, conversion: str = "ct", most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): reads with more than ``most`` target bases are rejected."""
    c = parse_conversion(conversion)
    n = F.length("seq") - F.length(F.replace("seq", F.lit(c.target), F.lit("")))
    counted = sam.withColumn("unconverted", n)
    return counted.where(F.col("unconverted") <= most), counted.where(F.col("unconverted") > most)


def consensus_level(sites: DataFrame, min_depth: int = 5, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Level 1 or 0 where enough reads agree."""
    deep = F.col("coverage") >= min_depth
    level = F.when(deep & (F.col("level") >= high), 1.0).when(deep & (F.col("level") <= low), 0.0).otherwise(F.col("level"))
    return sites.withColumn("consensus_level", level)


def flank_for(read_length: int) -> int:
    return 0 if read_length < 80 else 1 if read_length < 150 else 2 if read_length < 500 else 3


#: genome positions whose bases make one row, a power of two
RUN = 32


def site_motifs(sites: DataFrame, genome: DataFrame, flank: int) -> DataFrame:
    """Adds ``motif``: the bases ``flank`` to either side.

    The genome is put together to runs of ``RUN`` positions, which know ``flank``
    bases of their neighbours; each site meets its own run in an equi-join. Sites at a
    contig's edge get a shorter motif, those without any base near have no row. Runs
    are never broadcast: they grow with the genome, whatever the files it comes from.
    """
    run = lambda at: F.shiftright(at.cast("bigint"), RUN.bit_length() - 1)
    first, last = run(F.col("pos") - flank), run(F.col("pos") + flank)
    inside = lambda: F.col("pos").cast("bigint") - F.col("__run") * RUN
    # place in the run and letter as one small number, in order of the place
    g = genome.select(F.col("chrom").alias("__chrom"), "pos", "base", F.explode(F.sequence(first, last)).alias("__run"))
    g = g.select("__chrom", "__run", ((inside() + flank) * 256 + F.ascii("base")).cast("int").alias("x"))
    runs = g.groupBy("__chrom", "__run").agg(F.sort_array(F.collect_list("x")).alias("__x")).hint("merge")
    # an array of one, so that the site's own place is found once and not for each letter
    near = F.transform(F.array((inside() * 256).cast("int")), lambda low: F.filter("__x", lambda x: (x >= low) & (x < low + 256 * (2 * flank + 1))))[0]
    at = sites.join(runs, (F.col("chrom") == F.col("__chrom")) & (run(F.col("pos")) == F.col("__run")))
    motif = F.array_join(F.transform(near, lambda x: F.char(x.bitwiseAND(F.lit(255)).cast("bigint"))), "")
    return at.withColumn("motif", motif).drop("__chrom", "__run", "__x").where("motif <> ''")


def context_posterior(sites: DataFrame, strength: float = 2.0) -> DataFrame:
    """Beta-binomial posterior level with the motif's mean as prior."""
    prior = sites.groupBy("motif").agg((F.sum("meth_count") / F.sum("coverage")).alias("prior"))
    both = sites.join(prior, "motif")  # few motifs: Spark broadcasts by their size
    return both.withColumn("posterior", F.bround((F.col("prior") * strength + F.col("meth_count")) / (strength + F.col("coverage")), 6)).withColumn("prior", F.bround("prior", 6))


def motif_enrichment(sites: DataFrame) -> DataFrame:
    """Share of each motif among methylated over that among other sites; needs motif, methylated."""
    m = F.col("methylated") == 1
    per = sites.groupBy("motif").agg(F.count_if(m).alias("methylated"), F.count_if(~m).alias("unmethylated"))
    total = per.agg(F.sum("methylated").alias("tm"), F.sum("unmethylated").alias("tu"))
    ratio = F.try_divide(F.col("methylated") * F.col("tu").cast("double"), F.col("tm").cast("double") * F.col("unmethylated"))
    return per.join(F.broadcast(total)).select("motif", "methylated", "unmethylated", F.bround(ratio, 4).alias("enrichment"))


def iupac_pattern(motif: str) -> str:
    return "".join(f"[{IUPAC[x]}]" for x in motif.upper())


def match_iupac(rows: DataFrame, column: str, motifs: str) -> DataFrame:
    """Rows whose ``column`` holds any of the comma-separated motifs."""
    return rows.where(F.col(column).rlike("|".join(iupac_pattern(m.strip()) for m in motifs.split(","))))


FEATURES = ["mapq", "read_length", "clip_fraction", "abs_tlen", "mean_quality", "unconverted", "converted", "gc", "reverse"]


def read_features(sam: DataFrame, conversion: str = "ct") -> DataFrame:
    """Nine features of a read, all inside the JVM."""
    c = parse_conversion(conversion)
    count = lambda letters: F.length("seq") - F.length(F.translate("seq", letters, ""))
    q = F.transform(F.split("qual", ""), lambda x: F.ascii(x) - 33)
    return clip_fraction(sam).select(
        "line_no", F.col("mapq").cast("double").alias("mapq"), F.length("seq").cast("double").alias("read_length"), "clip_fraction", F.abs("tlen").cast("double").alias("abs_tlen"),
        F.coalesce(F.try_divide(F.aggregate(q, F.lit(0), lambda a, x: a + x).cast("double"), F.size(q).cast("double")), F.lit(0.0)).alias("mean_quality"),
        count(c.target).cast("double").alias("unconverted"), count(c.converted).cast("double").alias("converted"), F.coalesce(F.try_divide(count("GC").cast("double"), F.length("seq").cast("double")), F.lit(0.0)).alias("gc"),
        F.when(F.col("flag").bitwiseAND(16) != 0, 1.0).otherwise(0.0).alias("reverse"),
    )


def model_filter(sam: DataFrame, labelled: DataFrame, threshold: float = 0.5, conversion: str = "ct") -> DataFrame:
    """Reads with the chance of being wrong below ``threshold``.

    ``labelled``: (line_no, label 0/1). Logistic regression fitted by Spark. Features and
    labels are written once, since the fit goes over them again and again. Runs jobs at once.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = materialize(read_features(sam, conversion).join(labelled, "line_no", "left"), "features")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(rows.where("label is not null"))
    wrong = model.transform(rows).select("line_no", vector_to_array("probability")[1].alias("wrong"))
    return wrong.where(F.col("wrong") < threshold)
