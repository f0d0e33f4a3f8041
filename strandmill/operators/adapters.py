"""Adapter detection inside the JVM, and 3' trimming over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conversion import parse_conversion

# fixed values: the known adapters, in the order in which they are tried
ADAPTERS = {
    "illumina_universal": "AGATCGGAAGAGC",
    "illumina_small_rna": "TGGAATTCTCGG",
    "nextera": "CTGTCTCTTATA",
    "polya": "AAAAAAAAAAAA",
    "polyt": "TTTTTTTTTTTT",
    "truseq_r1": "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "truseq_r2": "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "nebnext": "GATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "solexa": "TCGTATGCCGTCTTCTGCTTG",
}


def adapter_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(ADAPTERS.items())], "adapter_no int, adapter string, sequence string")


def windows_of(sequence: str) -> list[str]:
    """8-mers of an adapter with the shorter ones at its end (6 letters or more)."""
    return [sequence[i : i + 8] for i in range(len(sequence) - 5)]


def detect(reads: DataFrame, share: float = 0.01, top: int = 20) -> DataFrame:
    """(tail, reads, adapter): frequent 12-letter read ends that hold a piece of an adapter.

    Ends are counted with map-side combine; only ``top`` rows meet the adapters.
    The first adapter in table order names an end.
    """
    tails = reads.where(F.length("seq") >= 10).select(F.substring("seq", F.greatest(F.length("seq") - 11, F.lit(1)), F.lit(12)).alias("tail"))
    counted = tails.groupBy("tail").agg(F.count(F.lit(1)).alias("reads"))
    total = counted.agg(F.sum("reads").alias("n"))
    most = counted.orderBy(F.desc("reads"), "tail").limit(top).join(F.broadcast(total)).where(F.col("reads") >= F.col("n") * share)
    name = F.coalesce(*[F.when(F.col("tail").rlike("|".join(windows_of(s))), n) for n, s in ADAPTERS.items()])
    return most.select("tail", "reads", name.alias("adapter")).where("adapter is not null")


def first_fit(seqs: list[str | None], forms: list[str], min_overlap: int = 6, max_error: float = 0.1) -> np.ndarray:
    """Smallest offset at which any form fits ungapped to the read's end, -1 if none.

    The overlap is what of the adapter lies in the read; it needs ``min_overlap``
    letters, as many matches, and a share of mismatches of at most ``max_error``.
    All reads of a batch are compared at one offset at a time.
    """
    raw = [(s or "").encode() for s in seqs]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    wide, most = int(lens.max(initial=0)), max(map(len, forms))
    grid = np.zeros((len(raw), wide + most), np.uint8)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    grid[np.repeat(np.arange(len(raw)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    cut = np.full(len(raw), -1, np.int64)
    for i in range(max(0, wide - min_overlap + 1)):
        open_ = np.flatnonzero((cut < 0) & (lens - i >= min_overlap))
        if not len(open_):
            continue
        for form in forms:
            overlap = np.minimum(lens[open_] - i, len(form))
            same = (grid[open_, i : i + len(form)] == np.frombuffer(form.encode(), np.uint8)).sum(axis=1)
            fits = (same >= min_overlap) & (1 - same / overlap <= max_error)
            cut[open_[fits]] = i
    return cut


def trim(reads: DataFrame, adapter: str, conversion: str = "ct", min_overlap: int = 6, max_error: float = 0.1) -> DataFrame:
    """Reads cut at the adapter or its fully converted form, whichever comes first.

    Offset 0 gives an empty read; no read is dropped; null stays null.
    """
    c = parse_conversion(conversion)
    forms = sorted({adapter, adapter.replace(c.target, c.converted)})

    @F.pandas_udf("int")
    def cut(seq: pd.Series) -> pd.Series:
        at = pd.Series(first_fit(seq.tolist(), forms, min_overlap, max_error), index=seq.index)
        return at.astype("Int32").mask(at < 0)

    out = reads.withColumn("cut_at", cut(F.col("seq")))
    for column in ("seq", "qual"):
        if column in reads.columns:
            out = out.withColumn(column, F.when(F.col("cut_at").isNull(), F.col(column)).otherwise(F.substring(column, F.lit(1), F.col("cut_at"))))
    return out


def trim_mates(reads: DataFrame, first: str, second: str | None = None, conversion: str = "ct", **params) -> DataFrame:
    """Both mates, each by its adapter (the second's is the first's where none is given), apart from each other."""
    rest = F.coalesce(F.col("mate"), F.lit(1)) != 2
    one = trim(reads.where(rest), first, conversion, **params)
    return one.unionByName(trim(reads.where(~rest), second or first, conversion, **params))


def trim_stats(trimmed: DataFrame) -> DataFrame:
    return trimmed.agg(F.count(F.lit(1)).alias("total_reads"), F.count("cut_at").alias("trimmed_reads"), F.count_if(F.col("seq") == "").alias("empty_reads"), F.sum(F.length("seq")).alias("bases_left"))
