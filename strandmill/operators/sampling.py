"""Seeded samples without a driver loop.

A row's place in the draw is the md5 of its id and the seed, so the same rows
come out on every run and any partitioning; taking the first n is a TakeOrdered
(each task keeps n rows), not a global sort. For shares of a large set there is
``sample_percent``, which takes no more than a sliver in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def draw_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


#: rows up to which a draw is ordered in one task
ONE_TASK = 100_000


def sample_reads(reads: DataFrame, n: int, seed: int = 42, id_col: str = "read_idx") -> DataFrame:
    """min(n, all) rows, each set of rows as likely as another."""
    if n > ONE_TASK:
        return _first_drawn(reads, lambda total: min(n, total), seed, id_col)
    return reads.orderBy(draw_key(id_col, seed), id_col).limit(n)


def sample_pairs(read1: DataFrame, read2: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Pairs stay together; a read without its mate takes no part."""
    picked = sample_reads(read1.join(read2.select("read_idx"), "read_idx", "left_semi"), n, seed)
    return picked.withColumnRenamed("seq", "seq1").join(read2.select("read_idx", F.col("seq").alias("seq2")), "read_idx")


def sample_percent(reads: DataFrame, percent: float, seed: int = 42, id_col: str = "read_idx") -> DataFrame:
    """max(1, floor(all * percent / 100)) rows, the first of the draw."""
    return _first_drawn(reads, lambda total: max(1, int(total * percent / 100)), seed, id_col)


def _first_drawn(reads: DataFrame, wanted, seed: int, id_col: str) -> DataFrame:
    """The first ``wanted(number of rows)`` rows of the draw.

    A share of a large set is too much to take in one task: rows are counted by
    the first four digits of their draw (65,536 counts reach the driver), all
    digits below the cut are kept as they are, and only those at it are ordered.
    """
    keyed = reads.withColumn("__draw", draw_key(id_col, seed))
    digits = F.substring("__draw", 1, 4)
    counts = sorted((r["d"], r["count"]) for r in keyed.groupBy(digits.alias("d")).count().where("d is not null").collect())
    want, cut = wanted(sum(n for _, n in counts)), ""
    for cut, n in counts:
        if n >= want:
            break
        want -= n
    at = keyed.where(digits == cut).orderBy("__draw", id_col).limit(want)
    return keyed.where(digits < cut).unionByName(at).drop("__draw")


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n records by index, whatever the partitioning."""
    return reads.where(F.col("read_idx") < n)

