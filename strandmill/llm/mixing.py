"""Mixing sources to target weights.

Tokens of every document are counted once (whole texts, a public tokenizer) and
written as (id, source, tokens). Sums by source, with map-side combine, give
each source's repetition rate: target share of the mix over its own tokens, at
most ``max_repeats``. A document is then given floor(rate) times plus once more
with the fraction as chance, decided by a hash of its id. So the copies of a
document follow from its id and its source's rate: the mix is written by the scan
of the documents itself, without a shuffle of texts, the same on every run. Rates
are broadcast while at most ``MOST_SOURCES`` sources are listed, which is counted
first; beyond, Spark chooses the join.

Defined results: names are compared trimmed and in lower case; a source listed
twice has the sum of its shares and the larger ``max_repeats``; documents of
unlisted or null sources are in no sum; a null or empty text has 0 tokens; a
listed source without tokens gets rate 0; rates never exceed ``max_repeats``; rows
that repeat an id are given alike.
The mix falls short of the whole where a source is capped; the report states
the share reached of what was drawn and the tokens missing.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: listed sources up to which rates are broadcast
MOST_SOURCES = 100_000
#: the pattern this vocabulary was made with, a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """One encoder a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_name(column: str) -> F.Column:
    return F.lower(session.blank_trimmed(F.col(column)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, source, tokens) for each row."""

    def run(batches):
        for batch in batches:
            e = encoding(ranks)
            n = [len(e.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), source_name(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, source string, tokens long")


def rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, total, wanted, rate), a row a listed source.

    Runs a job on ``targets`` for their number.
    """
    listed = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sums = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    own = listed.join(sums, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = own.agg(F.sum("tokens").alias("total"))
    wanted = F.col("target_share") * F.col("total")
    rate = F.when(F.col("tokens") > 0, F.least(wanted / F.greatest("tokens", F.lit(1)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    every = own.join(F.broadcast(total)).withColumn("wanted", wanted).withColumn("rate", rate)
    few = targets.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    return F.broadcast(every) if few else every


def copies_of(id_: F.Column, rate: F.Column, seed: int = 42) -> F.Column:
    """How often a document is in the mix."""
    chance = F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor(rate)
    return (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("int")


def draw(counts: DataFrame, rate: DataFrame, seed: int = 42) -> DataFrame:
    """(id, source, tokens, copies): how often each document is in the mix."""
    listed = counts.join(rate.select("source", "rate"), "source")
    return listed.select("id", "source", "tokens", copies_of(F.col("id"), F.col("rate"), seed).alias("copies"))


def emit(docs: DataFrame, rate: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The documents of the mix, one row a copy with its number from 1."""
    of = rate.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    kept = docs.join(of, source_name(source_col) == F.col("__source")).withColumn("__copies", copies_of(F.col(id_col).cast("long"), F.col("__rate"), seed))
    kept = kept.where("__copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), "__copies")))
    return kept.drop("__source", "__rate", "__copies")


def report(drawn: DataFrame, rate: DataFrame) -> DataFrame:
    """Targets and shares reached, a row a listed source."""
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("drawn_docs"), F.max("copies").alias("most_copies"))
    every = rate.join(got, "source", "left").fillna(0, ["drawn_tokens", "drawn_docs", "most_copies"])
    total = every.agg(F.sum("drawn_tokens").alias("mix_tokens"))
    return every.join(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "tokens", "rate", "drawn_docs", "most_copies", "drawn_tokens",
        F.coalesce(F.try_divide("drawn_tokens", "mix_tokens"), F.lit(0.0)).alias("share_reached"),
        F.greatest(F.col("wanted") - F.col("drawn_tokens"), F.lit(0.0)).alias("tokens_missing"),
    )


def on_target(drawn: DataFrame, rate: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """(source, capped, holds): is the drawn size within ``sigmas`` of its mean, rate times tokens?"""
    part = F.col("rate") - F.floor("rate")
    chance = rate.select("source", "rate", (part * (1 - part)).alias("spread"))
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.sum(F.col("tokens").cast("double") ** 2).alias("squares"), F.max("copies").alias("most"))
    every = rate.select("source", "tokens", "max_repeats").join(chance, "source").join(got, "source", "left").fillna(0)
    near = F.abs(F.col("drawn") - F.col("rate") * F.col("tokens")) <= sigmas * F.sqrt(F.col("spread") * F.col("squares")) + 1
    return every.select("source", (F.col("rate") >= F.col("max_repeats")).alias("capped"), (near & (F.col("most") <= F.col("max_repeats"))).alias("holds"))
