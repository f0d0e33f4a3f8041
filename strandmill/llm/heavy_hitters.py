"""Most frequent items by combinatorial group testing.

Every task keeps ``depth`` rows of ``width`` buckets; a bucket has a total and
one counter for each of the 64 bits of the item's hash. An item that holds more
than half of a bucket is read off directly: a bit is set where its counter is
over half the total. Sketches are sums, so tasks' sketches are added by one
aggregation of at most ``depth * width`` keys, whatever the input's size. The
decoded hashes (at most ``depth / share`` pass the threshold) are checked by an
exact count in a second pass, in which they are broadcast.

An item can be missed only where in all ``depth`` rows the others in its bucket
weigh as much as it does. The buckets of a row share all other items, so by
Markov's inequality that has at most the chance (others / (width * own)) ** depth,
which every answer states. ``width`` follows from ``share`` (``BUCKETS / share``), so
the chance is at most ``BUCKETS ** -depth`` for an item of just that share; a width
under ``4 / share`` is an error. A task emits at most depth * width rows of 66
counters, whatever it has read; they are added up as they arrive.

Defined results: null items don't count; ties are all kept; an empty table or a
column of nulls gives an empty result; hashes of two texts are told apart in the
exact pass because it counts texts, not hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix64, seeds

BITS = 64
DEPTH, BUCKETS = 5, 8


def sketch(items: DataFrame, depth: int = DEPTH, width: int = 2048) -> DataFrame:
    """Merged sketch of column ``h``: (row, bucket, total, b0..b63)."""
    salt = seeds(depth, 0x6C62272E)
    names = [f"b{i}" for i in range(BITS)]

    def count(batches):
        total = np.zeros((depth, width))
        bits = np.zeros((depth, BITS, width))
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            weight = n.astype(np.float64)
            at = [(mix64(h ^ s) % np.uint64(width)).astype(np.int64) for s in salt]
            for d in range(depth):
                total[d] += np.bincount(at[d], weight, width)
            for b in range(BITS):
                on = ((h >> np.uint64(b)) & np.uint64(1)).astype(bool)
                w = weight[on]
                for d in range(depth):
                    bits[d, b] += np.bincount(at[d][on], w, width)
        d, b = np.nonzero(total)
        if len(d):
            yield pa.RecordBatch.from_arrays(
                [pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[d, b].astype(np.int64)), *(pa.array(bits[d, i, b].astype(np.int64)) for i in range(BITS))],
                names=["row", "bucket", "total", *names],
            )

    parts = items.mapInArrow(count, "row int, bucket int, total long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("row", "bucket").agg(*(F.sum(c).alias(c) for c in ("total", *names)))


def decode(merged: DataFrame) -> DataFrame:
    """(h, bound): majority hash of each bucket, its total as upper bound.

    One row a hash, with the least total of the buckets that name it.
    """
    named = merged.select(
        F.expr(" | ".join(f"shiftleft(cast(b{i} * 2 > total as bigint), {i})" for i in range(BITS))).alias("h"), "total"
    )
    return named.groupBy("h").agg(F.min("total").alias("bound"))


def frequent_items(rows: DataFrame, item: Column, share: float, *, depth: int = DEPTH, width: int | None = None) -> DataFrame:
    """(item, approx_count, exact_count, miss_chance): items with at least ``share`` of the non-null rows.

    ``approx_count`` is the sketch's upper bound, ``miss_chance`` bounds the chance
    that an item as frequent as this one is not found.
    """
    width = width or max(256, int(np.ceil(BUCKETS / share)))
    if width * share < 4:
        raise ValueError(f"width {width} is too small for a share of {share}: at least 4 / share")
    keyed = rows.select(item.alias("item")).where("item is not null").select("item", F.xxhash64("item").alias("h"))
    merged = sketch(keyed.select("h"), depth, width)
    named = merged.groupBy().agg(F.sum(F.when(F.col("row") == 0, F.col("total"))).alias("n"))
    found = decode(merged).crossJoin(F.broadcast(named)).where(F.col("bound") >= F.lit(share) * F.col("n"))
    # at most depth / share rows pass, since buckets of one row sum to n
    exact = keyed.join(F.broadcast(found), "h").groupBy("item").agg(F.count(F.lit(1)).alias("exact_count"), F.min("bound").alias("approx_count"), F.min("n").alias("n"))
    others = (F.col("n") - F.col("exact_count")) / F.lit(float(width)) / F.col("exact_count")
    return exact.where(F.col("exact_count") >= F.lit(share) * F.col("n")).select("item", "approx_count", "exact_count", F.pow(F.least(others, F.lit(1.0)), F.lit(float(depth))).alias("miss_chance"))
