"""Percentiles by deterministic collapsing of weighted sorted buffers.

A sketch holds sorted buffers of ``k`` values in tiers; a buffer of tier t
stands for ``fan_in**t`` values each. When ``fan_in`` buffers meet in a tier
they collapse into one of the next: the weighted merge is read at evenly spaced
positions. The rank error of any answer is at most
``(W - C - 1) / 2 + w_max / 2`` with W the summed weights of all collapse
outputs and C their number; both travel with the sketch, so every answer states
its own bound. Sketches of tasks, days or tables merge by pooling their buffers.

Work is shared so: each task sketches its own rows for every group; the tasks'
sketches of a group are merged in two tiers (first by group and slice of tasks,
then by group), with as many slices as the square root of the tasks, so no task
merges more than about that many sketches of a group.

Defined results: null and NaN values and null groups are left out; a group
without values gives no row; of n sorted values percentile p is the one at rank
max(1, ceil(p * n)); with fewer than ``k * fan_in`` values a group is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, FAN_IN = 2048, 16
#: tier -1 holds loose values (fewer than k); w and c are the bound's terms, kept on one row a sketch
SKETCH = "tier int, vals array<double>, w long, c long"


class Buffers:
    """Buffers of one group by tier, with the terms of the error bound."""

    def __init__(self, k: int = K, fan_in: int = FAN_IN):
        self.k, self.fan_in = k, fan_in
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.tiers: list[list[np.ndarray]] = []
        self.turns: list[int] = []
        self.w = self.c = 0

    def add(self, values: np.ndarray) -> None:
        """``values`` weigh 1 each, in any order."""
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            pool = np.concatenate(self.loose)
            full = len(pool) // self.k * self.k
            for i in range(0, full, self.k):
                self.add_buffer(0, np.sort(pool[i : i + self.k]))
            self.loose, self.n_loose = [pool[full:]], len(pool) - full

    def add_buffer(self, tier: int, values: np.ndarray) -> None:
        while len(self.tiers) <= tier:
            self.tiers.append([])
            self.turns.append(0)
        self.tiers[tier].append(values)
        if len(self.tiers[tier]) == self.fan_in:
            full, self.tiers[tier] = self.tiers[tier], []
            # fan_in buffers of equal weight: of every fan_in merged values one stays
            odd = self.fan_in % 2
            at = (self.fan_in + 1) // 2 - 1 if odd else self.fan_in // 2 - 1 + self.turns[tier] % 2
            self.turns[tier] += 1
            self.w += self.fan_in ** (tier + 1)
            self.c += 1
            self.add_buffer(tier + 1, np.sort(np.concatenate(full))[at :: self.fan_in])

    def rows(self) -> list[tuple[int, np.ndarray]]:
        out = [(t, b) for t, tier in enumerate(self.tiers) for b in tier]
        loose = np.concatenate(self.loose) if self.loose else np.zeros(0)
        return [(-1, np.sort(loose)), *out]

    def merge_rows(self, tiers, values, w, c) -> None:
        """Pool another sketch's rows; loose values join the loose ones."""
        self.w += int(np.sum(w))
        self.c += int(np.sum(c))
        for t, v in zip(tiers, values):
            self.add(v) if t < 0 else self.add_buffer(t, v)

    def quantiles(self, shares: list[float]) -> tuple[int, list[float], float]:
        """(n, values, bound of the rank error)."""
        rows = self.rows()
        values = np.concatenate([v for _, v in rows])
        weights = np.concatenate([np.full(len(v), self.fan_in ** max(t, 0), np.int64) for t, v in rows])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        n = int(upto[-1])
        rank = np.maximum(1, np.ceil(np.array(shares) * n)).astype(np.int64)
        got = values[order][np.searchsorted(upto, rank)]
        bound = (self.w - self.c - 1) / 2 + max(weights) / 2 if self.c else 0.0
        return n, got.tolist(), bound


def _table(groups: list[tuple], kinds: list[pa.DataType], names: list[str], sketches: list[Buffers]) -> pa.RecordBatch:
    keys, tiers, vals, w, c = [], [], [], [], []
    for g, s in zip(groups, sketches):
        for i, (t, v) in enumerate(s.rows()):
            keys.append(g)
            tiers.append(t)
            vals.append(v)
            w.append(0 if i else s.w)
            c.append(0 if i else s.c)
    ends = np.concatenate([[0], np.cumsum([len(v) for v in vals])]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*vals, np.zeros(0)])))
    columns = [pa.array([g[i] for g in keys], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(tiers, pa.int32()), flat, pa.array(w, pa.int64()), pa.array(c, pa.int64())], names=[*names, "tier", "vals", "w", "c"])


def sketch_groups(rows: DataFrame, keys: list[str], measures: list[str], k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Task-wise sketches: (keys..., measure, slice, tier, vals, w, c).

    ``keys`` must be strings or dates as strings; rows with a null key are left
    out. Values are held per task until a group has ``k`` of them.
    """

    def run(batches):
        held: dict[tuple, Buffers] = {}
        for batch in batches:
            code, names = np.zeros(batch.num_rows, np.int64), [()]
            for i in range(len(keys)):
                d = batch.column(i).dictionary_encode()
                d = d if isinstance(d, pa.DictionaryArray) else d.combine_chunks()
                own = d.dictionary.to_pylist()
                code = code * len(own) + d.indices.to_numpy(zero_copy_only=False)
                names = [(*n, o) for n in names for o in own]
            for j, measure in enumerate(measures):
                v = batch.column(len(keys) + j).cast(pa.float64()).to_numpy(zero_copy_only=False)
                ok = ~np.isnan(v)
                order = np.argsort(code[ok], kind="stable")
                of, v = code[ok][order], v[ok][order]
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(of)]):
                    held.setdefault((*names[of[a]], measure), Buffers(k, fan_in)).add(v[a:b].copy())
        if held:
            yield _table(list(held), [pa.string()] * (len(keys) + 1), [*keys, "measure"], list(held.values()))

    clean = rows.select(*(F.col(c).cast("string").alias(c) for c in keys), *(F.col(m).cast("double").alias(m) for m in measures))
    clean = clean.where(" and ".join(f"`{c}` is not null" for c in keys)) if keys else clean
    schema = ", ".join(f"{c} string" for c in [*keys, "measure"]) + ", " + SKETCH
    return clean.mapInArrow(run, schema).withColumn("slice", F.spark_partition_id())


def _merged(batches, n_keys: int, k: int, fan_in: int):
    """(key, Buffers) of each run of rows with one key; only one group is held."""
    key, own = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        lists = batch.column(n_keys + 1)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        tiers, w, c = (batch.column(n_keys + i).to_numpy() for i in (0, 2, 3))
        for i, now in enumerate(keys):
            if now != key:
                if own is not None:
                    yield key, own
                key, own = now, Buffers(k, fan_in)
            own.merge_rows([tiers[i]], [flat[ends[i] : ends[i + 1]].copy()], w[i], c[i])
    if own is not None:
        yield key, own


def _by_key(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together, in an order that doesn't depend on which task ended first."""
    rows = sketches.select(*keys, "tier", "vals", "w", "c")
    return rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("tier"), F.xxhash64("vals"))


def merge_sketches(parts: DataFrame, keys: list[str], k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Merge sketches that agree in ``keys``; the result is again sketches."""
    kinds = [pa.int32() if parts.schema[c].dataType.simpleString() == "int" else pa.string() for c in keys]

    def run(batches):
        done: list[tuple] = []
        for one in _merged(batches, len(keys), k, fan_in):
            done.append(one)
            if len(done) == 256:
                yield _table([g for g, _ in done], kinds, keys, [b for _, b in done])
                done = []
        if done:
            yield _table([g for g, _ in done], kinds, keys, [b for _, b in done])

    schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in keys) + ", " + SKETCH
    return _by_key(parts, keys).mapInArrow(run, schema)


def slices_of(rows: DataFrame) -> int:
    """Square root of the number of tasks that sketch ``rows``."""
    return max(1, int(np.ceil(np.sqrt(rows.rdd.getNumPartitions()))))


def merged_in_tiers(parts: DataFrame, keys: list[str], slices: int, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """First by key and slice of tasks, then by key."""
    some = parts.withColumn("slice", F.col("slice") % slices)
    return merge_sketches(merge_sketches(some, [*keys, "slice"], k, fan_in), keys, k, fan_in)


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float], k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """(keys..., n, p, value, max_rank_error): merge what agrees in ``keys`` and answer."""

    def run(batches):
        for key, own in _merged(batches, len(keys), k, fan_in):
            n, got, bound = own.quantiles(shares)
            m = len(shares)
            columns = [*(pa.array([x] * m, pa.string()) for x in key), pa.array([n] * m, pa.int64()), pa.array(shares, pa.float64()), pa.array(got, pa.float64()), pa.array([bound] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "p", "value", "max_rank_error"])

    schema = ", ".join(f"{c} string" for c in keys) + ", n long, p double, value double, max_rank_error double"
    return _by_key(sketches, keys).mapInArrow(run, schema)


def rank_check(told: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., p, n, collapsed, holds): are stated values within their rank error of the exact rank?

    Counts the values below and up to each stated one, with map-side combine; a
    group's stated values travel as one row.
    """
    asked = told.groupBy(*keys).agg(F.collect_list(F.struct("p", "n", F.col("value").alias("said"), "max_rank_error")).alias("q"))
    each = values.select(*keys, value).join(asked, keys).select(*keys, value, F.explode("q").alias("q"))
    counted = each.groupBy(*keys, "q").agg(F.count_if(F.col(value) < F.col("q.said")).alias("below"), F.count_if(F.col(value) <= F.col("q.said")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q.p") * F.col("q.n")))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return counted.select(*keys, "q.p", "q.n", (F.col("q.max_rank_error") > 0).alias("collapsed"), (off <= F.col("q.max_rank_error")).alias("holds"))
