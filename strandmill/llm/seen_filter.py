"""Has this key been seen before? Sealed batches as peeled fingerprint filters.

The stream of rows is cut into batches by a rising order column. A sealed batch
leaves immutable fingerprint filters, built by peeling (three slots a key,
fingerprints XOR to the key's own). Batches are grouped into generations of
``fan_out``, ``fan_out**2`` and so on, the tiers. A row probes in each tier only the
complete generations before its own inside the same generation of the tier above:
at most ``fan_out - 1`` filters a tier, a number that grows with the logarithm of
the number of batches. Keys inside the row's own batch are handled exactly.

Cost: rows are first reduced to one per (batch, key) with map-side combine, so a
key that holds a third of all rows is one row a batch and task. The key space of a
generation is cut into shards in proportion to its batches, so a filter has about
``shard_keys`` keys in every tier, and there are (rows / shard_keys) filters a tier.
A task that probes holds ``fan_out`` filters and the rows of the same shard; rows are
sorted by generation, so each filter meets one range of them. Work and shuffled rows
grow as rows times tiers. Nothing but two bounds reaches the driver.

Filters outlive a run: ``sealed_filters`` gives them as a table, and a later run
answers only rows of batches from ``since`` on with ``sealed`` and builds only the
generations that became complete since then.

Defined results: null keys or null order values are never "seen"; repeated
order values in one batch count as one arrival, so of equal rows none comes
before the other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix64

_U = np.uint64
BATCH_ROWS, FAN_OUT, BITS, SHARD_KEYS = 1 << 17, 8, 32, 1 << 14
FILTER_SCHEMA = "tier int, generation long, shard long, n_keys long, seed long, blob binary"


def _slots(keys: np.ndarray, seed: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = mix64(keys ^ _U(seed))
    b = mix64(a + _U(0x9E3779B97F4A7C15))
    low, s = _U(0xFFFFFFFF), _U(segment)
    i0 = ((a & low) * s) >> _U(32)
    i1 = ((a >> _U(32)) * s >> _U(32)) + s
    i2 = ((b & low) * s >> _U(32)) + s + s
    return i0.astype(np.int64), i1.astype(np.int64), i2.astype(np.int64), (b >> _U(32)).astype(np.uint32)


def _width(bits: int) -> np.dtype:
    return np.dtype({8: np.uint8, 16: np.uint16, 32: np.uint32}[bits])


def build_filter(keys: np.ndarray, bits: int) -> tuple[int, np.ndarray]:
    """Peel distinct 64-bit ``keys``; returns (seed, fingerprint table).

    Peeling goes in rounds: all slots that hold a single remaining key release
    their keys at once. Keys of one round never touch each other's release
    slot, so tables are filled round by round, last round first.
    """
    kind, n = _width(bits), len(keys)
    segment = int(1.23 * n + 32) // 3 + 1
    for seed in range(1, 200):
        i0, i1, i2, fp = _slots(keys, seed * 0x51ED27, segment)
        slots = np.stack([i0, i1, i2], axis=1)
        flat = slots.ravel()
        count = np.bincount(flat, minlength=3 * segment)
        owner = np.bincount(flat, weights=np.repeat(np.arange(n, dtype=np.float64), 3), minlength=3 * segment).astype(np.int64)
        free, rounds, left = np.flatnonzero(count == 1), [], n
        while len(free):
            who = owner[free]
            who, first = np.unique(who, return_index=True)
            rounds.append((who, free[first]))
            left -= len(who)
            touched = slots[who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(owner, touched, np.repeat(who, 3))
            touched = np.unique(touched)
            free = touched[count[touched] == 1]
        if left:
            continue
        table = np.zeros(3 * segment, kind)
        fp = fp.astype(kind)
        for who, at in reversed(rounds):
            s = slots[who]
            table[at] = 0
            table[at] = fp[who] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
        return seed * 0x51ED27, table
    raise RuntimeError("no seed peels these keys; are they distinct?")


def probe_filter(keys: np.ndarray, seed: int, table: np.ndarray) -> np.ndarray:
    """True for every key built in; true with chance 2**-bits for another."""
    i0, i1, i2, fp = _slots(keys, seed, len(table) // 3)
    return (table[i0] ^ table[i1] ^ table[i2]) == fp.astype(table.dtype)


def first_in_batch(rows: DataFrame, order: Column, key: Column, batch_rows: int, base: int = 0) -> DataFrame:
    """(batch, h, first): the first arrival of each key in its batch; batches count from ``base``.

    ``h`` is 64 bits of the key; with n distinct keys two share it with chance
    about n**2 / 2**65 (counted by ``error_report``).
    """
    keyed = rows.select(order.cast("long").alias("first"), F.xxhash64(key).alias("h"), key.isNotNull().alias("ok"))
    keyed = keyed.where("ok and first is not null").select((F.floor(F.col("first") / batch_rows).cast("long") - base).alias("batch"), "h", "first")
    return keyed.groupBy("batch", "h").agg(F.min("first").alias("first"))


def plan_tiers(batches: int, fan_out: int) -> int:
    tiers = 1
    while fan_out**tiers < batches:
        tiers += 1
    return tiers


def _by_tier(tiers: int, fan_out: int, shards: int) -> Column:
    """A struct for each tier: tier, generation, the generation above (``parent``) and shard."""
    one = lambda t: F.struct(
        F.lit(t).alias("tier"),
        F.floor(F.col("batch") / fan_out**t).cast("long").alias("generation"),
        F.floor(F.col("batch") / fan_out ** (t + 1)).cast("long").alias("parent"),
        F.expr(f"pmod(h, {shards * fan_out**t}L)").alias("shard"),
        F.lit(fan_out**t).cast("long").alias("width"),
    )
    return F.explode(F.array(*map(one, range(tiers)))).alias("g")


def open_from(since: int, last: int, tiers: int, fan_out: int) -> int:
    """First batch whose keys are needed to seal what became complete in (since, last]."""
    starts = [since]
    for t in range(tiers):
        w = fan_out**t
        starts += [g * w for g in (since // w, since // w + 1) if since < (g + 1) * w <= last and g % fan_out != fan_out - 1]
    return min(starts)


def seal(firsts: DataFrame, tiers: int, fan_out: int, bits: int, shards: int, last: int, since: int = 0) -> DataFrame:
    """Filters of all generations that some batch up to ``last`` probes and none up to ``since`` did.

    The last generation of a parent is never probed, so it gets no filter.
    """
    keyed = firsts.select(_by_tier(tiers, fan_out, shards), "h").select("g.*", "h")
    end = (F.col("generation") + 1) * F.col("width")
    keyed = keyed.where((end > since) & (end <= last) & (F.pmod("generation", F.lit(fan_out)) != fan_out - 1))

    def build(group: pa.Table) -> pa.Table:
        keys = np.unique(group["h"].to_numpy().view(np.uint64))
        seed, table = build_filter(keys, bits)
        one = group.slice(0, 1)
        made = {"n_keys": pa.array([len(keys)], pa.int64()), "seed": pa.array([seed], pa.int64()), "blob": pa.array([table.tobytes()], pa.binary())}
        return pa.table({c: one[c] for c in ("tier", "generation", "shard")} | made)

    return keyed.select("tier", "generation", "shard", "h").groupBy("tier", "generation", "shard").applyInArrow(build, FILTER_SCHEMA)


def look_up(generation: np.ndarray, keys: np.ndarray, filters: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(seen, filters probed) of rows against the (generation, seed, table) before their own."""
    order = np.argsort(generation, kind="stable")
    own, keys = generation[order], keys[order]
    seen, probes = np.zeros(len(own), bool), np.zeros(len(own), np.int32)
    for gen, seed, table in filters:
        at = int(np.searchsorted(own, gen, "right"))
        seen[at:] |= probe_filter(keys[at:], seed, table)
        probes[at:] += 1
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return seen[back], probes[back]


def probe(firsts: DataFrame, filters: DataFrame, tiers: int, fan_out: int, bits: int, shards: int) -> DataFrame:
    """(batch, h, first, seen, probes): each row against all earlier batches."""
    kind = _width(bits)

    def look(rows: pa.Table, sealed: pa.Table) -> pa.Table:
        made = [(g, s, np.frombuffer(b.as_buffer(), kind)) for g, s, b in zip(sealed["generation"].to_pylist(), sealed["seed"].to_pylist(), sealed["blob"])]
        seen, probes = look_up(rows["generation"].to_numpy(), rows["h"].to_numpy().view(np.uint64), made)
        return pa.table({"batch": rows["batch"], "h": rows["h"], "first": rows["first"], "seen": pa.array(seen), "probes": pa.array(probes)})

    asked = firsts.select("batch", "h", "first", _by_tier(tiers, fan_out, shards)).select("batch", "h", "first", "g.*")
    # every row once in tier 0; in other tiers where a generation lies before its own
    asked = asked.where((F.col("tier") == 0) | (F.pmod("generation", F.lit(fan_out)) > 0)).drop("width")
    keys = ("tier", "parent", "shard")
    sealed = filters.withColumn("parent", F.floor(F.col("generation") / fan_out).cast("long"))
    told = asked.groupBy(*keys).cogroup(sealed.groupBy(*keys)).applyInArrow(look, "batch long, h long, first long, seen boolean, probes int")
    if tiers == 1:
        return told
    return told.groupBy("batch", "h", "first").agg(F.max("seen").alias("seen"), F.sum("probes").cast("int").alias("probes"))


def probed_firsts(
    rows: DataFrame, order: Column, key: Column, *, batch_rows: int = BATCH_ROWS, fan_out: int = FAN_OUT, bits: int = BITS, shard_keys: int = SHARD_KEYS, sealed: DataFrame | None = None, since: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(first rows of each batch and key with their answer, the filters).

    Runs a job for the bounds of ``order``. With ``sealed``, the filters of an
    earlier run whose last batch was ``since``, only batches from there on are
    answered, and of older rows only those are read that newly complete
    generations hold.
    """
    o = order.cast("long")
    bounds = rows.agg(F.min(o).alias("low"), F.max(o).alias("top")).first()
    low, top = (0, 0) if bounds["top"] is None else (bounds["low"], bounds["top"])
    base = min(0, low // batch_rows)
    last = top // batch_rows - base
    tiers, shards = plan_tiers(last + 1, fan_out), max(1, -(-batch_rows // shard_keys))
    if since:
        rows = rows.where(o >= (open_from(since, last, tiers, fan_out) + base) * batch_rows)
    firsts = first_in_batch(rows, order, key, batch_rows, base)
    filters = seal(firsts, tiers, fan_out, bits, shards, last, since)
    if sealed is not None:
        filters = sealed.select(*filters.columns).unionByName(filters)
    answers = probe(firsts.where(F.col("batch") >= since) if since else firsts, filters, tiers, fan_out, bits, shards)
    return answers.withColumn("batch", F.col("batch") + base), filters


def sealed_filters(rows: DataFrame, order: Column, key: Column, **params) -> DataFrame:
    """The filters themselves, to be written and given to a later run as ``sealed``."""
    return probed_firsts(rows, order, key, **params)[1]


def seen_before(rows: DataFrame, order: Column, key: Column, *, batch_rows: int = BATCH_ROWS, since: int = 0, **params) -> DataFrame:
    """(first, seen) for every row with a key: did it occur in an earlier row?

    Only the first row of a key in its batch can be new; every other row is
    "seen". So new rows are one a key, found by the filters, and the rest
    follows from an anti join on the unique order value: no skew.
    """
    answers, _ = probed_firsts(rows, order, key, batch_rows=batch_rows, since=since, **params)
    new = answers.where(~F.col("seen")).select(F.col("first").alias("new_first"))
    every = rows.where(key.isNotNull()).select(order.cast("long").alias("first")).where("first is not null")
    if since:
        every = every.where(F.col("first") >= since * batch_rows)
    return every.join(new, F.col("first") == F.col("new_first"), "left").select("first", F.col("new_first").isNull().alias("seen"))


def error_report(rows: DataFrame, order: Column, key: Column, *, bits: int = BITS, batch_rows: int = BATCH_ROWS, **params) -> DataFrame:
    """Per batch: distinct keys, filters probed, stated and measured error.

    ``stated`` is the mean of 1 - (1 - 2**-bits)**probes over the batch's keys
    that are truly new, plus known / 2**64 for keys that share a hash, with
    ``known`` keys so far (n**2 / 2**65 in sum over n keys); ``wrong`` counts keys
    called seen although new, ``missed`` the others. Truth is the first arrival of
    each key itself, not of its hash.
    """
    answers, _ = probed_firsts(rows, order, key, bits=bits, batch_rows=batch_rows, **params)
    keyed = rows.select(order.cast("long").alias("at"), key.alias("key")).where("key is not null and at is not null")
    keyed = keyed.select(F.floor(F.col("at") / batch_rows).cast("long").alias("batch"), F.xxhash64("key").alias("h"), "key", "at").groupBy("batch", "h", "key").agg(F.min("at").alias("at"))
    born = keyed.groupBy("key").agg(F.min("batch").alias("born"))
    # only the first arrival of a hash in its batch can be told new
    told = keyed.join(answers, ["batch", "h"]).join(born, "key").withColumn("told", F.col("seen") | (F.col("at") > F.col("first")))
    new = F.col("batch") == F.col("born")
    rate = -F.expm1(F.col("probes") * float(np.log1p(-(2.0**-bits))))
    per = told.groupBy("batch").agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if(new).alias("new_keys"),
        F.max("probes").alias("filters_probed"),
        F.count_if(new & F.col("told")).alias("wrong"),
        F.count_if(~new & ~F.col("told")).alias("missed"),
        F.coalesce(F.avg(F.when(new, rate)), F.lit(0.0)).alias("stated_rate"),
        F.coalesce(F.avg(F.when(new, F.col("told").cast("double"))), F.lit(0.0)).alias("measured_rate"),
    )
    # one row a batch, so a single window over them is small
    known = F.sum("new_keys").over(Window.orderBy("batch"))
    return per.withColumn("stated_rate", F.when(F.col("new_keys") > 0, F.col("stated_rate") + known / 2.0**64).otherwise(F.col("stated_rate")))
