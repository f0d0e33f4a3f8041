import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import heavy_hitters, quantiles


def frequent(spark, values, share, **params):
    df = spark.createDataFrame([(v, "x") for v in values], "seq string, h string").repartition(6)
    return {r.item: (r.exact_count, r.approx_count) for r in heavy_hitters.frequent_items(df, F.col("seq"), share, **params).collect()}


def test_frequent_items(spark):
    r = np.random.default_rng(2)
    values = ["hot"] * 4000 + ["warm"] * 150 + ["tie_a"] * 120 + ["tie_b"] * 120 + [f"cold{r.integers(0, 10**9)}" for _ in range(7600)] + [None] * 500
    got = frequent(spark, values, 0.01)
    assert {k: v[0] for k, v in got.items()} == {"hot": 4000, "warm": 150, "tie_a": 120, "tie_b": 120}
    assert all(approx >= exact for exact, approx in got.values())


def test_small_shares_in_wide_data(spark):
    # thirty items of just the share among as many rows of others
    values = [f"item{i}" for i in range(30) for _ in range(60)] + [f"cold{i}" for i in range(28_000)]
    got = frequent(spark, values, 0.002)
    assert set(got) == {f"item{i}" for i in range(30)}
    with pytest.raises(ValueError, match="too small"):
        frequent(spark, values, 0.002, width=1000)


def test_frequent_edges(spark):
    assert frequent(spark, [], 0.1) == {}
    assert frequent(spark, [None, None], 0.1) == {}
    assert {k: v[0] for k, v in frequent(spark, ["a"], 0.5).items()} == {"a": 1}
    long = "z" * 300_000
    assert set(frequent(spark, [long, long, ""], 0.3)) == {long, ""}


def rank_error(values, got, p):
    """Distance of p's rank to the ranks that the value holds."""
    values = np.sort(values)
    low, high = np.searchsorted(values, got, "left") + 1, np.searchsorted(values, got, "right")
    rank = max(1, int(np.ceil(p * len(values))))
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("k,fan_in", [(8, 2), (16, 3), (32, 4), (64, 16)])
@pytest.mark.parametrize("shape", ["uniform", "sorted", "ties", "falling"])
def test_bound_holds(k, fan_in, shape):
    r = np.random.default_rng(k)
    v = r.random(20_000) if shape != "ties" else r.integers(0, 30, 20_000).astype(float)
    v = np.sort(v) if shape == "sorted" else np.sort(v)[::-1] if shape == "falling" else v
    parts = np.array_split(v, 7)
    whole = quantiles.Buffers(k, fan_in)
    for part in parts:  # sketches of parts, merged
        own = quantiles.Buffers(k, fan_in)
        for piece in np.array_split(part, 11):
            own.add(piece)
        rows = own.rows()
        whole.merge_rows([t for t, _ in rows], [x for _, x in rows], [own.w], [own.c])
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    n, got, bound = whole.quantiles(ps)
    assert n == len(v) and (k < 16 or bound < len(v) / 4)
    assert all(rank_error(v, g, p) <= bound for g, p in zip(got, ps))


def test_small_groups_are_exact():
    s = quantiles.Buffers()
    s.add(np.array([3.0, 1.0, 2.0]))
    assert s.quantiles([0.0, 0.34, 0.5, 1.0]) == (3, [1.0, 2.0, 2.0, 3.0], 0.0)


def test_daily_sketches_join(spark):
    r = np.random.default_rng(1)
    v = r.random(30_000)
    rows = [("a" if i % 3 else "b", f"d{i % 5}", float(x), None if i % 2 else float("nan")) for i, x in enumerate(v)] + [(None, "d0", 1.0, 1.0), ("c", "d0", None, None)]
    df = spark.createDataFrame(rows, "chrom string, day string, coverage double, level double").repartition(9)
    parts = quantiles.sketch_groups(df, ["chrom", "day"], ["coverage", "level"], 128, 4)
    days = quantiles.merged_in_tiers(parts, ["chrom", "day", "measure"], 3, 128, 4)
    got = quantiles.percentiles(days, ["chrom", "measure"], [0.1, 0.5, 0.99], 128, 4).collect()
    assert {(x.chrom, x.measure) for x in got} == {("a", "coverage"), ("b", "coverage")}
    for x in got:
        own = np.array([z[2] for z in rows[:30_000] if z[0] == x.chrom])
        assert x.n == len(own) and rank_error(own, x.value, x.p) <= x.max_rank_error < 0.05 * len(own)
    assert quantiles.percentiles(quantiles.merged_in_tiers(quantiles.sketch_groups(df.limit(0), ["chrom", "day"], ["coverage"]), ["chrom", "measure"], 2), ["chrom", "measure"], [0.5]).count() == 0
