import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import seen_filter as sf
from strandmill.llm.hashing import mix64


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 50_000])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_filter(n, bits):
    keys = mix64(np.arange(n, dtype=np.uint64) + np.uint64(5))
    seed, table = sf.build_filter(keys, bits)
    assert sf.probe_filter(keys, seed, table).all()
    other = mix64(np.arange(200_000, dtype=np.uint64) + np.uint64(10**9))
    rate = sf.probe_filter(other, seed, table).mean()
    assert rate <= 3 * 2.0**-bits + 5e-5
    if n == 50_000:
        assert table.nbytes * 8 / n < 1.3 * bits


def truth(rows):
    first, out = {}, {}
    for i, k in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        out[i] = first.setdefault(k, i) < i
    return out


def told(spark, rows, **params):
    df = spark.createDataFrame(rows, "read_idx bigint, umi string").withColumn("seen", F.lit(1)).withColumn("h", F.lit("x")).repartition(5)
    return {r.first_: r.seen for r in sf.seen_before(df, F.col("read_idx"), F.col("umi"), **params).withColumnRenamed("first", "first_").collect()}


@pytest.mark.parametrize("params", [{"batch_rows": 16, "fan_out": 2, "shard_keys": 50}, {"batch_rows": 100, "fan_out": 3}, {}])
def test_against_a_set(spark, params):
    r = np.random.default_rng(3)
    # one key holds a third of the rows
    rows = [(int(i), "hot" if r.random() < 0.33 else f"k{r.integers(0, 300)}") for i in range(1200)] + [(2000, None), (None, "k1"), (2001, "")]
    assert told(spark, rows, **params) == truth(rows)


def test_negative_order_values(spark):
    r = np.random.default_rng(4)
    rows = [(int(i) - 700, f"k{r.integers(0, 300)}") for i in range(1200)]
    assert told(spark, rows, batch_rows=16, fan_out=2, shard_keys=8) == truth(rows)


@pytest.mark.parametrize("since", [1, 7, 8, 13, 20])
def test_later_run_with_sealed_filters(spark, since):
    r = np.random.default_rng(since)
    rows = [(i, f"k{r.integers(0, 500)}") for i in range(1300)]
    params = {"batch_rows": 50, "fan_out": 3, "shard_keys": 20}
    cut = since * 50 + 25
    old = spark.createDataFrame([x for x in rows if x[0] < cut], "read_idx bigint, umi string")
    every = spark.createDataFrame(rows, "read_idx bigint, umi string")
    sealed = sf.sealed_filters(old, F.col("read_idx"), F.col("umi"), **params)
    again = sf.seen_before(every, F.col("read_idx"), F.col("umi"), sealed=sealed, since=since, **params)
    assert {x["first"]: x["seen"] for x in again.collect()} == {k: v for k, v in truth(rows).items() if k >= since * 50}
    # nothing is built twice
    whole = sf.sealed_filters(every, F.col("read_idx"), F.col("umi"), **params).select("tier", "generation", "shard")
    both = sf.probed_firsts(every, F.col("read_idx"), F.col("umi"), sealed=sealed, since=since, **params)[1].select("tier", "generation", "shard")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_work_grows_with_the_rows(spark):
    work = []
    for n in (1000, 4000, 16_000):
        df = spark.range(n).selectExpr("id as read_idx", "concat('k', id) as umi")
        answers, filters = sf.probed_firsts(df, F.col("read_idx"), F.col("umi"), batch_rows=50, fan_out=4, shard_keys=10)
        told = filters.agg(F.count(F.lit(1)), F.max("n_keys"), F.sum("n_keys")).first()
        work.append((told[0] / n, told[1], told[2] / n, answers.agg(F.sum("probes")).first()[0] / n))
    # filters, their keys and probes a row rise by a tier at most when the rows grow fourfold; filters don't get larger
    for a, b in zip(work, work[1:]):
        assert b[0] < a[0] + 0.12 and b[2] < a[2] + 1 and b[3] < a[3] + 3 and b[1] < 40


def test_edges(spark):
    assert told(spark, [(None, None)]) == {}
    df = spark.createDataFrame([], "read_idx bigint, umi string")
    assert sf.seen_before(df, F.col("read_idx"), F.col("umi")).count() == 0
    assert told(spark, [(5, "a"), (5, "a"), (7, "a" * 100_000), (9, "a" * 100_000)]) == {5: False, 7: False, 9: True}


def test_report(spark):
    rows = [(i, f"k{i % 7000}") for i in range(14_000)]
    df = spark.createDataFrame(rows, "read_idx bigint, umi string")
    got = sf.error_report(df, F.col("read_idx"), F.col("umi"), bits=8, batch_rows=1000, fan_out=4).orderBy("batch").collect()
    assert sum(r.new_keys for r in got) == 7000 and all(r.missed == 0 for r in got)
    new = [r for r in got if r.new_keys]
    wrong, stated = sum(r.wrong for r in new), sum(r.stated_rate * r.new_keys for r in new)
    assert abs(wrong - stated) < 5 * max(1, stated) ** 0.5
    assert got[5].filters_probed == 2  # one generation of four batches and one batch


def test_report_counts_keys_not_hashes(spark, monkeypatch):
    # a hash of four values: different keys share one, and that is wrong
    whole = F.xxhash64
    monkeypatch.setattr(sf.F, "xxhash64", lambda *c: F.pmod(whole(*c), F.lit(4)))
    df = spark.createDataFrame([(i, f"k{i}") for i in range(40)], "read_idx bigint, umi string")
    got = sf.error_report(df, F.col("read_idx"), F.col("umi"), batch_rows=10).collect()
    assert sum(r.new_keys for r in got) == 40 and sum(r.wrong for r in got) == 36 and all(r.missed == 0 for r in got)


def test_report_has_the_answers_own_width(spark):
    df = spark.createDataFrame([(i * 40_000, f"k{i}") for i in range(40)], "read_idx bigint, umi string")
    last = sf.error_report(df, F.col("read_idx"), F.col("umi")).orderBy("batch").collect()[-1]
    assert 0 < last.stated_rate < 1e-8 and last.wrong == 0
