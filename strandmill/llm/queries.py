"""The numbered training-data queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import contamination, heavy_hitters, langid, mixing, near_dup, quantiles, seen_filter


# ---------------------------------------------------------------- problem 1
def inserts(spark: SparkSession, d: str) -> DataFrame:
    """(read_idx, insert): seq without its library's inline UMI."""
    # one row a library (its reports agree in location and length); joined by
    # Spark's own choice of join, since the number of libraries grows
    stats = read_table(spark, d, "umi_stats").groupBy("library").agg(F.max("location").alias("location"), F.max("umi_length").alias("umi_length"))
    s, cut = F.col("s"), F.coalesce("umi_length", F.lit(0)).cast("int")
    reads = read_table(spark, d, "reads").where("seq is not null").select("read_idx", "library", F.upper(F.trim("seq")).alias("s"))
    insert = (
        F.when(F.col("location") == "inline_5prime", F.substring(s, cut + 1, F.length(s)))
        .when(F.col("location") == "inline_3prime", F.substring(s, F.lit(1), F.greatest(F.length(s) - cut, F.lit(0))))
        .otherwise(s)
    )
    return reads.join(stats, "library", "left").select("read_idx", insert.alias("insert"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_dup.similar_rows(inserts(spark, d), "read_idx", "insert")
    return found.select(F.col("id_a").alias("read_idx_a"), F.col("id_b").alias("read_idx_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct insert with a partner: its class and links."""
    rows = inserts(spark, d)
    strings = near_dup.distinct_strings(rows, "read_idx", "insert")
    linked = near_dup.similar_strings(strings).select("a", "b")
    return near_dup.groups(linked).select(F.col("id").alias("read_idx"), "class_id", "links")


def p1_reads(spark: SparkSession, d: str) -> DataFrame:
    """Every read of a group, copies of an insert too: its class, by the group's least read_idx."""
    return near_dup.grouped_rows(inserts(spark, d), "read_idx", "insert").withColumnRenamed("id", "read_idx")


# ---------------------------------------------------------------- problem 2
def umi_key() -> F.Column:
    key = F.regexp_replace(F.upper(F.trim("umi")), "[^ACGT]", "N")
    return F.when(F.length(key) >= 4, key)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    told = seen_filter.seen_before(read_table(spark, d, "reads"), F.col("read_idx"), umi_key())
    return told.where("seen").select(F.col("first").alias("read_idx"))


def p2_error(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of ``p2_found``'s own filters, stated and measured."""
    return seen_filter.error_report(read_table(spark, d, "reads"), F.col("read_idx"), umi_key())


# ---------------------------------------------------------------- problem 3
SHARES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches for each (chrom, day, measure): what a daily job would keep."""
    calls = read_table(spark, d, "calls").where("chrom is not null").select(
        F.lower(F.trim("chrom")).alias("chrom"), F.to_date("called_ts").cast("string").alias("day"), "coverage", "level"
    )
    calls = calls.withColumn("day", F.coalesce("day", F.lit("none")))
    parts = quantiles.sketch_groups(calls, ["chrom", "day"], ["coverage", "level"])
    return quantiles.merged_in_tiers(parts, ["chrom", "day", "measure"], quantiles.slices_of(calls))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole, joined from the days' sketches."""
    return quantiles.percentiles(daily_sketches(spark, d), ["chrom", "measure"], SHARES)


def p3_daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(daily_sketches(spark, d), ["chrom", "day", "measure"], [0.1, 0.5, 0.9])


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Does each value's true rank lie within the stated error, with buffers so small that groups collapse?"""
    k, fan_in = 64, 4
    calls = read_table(spark, d, "calls").where("chrom is not null").select(F.lower(F.trim("chrom")).alias("chrom"), F.col("coverage").cast("double").alias("coverage"), "level")
    parts = quantiles.sketch_groups(calls, ["chrom"], ["coverage", "level"], k, fan_in)
    merged = quantiles.merged_in_tiers(parts, ["chrom", "measure"], quantiles.slices_of(calls), k, fan_in)
    told = materialize(quantiles.percentiles(merged, ["chrom", "measure"], SHARES, k, fan_in), "percentiles")
    every = calls.unpivot("chrom", ["coverage", "level"], "measure", "v").where("v is not null and not isnan(v)")
    return quantiles.rank_check(told, every, ["chrom", "measure"], "v")


# ---------------------------------------------------------------- problem 4
def spoken_seq() -> F.Column:
    return F.when(F.trim("seq") != "", F.upper("seq"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.frequent_items(read_table(spark, d, "reads"), spoken_seq(), 0.005).select(F.col("item").alias("seq"))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """Items of 0.2 % and more: the sketch's upper bound beside the count, and the chance to have missed such an item."""
    r = heavy_hitters.frequent_items(read_table(spark, d, "reads"), spoken_seq(), 0.002)
    return r.select(F.col("item").alias("seq"), "exact_count", (F.col("approx_count") >= F.col("exact_count")).alias("bound_holds"), F.bround("miss_chance", 12).alias("miss_chance"))


# ---------------------------------------------------------------- problem 6
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.where(f"longest_run >= {contamination.RUN}").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Copies, whole or edited: at least half of a whole copy's alignment score.

    Seeds of three words, since edits leave only short runs.
    """
    found = contamination.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), gram=3, least=0.5)
    return found.where(f"score >= 0.5 or longest_run >= {contamination.RUN}")


# ---------------------------------------------------------------- problem 7
def mix_counts(spark: SparkSession, d: str) -> DataFrame:
    return materialize(mixing.token_counts(read_table(spark, d, "documents")), "mix-tokens")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rate = mixing.rates(mixing.token_counts(read_table(spark, d, "documents")), read_table(spark, d, "mix_targets"))
    return rate.where(F.col("tokens") * F.col("max_repeats") < F.col("wanted")).select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = mix_counts(spark, d)
    rate = mixing.rates(counts, read_table(spark, d, "mix_targets"))
    return mixing.report(mixing.draw(counts, rate), rate)


def p7_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Is each source capped, and has the draw the size that its rate asks for?"""
    counts = mix_counts(spark, d)
    rate = mixing.rates(counts, read_table(spark, d, "mix_targets"))
    return mixing.on_target(mixing.draw(counts, rate), rate)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself, one row a copy of a document."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.emit(docs, mixing.rates(mixing.token_counts(docs), read_table(spark, d, "mix_targets")))


# ---------------------------------------------------------------- problem 8
def told_stretches(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "text")
    return langid.stretches(docs, langid.fitted(docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_cases(langid.document_languages(told_stretches(spark, d)))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Main language of each document with its confidence."""
    return langid.document_languages(told_stretches(spark, d)).withColumn("others", F.array_join(F.sort_array("others"), ","))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return told_stretches(spark, d)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p1_reads, p2_found, p2_error, p3_percentiles, p3_daily, p3_bounds, p4_found, p4_top, p6_found, p6_leaks, p7_found, p7_shares, p7_drawn, p7_mix, p8_found, p8_documents, p8_stretches)
}

# ------------------------------------------------------------- DuckDB twins
_INSERTS = """u as (select library, max(location) as location, coalesce(max(umi_length), 0)::int as n from umi_stats group by library),
  s as (select read_idx, upper(trim(seq)) as s, location, n from reads left join u using (library) where seq is not null),
  ins as (select read_idx, case location when 'inline_5prime' then substr(s, n + 1) when 'inline_3prime' then left(s, greatest(length(s) - n, 0)) else s end as t from s)"""
_HITS = f"""{_INSERTS}, g as (select t, row_number() over (order by t) as id, min(read_idx) as least from ins where length(t) >= 8 group by t),
      k as (select distinct id, substr(t, i::int, 8) as k from (select id, t, unnest(range(1, length(t) - 6)) as i from g)), z as (select id, count(*) as n from k group by id),
      c as (select a.id as a, b.id as b, count(*) as i from k a join k b on a.k = b.k and a.id < b.id group by 1, 2),
      hit as (select a, b from c join z x on x.id = a join z y on y.id = b where 2 * c.i >= x.n + y.n - c.i)"""
_CALLS = """v as (select lower(trim(chrom)) as chrom, coalesce(strftime(called_ts, '%Y-%m-%d'), 'none') as day, unnest([{'m': 'coverage', 'v': coverage::double}, {'m': 'level', 'v': level}]) as x from calls where chrom is not null),
  w as (select chrom, day, x.m as measure, x.v as v from v where x.v is not null and not isnan(x.v))"""


# sizes in characters in place of tokens: the same sources fall short by either
_CAPPED = """with t as (select lower(trim(source)) as source, sum(target_share) as target_share, max(max_repeats) as max_repeats from mix_targets group by 1),
      c as (select lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as source, sum(length(text)) as chars from documents group by 1),
      y as (select source, target_share, max_repeats, coalesce(chars, 0) as chars from t left join c using (source)), z as (select *, target_share * sum(chars) over () as wanted from y)"""


def _percentiles(keys: str, shares: list[float]) -> str:
    """Value at rank max(1, ceil(p * n)); exact, as the sketches are for small groups."""
    return f"""with {_CALLS}, o as (select *, row_number() over (partition by {keys} order by v) as k, count(*) over (partition by {keys}) as n from w),
      p as (select unnest({shares}::double[]) as p) select {keys}, n, p, min(v) as value, 0.0::double as max_rank_error from o, p where k = greatest(1, ceil(p * n)) group by {keys}, n, p"""


# p1_found compares all pairs that share an n-gram; fine at the size of the check, too slow beyond
ORACLES: dict[str, str] = {
    "p1_found": f"""with {_HITS} select least(p.read_idx, q.read_idx) as read_idx_a, greatest(p.read_idx, q.read_idx) as read_idx_b from hit join g x on x.id = a join g y on y.id = b join ins p on p.t = x.t join ins q on q.t = y.t""",
    "p1_groups": f"""with recursive {_HITS}, e as (select x.least as a, y.least as b from hit join g x on x.id = a join g y on y.id = b), both_ways as (select a, b from e union select b, a from e),
      reach as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b)
      select a as read_idx, min(b) as class_id, (select count(*) from both_ways w where w.a = reach.a) as links from reach group by a""",
    "p1_reads": f"""with recursive {_HITS}, e as (select x.least as a, y.least as b from hit join g x on x.id = a join g y on y.id = b), both_ways as (select a, b from e union select b, a from e),
      reach as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on w.a = r.b),
      cl as (select g.t, coalesce(min(r.b), g.least) as class_id from g left join reach r on r.a = g.least group by g.t, g.least),
      m as (select read_idx, class_id, count(*) over (partition by class_id) as n from ins join cl using (t)) select read_idx, class_id from m where n > 1""",
    "p2_found": """with k as (select read_idx, regexp_replace(upper(trim(umi)), '[^ACGT]', 'N', 'g') as k from reads)
      select read_idx from (select read_idx, min(read_idx) over (partition by k) as first from k where length(k) >= 4) where read_idx > first""",
    "p2_error": """with k as (select read_idx, read_idx // 131072 as batch, regexp_replace(upper(trim(umi)), '[^ACGT]', 'N', 'g') as k from reads),
      f as (select batch, k, min(read_idx) over (partition by k) // 131072 as born from k where length(k) >= 4),
      b as (select batch, count(distinct k) as keys, count(distinct k) filter (batch = born) as new_keys, (select sum(batch // 8 ** i::int % 8) from range(8) t(i))::int as filters_probed from f group by batch)
      select batch, keys, new_keys, filters_probed, 0 as wrong, 0 as missed, case when new_keys = 0 then 0 else filters_probed / 2.0::double ** 32 + sum(new_keys) over (order by batch) / 2.0::double ** 64 end as stated_rate, 0.0 as measured_rate from b""",
    "p3_percentiles": _percentiles("chrom, measure", SHARES),
    "p3_daily": _percentiles("chrom, day, measure", [0.1, 0.5, 0.9]),
    "p3_bounds": f"with {_CALLS} select chrom, measure, unnest({SHARES}::double[]) as p, count(*) as n, count(*) >= 256 as collapsed, true as holds from w group by chrom, measure",
    "p4_found": "with r as (select upper(seq) as seq from reads where trim(seq) <> '') select seq from r group by seq having count(*) >= 0.005 * (select count(*) from r)",
    "p7_found": _CAPPED + " select source from z where chars * max_repeats < wanted",
    "p7_drawn": _CAPPED + " select source, chars > 0 and chars * max_repeats <= wanted as capped, true as holds from z",
    "p4_top": "with r as (select upper(seq) as seq from reads where trim(seq) <> '') select seq, count(*) as exact_count, true as bound_holds, round_even(pow(least(((select count(*) from r) - count(*))::double / 4000 / count(*), 1.0), 5), 12) as miss_chance from r group by seq having count(*) >= 0.002 * (select count(*) from r)",
}
