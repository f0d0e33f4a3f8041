"""Scoring calls against a truth set, ranking and multi-sample comparison.

Counts are pre-aggregated per key before anything else is joined; ratios with a
zero denominator are 0.0; scores are rounded to 4 places, half to even. Ties in
a ranking go to the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ["precision", "recall", "f1_score", "accuracy"]


def truth_join(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Calls at true sites with the binary call (level over 0.5)."""
    return calls.join(truth, ["chrom", "pos"]).withColumn("called", (F.col("level") > 0.5).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(calls: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, tn, fn over the overlap only."""
    c, m = F.col("called") == 1, F.col("methylated") == 1
    return truth_join(calls, truth).groupBy(*keys).agg(F.count_if(c & m).alias("tp"), F.count_if(c & ~m).alias("fp"), F.count_if(~c & ~m).alias("tn"), F.count_if(~c & m).alias("fn"))


def scored(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "tn", "fn")],
        F.bround(p, 4).alias("precision"),
        F.bround(r, 4).alias("recall"),
        F.bround(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1_score"),
        F.bround(ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        (tp + fp + tn + fn).alias("sites_overlap"),
        "tp", "fp", "tn", "fn",
    )


def metrics(calls: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return scored(confusion(calls, truth, keys))


def level_correlation(calls: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson of level and truth; null where either is constant."""
    x, y = F.col("level"), F.col("methylated").cast("double")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return truth_join(calls, truth).groupBy(*keys).agg(F.bround(r, 4).alias("level_correlation"))


def with_status(names: DataFrame, calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics for every listed aligner: ok, no_overlap or no_output."""
    called = calls.groupBy("aligner").agg(F.count(F.lit(1)).alias("sites_called"))
    m = metrics(calls, truth, ["aligner"])
    status = F.when(F.col("sites_called").isNull(), "no_output").when(F.col("sites_overlap").isNull(), "no_overlap").otherwise("ok")
    return names.join(called, "aligner", "left").join(m, "aligner", "left").withColumn("status", status)


def ranked(scores: DataFrame, score: str = "f1_score", name: str = "aligner") -> DataFrame:
    """Rank 1..n by falling score. One row an aligner, so one small window."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(name))))


def best(scores: DataFrame, score: str = "f1_score", name: str = "aligner") -> DataFrame:
    return scores.orderBy(F.desc(score), name).limit(1)


def best_per(results: DataFrame, key: str, score: str = "f1_score", name: str = "aligner") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), name)
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def mean_score(score: str = "f1_score") -> Column:
    """Mean of scores with 4 places, summed as whole numbers: the same in any order."""
    return F.bround(F.sum(F.round(F.col(score) * 10000).cast("bigint")) / (F.count(score) * 10000.0), 6)


def overall_ranking(results: DataFrame) -> DataFrame:
    s = results.groupBy("aligner").agg(mean_score().alias("mean_f1"), F.bround(F.stddev_samp("f1_score"), 6).alias("std_f1"), F.count("f1_score").alias("n"))
    return ranked(s, "mean_f1")


def wins_compat(results: DataFrame) -> DataFrame:
    """Rows equal to the aligner's own best score."""
    top = results.withColumn("top", F.max("f1_score").over(Window.partitionBy("aligner")))
    return top.groupBy("aligner").agg(F.count_if(F.col("f1_score") == F.col("top")).alias("wins"))


def sample_wins(results: DataFrame) -> DataFrame:
    """Samples in which the aligner is best."""
    won = best_per(results, "sample").groupBy("aligner").agg(F.count(F.lit(1)).alias("wins"))
    return results.select("aligner").distinct().join(won, "aligner", "left").select("aligner", F.coalesce("wins", F.lit(0)).alias("wins"))


def rank_by(results: DataFrame, key: str) -> DataFrame:
    mean = results.groupBy(key, "aligner").agg(mean_score().alias("mean_f1"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mean_f1"), "aligner")))


def pivot_scores(results: DataFrame, aligners: list[str]) -> DataFrame:
    """sample x aligner mean score; the columns are given, so no extra pass finds them."""
    return results.groupBy("sample").pivot("aligner", aligners).agg(mean_score())


def unpivot_scores(results: DataFrame) -> DataFrame:
    return results.unpivot(["sample", "aligner"], SCORES, "metric", "value")


def summary(results: DataFrame) -> DataFrame:
    """One row: totals, best aligner over all, and by sample."""
    top = best(overall_ranking(results), "mean_f1").select(F.col("aligner").alias("overall_best"), F.col("mean_f1").alias("overall_best_f1"))
    totals = results.agg(F.count_distinct("sample").alias("total_samples"), F.count_distinct("aligner").alias("total_aligners"))
    per = best_per(results, "sample").agg(F.array_sort(F.collect_list(F.struct("sample", "aligner", "f1_score"))).alias("per_sample_best"))
    return totals.join(F.broadcast(top)).join(F.broadcast(per))  # each of one row


def topk(results: DataFrame, k: int = 5) -> DataFrame:
    return results.orderBy(F.desc("f1_score"), "sample", "aligner").limit(k)
