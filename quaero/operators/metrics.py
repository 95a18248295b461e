"""Evaluation measures as ordinary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reciprocal(rank: Column, zero_based: bool = False) -> Column:
    """1 / rank; 0 for ``N/A`` and other texts, null, and ranks below the first."""
    r = rank.cast("string")
    n = F.trim(r).try_cast("double") + (1 if zero_based else 0)
    return F.when(n >= 1, 1 / n).otherwise(0.0)


def rank_measures(rows: DataFrame, rank: str, by: list[str] | None = None, zero_based: bool = False, at_most: int | None = None) -> DataFrame:
    """(questions, answered, mrr, p1). With ``at_most`` only questions with a rank up to it are counted."""
    value = reciprocal(F.col(rank), zero_based)
    kept = rows if at_most is None else rows.where(value >= 1 / at_most)
    aggregates = [F.count(F.lit(1)).alias("questions"), F.count_if(value > 0).alias("answered"), F.avg(value).alias("mrr"), F.avg(F.when(value == 1, 1.0).otherwise(0.0)).alias("p1")]
    return kept.groupBy(*by).agg(*aggregates) if by else kept.agg(*aggregates)


def precision_at(results: DataFrame, gold: DataFrame, k: int, key: str = "qid", doc: str = "doc_id") -> DataFrame:
    """(qid, precision): hits among the first k over k, however many came back."""
    wanted = gold.select(key, doc).distinct().withColumn("hit", F.lit(1))
    top = results.where(F.col("rank") <= k).join(wanted, [key, doc], "left")
    return top.groupBy(key).agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("precision"))


def coverage(results: DataFrame, gold: DataFrame, key: str = "qid", doc: str = "doc_id") -> DataFrame:
    """(qid, gold, found, coverage) for every question with a gold document."""
    wanted = gold.select(key, doc).distinct()
    found = wanted.join(results.select(key, doc).distinct(), [key, doc], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    joined = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("gold")).join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    return joined.withColumn("coverage", F.col("found") / F.col("gold"))


def coverage_summary(per_question: DataFrame) -> DataFrame:
    return per_question.agg(
        F.avg("coverage").alias("mean"), F.stddev_pop("coverage").alias("deviation"), F.sum("found").alias("found"), F.sum("gold").alias("gold"),
        F.count_if(F.col("coverage") == 1).alias("full"), F.count_if(F.col("found") == 0).alias("none"),
    )


def precision_recall(rows: DataFrame, label: str, predicted: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, precision, recall, f1) in percent, from counts over each group."""
    p, t = F.col(predicted) >= threshold, F.col(label) > 0
    counted = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    share = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": precision, "recall": recall}).withColumn("f1", share(2 * F.col("precision") * F.col("recall") / 100, F.col("precision") + F.col("recall")))


def over_folds(per_fold: DataFrame) -> DataFrame:
    """Means and population deviations of precision, recall and F1."""
    return per_fold.agg(*(f(m).alias(f"{m}_{name}") for m in ("precision", "recall", "f1") for f, name in ((F.avg, "mean"), (F.stddev_pop, "sd"))))


def pair_accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.agg(F.avg(F.when((F.col(predicted) >= 0.5) == (F.col(label) >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(label) == F.col(predicted)).alias("correct"), F.count_if(~F.col(label) & F.col(predicted)).alias("fp"), F.count_if(F.col(label) & ~F.col(predicted)).alias("fn"))


def t_test(rows: DataFrame, value: str, group: str) -> DataFrame:
    """(t, df): pooled two-sample t statistic of the two groups of a boolean column."""
    a, b = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    s = rows.agg(F.count(a).alias("n"), F.count(b).alias("m"), F.avg(a).alias("x"), F.avg(b).alias("y"), F.var_samp(a).alias("v"), F.var_samp(b).alias("w"))
    pooled = ((F.col("n") - 1) * F.col("v") + (F.col("m") - 1) * F.col("w")) / (F.col("n") + F.col("m") - 2)
    return s.select(((F.col("x") - F.col("y")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("m")))).alias("t"), (F.col("n") + F.col("m") - 2).alias("df"))


def learning_curve(runs: DataFrame, series: str) -> DataFrame:
    """(epoch, mean): the mean over runs of the entries of an array column, in percent."""
    return runs.select(F.posexplode(series).alias("epoch", "v")).groupBy("epoch").agg((100 * F.avg("v")).alias("mean"))


def first_hit_rank(results: DataFrame, gold: DataFrame, key: str = "qid", text: str = "key") -> DataFrame:
    """(qid, rank): the least rank of a result that is gold, 0 if none."""
    hits = results.join(gold.select(key, text).distinct(), [key, text], "left_semi").groupBy(key).agg(F.min("rank").alias("r"))
    return results.select(key).distinct().join(hits, key, "left").select(key, F.coalesce("r", F.lit(0)).alias("rank"))
