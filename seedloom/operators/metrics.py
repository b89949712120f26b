"""Ranking and threshold metrics of labelled probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-7


def clip_probability(p: Column, least: float = CLIP) -> Column:
    return F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))


def hard_prediction(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def score_table(df: DataFrame, by: list[str], label: str = "label", score: str = "probability_1") -> DataFrame:
    """Positives and rows of each distinct score, by group: what ranking metrics need, summed before it is shuffled."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n"))


def running_counts(table: DataFrame, by: list[str], buckets: int = 64) -> DataFrame:
    """Adds ``tp`` and ``predicted``: running positives and rows from the highest score down.

    Scores are cut into ``buckets`` value ranges: a window inside each range, and one over
    the ranges' sums, so that distinct scores of a group are never ordered in one task.
    """
    ranged = table.withColumn("_bucket", F.least(F.greatest(F.floor(F.col("score") * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.desc("score"))
    totals = ranged.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*(by or [F.lit(0)]))
    totals = totals.select(
        *by, "_bucket", F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_pos_above"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n_above"),
        F.sum("_pos").over(group).alias("all_pos"), F.sum("_n").over(group).alias("all_n"),
    )
    joined = ranged.withColumn("tp", F.sum("pos").over(inside)).withColumn("predicted", F.sum("n").over(inside)).join(totals, [*by, "_bucket"])
    return joined.withColumn("tp", F.col("tp") + F.col("_pos_above")).withColumn("predicted", F.col("predicted") + F.col("_n_above")).drop("_bucket", "_pos_above", "_n_above")


def cumulative_pr_curve(df: DataFrame, by: list[str], **columns: str) -> DataFrame:
    """Precision and recall at each distinct score."""
    run = running_counts(score_table(df, by, **columns), by)
    return run.select(*by, "score", "tp", "predicted", (F.col("tp") / F.col("predicted")).alias("precision"), (F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0))).alias("recall"))


def ranking_metrics(df: DataFrame, by: list[str], **columns: str) -> DataFrame:
    """Average precision and AUROC by group, ties grouped; null where a group has one class."""
    run = running_counts(score_table(df, by, **columns), by)
    neg_above = (F.col("predicted") - F.col("n")) - (F.col("tp") - F.col("pos"))
    neg = F.col("n") - F.col("pos")
    beaten = F.col("all_n") - F.col("all_pos") - neg_above - neg
    sums = run.groupBy(*by).agg(
        F.max("all_pos").alias("n_pos"), F.max("all_n").alias("n_rows"),
        F.sum(F.col("pos") * F.col("tp") / F.col("predicted")).alias("ap"), F.sum(F.col("pos") * (beaten + neg / 2)).alias("wins"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_rows"))
    return sums.select(
        *by, "n_rows", "n_pos",
        F.when(both, F.col("ap") / F.col("n_pos")).alias("average_precision"),
        F.when(both, F.col("wins") / (F.col("n_pos") * (F.col("n_rows") - F.col("n_pos")))).alias("auroc"),
    )


def threshold_metrics(df: DataFrame, by: list[str], label: str = "label", score: str = "probability_1", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and MCC (0 where undefined), log-loss and Brier score by group."""
    y, p = F.col(label), clip_probability(F.col(score))
    hit = F.col(score) >= threshold
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"),
        F.avg(F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.select(
        *by, "n", ratio(tp + tn, F.col("n").cast("double")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc.alias("mcc"), "log_loss", "brier",
    )


def bce_loss(df: DataFrame, by: list[str], logit: Column, label: Column, weight: Column | None = None, positive_smoothing: float = 0.0, negative_smoothing: float = 0.0, focal_gamma: float = 0.0) -> DataFrame:
    """Weighted mean binary cross-entropy of logits by group, with asymmetric label smoothing and an optional focal factor."""
    w = F.lit(1.0) if weight is None else weight
    target = F.when(label > 0.5, 1 - positive_smoothing).otherwise(negative_smoothing)
    loss = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    if focal_gamma:
        p = 1 / (1 + F.exp(-logit))
        loss = loss * F.pow(1 - F.when(label > 0.5, p).otherwise(1 - p), F.lit(focal_gamma))
    return df.groupBy(*by).agg((F.sum(loss * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("loss"))


def mean_prob_logit(df: DataFrame, key: str, probability: str) -> DataFrame:
    """Mean probability of repeated passes and its logit, clipped by 1e-6."""
    p = clip_probability(F.col("probability"), 1e-6)
    return df.groupBy(key).agg(F.avg(probability).alias("probability")).withColumn("logit", F.log(p / (1 - p)))


def best_checkpoint(history: DataFrame) -> DataFrame:
    """The epoch of greatest AUPRC, then least log-loss, then fewest epochs."""
    return history.orderBy(F.desc("auprc"), F.asc("log_loss"), F.asc("epoch")).limit(1)
