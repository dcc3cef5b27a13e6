"""Evaluation of scored rows, all as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.session import materialise


def confusion(df: DataFrame, label: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives, per key if any."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*(keys or [])).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"),
    )


def f_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; zero where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("fpr", ratio(fp, fp + tn))
    )


def ranking_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ROC-AUC and average precision, exact, ties shared; rows without a score are left out.

    Equal scores are merged first. The merged scores, of any range, are dealt by ranges of about equal size
    and written once; running counts are taken over the ranges and then inside each, so no task sorts all scores.
    """
    y = F.coalesce((F.col(label) == 1).cast("bigint"), F.lit(0))
    merged = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    points = materialise(merged.repartitionByRange("_s").withColumn("_b", F.spark_partition_id()), "ranked-scores")
    totals = points.groupBy("_b").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range passes through this global window.
    offsets = totals.select(
        "_b",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    curve = (
        points.withColumn("_cp", F.sum("_pos").over(inside))
        .withColumn("_cn", F.sum("_neg").over(inside))
        .join(offsets, "_b")
        .withColumn("_tp", F.col("_op") + F.col("_cp"))
        .withColumn("_fp", F.col("_on") + F.col("_cn"))
    )
    return curve.agg(
        F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2)).alias("_area"),
        F.sum(F.col("_pos") * (F.col("_tp") / (F.col("_tp") + F.col("_fp")))).alias("_ap"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
    ).select(
        "positives",
        "negatives",
        F.coalesce(F.try_divide("_area", F.col("positives") * F.col("negatives")), F.lit(0.0)).alias("roc_auc"),
        F.coalesce(F.try_divide("_ap", "positives"), F.lit(0.0)).alias("pr_auc"),
    )


def evaluate(df: DataFrame, label: str, predicted: str, score: str) -> DataFrame:
    """One row: confusion matrix, threshold scores and ranking scores."""
    return f_scores(confusion(df, label, predicted)).crossJoin(
        ranking_scores(df, label, score).select("roc_auc", "pr_auc")
    )


def detection_rate(df: DataFrame, experiment: str, predicted: str) -> DataFrame:
    """Flagged share per experiment."""
    hit = F.col(predicted) == 1
    return df.groupBy(experiment).agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(hit).alias("flagged"),
        F.avg(hit.cast("double")).alias("detection_rate"),
    )
