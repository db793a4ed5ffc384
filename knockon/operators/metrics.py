"""Exact ranking metrics (ROC-AUC, average precision) for a score column.

Ties are grouped by distinct score.  The cumulative true/false positive counts
(ordered by score, descending) are built without a global single-partition
window: Spark's range partitioning deals the distinct scores into rising value
ranges, as many as there are shuffle partitions; range totals are prefix-summed
on the small range table, and each range does its own running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knockon.session import materialize

def _ranges(scores: DataFrame, col: str, n_ranges: int | None) -> DataFrame:
    """The distinct scores, written with ``_range``: rising value ranges, equal scores together."""
    dealt = scores.repartitionByRange(n_ranges, col) if n_ranges else scores.repartitionByRange(col)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "scores")  # read 3 times


def score_curve(df: DataFrame, score: str, label: str, n_ranges: int | None = None, by=()) -> DataFrame:
    """One row per (group, distinct score): tp/fp at that score and cumulative TP/FP of
    all scores >= it within the group (descending sweep)."""
    by = list(by)
    g = (df.where(F.col(score).isNotNull())
         .groupBy(*by, F.col(score).cast("double").alias("score"))
         .agg(F.sum(F.col(label).cast("long")).alias("tp"),
              F.sum((1 - F.col(label)).cast("long")).alias("fp")))
    g = _ranges(g, "score", n_ranges)
    totals = g.groupBy(*by, "_range").agg(F.sum("tp").alias("_rtp"), F.sum("fp").alias("_rfp"))
    before = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range",
        F.coalesce(F.sum("_rtp").over(before), F.lit(0)).alias("_otp"),
        F.coalesce(F.sum("_rfp").over(before), F.lit(0)).alias("_ofp"))
    run = Window.partitionBy(*by, "_range").orderBy(F.col("score").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    # offsets: at most groups x shuffle partitions rows (a bounded broadcast)
    return (g.join(F.broadcast(offsets), [*by, "_range"])
            .withColumn("cum_tp", F.col("_otp") + F.sum("tp").over(run))
            .withColumn("cum_fp", F.col("_ofp") + F.sum("fp").over(run))
            .drop("_range", "_otp", "_ofp"))


def ranking_metrics(df: DataFrame, score: str, label: str, n_ranges: int | None = None, by=()) -> DataFrame:
    """Per group: roc_auc (trapezoid over the ROC steps) and average_precision (sum of
    recall steps times precision); null when only one class is present."""
    by = list(by)
    c = score_curve(df, score, label, n_ranges, by)
    # counts as doubles: their products pass the range of long before the counts do
    tp, fp, cum_tp, cum_fp = (F.col(x).cast("double") for x in ("tp", "fp", "cum_tp", "cum_fp"))
    aggs = [F.sum(tp).alias("P"), F.sum(fp).alias("N"),
            F.sum(fp * (cum_tp - tp / 2.0)).alias("_area"),
            F.sum(tp * (cum_tp / (cum_tp + cum_fp))).alias("_ap")]
    agg = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *by,
        F.when(ok, F.col("_area") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(ok, F.col("_ap") / F.col("P")).alias("average_precision"))
