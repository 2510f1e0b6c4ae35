"""How good scored rows are: (y boolean, p double) to one row, each in sort-based aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def _levels(scored: DataFrame) -> DataFrame:
    """(p, pos, n, tp, seen): by distinct score, with running counts from the highest.

    Rows collapse to distinct scores before they are ordered. Scores fall into 4,096 strips; running counts over
    the strips and within each avoid ordering all in one task.
    """
    level = scored.groupBy("p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    level = level.withColumn("strip", F.floor(F.col("p") * 4096).cast("int"))
    strips = level.groupBy("strip").agg(F.sum("pos").alias("sp"), F.sum("n").alias("sn"))
    above = Window.orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select("strip", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("seen0"))
    within = Window.partitionBy("strip").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    placed = level.join(F.broadcast(strips), "strip")
    return placed.select("p", "pos", "n", (F.col("tp0") + F.sum("pos").over(within)).alias("tp"), (F.col("seen0") + F.sum("n").over(within)).alias("seen"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision."""
    steps = _levels(scored).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("s"), F.sum("pos").alias("t"))
    return steps.select(F.try_divide("s", "t").alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null with one class only."""
    neg = F.col("n") - F.col("pos")
    # Positives above each level's negatives, and half of those at their side.
    area = _levels(scored).agg(F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)).alias("s"), F.sum("pos").alias("t"), F.sum(neg).alias("f"))
    return area.select(F.try_divide("s", F.col("t") * F.col("f")).alias("roc_auc"))


def losses(scored: DataFrame) -> DataFrame:
    """Log loss, Brier score, base rate and the number of rows."""
    p = F.least(F.greatest("p", F.lit(EPSILON)), F.lit(1 - EPSILON))
    y = F.col("y").cast("double")
    return scored.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col("p") - y) ** 2).alias("brier"), F.avg(y).alias("base_rate"), F.count("*").alias("examples"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n) of equal bins; the last is closed, empty ones are left out."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"), F.count("*").alias("n"))


def evaluate(scored: DataFrame) -> DataFrame:
    """All of them in one row."""
    return average_precision(scored).join(roc_auc(scored)).join(losses(scored))
