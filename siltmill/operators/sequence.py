"""Positions in an order, without bringing a table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def with_sequence(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """``df`` with each row's place (from 0) in an order, which should be total.

    A range-partitioned sort, written once so that the ranges are fixed, gives each row its place in its
    partition; partitions begin where the ones before them end. Only one count for each partition is gathered.
    """
    sort = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    fixed = written(sort)
    sizes = fixed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))  # a row for each partition
    return fixed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
