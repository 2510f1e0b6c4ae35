"""The Spark session the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that results depend on, and those that plans are made for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build(master: str | None = None, app: str = "siltmill", **settings: str) -> SparkSession:
    """A session with SETTINGS; on a cluster master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.config(map=SETTINGS | settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS to a session that someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
