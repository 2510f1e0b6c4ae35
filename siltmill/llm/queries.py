"""One query for each corpus operator, over its whole table with production parameters.

None has SQL for DuckDB: each is tested against brute force, an exact round trip or held-out accuracy instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, licenses, media_mpeg, packing, pii, sentencepiece_scan, simhash, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.round_trip(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_mpeg.store(_table(spark, sf_dir, "documents"))
    return media_mpeg.features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pii_spans(_table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(langid.training_rows(docs)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_mpeg_audio, op4_token_counts, op5_nearest, op6_toxicity, op7_packing, op8_pii, op9_language, op10_licenses)}
ORACLE_SQL: dict[str, str] = {}
