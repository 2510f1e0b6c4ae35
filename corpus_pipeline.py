"""Documents to packed training sequences: language, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever extra ones there
are; names that a stage needs for itself are chosen so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmill.llm import langid, near_copies, packing, pii, toxicity
from siltmill.llm.common import append_columns, free_name, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: those without letters, or far from every learned profile."""
    profiles = langid.train(langid.training_rows(docs))
    keep = free_name(docs, "keep")

    def make():
        look = langid.Predictor(profiles)

        def each(texts: list) -> dict:
            found = [look(t) for t in texts]
            return {keep: [lang != langid.UNKNOWN and score >= langid.REJECT_SCORE for lang, score in found]}

        return each

    return append_columns(docs, "text", make, f"`{keep}` boolean").filter(F.col(keep)).drop(keep)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier chain calls toxic."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    prefix = "p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    scored = toxicity.score(docs, chain, prefix=prefix)
    return scored.filter(F.col(f"{prefix}toxic") <= toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: five-word shingles, verified Jaccard 0.8 or more."""
    return near_copies.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds."""
    out = pii.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Rank-order language profiles, learned weights and byte-pair ids can't be written in SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
