"""The driver's tables in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, build_index
from ..schema import EVENT_SCHEMA

# The table's event types in ours.
KINDS = {"view": "view", "click": "click", "signup": "add_to_cart", "error": "remove_from_cart", "purchase": "purchase"}
DOCS_PER_SEGMENT = 100
#: Documents have no time of their own; arrival gives them one.
FIRST_TS = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, docs_per_segment: int = DOCS_PER_SEGMENT) -> Index:
    """The index of ``documents``: doc_id counts arrivals, so no row has to be counted."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text", "lang", "source")
    return build_index(docs, ["text"], docs_per_segment, position="position", ts=F.col("position") + FIRST_TS)


def catalog(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``part`` over three pooled fields."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("position"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    return build_index(part, ["title", "category", "brand"], 500, position="position", ts=F.col("position"))


def web_pages(spark: SparkSession, sf_dir: str) -> Index:
    """The index of ``pages`` without their tags."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return build_index(pages, ["text"], DOCS_PER_SEGMENT, position="position", ts=F.col("position"))


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as clickstream events: a user's week is a session, a part is a product."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    base = e.select(
        F.format_string("r_%09d", "event_id").alias("event_id"), F.floor(F.unix_micros(ts) / 1_000_000).cast("long").alias("ts"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.weekofyear(ts).cast("string")).alias("session_id"), F.col("user_id").cast("string").alias("user_id"),
        F.try_element_at(kinds, "event_type").alias("event_type"), F.regexp_extract("props", "([0-9]+)", 1).alias("product_id"), F.col("value").alias("price"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    full = base.join(part, "product_id", "left").withColumns({c: F.lit(None).cast("string") for c in ("device", "title", "query")})
    return full.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA])
