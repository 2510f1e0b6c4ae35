"""The event row and the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"ts": LongType(), "price": DoubleType()}

# The twelve fields of an event, in order.
EVENT_FIELDS = ("event_id", "ts", "session_id", "user_id", "event_type", "device", "product_id", "title", "category", "brand", "price", "query")
# The fields that are indexed, and the closed set of event types.
TEXT_FIELDS = ("title", "category", "brand", "query", "event_type")
EVENT_TYPES = ("view", "click", "search", "add_to_cart", "remove_from_cart", "purchase")
CART, REMOVE, PURCHASE = "add_to_cart", "remove_from_cart", "purchase"
REQUIRED = ("event_id", "ts", "session_id", "user_id", "event_type")

EVENT_SCHEMA = StructType([StructField(f, _KINDS.get(f, StringType()), f not in REQUIRED) for f in EVENT_FIELDS])

POSTINGS_SCHEMA = StructType([StructField("segment", StringType()), StructField("term", StringType()), StructField("doc_id", LongType()), StructField("tf", IntegerType()), StructField("length", IntegerType())])


def conform(df: DataFrame) -> DataFrame:
    """The event's fields in order: what is missing becomes null, what is extra goes."""
    return df.select(*[(F.col(f) if f in df.columns else F.lit(None)).cast(EVENT_SCHEMA[f].dataType).alias(f) for f in EVENT_FIELDS])


def event_problem() -> Column:
    """Why a row is no valid event, or null."""
    missing = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in REQUIRED])
    return F.coalesce(missing, F.when(~F.col("event_type").isin(*EVENT_TYPES), F.concat(F.lit("unknown event_type "), "event_type")))


def validated(df: DataFrame) -> DataFrame:
    """The events, checked when they are read: any invalid row fails the job with its problem."""
    fields = [(f.name, f.dataType) for f in df.schema]
    if fields != [(f.name, f.dataType) for f in EVENT_SCHEMA]:
        raise ValueError(f"not the event schema: {fields}")
    problem = event_problem()
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("event_type"))
    return df.withColumn("event_type", checked)
