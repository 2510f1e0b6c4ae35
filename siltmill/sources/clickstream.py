"""The clickstream CSV: reading, cleaning, counting, and cutting out whole sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.titles import derive_title
from ..operators.sequence import with_sequence
from ..schema import EVENT_FIELDS, EVENT_SCHEMA

# The columns a file must have, and its event types in ours.
COLUMNS = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")
TYPES = {"view": "view", "cart": "add_to_cart", "remove_from_cart": "remove_from_cart", "purchase": "purchase"}
CORRUPT = "_corrupt"
#: Sessions of a slice are chosen from this part of its window, so that their later rows are still inside.
SELECTION = 5


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The first line's names, byte order mark stripped; missing columns are an error."""
    line = spark.read.text(path).limit(1).collect()
    names = [] if not line else [c.strip().strip('"') for c in line[0][0].lstrip("﻿").split(",")]
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; it has {names}")
    return names


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All rows as strings, plain or gzipped; rows of another width are kept in ``_corrupt``.

    ``seq`` orders rows by their file's path, then by their place in the file. A user schema binds by position, so it
    follows the header. Column pruning is off, or rows that are too short would not be noticed.
    """
    schema = StructType([StructField(c, StringType()) for c in [*header_of(spark, path), CORRUPT]])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).option("columnPruning", False).csv(path)
    # Within a split, rows come in order and the id grows.
    return raw.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def epoch(column: Column) -> Column:
    """Seconds since 1970 of a fixed-width time; what follows is ignored, null if it can't be one."""
    n = lambda a, b: F.substring(column, a, b).cast("int")
    ok = column.rlike(r"^\d{4}.\d{2}.\d{2}.\d{2}.\d{2}.\d{2}")
    midnight = F.try_to_timestamp(F.concat_ws("-", F.substring(column, 1, 4), F.substring(column, 6, 2), F.lit("01")))
    # Days and times of day are not held to their ranges; they only add up.
    seconds = F.unix_timestamp(midnight) + (n(9, 2) - 1) * 86_400 + n(12, 2) * 3_600 + n(15, 2) * 60 + n(18, 2)
    return F.when(ok, seconds)


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def clean(raw: DataFrame, titles: bool = True) -> DataFrame:
    """Raw rows with the event's columns and ``reason``: null for good rows, else the first thing wrong."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    kind = F.try_element_at(kinds, F.coalesce("event_type", F.lit("")))
    ts = epoch(F.col("event_time"))
    reason = F.coalesce(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed row")),
        F.when(kind.isNull(), F.concat(F.lit("unknown event_type '"), F.coalesce("event_type", F.lit("")), F.lit("'"))),
        F.when(ts.isNull(), F.lit("unparseable event_time")),
    )
    product, brand, category = (blank_to_null(F.col(c)) for c in ("product_id", "brand", "category_code"))
    out = {
        "ts": ts, "session_id": F.coalesce("user_session", F.lit("")), "user_id": F.coalesce("user_id", F.lit("")), "event_type": kind, "device": F.lit(None),
        "product_id": product, "title": derive_title(product, brand, category) if titles else F.lit(None), "category": category, "brand": brand,
        "price": F.expr("try_cast(trim(price) as double)"), "query": F.lit(None),
    }
    return raw.select("seq", reason.alias("reason"), *[c.cast(EVENT_SCHEMA[k].dataType).alias(k) for k, c in out.items()])


def events(cleaned: DataFrame, limit: int | None = None) -> DataFrame:
    """The good rows as events, numbered in file order; ``limit`` counts good rows."""
    good = with_sequence(cleaned.filter("reason is null"), ["seq"], "rn")
    if limit is not None:
        good = good.filter(F.col("rn") < limit)
    event_id = F.format_string("r_%09d", F.col("rn") + 1)
    return good.withColumn("event_id", event_id).select(*EVENT_FIELDS)


def load_events(spark: SparkSession, path: str, limit: int | None = None, titles: bool = True) -> DataFrame:
    return events(clean(read_raw(spark, path), titles), limit)


def load_stats(cleaned: DataFrame) -> DataFrame:
    """One row: rows read and skipped, events, missing fields and the span of time, in one aggregation."""
    good = F.col("reason").isNull()
    return cleaned.agg(
        F.count("*").alias("rows_read"), F.count_if(~good).alias("rows_skipped"), F.count_if(good).alias("events"),
        *[F.count_if(good & F.col(c).isNull()).alias(f"missing_{c}") for c in ("brand", "category", "title")],
        F.min(F.when(good, F.col("ts"))).alias("first_ts"), F.max(F.when(good, F.col("ts"))).alias("last_ts"),
    )


def skip_reasons(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("reason is not null").groupBy("reason").count()


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"))


def slice_sessions(raw: DataFrame, sessions: int = 2000, scan_limit: int = 2_000_000, session: str = "user_session", seq: str = "seq") -> DataFrame:
    """The raw rows, in a window of the file, of the first sessions that begin in its first fifth.

    Rows that cleaning would reject stay; only rows too short to have a session are left out.
    """
    if sessions < 1:
        raise ValueError("sessions must be at least 1")
    window = with_sequence(raw, [seq], "__rn").filter(F.col("__rn") < scan_limit)
    named = F.col(session).isNotNull() & (F.col(session) != "")
    head = window.filter(named & (F.col("__rn") < max(1, scan_limit // SELECTION)))
    first = head.groupBy(session).agg(F.min("__rn").alias("__first")).orderBy("__first").limit(sessions)
    return window.join(first.select(session), session, "left_semi").orderBy("__rn").drop("__rn")


def write_slice(sliced: DataFrame, path: str) -> None:
    """The slice as CSV with a header."""
    sliced.drop("seq", CORRUPT).write.option("header", True).mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields included."""
    df.write.option("ignoreNullFields", False).mode("overwrite").json(path)
