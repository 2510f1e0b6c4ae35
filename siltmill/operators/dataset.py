"""Labelled examples, their statistics, and a split in time that keeps sessions whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PURCHASE
from .sessions import feature_rows, session_state


def examples(events: DataFrame, seq: str = "event_id") -> DataFrame:
    """One row for each event that leaves a cart open: features, ``abandoned``, session_id, session_start, event_index.

    A cart is abandoned if no purchase follows it, that is if its cycle is the session's last. Purchases
    themselves are no examples.
    """
    state = session_state(events, seq).withColumn("last_cycle", F.max("cycle").over(Window.partitionBy("session_id")))
    kept = state.filter((F.col("event_type") != PURCHASE) & (F.col("open_adds") > 0))
    labelled = kept.withColumns({"abandoned": F.col("cycle") == F.col("last_cycle"), "session_start": F.col("first_ts")})
    return feature_rows(labelled, ("session_id", "event_index", "session_start", "abandoned"))


def dataset_stats(events: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: events, sessions, sessions with a cart, converted ones, those dropped, examples, abandonment rate.

    A session is converted if one of its examples is; one whose only purchase came before any cart is not.
    """
    all_ = events.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
    by = rows.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("abandoned").alias("lost"))
    sums = by.agg(F.count("*").alias("sessions_with_cart"), F.count_if(F.col("lost") < F.col("n")).alias("sessions_converted"), F.coalesce(F.sum("n"), F.lit(0)).alias("examples"), F.coalesce(F.sum("lost"), F.lit(0)).alias("abandoned"))
    rate = F.coalesce(F.try_divide("abandoned", "examples"), F.lit(0.0))
    return all_.join(sums).select("events", "sessions", "sessions_with_cart", "sessions_converted", (F.col("sessions") - F.col("sessions_with_cart")).alias("dropped_no_cart"), "examples", rate.alias("abandonment_rate"))


def split_cutoff(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """One row, ``cutoff``: the last session start that trains.

    The place is found over counts by hour of start first, so that only one hour's starts are ever ordered in
    one place.
    """
    if not 0 < fraction < 1:
        raise ValueError(f"the fraction must be between 0 and 1, not {fraction}")
    starts = rows.select("session_start").distinct()
    hours = starts.groupBy(F.floor(F.col("session_start") / 3600).alias("h")).agg(F.count("*").alias("n"))
    placed = hours.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = starts.agg(F.greatest(F.lit(0), F.floor(F.count("*") * F.lit(fraction)) - 1).alias("place"))
    hour = placed.join(total).filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    inside = starts.withColumn("h", F.floor(F.col("session_start") / 3600)).join(F.broadcast(hour), "h")
    at = F.row_number().over(Window.partitionBy("h").orderBy("session_start")) - 1
    return inside.withColumn("at", at).filter(F.col("at") == F.col("place") - F.col("before")).select(F.col("session_start").alias("cutoff"))


def time_split(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """``rows`` with ``is_train``: sessions that begin no later than the cutoff."""
    return rows.join(F.broadcast(split_cutoff(rows, fraction))).withColumn("is_train", F.col("session_start") <= F.col("cutoff")).drop("cutoff")


def session_overlap(rows: DataFrame) -> DataFrame:
    """Sessions on both sides of a split; there must be none."""
    return rows.filter("is_train").select("session_id").intersect(rows.filter("not is_train").select("session_id"))
