"""Scoring sessions while they happen, with the windows that batch uses.

What a micro-batch needs of the past is the events of the sessions that are still open. They are held in a table;
each micro-batch joins them with its own events, runs ``session_state`` over both in order of arrival, scores its own
rows, and writes the events of what is open now as the next table. So there is one definition of a session's state,
and a session costs a sort of its own events whenever it gets new ones. The table holds each event from when it
comes until its session expires.

A session expires by its own partition's progress alone: when the newest time seen there is more than the timeout past
the session's last event, it is swept from the table, and what comes later starts a new run. Late events belong to the
run they find, with a gap of zero.

Tables and results carry their micro-batch's number and are overwritten by a replay, so files get every prediction
exactly once; a topic or a callback gets it at least once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.model import Ensemble, score_column
from ..operators.sessions import AT_RISK, TIMEOUT, feature_rows, scoring_gate, session_state, watermarks, with_runs
from ..schema import EVENT_FIELDS, EVENT_SCHEMA, PURCHASE
from ..sources.store import Store

LOGGED = StructType([*(StructField(f.name, f.dataType) for f in EVENT_SCHEMA), StructField("partition", IntegerType()), StructField("offset", LongType())])
_MARKS = "partition int, watermark long"
#: Takes a micro-batch's predictions and its number.
Sink = Callable[[DataFrame, int], None]


def session_states(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """Every event with its session run's state after it, by arrival. ``events`` has ``partition`` and ``offset``."""
    return session_state(with_runs(events, timeout), session=("session_id", "run"), order=("offset",))


def predictions(states: DataFrame, ensemble: Ensemble, threshold: float = AT_RISK) -> DataFrame:
    """The scored events: those of sessions with an open cart and at least two events."""
    gated = states.filter(scoring_gate().isNull() & (F.col("event_type") != PURCHASE))
    keep = ("session_id", "event_id", "user_id", "partition", "last_ts")
    renamed = gated.withColumns({"__events": F.col("events"), "__size": F.col("cart_size"), "__value": F.col("cart_value")})
    rows = feature_rows(renamed, (*keep, "__events", "__size", "__value")).withColumn("p", score_column(ensemble))
    return rows.select(
        "session_id", "event_id", "user_id", F.col("last_ts").alias("ts"), F.col("__events").alias("events"), F.col("__size").alias("cart_size"),
        F.round("__value", 2).alias("cart_value"), F.round("p", 4).alias("probability"), (F.col("p") >= threshold).alias("at_risk"), "partition",
    )


def sweep(events: DataFrame, marks: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """The events of each session's last run, if its partition has not shown a time more than ``timeout`` past its end.

    ``marks`` has a row for each log partition.
    """
    runs = with_runs(events, timeout)
    last = runs.groupBy("session_id").agg(F.max("run").alias("run"), F.max_by("ts", "offset").alias("__end"))
    kept = runs.join(last, ["session_id", "run"]).join(F.broadcast(marks), "partition")
    return kept.filter(F.col("watermark") - F.col("__end") <= timeout).select(*events.columns)


def json_sink(path: str) -> Sink:
    """JSON lines, a folder for each micro-batch."""
    return lambda scored, number: scored.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/batch={number}")


def topic_sink(servers: str, topic: str) -> Sink:
    """Records of a topic, keyed by session."""
    from .indexer import SINK, to_records

    return lambda scored, _: to_records(scored).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**SINK).save()


def callback_sink(each: Callable[[dict], None]) -> Sink:
    """Calls a function on the driver for each prediction, a partition's rows at a time."""

    def run(scored: DataFrame, _: int) -> None:
        for row in scored.toLocalIterator():
            each(row.asDict())

    return run


class Held:
    """The open sessions' events and the partitions' newest times, by micro-batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def read(self, number: int) -> tuple[DataFrame, DataFrame]:
        """What the micro-batch before this one left."""
        if not self.store.exists(f"events/{number - 1}/_SUCCESS"):
            return self.spark.createDataFrame([], LOGGED), self.spark.createDataFrame([], _MARKS)
        return self.spark.read.schema(LOGGED).parquet(self.store.url(f"events/{number - 1}")), self.spark.read.schema(_MARKS).parquet(self.store.url(f"marks/{number - 1}"))

    def write(self, number: int, events: DataFrame, marks: DataFrame) -> None:
        marks.write.mode("overwrite").parquet(self.store.url(f"marks/{number}"))
        events.write.mode("overwrite").parquet(self.store.url(f"events/{number}"))
        for table in ("events", "marks"):
            self.store.delete(f"{table}/{number - 2}")


def advance(held: Held, number: int, batch: DataFrame, ensemble: Ensemble, sinks: Sequence[Sink], timeout: int = TIMEOUT, threshold: float = AT_RISK) -> None:
    """Takes one micro-batch: scores its events for the sinks, then leaves the open sessions for the next one."""
    past, old = held.read(number)
    fresh = batch.select(*[F.col(c) for c in (*EVENT_FIELDS, "partition", "offset")])
    both = past.withColumn("__new", F.lit(False)).unionByName(fresh.withColumn("__new", F.lit(True))).persist()
    scored = predictions(session_states(both, timeout).filter("__new"), ensemble, threshold).persist()
    try:
        for sink in sinks:
            sink(scored, number)
        marks = watermarks(old.withColumnRenamed("watermark", "ts").unionByName(both.select("partition", "ts")))
        held.write(number, sweep(both.drop("__new"), marks, timeout), marks)
    finally:
        scored.unpersist()
        both.unpersist()


def run(events: DataFrame, ensemble: Ensemble, sinks: str | Sequence[Sink], checkpoint: str, available_now: bool = True, timeout: int = TIMEOUT, threshold: float = AT_RISK, every: str = "10 seconds") -> StreamingQuery:
    """Starts the predictor on a stream of events; a path stands for a sink of JSON lines."""
    sinks = [json_sink(sinks)] if isinstance(sinks, str) else list(sinks)
    held = Held(events.sparkSession, f"{checkpoint.rstrip('/')}-sessions")
    writer = events.writeStream.foreachBatch(lambda batch, number: advance(held, number, batch, ensemble, sinks, timeout, threshold)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
