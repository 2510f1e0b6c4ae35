"""Indexing a log: every micro-batch becomes segments and a manifest before its offsets are committed.

Order is what makes replays safe. ``foreachBatch`` writes segments, then manifests; Spark commits the offsets
only when it returns. A crash before the manifest leaves rows that nobody sees and a replay overwrites; a crash
after it leaves rows that a replay writes alike. A replay that reaches further evicts what it overlaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.lifecycle import publish_batch
from ..schema import EVENT_SCHEMA, TEXT_FIELDS
from ..sources.store import Store

MAX_DOCS = 10_000
# Settings of the log's readers and writers.
SOURCE = {"startingOffsets": "earliest", "failOnDataLoss": "true"}
SINK = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4"}


def kafka_source(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """(key, value, partition, offset) of a topic; the checkpoint takes the place of a consumer group."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**SOURCE)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")


def to_records(events: DataFrame) -> DataFrame:
    """Events as log records: the session is the key, so a session stays in one partition."""
    return events.select(F.col("session_id").alias("key"), F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value"))


def produce(events: DataFrame, servers: str, topic: str) -> None:
    """Writes events to a topic; the write fails if any delivery does."""
    to_records(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**SINK).save()


def parse(records: DataFrame) -> DataFrame:
    """Records as events with their partition and offset; missing fields are null, others are dropped."""
    return records.select(F.from_json("value", EVENT_SCHEMA).alias("e"), "partition", "offset").select("e.*", "partition", "offset")


def run(records: DataFrame, store: Store, checkpoint: str, max_docs: int = MAX_DOCS, fields: Sequence[str] = TEXT_FIELDS, available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Starts the indexer on a stream of records."""

    def flush(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            publish_batch(store, parse(held), max_docs, fields)
        finally:
            held.unpersist()

    writer = records.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def drain(query: StreamingQuery, seconds: float = 60.0) -> bool:
    """Stops a running query once it has caught up, or after so many seconds; whether it had caught up.

    What it had not committed then is taken again by the next run, from the same offsets.
    """
    import time

    until = time.monotonic() + seconds
    idle = 0
    while query.isActive and time.monotonic() < until and idle < 3:
        status = query.status
        idle = 0 if status["isDataAvailable"] or status["isTriggerActive"] or query.lastProgress is None else idle + 1
        time.sleep(0.1)
    query.stop()
    return idle >= 3
