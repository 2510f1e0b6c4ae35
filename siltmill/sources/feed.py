"""A feed of events as numbered compressed chunks: written in batch, taken some events at a time, or read as a stream.

Chunks are full but for the last, and their numbers are the events' order, so a place in the feed is a number of events.
"""

from __future__ import annotations

import gzip
import json
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import with_sequence
from ..schema import EVENT_SCHEMA
from .store import Store

CHUNK = 2_000
PREFIX = "feed/"


def chunk_key(number: int, prefix: str = PREFIX) -> str:
    return f"{prefix}{number:05d}.jsonl.gz"


def write_feed(events: DataFrame, store: Store, prefix: str = PREFIX, chunk: int = CHUNK, order: Sequence[str] = ("ts", "event_id")) -> int:
    """Writes chunks of ``chunk`` events in order, null fields included; their number.

    Events are counted in order, dealt to tasks by whole chunks, and written as one file a chunk; then the files get
    their chunks' names.
    """
    numbered = with_sequence(events, order, "__place").withColumn("__chunk", F.floor(F.col("__place") / chunk))
    line = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("value")
    folder = f"{prefix.rstrip('/')}-writing"
    dealt = numbered.repartition("__chunk").sortWithinPartitions("__chunk", "__place").select(line, "__chunk")
    dealt.write.mode("overwrite").partitionBy("__chunk").option("compression", "gzip").text(store.url(folder))
    written = [s.key for s in store.list(f"{folder}/") if "/__chunk=" in s.key]
    name = lambda key: chunk_key(int(key.split("__chunk=")[1].split("/")[0]), prefix)
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda key: store.rename(key, name(key)), written))
    store.delete(folder)
    return len(written)


class Feed:
    """Takes events from a feed in order, a chunk in memory at a time; ``start_after`` events are passed over."""

    def __init__(self, store: Store, prefix: str = PREFIX, chunk: int = CHUNK, start_after: int = 0):
        self.store, self.prefix, self.chunk = store, prefix, chunk
        self.position = start_after
        self._held: tuple[int, list[dict]] = (-1, [])
        self._lock = threading.Lock()

    def _events(self, number: int) -> list[dict]:
        if self._held[0] != number:
            key = chunk_key(number, self.prefix)
            lines = gzip.decompress(self.store.get(key)).splitlines() if self.store.exists(key) else []
            self._held = number, [json.loads(x) for x in lines if x.strip()]
        return self._held[1]

    def take(self, count: int) -> list[dict]:
        """The next events, fewer at the feed's end."""
        with self._lock:
            out: list[dict] = []
            while len(out) < count:
                number, at = divmod(self.position, self.chunk)
                some = self._events(number)[at : at + count - len(out)]
                if not some:
                    break
                out += some
                self.position += len(some)
            return out

    @property
    def exhausted(self) -> bool:
        with self._lock:
            number, at = divmod(self.position, self.chunk)
            return at >= len(self._events(number))


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The feed as a stream, some chunks at a time; the checkpoint remembers how far it came."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.jsonl.gz").json(path)
