"""Stored indexes: tables partitioned by segment, made visible by a manifest.

Below the store: ``tables/{docs,postings,termdict,segments}/segment=<name>``. A segment's rows are written first
and its manifest entry after that; what no manifest names does not exist for readers. Writing a segment again
replaces it, since its name comes from its offsets.

Postings and dictionary lie in order of terms. The dictionary's files have a bloom filter on the term, those of the
postings have one or, while a dictionary page holds all their terms, that page, so a look for a term skips what cannot
hold it. The tables' columns are known (those of docs are kept beside them), so opening an index reads nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import search as s
from ..operators.index import TABLES, Index, analyzed, assign_segments, build_postings, segment_stats
from ..schema import TEXT_FIELDS
from ..sources.store import Store
from . import manifest as m

#: Columns of the tables whose columns are always the same.
COLUMNS = {
    "postings": "term string, doc_id long, tf int, length int",
    "termdict": "term string, df long",
    "segments": "num_docs long, num_terms long, num_postings long, total_length long, min_ts long, max_ts long",
}
DOCS_SCHEMA = "tables/docs.schema.json"
#: Documents of a segment that one task indexes, so that a large segment is many tasks' work and files.
RUN = 1_000
#: Rows up to which tables of names are broadcast, requests to a store at a time, and bytes of a merged segment for each task.
SMALL, REQUESTS, MERGED_BYTES = 50_000, 16, 8 << 20
#: Bytes of small segments that are merged by one set of jobs, and published together.
ROUND_BYTES = 2 << 30
#: Files of a row that a task writes, and segments above which files' sizes are listed by tasks.
FILES, LISTED = 32, 256
DOCS_PER_SEGMENT = 5_000
GRACE = 3_600.0
#: Seconds after which a coordinator reads its manifest again.
STALE = 30.0


def name_of(key: str) -> str:
    """A segment's folder name."""
    return key.removeprefix("segments/").removesuffix(".seg").replace("/", "~")


def table_path(store: Store, table: str) -> str:
    return store.url(f"tables/{table}")


def write_segments(store: Store, placed: DataFrame, fields: Sequence[str], names: Sequence[str]) -> None:
    """Writes documents (with segment names and doc_id) as whole segments.

    Runs of documents are dealt to tasks and tokenised there, once: the tokens are kept while documents and postings
    are written from them. A run holds its documents whole, so counting needs no shuffle. The dictionary and the
    statistics are read from what was written.
    """
    dealt = placed.withColumn("__run", F.floor(F.col("doc_id") / RUN)).repartition("segment", "__run")
    docs = analyzed(dealt, fields).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stored = docs.drop("tokens", "__run")
        _keep_schema(store, stored.schema)
        _write(store, "docs", stored.sortWithinPartitions("segment", "doc_id"))
        counted = docs.select("segment", "__run", "doc_id", "length", F.explode("tokens").alias("term"))
        tf = counted.groupBy("segment", "__run", "doc_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        _write(store, "postings", tf.select("segment", "term", "doc_id", "tf", "length").sortWithinPartitions("segment", "term", "doc_id"))
    finally:
        docs.unpersist()
    termdict = read_table(store, "postings", names).groupBy("segment", "term").agg(F.count("*").alias("df"))
    _write(store, "termdict", termdict.repartition("segment").sortWithinPartitions("segment", "term"))
    _write_stats(store, segment_stats(read_table(store, "docs", names), read_table(store, "termdict", names)), len(names))


def _write_stats(store: Store, stats: DataFrame, segments: int) -> None:
    """Writes a row for each segment: a file each, so many are dealt to tasks by their number, not their bytes."""
    tasks = min(-(-segments // FILES), int(store.spark.conf.get("spark.sql.shuffle.partitions")))
    _write(store, "segments", stats.repartition(tasks, "segment") if tasks > 1 else stats.coalesce(1))


def _options(table: str) -> dict[str, str]:
    out = {"compression": "zstd"}
    if table in ("postings", "termdict"):
        out |= {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    if table == "termdict":  # every term once: a dictionary page would hold them all a second time
        out["parquet.enable.dictionary#term"] = "false"
    return out


def _write(store: Store, table: str, df: DataFrame) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**_options(table)).partitionBy("segment").parquet(table_path(store, table))


def _keep_schema(store: Store, schema: StructType) -> None:
    """Adds the columns of documents to those that the store has had so far."""
    known = StructType.fromJson(json.loads(store.get(DOCS_SCHEMA))) if store.exists(DOCS_SCHEMA) else StructType()
    new = [StructField(f.name, f.dataType) for f in schema if f.name not in known.names and f.name != "segment"]
    if new:
        store.put(DOCS_SCHEMA, StructType([*known.fields, *new]).json().encode())


def segment_bytes(store: Store, names: Sequence[str]) -> dict[str, int]:
    if len(names) > LISTED:
        # Only paths and lengths are asked for, so no content is read.
        found = [store.spark.read.format("binaryFile").load([f"{table_path(store, t)}/segment={n}" for n in names]).select("path", "length") for t in TABLES]
        sizes = reduce(DataFrame.unionByName, found).groupBy(F.regexp_extract("path", "/segment=([^/]*)/[^/]*$", 1).alias("name")).agg(F.sum("length").alias("bytes"))
        return dict.fromkeys(names, 0) | {r["name"]: r["bytes"] for r in sizes.collect()}  # a row for each segment
    size = lambda name: sum(f.size for t in TABLES for f in store.list(f"tables/{t}/segment={name}/"))
    with ThreadPoolExecutor(REQUESTS) as pool:
        return dict(zip(names, pool.map(size, names), strict=True))


def read_table(store: Store, table: str, names: Sequence[str]) -> DataFrame:
    """The rows of some segments; only their folders are opened."""
    if table in COLUMNS:
        schema = StructType.fromDDL(COLUMNS[table])
    else:
        schema = StructType.fromJson(json.loads(store.get(DOCS_SCHEMA)))
    # The name comes last, as partition columns do.
    schema = StructType([*schema.fields, StructField("segment", StringType())])
    return store.spark.read.schema(schema).option("basePath", table_path(store, table)).parquet(*[f"{table_path(store, table)}/segment={n}" for n in names])


def open_index(store: Store, live: m.Manifest, start: int | None = None, end: int | None = None) -> Index | None:
    """The live segments that a time window can touch, pruned before anything is read; None if there are none."""
    names = [name_of(x.key) for x in live.segments if x.overlaps(start, end)]
    if not names:
        return None
    index = Index(*(read_table(store, t, names) for t in TABLES))
    if len(names) > s.PLANNED:
        return index
    return replace(index, stats={r["segment"]: r.asDict() for r in index.segments.collect()})


def section_sizes(store: Store) -> dict[str, int]:
    return {t: sum(f.size for f in store.list(f"tables/{t}/")) for t in TABLES}


def ingest(store: Store, docs: DataFrame, docs_per_segment: int = DOCS_PER_SEGMENT, fields: Sequence[str] = TEXT_FIELDS, position: str | None = None, order: Sequence[str] = ("event_id",), manifest_key: str = m.KEY) -> m.Manifest:
    """Indexes a table in segments of a fixed size and publishes them all at once."""
    placed = assign_segments(docs, docs_per_segment, position, order)
    last = placed.groupBy("segment").agg(F.max("doc_id").alias("last")).orderBy("segment").collect()  # a row for each segment
    keys = {r["segment"]: m.batch_key(r["segment"] * docs_per_segment, r["segment"] * docs_per_segment + r["last"]) for r in last}
    table = placed.sparkSession.createDataFrame([(k, name_of(v)) for k, v in keys.items()], "segment long, __name string")
    named = placed.join(_if_small(table, len(keys)), "segment").drop("segment").withColumnRenamed("__name", "segment")
    if keys:
        write_segments(store, named, fields, [name_of(k) for k in keys.values()])
    live = m.read(store, manifest_key).replaced(_entries(store, {k: (s * docs_per_segment, None) for s, k in keys.items()}))
    m.write(store, live, manifest_key)
    return live


def _if_small(table: DataFrame, rows: int) -> DataFrame:
    """A table of names for a join, broadcast if it has few rows."""
    return F.broadcast(table) if rows <= SMALL else table


def _entries(store: Store, keys: dict[str, tuple[int, int | None]]) -> list[m.Segment]:
    """Manifest entries of segments just written, from their own statistics."""
    if not keys:
        return []
    names = {name_of(k): k for k in keys}
    sizes = segment_bytes(store, list(names))
    rows = {r["segment"]: r for r in read_table(store, "segments", list(names)).collect()}
    out = []
    for name, key in names.items():
        r, (first, last) = rows[name], keys[key]
        out.append(m.Segment(key, r["num_docs"], sizes[name], r["min_ts"], r["max_ts"], first, first + r["num_docs"] - 1 if last is None else last))
    return out


def publish_batch(store: Store, docs: DataFrame, max_docs: int, fields: Sequence[str] = TEXT_FIELDS) -> list[m.Segment]:
    """Indexes rows that have ``partition`` and ``offset``, a manifest for each partition.

    Segments are sealed every ``max_docs`` rows of a partition, in offset order, so a replay of the same offsets
    writes the same segments. Segments first, then each partition's manifest; the caller commits offsets after.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("partition").orderBy("offset")) - 1
    cut = docs.withColumn("__n", place).withColumn("__cut", F.floor(F.col("__n") / max_docs))
    spans = cut.groupBy("partition", "__cut").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).collect()  # a row for each segment
    if not spans:
        return []
    keys = {(r["partition"], r["__cut"]): m.stream_key(r["partition"], r["lo"], r["hi"]) for r in spans}
    table = docs.sparkSession.createDataFrame([(*k, name_of(v)) for k, v in keys.items()], "partition int, __cut long, __name string")
    placed = cut.withColumn("partition", F.col("partition").cast("int")).join(_if_small(table, len(keys)), ["partition", "__cut"])
    placed = placed.drop(*{"segment", "doc_id"} & set(placed.columns)).withColumn("doc_id", F.pmod("__n", F.lit(max_docs)).cast("long")).withColumnRenamed("__name", "segment").drop("__n", "__cut", "partition", "offset")
    write_segments(store, placed, fields, [name_of(k) for k in keys.values()])
    entries = {e.key: e for e in _entries(store, {keys[r["partition"], r["__cut"]]: (r["lo"], r["hi"]) for r in spans})}
    for partition in sorted({r["partition"] for r in spans}):
        at = m.partition_key(partition)
        live = m.read(store, at)
        for (p, _), key in sorted(keys.items()):
            if p == partition:
                live = live.publish(entries[key])
        m.write(store, live, at)
    return list(entries.values())


@dataclass
class Compaction:
    merged: list[m.Segment] = field(default_factory=list)
    retired: list[m.Segment] = field(default_factory=list)

    @property
    def documents(self) -> int:
        return sum(x.docs for x in self.merged)


def merge_group(store: Store, group: list[m.Segment], manifest_key: str = m.KEY) -> m.Segment:
    """Merges neighbours into one segment and publishes it; the sources stay stored."""
    merged = _merge(store, group)
    _publish_merged(store, [group], [merged], manifest_key)
    return merged


def _merge(store: Store, group: list[m.Segment]) -> m.Segment:
    """Writes one segment with the documents of several neighbours.

    Documents keep their order: each source's doc_ids move up by the documents before it. Nothing is tokenised
    again; the dictionary is the sum of the sources', and so are the statistics.
    """
    spark, key = store.spark, m.merged_key(group)
    base, total = F.lit(None).cast("long"), 0
    names = [name_of(x.key) for x in group]
    for name, x in zip(names, group, strict=True):  # at most the merge factor's number
        base = F.when(F.col("segment") == name, F.lit(total).cast("long")).otherwise(base)
        total += x.docs
    target = name_of(key)
    parts = min(_parts(group), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(table: str, df: DataFrame, order: Sequence[str]) -> None:
        out = df.drop("segment")
        if order:
            out = (out.repartitionByRange(parts, *order) if parts > 1 else out.coalesce(1)).sortWithinPartitions(*order)
        out.write.mode("overwrite").options(**_options(table)).parquet(f"{table_path(store, table)}/segment={target}")

    moved = lambda table: read_table(store, table, names).withColumn("doc_id", F.col("doc_id") + base)
    termdict = read_table(store, "termdict", names).groupBy("term").agg(F.sum("df").alias("df"))
    sums = read_table(store, "segments", names).agg(*[F.sum(c).alias(c) for c in ("num_docs", "num_postings", "total_length")], F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(write, "docs", moved("docs"), ["doc_id"]), pool.submit(write, "postings", moved("postings"), ["term", "doc_id"]), pool.submit(write, "termdict", termdict, ["term"])]
        for d in done:
            d.result()
    counted = read_table(store, "termdict", [target]).agg(F.count("*").alias("num_terms"))  # one row
    write("segments", sums.join(F.broadcast(counted)).select(*StructType.fromDDL(COLUMNS["segments"]).names), [])
    merged = _entries(store, {key: (group[0].first_offset, group[-1].last_offset)})[0]
    return replace(merged, first_offset=group[0].first_offset, last_offset=group[-1].last_offset)


def _merge_all(store: Store, groups: list[list[m.Segment]]) -> list[m.Segment]:
    """As _merge, for any number of groups whose merged segments are one task's work each: a job for each table, not
    for each group."""
    targets = [name_of(m.merged_key(g)) for g in groups]
    moves = []
    for target, group in zip(targets, groups, strict=True):
        total = 0
        for x in group:
            moves.append((name_of(x.key), target, total))
            total += x.docs
    names = [name for name, _, _ in moves]
    table = _if_small(store.spark.createDataFrame(moves, "segment string, __target string, __base long"), len(moves))

    def moved(name: str) -> DataFrame:
        rows = read_table(store, name, names).join(table, "segment").drop("segment").withColumnRenamed("__target", "segment")
        if "doc_id" in rows.columns:
            rows = rows.withColumn("doc_id", F.col("doc_id") + F.col("__base"))
        return rows.drop("__base")

    def write(name: str, rows: DataFrame, *order: str) -> None:
        _write(store, name, rows.sortWithinPartitions("segment", *order))

    dealt = lambda name: moved(name).repartition("segment")
    termdict = dealt("termdict").groupBy("segment", "term").agg(F.sum("df").alias("df"))
    sums = moved("segments").groupBy("segment").agg(*[F.sum(c).alias(c) for c in ("num_docs", "num_postings", "total_length")], F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(write, "docs", dealt("docs"), "doc_id"), pool.submit(write, "postings", dealt("postings"), "term", "doc_id"), pool.submit(write, "termdict", termdict, "term")]
        for d in done:
            d.result()
    counted = read_table(store, "termdict", targets).groupBy("segment").agg(F.count("*").alias("num_terms"))
    # A segment whose documents have no terms has no rows in the dictionary.
    stats = sums.join(counted, "segment", "left").fillna({"num_terms": 0})
    _write_stats(store, stats.select(*StructType.fromDDL(COLUMNS["segments"]).names, "segment"), len(targets))
    offsets = {m.merged_key(g): (g[0].first_offset, g[-1].last_offset) for g in groups}
    return [replace(x, first_offset=offsets[x.key][0], last_offset=offsets[x.key][1]) for x in _entries(store, offsets)]


def _publish_merged(store: Store, groups: list[list[m.Segment]], merged: list[m.Segment], manifest_key: str) -> None:
    """The manifest is read again, so that what was published meanwhile stays."""
    gone = {x.key for g in groups for x in g} | {x.key for x in merged}
    live = m.read(store, manifest_key)
    m.write(store, live.replaced([*(x for x in live.segments if x.key not in gone), *merged]), manifest_key)


def _parts(group: list[m.Segment]) -> int:
    """Tasks among which a merged segment is worth dividing."""
    return max(1, sum(x.bytes for x in group) // MERGED_BYTES)


def _rounds(groups: list[list[m.Segment]]) -> list[list[list[m.Segment]]]:
    """Small groups together, up to ROUND_BYTES and SMALL segments; each large one alone."""
    rounds: list[list[list[m.Segment]]] = []
    room_bytes = room_names = 0
    for group in sorted(groups, key=lambda g: _parts(g) > 1):
        size = sum(x.bytes for x in group)
        if _parts(group) > 1 or size > room_bytes or len(group) > room_names:
            rounds.append([])
            room_bytes, room_names = ROUND_BYTES, SMALL
        rounds[-1].append(group)
        room_bytes, room_names = room_bytes - size, room_names - len(group)
    return rounds


def compact(store: Store, manifest_key: str = m.KEY, merge_factor: int = m.FACTOR, max_bytes: int = m.MAX_BYTES, on_merge=None, at_once: int = 4) -> Compaction:
    """Merges what the plan says, in rounds, some at a time; each round is published as it is done.

    Small groups share a round's jobs, so their number costs no jobs; a large one is a round of its own.
    """
    out = Compaction()
    rounds = _rounds(m.plan_compaction(m.read(store, manifest_key).segments, merge_factor, max_bytes))
    merge = lambda groups: _merge_all(store, groups) if len(groups) > 1 else [_merge(store, groups[0])]
    with ThreadPoolExecutor(at_once) as pool:
        for groups, merged in zip(rounds, pool.map(merge, rounds), strict=True):
            _publish_merged(store, groups, merged, manifest_key)
            for group, one in zip(groups, merged, strict=True):
                out.merged.append(one)
                out.retired += group
                if on_merge:
                    on_merge(group, one)
    return out


@dataclass
class Collected:
    scanned: int = 0
    protected: int = 0
    deleted: list[str] = field(default_factory=list)
    spared: list[str] = field(default_factory=list)


def manifest_keys(store: Store) -> list[str]:
    return sorted(f.key for f in store.list() if f.key.endswith(("current.json", "manifest.json")))


def collect(store: Store, grace: float = GRACE, delete: bool = False, now: float | None = None) -> Collected:
    """Segments that no manifest names, deleted (if asked to) once they are older than the grace.

    Every manifest counts, and manifests themselves are never deleted.
    """
    if grace < 0:
        raise ValueError(f"the grace must not be negative, not {grace}")
    now = time.time() if now is None else now
    live = {name_of(x.key) for k in manifest_keys(store) for x in m.read(store, k).segments}
    newest: dict[str, float] = {}
    for f in store.list("tables/"):
        if "/segment=" in f.key:
            name = f.key.split("/segment=")[1].split("/")[0]
            newest[name] = max(newest.get(name, 0.0), f.modified)
    out = Collected(scanned=len(newest))
    for name, modified in sorted(newest.items()):
        if name in live:
            out.protected += 1
        elif now - modified < grace:
            out.spared.append(name)
        else:
            out.deleted.append(name)
            if delete:
                for table in TABLES:
                    store.delete(f"tables/{table}/segment={name}")
    return out


class Coordinator:
    """Answers queries over what is live: one manifest, or the union of all partitions' manifests."""

    def __init__(self, store: Store, partitioned: bool = False, manifest_key: str = m.KEY, stale: float = STALE, warm: bool = False):
        """``warm`` keeps the open index's dictionary in the executors' memory and disks, for many queries on it."""
        self.store, self.partitioned, self.manifest_key, self.stale, self.warm = store, partitioned, manifest_key, stale, warm
        self.live, self._read_at = m.Manifest(), 0.0
        self._open: tuple[m.Manifest, Index | None] | None = None
        self.refresh()

    def refresh(self) -> m.Manifest:
        keys = m.partition_keys(self.store) if self.partitioned else [self.manifest_key]
        self.live, self._read_at = m.union(m.read(self.store, k) for k in keys), time.monotonic()
        return self.live

    def maybe_refresh(self) -> None:
        """Reads the manifest again if it is stale; if that fails, the old one still answers."""
        if time.monotonic() - self._read_at > self.stale:
            try:
                self.refresh()
            except Exception:  # noqa: BLE001
                self._read_at = time.monotonic()

    def index(self, options: s.Options = s.Options()) -> Index | None:
        """The index that a query needs: of what is open the segments in its window, else only those are opened."""
        held = self._open
        whole = options.start is None and options.end is None
        if whole and (held is None or held[0] is not self.live):
            index = open_index(self.store, self.live)
            if self.warm:
                if held is not None and held[1] is not None:
                    held[1].termdict.unpersist()
                if index is not None:
                    index = replace(index, termdict=index.termdict.persist(StorageLevel.MEMORY_AND_DISK))
            held = self._open = (self.live, index)
        if held is None or held[0] is not self.live:
            return open_index(self.store, self.live, options.start, options.end)
        if whole or held[1] is None:
            return held[1]
        names = [name_of(x.key) for x in self.live.segments if x.overlaps(options.start, options.end)]
        return held[1].only(names) if names else None

    def search(self, query: str, options: s.Options = s.Options(), fields: Sequence[str] = ()) -> DataFrame | None:
        index = self.index(options)
        if index is None:
            return None
        hits = s.search(index, query, options)
        return s.fetch(index, hits, fields) if fields else hits

    def total(self, query: str, options: s.Options = s.Options()) -> int:
        index = self.index(options)
        return s.total_hits(index, query, options).first()[0] if index else 0

    def cost(self, query: str, options: s.Options = s.Options()) -> dict:
        """What a query reads: segments in all, pruned by time and searched, postings, and the steps one after the other
        (dictionary, postings, documents) with the files that they open and those files' bytes, an upper bound."""
        index = self.index()
        if index is None:
            return {"segments_total": 0, "segments_pruned": 0, "segments_searched": 0, "postings_read": 0, "steps": 0, "files": 0, "bytes": 0}
        out = s.cost(index, query, options).first().asDict()
        live = [name_of(x.key) for x in self.live.segments if x.overlaps(options.start, options.end)]
        terms = sorted(set(s.query_terms(query)))
        hit = s.planned_weights(index, terms, options)[1] if terms and index.stats is not None else live * bool(terms)
        read = [("termdict", n) for n in live if terms] + [(t, n) for n in hit for t in ("postings", "docs")]
        with ThreadPoolExecutor(REQUESTS) as pool:
            files = [f for found in pool.map(lambda x: self.store.list(f"tables/{x[0]}/segment={x[1]}/"), read) for f in found if f.key.endswith(".parquet")]
        return out | {"steps": bool(terms) * (3 if hit else 1), "files": len(files), "bytes": sum(f.size for f in files)}


def live_ingest(store: Store, spark: SparkSession, events: list[dict], partition: int = 900, max_docs: int = 200) -> list[m.Segment]:
    """Events posted by hand: at most 200, numbered on from what the partition has, searchable on return."""
    from pyspark.sql.types import LongType, StructField, StructType

    from ..schema import EVENT_FIELDS, EVENT_SCHEMA

    if len(events) > 200:
        raise ValueError("at most 200 events at a time")
    start = m.read(store, m.partition_key(partition)).next_offset
    row = lambda e: tuple(float(e[f]) if f == "price" and e.get(f) is not None else e.get(f) for f in EVENT_FIELDS)
    schema = StructType([*(StructField(f.name, f.dataType) for f in EVENT_SCHEMA), StructField("offset", LongType())])
    rows = spark.createDataFrame([(*row(e), start + i) for i, e in enumerate(events)], schema)
    return publish_batch(store, rows.withColumn("partition", F.lit(partition)), max_docs)
