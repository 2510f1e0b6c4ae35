"""Queries over what the engine stores, streams and serves, and the same in SQL for DuckDB over the plain tables.

Each writes what it needs to scratch storage first: clickstream files, indexes with manifests, logs, feeds. An index
that several queries only read is made once for a session.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators import model, search, sessions
from ..operators.search import Options
from ..schema import EVENT_SCHEMA, conform, validated
from ..scratch import scratch_path
from ..sources import clickstream, feed, tables
from ..sources.store import Store
from . import catalogue, lifecycle, manifest
from .catalogue import _CORPUS, _EVENTS, _EXAMPLES, _FEATURES, _FROM, _STATE, _TREES, _matches, query

SIZE = tables.DOCS_PER_SEGMENT


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark))


_MADE: dict[tuple, object] = {}


def _once(make):
    """What several queries only read is made once for a session and its tables."""

    def made(spark: SparkSession, sf_dir: str):
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _MADE:
            _MADE[key] = make(spark, sf_dir)
        return _MADE[key]

    return made


# ---- A clickstream file, made from events: some rows that must be skipped, some fields blank


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_id"), "p_type", "p_brand")
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    kind = F.when(F.col("event_type") == "signup", "cart").when(F.col("event_type") == "error", "remove_from_cart").otherwise(F.col("event_type"))
    rows = e.withColumn("product_id", F.regexp_extract("props", "([0-9]+)", 1)).join(part, "product_id", "left")
    return rows.select(
        F.col("user_id").cast("string").alias("user_id"), F.when(n % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("price"),
        F.when(n % 97 == 0, "soon").otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")).alias("event_time"), kind.alias("event_type"), "product_id",
        F.lit("7").alias("category_id"), F.col("p_type").alias("category_code"), F.when(n % 5 != 0, F.col("p_brand")).alias("brand"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.weekofyear(ts).cast("string")).alias("user_session"), "event_id",
    )


@_once
def _file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark)
    _raw(spark, sf_dir).orderBy("event_id").drop("event_id").write.option("header", True).option("compression", "gzip").csv(path)
    return path


_CSV = """raw AS (SELECT e.event_id AS n, CASE WHEN e.event_id % 97 <> 0 THEN CAST(floor(epoch_us(e.ts) / 1000000) AS BIGINT) END AS ts, CAST(e.user_id AS VARCHAR) || '-' || CAST(weekofyear(e.ts) AS VARCHAR) AS session_id,
CAST(e.user_id AS VARCHAR) AS user_id, CASE e.event_type WHEN 'view' THEN 'view' WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart' WHEN 'purchase' THEN 'purchase' END AS event_type, e.event_type AS kind,
nullif(regexp_extract(e.props, '([0-9]+)', 1), '') AS product_id, p.p_type AS category, CASE WHEN e.event_id % 5 <> 0 THEN p.p_brand END AS brand, CASE WHEN e.event_id % 11 <> 0 THEN e.value END AS price
FROM events e LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = regexp_extract(e.props, '([0-9]+)', 1)),
good AS (SELECT *, row_number() OVER (ORDER BY n) AS place FROM raw WHERE event_type IS NOT NULL AND ts IS NOT NULL)"""
_CSV_COLUMNS = ("event_id", "ts", "session_id", "user_id", "event_type", "product_id", "title", "category", "brand", "price")
_CSV_ROWS = "SELECT printf('r_%09d', place) AS event_id, ts, session_id, user_id, event_type, product_id, CAST(NULL AS VARCHAR) AS title, category, brand, price FROM good"


@query(f"WITH {_CSV} {_CSV_ROWS}")
def csv_events(spark, sf_dir):
    """Scan of compressed files, header by name, types mapped, times and prices parsed, blanks null, titles switched off."""
    return clickstream.load_events(spark, _file(spark, sf_dir), titles=False).select(*_CSV_COLUMNS)


@query(f"WITH {_CSV} {_CSV_ROWS} WHERE place <= 1000")
def csv_first_events(spark, sf_dir):
    """The limit counts events, not rows."""
    return clickstream.load_events(spark, _file(spark, sf_dir), limit=1000, titles=False).select(*_CSV_COLUMNS)


@query(f"WITH {_CSV} SELECT CASE WHEN event_type IS NULL THEN 'unknown event_type ''' || kind || '''' ELSE 'unparseable event_time' END AS reason, count(*) AS count FROM raw WHERE event_type IS NULL OR ts IS NULL GROUP BY 1")
def csv_skip_reasons(spark, sf_dir):
    return clickstream.skip_reasons(clickstream.clean(clickstream.read_raw(spark, _file(spark, sf_dir)), False))


@query(f"""WITH {_CSV} SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM raw) - count(*) AS rows_skipped, count(*) AS events, count(*) FILTER (brand IS NULL) AS missing_brand,
count(*) FILTER (category IS NULL) AS missing_category, count(*) AS missing_title, min(ts) AS first_ts, max(ts) AS last_ts FROM good""")
def csv_load_stats(spark, sf_dir):
    return clickstream.load_stats(clickstream.clean(clickstream.read_raw(spark, _file(spark, sf_dir)), False))


@query("SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) END AS seconds FROM events")
def parsed_times(spark, sf_dir):
    return _raw(spark, sf_dir).select("event_id", clickstream.epoch(F.col("event_time")).alias("seconds"))


@query(f"WITH {_CSV} {_CSV_ROWS}")
def jsonl_round_trip(spark, sf_dir):
    """Events as JSON lines, null fields included, read back."""
    path = scratch_path(spark)
    clickstream.write_jsonl(clickstream.load_events(spark, _file(spark, sf_dir), titles=False), path)
    return spark.read.schema(EVENT_SCHEMA).json(path).select(*_CSV_COLUMNS)


@query(f"WITH {_EVENTS}, s AS (SELECT session_id FROM ev GROUP BY 1 ORDER BY min(event_id) LIMIT 20) SELECT event_id, session_id FROM ev SEMI JOIN s USING (session_id)")
def slice_file(spark, sf_dir):
    """A slice of whole sessions written as CSV with a header and read back."""
    path = scratch_path(spark)
    rows = tables.clickstream(spark, sf_dir).withColumns({"seq": F.col("event_id"), clickstream.CORRUPT: F.lit(None).cast("string")})
    clickstream.write_slice(clickstream.slice_sessions(rows, 20, 10**9, "session_id"), path)
    return spark.read.option("header", True).csv(path).select("event_id", "session_id")


@query(f"WITH {_EVENTS} SELECT event_type, count(*) AS n, count(price) AS prices FROM ev GROUP BY 1")
def validated_events(spark, sf_dir):
    """Every event passes the schema's checks; columns it does not have become null, others go."""
    rows = tables.clickstream(spark, sf_dir).drop("device").withColumn("extra", F.lit(1))
    return validated(spark.createDataFrame([], EVENT_SCHEMA).unionByName(conform(rows)).to(_nullable())).groupBy("event_type").agg(F.count("*").alias("n"), F.count("price").alias("prices"))


def _nullable():
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType) for f in EVENT_SCHEMA])


# ---- Feeds and stores


@query(f"WITH {_EVENTS}, o AS (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 2000 AS chunk FROM ev) SELECT CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM o GROUP BY 1")
def feed_chunks(spark, sf_dir):
    store = _store(spark)
    feed.write_feed(tables.clickstream(spark, sf_dir), store)
    rows = spark.read.schema(EVENT_SCHEMA).json(store.url("feed")).withColumn("chunk", F.regexp_extract("_metadata.file_name", "([0-9]+)", 1).cast("int"))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


@query(f"WITH {_EVENTS}, o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM ev) SELECT event_id, place FROM o WHERE place >= 150 AND place < 400")
def feed_cursor(spark, sf_dir):
    """Events taken from a place in the feed on, over chunks' ends."""
    store = _store(spark)
    feed.write_feed(tables.clickstream(spark, sf_dir), store, chunk=100)
    cursor = feed.Feed(store, chunk=100, start_after=150)
    taken = cursor.take(30) + cursor.take(220)
    return spark.createDataFrame([(e["event_id"], 150 + i) for i, e in enumerate(taken)], "event_id string, place long")


@query("SELECT 'parts/' || CAST(p_partkey AS VARCHAR) AS key, strlen(p_name) AS size, p_name[2:4] AS middle FROM part WHERE p_partkey < 20 AND p_partkey % 4 <> 0")
def store_objects(spark, sf_dir):
    """Objects put, replaced, deleted, listed, and read in part."""
    store = _store(spark)
    for r in tables.table(spark, sf_dir, "part").filter("p_partkey < 20").collect():
        store.put(f"parts/{r['p_partkey']}", b"old")
        store.put(f"parts/{r['p_partkey']}", r["p_name"].encode())
        if r["p_partkey"] % 4 == 0:
            store.delete(f"parts/{r['p_partkey']}")
    rows = [(s.key, s.size, store.get_range(s.key, 1, 3).decode()) for s in store.list("parts/")]
    return spark.createDataFrame(rows, "key string, size long, middle string")


# ---- A stored index


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), "text", "lang", "source").withColumn("ts", F.col("position") + _FROM)


@_once
def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    store = _store(spark)
    lifecycle.ingest(store, _documents(spark, sf_dir), SIZE, ["text"], position="position")
    return store


_NAME = f"printf('%012d-%012d', {{0}} * {SIZE}, {{0}} * {SIZE} + n - 1)"
_OWN = f"""ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, * FROM found)
SELECT rank, printf('%012d-%012d', s.segment * {SIZE}, s.segment * {SIZE} + s.n - 1) AS segment, doc_id, score FROM ranked JOIN segments s USING (segment)"""


def _stored_page(text: str, o: Options) -> str:
    return _matches(_CORPUS, sorted(set(query_terms(text))), o) + f", {_OWN} WHERE rank > {o.offset} AND rank <= {o.offset + o.top_k}"


def _stored_search(name: str, text: str, o: Options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(lifecycle.Coordinator(_ingested(spark, sf_dir)).index(o), text, o, digits=6)

    run.__name__ = name
    query(_stored_page(text, o))(run)


for _name, _text, _options in (
    ("stored_and", "tion er", Options()),
    ("stored_or", "tion er", Options("or")),
    ("stored_and_global", "tion er", Options(global_stats=True)),
    ("stored_or_global_page2", "er on re", Options("or", global_stats=True, offset=10)),
    ("stored_rare", "worthless", Options(global_stats=True)),
    ("stored_absent_and", "tion absentterm", Options(global_stats=True)),
    ("stored_absent_or", "tion absentterm", Options("or", global_stats=True)),
    ("stored_pruned", "tion er", Options("or", global_stats=True, start=_FROM + 120, end=_FROM + 340)),
):
    _stored_search(_name, _text, _options)


@query(_stored_page("tion er", Options("or", global_stats=True, start=_FROM + 120, end=_FROM + 340)))
def stored_pruned_when_open(spark, sf_dir):
    """The same window on an index that is open as a whole."""
    c, o = lifecycle.Coordinator(_ingested(spark, sf_dir)), Options("or", global_stats=True, start=_FROM + 120, end=_FROM + 340)
    c.index()
    return search.search(c.index(o), "tion er", o, digits=6)


@query(_matches(_CORPUS, ["er", "tion"], Options("or", global_stats=True)) + f", ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, * FROM found) SELECT r.rank, r.doc_id, d.lang, d.source, length(d.text) AS n FROM ranked r JOIN documents d ON d.doc_id = r.segment * {SIZE} + r.doc_id WHERE r.rank <= 10")
def stored_fetch(spark, sf_dir):
    index, o = lifecycle.Coordinator(_ingested(spark, sf_dir)).index(), Options("or", global_stats=True)
    return search.fetch(index, search.search(index, "tion er", o, digits=6), ["lang", "source", "text"]).select("rank", "doc_id", "lang", "source", F.char_length("text").cast("long").alias("n"))


@query(_matches(_CORPUS, ["er", "tion"], Options()) + " SELECT count(*) AS total FROM found")
def stored_total(spark, sf_dir):
    return spark.createDataFrame([(lifecycle.Coordinator(_ingested(spark, sf_dir)).total("tion er"),)], "total long")


@query(f"WITH {_CORPUS} SELECT {_NAME.format('segment')} AS segment, term, doc_id, CAST(tf AS INTEGER) AS tf, CAST(length AS INTEGER) AS length FROM postings JOIN lens USING (segment, doc_id) JOIN segments USING (segment)")
def stored_postings(spark, sf_dir):
    return lifecycle.Coordinator(_ingested(spark, sf_dir)).index().postings.select("segment", "term", "doc_id", "tf", "length")


@query(f"""WITH {_CORPUS} SELECT {_NAME.format('segment')} AS segment, s.n AS num_docs, t.nt AS num_terms, CAST(t.np AS BIGINT) AS num_postings, CAST(s.total AS BIGINT) AS total_length, s.min_ts, s.max_ts
FROM segments s JOIN (SELECT segment, count(*) AS nt, sum(df) AS np FROM termdict GROUP BY segment) t USING (segment)""")
def stored_segments(spark, sf_dir):
    return lifecycle.Coordinator(_ingested(spark, sf_dir)).index().segments.select("segment", "num_docs", "num_terms", "num_postings", "total_length", "min_ts", "max_ts")


@query(f"WITH {_CORPUS}, p AS (SELECT segment, term, row_number() OVER (PARTITION BY segment ORDER BY term) - 1 AS place FROM termdict) SELECT {_NAME.format('segment')} AS segment, term, place FROM p JOIN segments USING (segment)")
def stored_dictionary_order(spark, sf_dir):
    """A segment's dictionary lies in order of terms: each term's place in its file."""
    index = lifecycle.Coordinator(_ingested(spark, sf_dir)).index()
    # Files of a segment are one here; a row's index in its file is its place.
    return index.termdict.select("segment", "term", F.col("_metadata.row_index").alias("place"))


_FILES = ("key", "docs", "min_ts", "max_ts", "first_offset", "last_offset")


def _listed(spark: SparkSession, live: manifest.Manifest) -> DataFrame:
    rows = [tuple(getattr(s, f) for f in _FILES) for s in live.segments]
    return spark.createDataFrame(rows, "key string, docs long, min_ts long, max_ts long, first_offset long, last_offset long")


@query(f"WITH {_CORPUS} SELECT 'segments/' || {_NAME.format('segment')} || '.seg' AS key, n AS docs, min_ts, max_ts, segment * {SIZE} AS first_offset, segment * {SIZE} + n - 1 AS last_offset FROM segments")
def stored_manifest(spark, sf_dir):
    return _listed(spark, manifest.read(_ingested(spark, sf_dir)))


_MERGED = f"""{_CORPUS}, runs AS (SELECT *, segment // 2 AS grp, count(*) OVER (PARTITION BY segment // 2) AS members FROM segments),
after AS (SELECT grp, members, min(segment) AS a, sum(n) AS n, min(min_ts) AS min_ts, max(max_ts) AS max_ts FROM runs GROUP BY ALL)"""


#: Merging only adds segments to a store: with a manifest of its own it leaves the ingested index as it is.
_COMPACTED = "compacted/manifest.json"


@_once
def _compacted(spark: SparkSession, sf_dir: str) -> Store:
    store = _ingested(spark, sf_dir)
    manifest.write(store, manifest.read(store), _COMPACTED)
    lifecycle.compact(store, _COMPACTED, merge_factor=2)
    return store


@query(f"""WITH {_MERGED} SELECT CASE WHEN members = 2 THEN printf('segments/%020d-%020d.seg', a * {SIZE}, a * {SIZE} + n::BIGINT - 1) ELSE printf('segments/%012d-%012d.seg', a * {SIZE}, a * {SIZE} + n::BIGINT - 1) END AS key,
CAST(n AS BIGINT) AS docs, min_ts, max_ts, a * {SIZE} AS first_offset, CAST(a * {SIZE} + n - 1 AS BIGINT) AS last_offset FROM after""")
def compacted_manifest(spark, sf_dir):
    """Pairs of neighbours merged; segments of like size, as here, always pair up in order."""
    return _listed(spark, manifest.read(_compacted(spark, sf_dir), _COMPACTED))


@query(_matches(_CORPUS, ["er", "tion"], Options("or", global_stats=True)) + f", ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, * FROM found) SELECT rank, segment * {SIZE} + doc_id AS place, score FROM ranked WHERE rank <= 20")
def compacted_search(spark, sf_dir):
    """Merging changes neither documents nor scores."""
    store, o = _compacted(spark, sf_dir), Options("or", global_stats=True, top_k=20)
    hits = lifecycle.Coordinator(store, manifest_key=_COMPACTED).search("tion er", o, ["ts"])
    return hits.select("rank", (F.col("ts") - _FROM).alias("place"), F.round("score", 6).alias("score"))


@query(f"WITH {_MERGED} SELECT 'segments/' || {_NAME.format('segment')} || '.seg' AS key FROM runs WHERE members = 2")
def collected_orphans(spark, sf_dir):
    """What merging has retired is found, and spared within the grace."""
    # An index of its own: what is deleted here is what a second run would look for.
    store = _store(spark)
    lifecycle.ingest(store, _documents(spark, sf_dir), SIZE, ["text"], position="position")
    lifecycle.compact(store, merge_factor=2)
    if lifecycle.collect(store).deleted:
        raise ValueError("segments within the grace were collected")
    import time

    gone = lifecycle.collect(store, delete=True, now=time.time() + 2 * lifecycle.GRACE).deleted
    left = {f.key.split("segment=")[1].split("/")[0] for f in store.list("tables/") if "segment=" in f.key}
    return spark.createDataFrame([(f"segments/{n}.seg",) for n in gone if n not in left], "key string")


# ---- Logs


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.clickstream(spark, sf_dir)
    number = F.regexp_extract("event_id", "([0-9]+)", 1).cast("long")
    return e.withColumns({"partition": (F.col("user_id").cast("long") % 3).cast("int"), "offset": number})


_LOG = f"{_EVENTS}, log AS (SELECT *, CAST(user_id AS BIGINT) % 3 AS part, CAST(regexp_extract(event_id, '([0-9]+)', 1) AS BIGINT) AS place FROM ev)"
_SEALED = f"""{_LOG}, cut AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY place) - 1) // 1000 AS c FROM log)
SELECT printf('segments/p%d/%020d-%020d.seg', part, min(place), max(place)) AS key, count(*) AS docs, min(ts) AS min_ts, max(ts) AS max_ts, min(place) AS first_offset, max(place) AS last_offset FROM cut GROUP BY part, c"""


@query(f"WITH {_SEALED}")
def published_twice(spark, sf_dir):
    """A replay of the same offsets leaves the same segments in every partition's manifest."""
    store = _store(spark)
    for _ in range(2):
        lifecycle.publish_batch(store, _log(spark, sf_dir), 1000)
    return _listed(spark, lifecycle.Coordinator(store, partitioned=True).live)


@_once
def _indexed_stream(spark: SparkSession, sf_dir: str) -> Store:
    """The log as files of records, indexed by the stream until it has caught up, then once more with nothing new."""
    from ..streaming import indexer

    store, path = _store(spark), scratch_path(spark)
    log = _log(spark, sf_dir)
    records = indexer.to_records(log.withColumnsRenamed({"partition": "p", "offset": "o"}))
    records = records.withColumns({"partition": F.get_json_object("value", "$.p").cast("int"), "offset": F.get_json_object("value", "$.o").cast("long")})
    records.write.parquet(path)
    for _ in range(2):
        q = indexer.run(spark.readStream.schema(records.schema).parquet(path), store, store.url("checkpoint"), max_docs=1000)
        q.awaitTermination()
        if q.exception():
            raise RuntimeError(str(q.exception()))
    return store


@query(f"WITH {_SEALED}")
def stream_index(spark, sf_dir):
    """A log indexed by Structured Streaming: its partitions' manifests."""
    return _listed(spark, lifecycle.Coordinator(_indexed_stream(spark, sf_dir), partitioned=True).live)


@query(f"WITH {_LOG} SELECT count(*) AS documents, count(*) FILTER (event_type = 'purchase') AS purchases FROM log")
def stream_index_search(spark, sf_dir):
    c = lifecycle.Coordinator(_indexed_stream(spark, sf_dir), partitioned=True)
    return spark.createDataFrame([(c.live.docs, c.total("purchase"))], "documents long, purchases long")


_ARRIVAL = _STATE.replace("ORDER BY ts, event_id", "ORDER BY event_id")
_PREDICTED = f"""{_ARRIVAL}, f AS (SELECT event_id, session_id, user_id, ts AS stamp, CAST(user_id AS BIGINT) % 3 AS part, event_type, n AS seen, open_adds, cart_size AS size, cart_value AS value, {_FEATURES} FROM st),
sc AS (SELECT *, 1 / (1 + exp(-({_TREES}))) AS p FROM f WHERE event_type <> 'purchase' AND open_adds > 0 AND seen >= 2)
SELECT session_id, event_id, user_id, stamp AS ts, CAST(seen AS BIGINT) AS events, CAST(size AS BIGINT) AS cart_size, round(value, 2) + 0.0 AS cart_value, round(p, 4) AS probability, p >= 0.7 AS at_risk, CAST(part AS BIGINT) AS partition FROM sc"""


@query(f"WITH {_PREDICTED}")
def stream_predictions(spark, sf_dir):
    """A log scored in micro-batches, over sessions that no pause ends: what windows over the whole log give."""
    from ..streaming import predictor

    path, log = scratch_path(spark), _log(spark, sf_dir)
    total = log.agg(F.max("offset")).first()[0] or 0
    files = log.withColumn("third", F.least(F.lit(2), F.floor(F.col("offset") * 3 / (total + 1)))).orderBy("offset")
    for k in range(3):  # three files, three micro-batches
        files.filter(F.col("third") == k).drop("third").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = predictor.run(stream, model.demo_ensemble(), f"{path}/out", f"{path}/checkpoint", timeout=10**10)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    kinds = "session_id string, event_id string, user_id string, ts long, events long, cart_size long, cart_value double, probability double, at_risk boolean, partition long"
    return spark.read.schema(kinds).json(f"{path}/out").withColumn("cart_value", F.col("cart_value") + 0.0).select(*[k.split()[0] for k in kinds.split(", ")])


@query(f"WITH {_LOG}, b AS (SELECT *, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY place) > 1800 AS pause FROM log) SELECT event_id, CAST(coalesce(sum(pause::INT) OVER (PARTITION BY session_id ORDER BY place), 0) AS BIGINT) AS run FROM b")
def session_runs(spark, sf_dir):
    return sessions.with_runs(_log(spark, sf_dir)).select("event_id", "run")


@query(f"WITH {_EVENTS} SELECT session_id, 1::BIGINT AS partitions, true AS in_range FROM ev GROUP BY 1")
def log_partitions(spark, sf_dir):
    """A key's events all go to one of the log's partitions."""
    placed = tables.clickstream(spark, sf_dir).withColumn("p", sessions.partition_of("session_id", 12))
    return placed.groupBy("session_id").agg(F.count_distinct("p").alias("partitions"), ((F.min("p") >= 0) & (F.max("p") < 12)).alias("in_range"))


@query(f"WITH {_LOG} SELECT event_id, max(ts) OVER (PARTITION BY part ORDER BY place) AS watermark FROM log")
def running_watermarks(spark, sf_dir):
    return sessions.running_watermarks(_log(spark, sf_dir)).select("event_id", "watermark")


@query(f"""WITH {_LOG}, b AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY place) > 1800, false)::INT AS pause FROM log), r AS (SELECT *, sum(pause) OVER (PARTITION BY session_id ORDER BY place) AS run FROM b),
l AS (SELECT session_id, max(run) AS run, arg_max(ts, place) AS ended FROM r GROUP BY 1), w AS (SELECT part, max(ts) AS watermark FROM log GROUP BY 1)
SELECT event_id, session_id FROM r JOIN l USING (session_id, run) JOIN w USING (part) WHERE watermark - ended <= 1800""")
def open_sessions(spark, sf_dir):
    """The events of sessions that their own partition's progress has not expired."""
    from ..streaming.predictor import sweep

    log = _log(spark, sf_dir)
    return sweep(log, sessions.watermarks(log)).select("event_id", "session_id")


# ---- Service


def _engine(spark: SparkSession, sf_dir: str, **more):
    from ..service import Engine

    return Engine(spark, _ingested(spark, sf_dir), model.demo_ensemble(), partitioned=False, fields=("lang", "source"), **more)


@query(_matches(_CORPUS, ["er", "tion"], Options("or", global_stats=True)) + f""", ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, segment, doc_id) AS INTEGER) AS rank, * FROM found)
SELECT r.rank, r.doc_id, round(r.score, 5) AS score, d.lang, (SELECT count(*) FROM found) AS total FROM ranked r JOIN documents d ON d.doc_id = r.segment * {SIZE} + r.doc_id WHERE r.rank > 5 AND r.rank <= 15""")
def service_search(spark, sf_dir):
    got = _engine(spark, sf_dir).search("tion er", 10, 5, "or", True)
    rows = [(h["rank"], h["doc_id"], round(h["score"], 5), h["document"]["lang"], got["total"]) for h in got["hits"]]
    return spark.createDataFrame(rows, "rank int, doc_id long, score double, lang string, total long")


@query(f"WITH {_CORPUS} SELECT 'ok' AS status, count(*) AS segments, CAST(sum(n) AS BIGINT) AS documents, 3::BIGINT AS trees FROM segments")
def service_status(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return spark.createDataFrame([(e.health()["status"], e.health()["segments"], e.index()["documents"], e.model()["trees"])], "status string, segments long, documents long, trees long")


@query(f"""WITH {_PREDICTED.rsplit('SELECT', 1)[0]}, one AS (SELECT session_id FROM ev GROUP BY 1 HAVING count(*) <= 200 ORDER BY sum((event_type = 'add_to_cart')::INT) DESC, session_id LIMIT 1)
SELECT f.event_id, CAST(f.seen AS BIGINT) AS events, CAST(f.size AS BIGINT) AS cart_size, round(f.value, 2) + 0.0 AS cart_value, round(sc.p, 4) AS probability FROM f SEMI JOIN one USING (session_id) LEFT JOIN sc ON sc.event_id = f.event_id""")
def service_predict(spark, sf_dir):
    """The trajectory of the session with the most adds among those that one request may hold."""
    e = tables.clickstream(spark, sf_dir)
    adds = F.sum((F.col("event_type") == "add_to_cart").cast("int"))
    one = e.groupBy("session_id").agg(F.count("*").alias("n"), adds.alias("adds")).filter("n <= 200").orderBy(F.desc("adds"), "session_id").first()
    rows = [r.asDict() for r in e.filter(F.col("session_id") == (one["session_id"] if one else "")).orderBy("event_id").collect()]
    scores = _engine(spark, sf_dir).predict(rows)["scores"]
    out = [(r["event_id"], s["events"], s["cart_size"], s["cart_value"] + 0.0, s["probability"]) for r, s in zip(rows, scores, strict=True)]
    return spark.createDataFrame(out, "event_id string, events long, cart_size long, cart_value double, probability double")


@query(f"WITH {_EVENTS}, few AS (SELECT * FROM ev ORDER BY event_id LIMIT 60) SELECT count(*) AS documents, count(*) FILTER (event_type = 'view') AS views FROM few")
def service_ingest(spark, sf_dir):
    """Events posted by hand in three requests, each searchable on return."""
    from ..service import Engine

    engine = Engine(spark, _store(spark))
    events = [r.asDict() for r in tables.clickstream(spark, sf_dir).orderBy("event_id").limit(60).collect()]
    for i in range(0, len(events), 20):
        engine.ingest(events[i : i + 20])
    return spark.createDataFrame([(engine.index()["documents"], engine.search("view")["total"])], "documents long, views long")


@query(f"WITH {_EVENTS}, few AS (SELECT * FROM ev ORDER BY ts, event_id LIMIT 250 OFFSET 40) SELECT count(*) AS documents, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS sent FROM few")
def service_stream(spark, sf_dir):
    """The paced feed, from a place in it on until it is exhausted."""
    from ..service import Engine

    store = _store(spark)
    feed.write_feed(tables.clickstream(spark, sf_dir).orderBy("ts", "event_id").limit(290), store, chunk=50)
    engine = Engine(spark, store, feed=feed.Feed(store, chunk=50, start_after=40))
    last = list(engine.stream(120, 200))[-1]
    return spark.createDataFrame([(engine.index()["documents"], engine.search("purchase")["total"], json.loads(last.split("data: ")[1])["sent"])], "documents long, purchases long, sent long")


@query(f"WITH {_CORPUS} SELECT CAST(sum(n) AS BIGINT) AS before, CAST(sum(n) AS BIGINT) + 1 AS after FROM segments")
def refreshed(spark, sf_dir):
    """A coordinator that finds its manifest stale reads it again."""
    store = _store(spark)
    manifest.write(store, manifest.read(_ingested(spark, sf_dir)))
    c = lifecycle.Coordinator(store, stale=0.0)
    before, live = c.live.docs, manifest.read(store)
    manifest.write(store, live.publish(manifest.Segment("segments/x.seg", 1, 1, 0, 0)))
    c.maybe_refresh()
    return spark.createDataFrame([(before, c.live.docs)], "before long, after long")


# ---- Models and guards


@query(f"WITH {_EXAMPLES} SELECT session_id, CAST(event_index AS INTEGER) AS event_index, round(1 / (1 + exp(-({_TREES}))), 6) AS p FROM ex")
def tree_scores_walked(spark, sf_dir):
    """The tree walk over arrays, by a model that was written and read back."""
    from ..operators import dataset

    ensemble = model.Ensemble.from_json(model.demo_ensemble().to_json())
    rows = dataset.examples(tables.clickstream(spark, sf_dir))
    walk = F.pandas_udf(lambda *columns: _walked(ensemble, columns), "double")
    return rows.select("session_id", "event_index", F.round(model.sigmoid(walk(*ensemble.features)), 6).alias("p"))


def _walked(ensemble, columns):
    import numpy as np
    import pandas as pd

    return pd.Series(ensemble.raw(np.column_stack([c.to_numpy(float) for c in columns])))


_WRONG = (
    ("mode", lambda: Options("xor")), ("offset", lambda: Options(offset=-1)), ("k1", lambda: Options(k1=-1)), ("b", lambda: Options(b=2)), ("long query", lambda: search.guard("x" * 257, 10, 0)),
    ("k too small", lambda: search.guard("ab", 0, 0)), ("k too large", lambda: search.guard("ab", 101, 0)), ("far page", lambda: search.guard("ab", 10, 501)), ("many terms", lambda: search.guard(" ".join(f"t{i}" for i in range(17)), 10, 0)),
    ("features", lambda: model.Ensemble(**(json.loads(model.demo_ensemble().to_json()) | {"features": ["x"]}))), ("version", lambda: manifest.Manifest.from_json(b'{"version": 9}')), ("merge factor", lambda: manifest.plan_compaction([], 1)),
)
_RIGHT = (("query", lambda: search.guard("fine query", 100, 500)), ("options", lambda: Options("or", 0, 0, k1=0.0, b=1.0)))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n, _ in _WRONG) + ", " + ", ".join(f"('{n}', false)" for n, _ in _RIGHT) + ") AS t(guarded, refused)")
def guards(spark, sf_dir):
    """What must be refused is, and what is allowed isn't."""

    def refused(call) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(n, refused(call)) for n, call in (*_WRONG, *_RIGHT)], "guarded string, refused boolean")


QUERIES, SQL = catalogue.QUERIES, catalogue.SQL
