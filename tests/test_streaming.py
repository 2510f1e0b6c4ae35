from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltmill.operators import sessions
from siltmill.operators.model import demo_ensemble
from siltmill.plans.lifecycle import Coordinator
from siltmill.schema import EVENT_FIELDS, EVENT_SCHEMA
from siltmill.sources.feed import Feed, read_feed, write_feed
from siltmill.sources.store import Store
from siltmill.streaming import indexer, predictor
from tests.reference_fold import random_events, states


@pytest.fixture
def table(spark):
    return spark.createDataFrame([tuple(e[f] for f in EVENT_FIELDS) for e in random_events(80, sessions=5)], EVENT_SCHEMA)


def test_stream_index(spark, table, tmp_path):
    rows = indexer.to_records(table).withColumn("partition", F.lit(0)).coalesce(1).withColumn("offset", F.monotonically_increasing_id())
    rows.write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "log"))
    assert set(json.loads(rows.first()["value"])) == set(EVENT_FIELDS)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds everything committed
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        q = indexer.run(stream, store, str(tmp_path / "cp"), max_docs=20)
        q.awaitTermination()
        assert q.exception() is None
    c = Coordinator(store, partitioned=True)
    assert c.live.docs == 80 and c.total("widget") == 80 and all(s.docs <= 20 for s in c.live.segments)


def logged(events, partitions=1):
    """Events in order of arrival with the place their session's partition gave them."""
    rows = []
    for i, e in enumerate(events):
        rows.append((*[e[f] for f in EVENT_FIELDS], sum(map(ord, e["session_id"])) % partitions, i))
    return rows


def test_predictor_is_batch(spark, tmp_path):
    """Micro-batches of a log, stopped and run again halfway, score as the windows over the whole log do."""
    events = random_events(90, sessions=5)
    log = spark.createDataFrame(logged(events, 2), predictor.LOGGED)
    for k in range(3):
        log.filter(F.floor(F.col("offset") / 30) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        q = predictor.run(stream, demo_ensemble(), str(tmp_path / "out"), str(tmp_path / "cp"), timeout=10**9)
        q.awaitTermination()
        assert q.exception() is None
    got = {r["event_id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    batch = predictor.predictions(sessions.session_state(log, order=("offset",)), demo_ensemble())
    want = {r["event_id"]: r for r in batch.collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k in want:
        assert got[k]["probability"] == want[k]["probability"] and got[k]["cart_size"] == want[k]["cart_size"] and got[k]["cart_value"] == pytest.approx(want[k]["cart_value"])


def test_states_are_the_prefixes(spark):
    """Arrival order, late events and pauses, against states made anew from each run's events so far."""
    events = random_events(120, sessions=4)
    for i in range(7, len(events), 9):
        events[i]["ts"] -= 700
    got = {r["event_id"]: r for r in predictor.session_states(spark.createDataFrame(logged(events), predictor.LOGGED), timeout=1500).collect()}
    runs, last, number = [], {}, {}
    for e in events:
        s = e["session_id"]
        if s in last and e["ts"] - last[s] > 1500:
            number[s] = number.get(s, 0) + 1
        last[s] = e["ts"]
        runs.append(e | {"session_id": f"{s}/{number.get(s, 0)}"})
    assert len({e["session_id"] for e in runs}) > 4
    want = states(runs)
    for k, state in want.items():
        for c in sessions.STATE:
            assert got[k][c] == (pytest.approx(state[c], abs=1e-6) if isinstance(state[c], float) else state[c]), (k, c)


def test_sessions_expire_by_their_own_partition(spark, tmp_path):
    base = {f: None for f in EVENT_FIELDS} | {"user_id": "u", "event_type": "add_to_cart", "product_id": "p", "price": 1.0}
    event = lambda i, session, ts: base | {"event_id": f"e{i}", "session_id": session, "ts": ts}
    batches = [
        [(event(0, "a", 100), 0), (event(1, "b", 100), 1)],
        [(event(2, "c", 5000), 0)],  # partition 0 goes on: a expires, b does not
        [(event(3, "b", 150), 1), (event(4, "a", 120), 0)],  # b goes on, a begins anew, though its event is late
    ]
    seen, held = [], predictor.Held(spark, str(tmp_path / "held"))
    place = 0
    for number, batch in enumerate(batches):
        rows = []
        for e, partition in batch:
            rows.append((*[e[f] for f in EVENT_FIELDS], partition, place))
            place += 1
        for _ in range(2 if number == 2 else 1):  # a replay of a micro-batch finds what it found before
            seen.clear() if number == 2 else None
            predictor.advance(held, number, spark.createDataFrame(rows, predictor.LOGGED), demo_ensemble(), [predictor.callback_sink(seen.append)], timeout=1800)
        open_now = {r["session_id"] for r in held.read(number + 1)[0].collect()}
        assert open_now == [{"a", "b"}, {"b", "c"}, {"b", "c"}][number]
    assert [(r["event_id"], r["events"]) for r in seen] == [("e3", 2)]
    assert {(r[0], r[1]) for r in held.read(3)[1].collect()} == {(0, 5000), (1, 150)}


def test_drain_stops_when_caught_up(spark, table, tmp_path):
    rows = indexer.to_records(table).withColumn("partition", F.lit(0)).coalesce(1).withColumn("offset", F.monotonically_increasing_id())
    rows.write.parquet(str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "store"))
    q = indexer.run(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log")), store, str(tmp_path / "cp"), available_now=False, every="200 milliseconds")
    assert indexer.drain(q, 90) and not q.isActive
    assert Coordinator(store, partitioned=True).live.docs == 80


def test_feed(spark, table, tmp_path):
    store = Store(spark, str(tmp_path / "fed"))
    assert write_feed(table.repartition(5), store, chunk=25) == 4
    assert [s.key for s in store.list("feed/")] == [f"feed/{k:05d}.jsonl.gz" for k in range(4)] and not store.list("feed-writing/")
    order = [r["event_id"] for r in table.orderBy("ts", "event_id").collect()]
    feed = Feed(store, chunk=25)
    taken = feed.take(10) + feed.take(40)
    assert [e["event_id"] for e in taken] == order[:50] and set(taken[0]) == set(EVENT_FIELDS) and not feed.exhausted
    late = Feed(store, chunk=25, start_after=65)
    assert [e["event_id"] for e in late.take(100)] == order[65:] and late.exhausted and late.take(1) == []
    q = read_feed(spark, str(tmp_path / "fed" / "feed")).writeStream.format("memory").queryName("fed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fed").count() == 80
