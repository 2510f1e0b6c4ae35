from __future__ import annotations

import json
import random
import time

import pytest

from siltmill.operators.search import Options
from siltmill.plans import lifecycle, manifest
from siltmill.plans.manifest import Manifest, Segment
from siltmill.schema import EVENT_FIELDS, EVENT_SCHEMA
from siltmill.sources.store import Store, resolve, s3_settings, self_check
from siltmill.streaming import indexer
from tests.reference_fold import random_events


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def table(spark, n=30, seed=1):
    return spark.createDataFrame([tuple(e[f] for f in EVENT_FIELDS) for e in random_events(n, seed=seed)], EVENT_SCHEMA)


def scores(coordinator, query="widget gadget1", **o):
    hits = coordinator.search(query, Options("or", top_k=100, global_stats=True, **o), ["event_id"])
    return {} if hits is None else {r["event_id"]: round(r["score"], 9) for r in hits.collect()}


def test_ingest_and_compaction_keep_results(spark, store):
    live = lifecycle.ingest(store, table(spark), docs_per_segment=4)
    assert [s.docs for s in live.segments] == [4] * 7 + [2] and live.generation == 1
    assert live.segments[0].key == "segments/000000000000-000000000003.seg" and live.docs == 30
    c = lifecycle.Coordinator(store)
    before = scores(c)
    assert len(before) == 30
    done = lifecycle.compact(store, merge_factor=3)
    assert len(done.retired) == 3 * len(done.merged) > 0 and done.documents == sum(s.docs for s in done.retired)
    assert scores(c) == before  # an old snapshot still reads its segments
    c.refresh()
    assert scores(c) == before and len(c.live.segments) == 8 - 2 * len(done.merged)
    stats = {r["segment"]: r["num_docs"] for r in c.index().segments.collect()}
    assert sum(stats.values()) == 30
    assert not lifecycle.collect(store).deleted and len(lifecycle.collect(store, now=time.time() + 9999).deleted) == len(done.retired)
    gone = lifecycle.collect(store, grace=0, delete=True, now=time.time() + 1)
    assert len(gone.deleted) == len(done.retired) and scores(c) == before
    assert lifecycle.collect(store, grace=0, now=time.time() + 1).deleted == []


def records(spark, lo, hi, partition=0):
    rows = [(e["session_id"], json.dumps(e), partition, lo + i) for i, e in enumerate(random_events(hi - lo, seed=7))]
    return spark.createDataFrame(rows, "key string, value string, partition int, offset long")


def test_replays_and_partitions(spark, store):
    parsed = indexer.parse(records(spark, 100, 110).unionByName(records(spark, 100, 110, 1)))
    first = lifecycle.publish_batch(store, parsed, 4)
    assert sorted(s.key for s in first)[0] == "segments/p0/00000000000000000100-00000000000000000103.seg"
    again = lifecycle.publish_batch(store, parsed, 4)
    assert sorted(s.key for s in again) == sorted(s.key for s in first)
    c = lifecycle.Coordinator(store, partitioned=True)
    assert c.live.docs == 20 and len(c.live.segments) == 6  # offsets of one partition don't evict another's
    wider = lifecycle.publish_batch(store, indexer.parse(records(spark, 100, 112)), 100)
    assert len(wider) == 1
    c.refresh()
    assert c.live.docs == 22 and sum("/p0/" in s.key for s in c.live.segments) == 1


def test_crash_before_the_manifest(spark, store, monkeypatch):
    parsed = indexer.parse(records(spark, 0, 5))

    def fail(*_):
        raise RuntimeError("crash")

    monkeypatch.setattr(manifest, "write", fail)
    with pytest.raises(RuntimeError):
        lifecycle.publish_batch(store, parsed, 10)
    monkeypatch.undo()
    c = lifecycle.Coordinator(store, partitioned=True)
    assert c.live.docs == 0 and c.search("widget") is None
    lifecycle.publish_batch(store, parsed, 10)
    assert c.refresh().docs == 5


def test_time_pruning_opens_fewer_segments(spark, store):
    lifecycle.ingest(store, table(spark, 40), docs_per_segment=10)
    c = lifecycle.Coordinator(store)
    last = c.live.segments[-1]
    pruned = c.index(Options(start=last.min_ts + 1))
    assert all("segment=" in f for f in pruned.postings.inputFiles()) and len(pruned.postings.inputFiles()) < len(c.index().postings.inputFiles())


def test_terms_have_bloom_filters_and_order(spark, store, tmp_path):
    import duckdb

    lifecycle.ingest(store, table(spark, 40), docs_per_segment=20)
    lifecycle.compact(store, merge_factor=2)
    for name in ("postings", "termdict"):
        files = f"{tmp_path}/store/tables/{name}/*/*.parquet"
        found = duckdb.sql(f"SELECT file_name, bloom_filter_offset, dictionary_page_offset FROM parquet_metadata('{files}') WHERE path_in_schema = 'term'").fetchall()
        # A file of postings needs no filter while a dictionary page has all its terms.
        assert len({f for f, _, _ in found}) >= 3 and all(bloom or (name == "postings" and page) for _, bloom, page in found)
        for file in {f for f, _, _ in found}:
            terms = [r[0] for r in duckdb.sql(f"SELECT term FROM read_parquet('{file}') ORDER BY file_row_number").fetchall()] if name == "termdict" else None
            assert terms is None or terms == sorted(terms)


def test_a_term_that_no_segment_has_ends_the_search(spark, store):
    """One look at the dictionary is all: no postings are opened."""
    from pyspark.sql import functions as F

    lifecycle.ingest(store, table(spark, 40), docs_per_segment=10)
    index = lifecycle.Coordinator(store).index()
    broken = index.postings.withColumn("tf", F.raise_error(F.lit("read")).cast("int"))
    from dataclasses import replace

    from siltmill.operators import search

    closed = replace(index, postings=broken)
    for text, o in (("absentterm", Options("or")), ("widget absentterm", Options()), ("absentterm widget", Options(global_stats=True))):
        assert search.search(closed, text, o).collect() == [] and search.total_hits(closed, text, o).first()[0] == 0
    with pytest.raises(Exception, match="read"):
        search.search(closed, "widget").collect()


def test_cost_counts_what_is_opened(spark, store):
    lifecycle.ingest(store, table(spark, 40), docs_per_segment=10)
    c = lifecycle.Coordinator(store)
    files = lambda t: [f for f in store.list(f"tables/{t}/") if f.key.endswith(".parquet")]
    absent = c.cost("absentterm")
    assert (absent["segments_searched"], absent["postings_read"], absent["steps"], absent["files"], absent["bytes"]) == (4, 0, 1, len(files("termdict")), sum(f.size for f in files("termdict")))
    found = c.cost("widget")
    every = [f for t in ("termdict", "postings", "docs") for f in files(t)]
    assert (found["postings_read"], found["steps"], found["files"], found["bytes"]) == (40, 3, len(every), sum(f.size for f in every))
    pruned = c.cost("widget", Options(start=c.live.segments[-1].min_ts + 1))
    assert pruned["segments_pruned"] == 3 and pruned["files"] < found["files"]
    assert c.cost("the")["steps"] == 0


def test_planned_and_lazy_searches_agree(spark, store):
    from dataclasses import replace

    from siltmill.operators import search

    lifecycle.ingest(store, table(spark, 60), docs_per_segment=7)
    index = lifecycle.Coordinator(store).index()
    lazy = replace(index, stats=None)
    first, last = (index.segments.agg({"min_ts": "min"}).first()[0], index.segments.agg({"max_ts": "max"}).first()[0])
    for text in ("widget gadget1", "gadget2 phone acme", "absentterm bolt"):
        for o in (Options(), Options("or"), Options("or", global_stats=True), Options("or", start=first + 900, end=last - 900), Options(global_stats=True, end=last - 2000)):
            rows = [[(r["segment"], r["doc_id"], round(r["score"], 9)) for r in search.search(x, text, o).collect()] for x in (index, lazy)]
            assert rows[0] == rows[1], (text, o)


def test_live_ingest(spark, store):
    event = {"event_id": "x1", "ts": 5, "session_id": "s", "user_id": "u", "event_type": "view", "title": "Bespoke Widget XR9", "price": 42, "extra": 1}
    lifecycle.live_ingest(store, spark, [event])
    lifecycle.live_ingest(store, spark, [event | {"event_id": "x2"}])
    c = lifecycle.Coordinator(store, partitioned=True)
    assert c.live.docs == 2 and c.total("bespoke xr9") == 2 and c.live.next_offset == 2
    with pytest.raises(ValueError):
        lifecycle.live_ingest(store, spark, [event] * 201)


def test_manifest_rules():
    s = lambda k, lo, hi, size=1000: Segment(k, 10, size, lo, hi, lo, hi)
    m = Manifest().publish(s("a", 0, 9)).publish(s("b", 10, 19)).publish(s("c", 5, 9))
    assert [x.key for x in m.segments] == ["b", "c"] and m.generation == 3
    assert Manifest.from_json(m.to_json()) == m
    for bad in (b"{", b'{"version": 9}'):
        with pytest.raises(ValueError):
            Manifest.from_json(bad)
    both = manifest.union([m, Manifest((s("b", 0, 99), s("d", 0, 9)), 9)])
    assert [x.key for x in both.segments] == ["b", "c", "d"] and both.generation == 9
    assert s("a", 5, 9).overlaps(9, None) and not s("a", 5, 9).overlaps(10, None) and not s("a", 5, 9).overlaps(None, 4)


def test_plan():
    s = lambda i, size: Segment(f"segments/{i:03d}", 10, size, 0, 0, i * 10, i * 10 + 9)
    plan = lambda sizes, **o: [[x.first_offset // 10 for x in g] for g in manifest.plan_compaction([s(i, b) for i, b in enumerate(sizes)], **o)]
    assert plan([10] * 25) == [list(range(10)), list(range(10, 20))]
    assert plan([10, 10, 100, 100, 100, 10], merge_factor=3) == [[2, 3, 4]]
    assert plan([10, 40, 160, 640], merge_factor=2) == [[0, 1], [2, 3]]
    assert plan([100] * 4, merge_factor=2, max_bytes=150) == []
    with pytest.raises(ValueError):
        plan([1], merge_factor=1)
    group = [s(0, 1), s(1, 1)]
    assert manifest.merged_key(group) == "segments/00000000000000000000-00000000000000000019.seg"
    assert manifest.merged_key([Segment("segments/q", 1, 1, 0, 0)]) == "segments/merged-q"


def test_store(spark, store):
    assert set(self_check(store)) >= {"put", "get_range", "list"}
    store.put("a/b", b"12345")
    store.put("a/b", b"123456")
    assert store.get("a/b") == b"123456" and store.get_suffix("a/b", 2) == b"56" and store.get_range("a/b", 1, 2) == b"23"
    assert [x.key for x in store.list("a/")] == ["a/b"] and store.modified_at("a/b") > 0
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(ValueError):
            store.url(bad)
    assert resolve(spark, "/tmp/x") == "file:///tmp/x"
    with pytest.raises(ValueError):
        resolve(spark, "ftp://x/y")
    assert s3_settings("r2", {"R2_ACCOUNT_ID": "q"})["fs.s3a.endpoint"].startswith("https://q.")
    with pytest.raises(ValueError):
        s3_settings("r2", {})


def test_random_publishes_never_overlap():
    rng = random.Random(0)
    for _ in range(50):
        m = Manifest()
        for _ in range(20):
            lo = rng.randrange(100)
            hi = lo + rng.randrange(20)
            m = m.publish(Segment(f"k{lo}-{hi}", 1, 1, 0, 0, lo, hi))
        spans = sorted((s.first_offset, s.last_offset) for s in m.segments)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def contents(store):
    """All rows of the live segments' tables, and the manifest without sizes of files."""
    live = manifest.read(store)
    index = lifecycle.open_index(store, live)
    rows = {t: sorted(repr(r) for r in getattr(index, t).select(*sorted(getattr(index, t).columns)).collect()) for t in lifecycle.TABLES}
    assert all(s.bytes > 0 for s in live.segments)
    return rows, [(s.key, s.docs, s.min_ts, s.max_ts, s.first_offset, s.last_offset) for s in live.segments]


def test_many_small_groups_share_their_jobs(spark, tmp_path):
    """Twenty groups take about as many jobs as two, and give what merging each group alone gives."""
    newest = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    jobs = {}
    for segments in (4, 40):
        store = Store(spark, f"file://{tmp_path}/s{segments}")
        lifecycle.ingest(store, table(spark, 4 * segments - 1), docs_per_segment=4)
        before, seen = newest(), []
        done = lifecycle.compact(store, merge_factor=2, on_merge=lambda group, one: seen.append((len(group), one.docs)))
        jobs[segments] = newest() - before
        assert seen == [(2, 8)] * (segments // 2 - 1) + [(2, 7)] and len(done.retired) == segments
    assert jobs[40] <= jobs[4] + 20
    alone = Store(spark, f"file://{tmp_path}/alone")
    live = lifecycle.ingest(alone, table(spark, 159), docs_per_segment=4)
    for i in range(0, 40, 2):
        lifecycle.merge_group(alone, list(live.segments[i : i + 2]))
    assert contents(store) == contents(alone)


def test_large_groups_merge_alone_and_sizes_agree(spark, store, tmp_path, monkeypatch):
    lifecycle.ingest(store, table(spark, 64), docs_per_segment=4)
    names = [lifecycle.name_of(s.key) for s in manifest.read(store).segments]
    listed = lifecycle.segment_bytes(store, names)
    monkeypatch.setattr(lifecycle, "LISTED", 0)
    assert lifecycle.segment_bytes(store, names) == listed and min(listed.values()) > 0
    groups = [list(manifest.read(store).segments[i : i + 2]) for i in range(0, 16, 2)]
    assert lifecycle._rounds(groups) == [groups]
    monkeypatch.setattr(lifecycle, "SMALL", 5)
    assert lifecycle._rounds(groups) == [groups[0:2], groups[2:4], groups[4:6], groups[6:8]]
    other = Store(spark, f"file://{tmp_path}/other")
    lifecycle.ingest(other, table(spark, 64), docs_per_segment=4)
    monkeypatch.setattr(lifecycle, "MERGED_BYTES", 1)
    assert lifecycle._rounds(groups) == [[g] for g in groups]
    lifecycle.compact(other, merge_factor=2)
    monkeypatch.undo()
    lifecycle.compact(store, merge_factor=2)
    assert contents(store) == contents(other)


def test_compacted_queries_ingest_nothing_again(spark, monkeypatch):
    """They merge what is ingested already, under a manifest of their own."""
    from siltmill.plans import stored_queries as q

    sf = "/root/testdata/sf0.001"
    store = q._ingested(spark, sf)
    before = manifest.read(store)
    monkeypatch.setattr(q, "_MADE", {k: v for k, v in q._MADE.items() if k[0] == "_ingested"})
    monkeypatch.setattr(lifecycle, "ingest", lambda *a, **k: pytest.fail("ingested again"))
    n = len(before.segments)
    assert q.compacted_manifest(spark, sf).count() == n - n // 2
    assert q.compacted_search(spark, sf).count() == 20
    assert manifest.read(store) == before and q._ingested(spark, sf) is store
