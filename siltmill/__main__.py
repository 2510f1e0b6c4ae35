"""Command line: python -m siltmill COMMAND --help."""

from __future__ import annotations

import argparse
import json

from .session import build


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple[str, dict], about: str) -> None:
        c = sub.add_parser(name, help=about)
        for flag, options in args:
            c.add_argument(flag, **options)

    text, number, flag = {}, {"type": int}, {"action": "store_true"}
    src, uri = ("source", text), ("--store", {"required": True})
    command("load", src, ("--out", text), ("--limit", number), ("--no-titles", flag), about="read a clickstream file, print statistics, write JSON lines")
    command("slice", src, ("target", text), ("--sessions", {"type": int, "default": 2000}), ("--scan-limit", {"type": int, "default": 2_000_000}), about="cut whole sessions out of a file")
    command("ingest", src, uri, ("--docs-per-segment", {"type": int, "default": 5000}), ("--limit", number), about="index a clickstream file")
    command("search", ("query", text), uri, ("--k", {"type": int, "default": 10}), ("--offset", {"type": int, "default": 0}), ("--mode", {"default": "and"}), ("--global-stats", flag), ("--start", number), ("--end", number), ("--partitioned", flag), about="query an index")
    command("compact", uri, ("--merge-factor", {"type": int, "default": 10}), ("--collect", flag), ("--delete", flag), ("--grace", {"type": float, "default": 3600.0}), about="merge small segments and find orphans")
    command("produce", src, ("--servers", {"required": True}), ("--topic", {"required": True}), about="send a clickstream file to a log")
    command("index", uri, ("--servers", {"required": True}), ("--topic", {"required": True}), ("--checkpoint", {"required": True}), ("--max-docs", {"type": int, "default": 10_000}), about="index a log")
    command("predict", ("--servers", {"required": True}), ("--topic", {"required": True}), ("--model", {"required": True}), ("--out", text), ("--out-topic", text), ("--checkpoint", {"required": True}), about="score a log's sessions into files or a topic")
    command("train", src, ("--out", {"required": True}), ("--fraction", {"type": float, "default": 0.7}), ("--iterations", {"type": int, "default": 200}), about="train and export a model")
    command("serve", uri, ("--model", text), ("--port", {"type": int, "default": 8080}), ("--secret", text), ("--feed-after", number), about="answer over HTTP; --feed-after: take the store's feed from so many events on")
    command("feed", src, uri, ("--limit", number), about="write a clickstream file as a feed into a store")
    command("check", uri, about="time each kind of access to a store")
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = build()
    from .plans import lifecycle
    from .sources import clickstream as cs
    from .sources.store import Store

    store = Store(spark, a.store) if getattr(a, "store", None) else None
    if a.command == "load":
        cleaned = cs.clean(cs.read_raw(spark, a.source), not a.no_titles).cache()
        print(json.dumps(cs.load_stats(cleaned).first().asDict() | {"reasons": {r["reason"]: r["count"] for r in cs.skip_reasons(cleaned).collect()}}, indent=1))
        if a.out:
            cs.write_jsonl(cs.events(cleaned, a.limit), a.out)
    elif a.command == "slice":
        cs.write_slice(cs.slice_sessions(cs.read_raw(spark, a.source), a.sessions, a.scan_limit), a.target)
    elif a.command == "ingest":
        live = lifecycle.ingest(store, cs.load_events(spark, a.source, a.limit), a.docs_per_segment)
        print(f"{live.docs} documents in {len(live.segments)} segments, {live.bytes} bytes")
    elif a.command == "search":
        from .operators.search import Options

        c = lifecycle.Coordinator(store, a.partitioned)
        hits = c.search(a.query, Options(a.mode, a.k, a.offset, a.global_stats, a.start, a.end), ["event_id", "title"])
        if hits is not None:
            hits.show(a.k, False)
    elif a.command == "compact":
        keys = [k for k in lifecycle.manifest_keys(store)]
        for key in keys:
            done = lifecycle.compact(store, key, a.merge_factor)
            print(f"{key}: {len(done.retired)} segments into {len(done.merged)}")
        if a.collect:
            print(lifecycle.collect(store, a.grace, a.delete))
    elif a.command == "produce":
        from .streaming.indexer import produce

        produce(cs.load_events(spark, a.source), a.servers, a.topic)
    elif a.command == "index":
        from .streaming import indexer

        indexer.run(indexer.kafka_source(spark, a.servers, a.topic), store, a.checkpoint, a.max_docs, available_now=False).awaitTermination()
    elif a.command == "predict":
        from .operators.model import Ensemble
        from .streaming import indexer, predictor

        with open(a.model) as f:
            ensemble = Ensemble.from_json(f.read())
        sinks = [predictor.json_sink(a.out)] * bool(a.out) + [predictor.topic_sink(a.servers, a.out_topic)] * bool(a.out_topic)
        predictor.run(indexer.parse(indexer.kafka_source(spark, a.servers, a.topic)), ensemble, sinks or [predictor.callback_sink(print)], a.checkpoint, False).awaitTermination()
    elif a.command == "train":
        from pyspark.sql import functions as F

        from .operators import dataset, metrics
        from .operators.model import export, scored, train_trees

        rows = dataset.time_split(dataset.examples(cs.load_events(spark, a.source)), a.fraction).cache()
        if dataset.session_overlap(rows).count():
            raise SystemExit("sessions on both sides of the split")
        ensemble = export(train_trees(rows.filter("is_train"), iterations=a.iterations))
        held = scored(rows.filter("not is_train"), ensemble, "p").select(F.col("abandoned").alias("y"), "p")
        ensemble.metrics = metrics.evaluate(held).first().asDict()
        with open(a.out, "w") as f:
            f.write(ensemble.to_json())
        print(json.dumps(ensemble.metrics, indent=1))
    elif a.command == "serve":
        from .operators.model import Ensemble
        from .service import Engine, serve
        from .sources.feed import Feed

        ensemble = Ensemble.from_json(open(a.model).read()) if a.model else None
        feed = None if a.feed_after is None else Feed(store, start_after=a.feed_after)
        serve(Engine(spark, store, ensemble, feed=feed), port=a.port, secret=a.secret).serve_forever()
    elif a.command == "feed":
        from .sources.feed import write_feed

        print(write_feed(cs.load_events(spark, a.source, a.limit), store), "chunks")
    elif a.command == "check":
        from .sources.store import self_check

        print(json.dumps(self_check(store), indent=1))


if __name__ == "__main__":
    main()
