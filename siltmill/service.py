"""The HTTP surface over a coordinator: search, ingest, predict, and a paced feed, on the standard library's server."""

from __future__ import annotations

import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .operators.model import Ensemble
from .operators.search import Options, fetch, guard, search, total_hits
from .operators.sessions import AT_RISK, scoring_gate, session_state
from .plans.lifecycle import Coordinator, live_ingest
from .schema import EVENT_FIELDS, EVENT_TYPES
from .sources.feed import Feed
from .sources.store import Store
from .streaming.predictor import LOGGED, predictions

# Limits of a request.
MAX_EVENTS, MAX_SECONDS, MAX_RATE = 200, 120.0, 200
FIELDS = ("event_id", "title", "category", "brand", "price", "event_type")


class Engine:
    """What the handlers do; every answer is a dictionary. Bad input raises ValueError."""

    def __init__(self, spark: SparkSession, store: Store, ensemble: Ensemble | None = None, partitioned: bool = True, fields: tuple[str, ...] = FIELDS, feed: Feed | None = None):
        self.spark, self.store, self.ensemble, self.fields, self.feed = spark, store, ensemble, fields, feed
        self.coordinator = Coordinator(store, partitioned, warm=True)
        self._lock = threading.Lock()

    def health(self) -> dict:
        return {"status": "ok", "segments": len(self.coordinator.live.segments)}

    def index(self) -> dict:
        live = self.coordinator.live
        return {"documents": live.docs, "bytes": live.bytes, "segments": len(live.segments), "generation": live.generation}

    def model(self) -> dict:
        e = self.ensemble
        return {"loaded": e is not None} | ({} if e is None else {"trees": len(e.offsets) - 1, "nodes": len(e.feature), "features": list(e.features), "metrics": e.metrics})

    def search(self, q: str, k: int = 10, offset: int = 0, mode: str = "and", global_stats: bool = False, explain: bool = False) -> dict:
        began = time.perf_counter()
        guard(q, k, offset)
        options = Options(mode, k, offset, global_stats)
        self.coordinator.maybe_refresh()
        index = self.coordinator.index(options)
        out = {"query": q, "total": 0, "hits": []}
        if index is not None:
            out["total"] = total_hits(index, q, options).first()[0]
            fields = [f for f in self.fields if f in index.docs.columns]
            out["hits"] = [{"rank": r["rank"], "segment": r["segment"], "doc_id": r["doc_id"], "score": round(r["score"], 6), "document": {f: r[f] for f in fields}} for r in fetch(index, search(index, q, options), fields).collect()]
            if explain:
                out["cost"] = self.coordinator.cost(q, options)
        return out | {"took_ms": round((time.perf_counter() - began) * 1000, 1)}

    def ingest(self, events: list[dict]) -> dict:
        began = time.perf_counter()
        with self._lock:  # one writer a partition
            sealed = live_ingest(self.store, self.spark, events)
            self.coordinator.refresh()
        return {"accepted": len(events), "searchable": bool(sealed), "segments": [s.key for s in sealed], "took_ms": round((time.perf_counter() - began) * 1000, 1)}

    def predict(self, events: list[dict], threshold: float = AT_RISK) -> dict:
        """What is known after each event of one session, in the order given, by the windows and the scores of the stream."""
        if self.ensemble is None:
            raise ValueError("no model is loaded")
        if len(events) > MAX_EVENTS:
            raise ValueError(f"at most {MAX_EVENTS} events at a time")
        if not 0 <= threshold <= 1:
            raise ValueError("the threshold must be between 0 and 1")
        for e in events:
            if e["event_type"] not in EVENT_TYPES:
                raise ValueError(f"unknown event_type {e['event_type']!r}")
        given = lambda e, i: {"event_id": str(i), "session_id": "", "user_id": e.get("user_id") or "", "ts": int(e["ts"]), "price": None if e.get("price") is None else float(e["price"])}
        rows = [tuple(({f: e.get(f) for f in EVENT_FIELDS} | given(e, i)).values()) + (0, i) for i, e in enumerate(events)]
        state = session_state(self.spark.createDataFrame(rows, LOGGED).coalesce(1), order=("offset",))
        said = state.withColumn("why", scoring_gate()).orderBy("offset").select("offset", "ts", "event_type", "events", "cart_size", "cart_value", "why").collect()
        scored = {int(r["event_id"]): r["probability"] for r in predictions(state, self.ensemble, threshold).collect()}
        scores = [
            {"index": r["offset"], "ts": r["ts"], "event_type": r["event_type"], "events": r["events"], "cart_size": r["cart_size"], "cart_value": round(r["cart_value"], 2),
             "probability": scored.get(r["offset"]), "scored": r["offset"] in scored, "reason": None if r["offset"] in scored else r["why"]}
            for r in said
        ]
        # The last score counts, whatever came after it.
        final = next((x["probability"] for x in reversed(scores) if x["scored"]), None)
        return {"threshold": threshold, "scores": scores, "final": final, "at_risk": final is not None and final >= threshold}

    def stream(self, seconds: float, rate: int):
        """Takes events from the feed and indexes them at a pace: server-sent events of how far it came."""
        if self.feed is None:
            raise ValueError("no feed is configured")
        if not 0 < seconds <= MAX_SECONDS or not 0 < rate <= MAX_RATE:
            raise ValueError(f"seconds must be up to {MAX_SECONDS:g} and rate up to {MAX_RATE}")
        return self._paced(seconds, rate)

    def _paced(self, seconds: float, rate: int):
        said = lambda kind, **x: f"event: {kind}\ndata: {json.dumps(x)}\n\n"
        began, sent, due = time.monotonic(), 0, 0.0
        yield said("start", rate=rate, seconds=seconds, documents=self.coordinator.live.docs)
        while (elapsed := time.monotonic() - began) < seconds:
            # What the pace has made due by now goes into one segment.
            due = min(rate * seconds, max(1.0, rate * elapsed))
            events = self.feed.take(min(MAX_EVENTS, int(due) - sent))
            if not events and int(due) > sent:
                yield said("exhausted", documents=self.coordinator.live.docs)
                break
            if events:
                sealed = self.ingest(events)["segments"]
                sent += len(events)
                yield said("progress", sent=sent, sealed=sealed, documents=self.coordinator.live.docs, elapsed=round(time.monotonic() - began, 1))
            time.sleep(min(0.25, max(0.0, seconds - (time.monotonic() - began))))
        yield said("done", sent=sent, documents=self.coordinator.live.docs)


def handler(engine: Engine, secret: str | None = None):
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, body: bytes = b"") -> None:
            url = urlparse(self.path)
            args = {k: v[-1] for k, v in parse_qs(url.query).items()}
            if secret and url.path.startswith("/api/") and not hmac.compare_digest(self.headers.get("X-Secret", ""), secret):
                return self._send(401, {"error": "not allowed"})
            yes = lambda k: args.get(k, "").lower() in ("1", "true", "yes")
            try:
                route = (self.command, url.path)
                if route == ("GET", "/health"):
                    return self._send(200, engine.health())
                if route == ("GET", "/api/index"):
                    return self._send(200, engine.index())
                if route == ("GET", "/api/model"):
                    return self._send(200, engine.model())
                if route == ("GET", "/api/search"):
                    return self._send(200, engine.search(args.get("q", ""), int(args.get("k", 10)), int(args.get("offset", 0)), args.get("mode", "and"), yes("global_stats"), yes("explain")))
                if route == ("POST", "/api/events"):
                    return self._send(200, engine.ingest(json.loads(body)["events"]))
                if route == ("POST", "/api/predict"):
                    given = json.loads(body)
                    return self._send(200, engine.predict(given["events"], float(given.get("threshold", AT_RISK))))
                if route == ("GET", "/api/stream"):
                    lines = engine.stream(float(args.get("seconds", 10)), int(args.get("rate", 5)))
                    self.send_response(200)
                    self.send_header("Content-Type", "text/event-stream")
                    self.end_headers()
                    for line in lines:
                        self.wfile.write(line.encode())
                        self.wfile.flush()
                    return None
                return self._send(404, {"error": "no such path"})
            except (ValueError, KeyError, TypeError) as e:
                return self._send(400, {"error": str(e)})

        def do_GET(self):  # noqa: N802
            self._answer()

        def do_POST(self):  # noqa: N802
            self._answer(self.rfile.read(int(self.headers.get("Content-Length", 0))))

        def log_message(self, *_):
            pass

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080, secret: str | None = None) -> ThreadingHTTPServer:
    """The server, ready for serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(engine, secret))
