from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest

from siltmill.operators.model import demo_ensemble
from siltmill.schema import EVENT_FIELDS, EVENT_SCHEMA
from siltmill.service import Engine, serve
from siltmill.sources.feed import Feed, write_feed
from siltmill.sources.store import Store
from tests.reference_fold import random_events


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    engine = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("served"))), demo_ensemble())
    server = serve(engine, port=0, secret="s3")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def call(url, body=None, secret="s3"):
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"X-Secret": secret})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


EVENT = {"event_id": "a1", "ts": 1_570_000_000, "session_id": "s", "user_id": "u", "event_type": "view", "title": "Bespoke Widget XR9", "brand": "acme", "price": 42.5, "product_id": "p"}


def test_ingest_then_search(base):
    assert call(f"{base}/health", secret="")[0] == 200 and call(f"{base}/api/index", secret="no")[0] == 401
    assert call(f"{base}/api/search?q=bespoke")[1]["total"] == 0
    status, got = call(f"{base}/api/events", {"events": [EVENT, EVENT | {"event_id": "a2", "title": "Other thing"}]})
    assert status == 200 and got["accepted"] == 2 and got["searchable"]
    status, got = call(f"{base}/api/search?q=bespoke+widget&explain=1")
    assert status == 200 and got["total"] == 1 and got["hits"][0]["document"]["event_id"] == "a1" and got["cost"]["segments_searched"] == 1
    assert call(f"{base}/api/index")[1]["documents"] == 2
    for bad in ("k=0", "offset=501", "mode=xor", "k=x"):
        assert call(f"{base}/api/search?q=ab&{bad}")[0] == 400
    assert call(f"{base}/nowhere")[0] == 404


def test_predict(base):
    assert call(f"{base}/api/model")[1]["trees"] == 3
    events = [EVENT, EVENT | {"ts": 1_570_000_012}, EVENT | {"event_type": "add_to_cart", "ts": 1_570_000_030}, EVENT | {"event_type": "view", "ts": 1_570_000_055}]
    status, got = call(f"{base}/api/predict", {"events": events})
    assert status == 200 and [s["scored"] for s in got["scores"]] == [False, False, True, True] and got["threshold"] == 0.7
    assert got["final"] == got["scores"][-1]["probability"] and 0 < got["final"] < 1
    assert [(s["events"], s["cart_size"], s["cart_value"], s["event_type"]) for s in got["scores"]][2:] == [(3, 1, 42.5, "add_to_cart"), (4, 1, 42.5, "view")]
    assert got["scores"][0]["reason"] == "no open cart"
    # A purchase is not scored and settles the cart; the last score stays the final one.
    status, bought = call(f"{base}/api/predict", {"events": [*events, EVENT | {"event_type": "purchase", "ts": 1_570_000_090}]})
    assert bought["final"] == got["final"] and not bought["scores"][-1]["scored"] and bought["scores"][-1]["cart_size"] == 0 and bought["scores"][-1]["events"] == 5
    for threshold in (0.0, 1.0):
        assert call(f"{base}/api/predict", {"events": events, "threshold": threshold})[1]["at_risk"] == (got["final"] >= threshold)
    assert call(f"{base}/api/predict", {"events": []})[1]["final"] is None
    for bad in ({"events": [{}]}, {"events": events, "threshold": 2}, {"events": [EVENT | {"event_type": "stare"}]}, {"events": [EVENT] * 201}):
        assert call(f"{base}/api/predict", bad)[0] == 400


def test_stream_takes_from_the_feed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    events = spark.createDataFrame([tuple(e[f] for f in EVENT_FIELDS) for e in random_events(30)], EVENT_SCHEMA)
    write_feed(events, store, chunk=20)
    engine = Engine(spark, store, feed=Feed(store, chunk=20, start_after=5))
    said = [(x.split("\n")[0].removeprefix("event: "), json.loads(x.split("data: ")[1])) for x in engine.stream(60, 200)]
    assert [k for k, _ in said if k != "progress"] == ["start", "exhausted", "done"] and said[0][1]["documents"] == 0
    assert said[-1][1]["sent"] == 25 and engine.search("widget")["total"] == 25
    with pytest.raises(ValueError):
        Engine(spark, store).stream(1, 1)
