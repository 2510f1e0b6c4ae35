from __future__ import annotations

import gzip
import json

import pytest

from siltmill.schema import EVENT_FIELDS, EVENT_SCHEMA, conform, validated
from siltmill.sources import clickstream as cs

HEADER = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session"
ROWS = [
    "2019-10-01 00:00:01 UTC,view,11,2,electronics.smartphone,apple,1302.48,5,s1",
    "2019-10-01 00:00:04 UTC,cart,12,2,, acme ,0.00,6,s2",
    "2019-10-01 00:01:04 UTC,purchase,12,2,tools.hand_saw,,x,6,s2",
    "2019-10-01 00:02:04 UTC,browse,12,2,tools,,1,6,s3",
    "never,view,12,2,tools,,1,6,s3",
    "2019-10-01 00:03:04 UTC,view,13",
    "2019-10-01 00:03:09 UTC,remove_from_cart,13,2,tools,bolt,,7,",
    "2019-10-01 25:61:61 UTC,view,13,2,tools,bolt,3.5,7,s1",
]


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿" + "\n".join([HEADER, *ROWS]) + "\n", encoding="utf-8")
    return str(p)


def test_load(spark, path):
    df = cs.load_events(spark, path)
    assert df.columns == list(EVENT_FIELDS)
    got = sorted(r.asDict().items() for r in df.collect())
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: r["event_id"])
    assert [r["event_id"] for r in rows] == [f"r_{i:09d}" for i in range(1, 6)] and got
    assert [r["event_type"] for r in rows] == ["view", "add_to_cart", "purchase", "remove_from_cart", "view"]
    assert rows[0]["ts"] == 1569888001 and rows[4]["ts"] == 1569888000 + 25 * 3600 + 61 * 60 + 61
    assert rows[1]["brand"] == "acme" and rows[1]["category"] is None and rows[1]["price"] == 0.0
    assert rows[2]["price"] is None and rows[2]["brand"] is None and rows[3]["session_id"] == ""
    assert validated(df.select(*EVENT_FIELDS)).count() == 5
    assert [r["title"] for r in cs.load_events(spark, path, titles=False).collect()] == [None] * 5
    assert cs.load_events(spark, path, limit=2).count() == 2


def test_gzip_and_column_order(spark, tmp_path):
    names = HEADER.split(",")[::-1]
    rows = [",".join(r.split(",")[::-1]) for r in ROWS[:3]]
    p = tmp_path / "y.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join([",".join(names), *rows]) + "\n")
    assert cs.load_events(spark, str(p)).filter("user_id = '6'").count() == 2


def test_missing_column(spark, tmp_path):
    p = tmp_path / "z.csv"
    p.write_text("event_time,brand\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        cs.load_events(spark, str(p))


def test_stats(spark, path):
    cleaned = cs.clean(cs.read_raw(spark, path)).cache()
    s = cs.load_stats(cleaned).first()
    assert (s["rows_read"], s["rows_skipped"], s["events"], s["missing_brand"], s["missing_category"]) == (8, 3, 5, 1, 1)
    reasons = {r["reason"]: r["count"] for r in cs.skip_reasons(cleaned).collect()}
    assert reasons == {"malformed row": 1, "unknown event_type 'browse'": 1, "unparseable event_time": 1}


def test_slice(spark, path, tmp_path):
    raw = cs.read_raw(spark, path)
    out = cs.slice_sessions(raw, sessions=1, scan_limit=100)
    assert [r["user_session"] for r in out.collect()] == ["s1", "s1"]
    cs.write_slice(out, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        cs.slice_sessions(raw, sessions=0)


def test_jsonl_keeps_nulls(spark, path, tmp_path):
    cs.write_jsonl(cs.load_events(spark, path), str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json").read_text().splitlines()[0]
    assert list(json.loads(line)) == list(EVENT_FIELDS)


def test_conform_and_validate(spark):
    df = spark.createDataFrame([("e", 1, "zoom")], "event_id string, ts int, extra string")
    assert conform(df).schema.names == list(EVENT_FIELDS)
    bad = spark.createDataFrame([("e", 1, "s", "u", "dance", *[None] * 5, None, None)], EVENT_SCHEMA)
    with pytest.raises(Exception, match="unknown event_type dance"):
        validated(bad).collect()
    with pytest.raises(ValueError):
        validated(df)
