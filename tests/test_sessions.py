from __future__ import annotations

import math

import numpy as np
import pytest

from siltmill.operators import dataset, metrics, sessions
from siltmill.operators.model import Ensemble, demo_ensemble, export, permutation_importance, scored, train_logistic, train_trees
from siltmill.schema import EVENT_FIELDS, EVENT_SCHEMA
from tests.reference_fold import random_events, state_after, states


@pytest.fixture(scope="module")
def events():
    return random_events(400)


@pytest.fixture(scope="module")
def table(spark, events):
    return spark.createDataFrame([tuple(e[f] for f in EVENT_FIELDS) for e in events], EVENT_SCHEMA).cache()


def folded(events):
    return states(sorted(events, key=lambda e: (e["ts"], e["event_id"])))


def test_windows_are_the_fold(events, table):
    want = folded(events)
    for r in sessions.session_state(table).collect():
        for c in sessions.STATE:
            got, expected = r[c], want[r["event_id"]][c]
            assert got == pytest.approx(expected, abs=1e-6) if isinstance(expected, float) else got == expected, (c, r["event_id"])


def test_features(events, table):
    assert len(sessions.FEATURES) == 27
    rows = {(r["session_id"], r["event_index"]): r for r in sessions.feature_rows(sessions.session_state(table)).collect()}
    want, index = folded(events), {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        i = index[e["session_id"]] = index.get(e["session_id"], -1) + 1
        s, r = want[e["event_id"]], rows[e["session_id"], i]
        duration = s["last_ts"] - s["first_ts"]
        assert r["events"] == s["events"] and r["duration"] == duration and r["max_gap"] == s["gap_max"]
        assert r["log_cart_value"] == pytest.approx(math.log1p(s["cart_value"]), abs=1e-9)
        assert r["mean_price"] == pytest.approx(s["price_sum"] / s["price_count"] if s["price_count"] else 0.0)
        assert r["events_per_minute"] == pytest.approx(s["events"] * 60 / duration if duration else 0.0)
        assert r["remove_ratio"] == pytest.approx(s["cart_removes"] / max(s["cart_adds"], 1))
        assert r["is_mobile"] == float((s["device"] or "").lower() == "mobile")
        assert r["is_weekend"] == float((s["last_ts"] // 86400 + 4) % 7 >= 5)
        assert r["hour_of_day"] == pytest.approx(s["last_ts"] % 86400 / 3600)


def plain_examples(events):
    by = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        by.setdefault(e["session_id"], []).append(e)
    out = {}
    for sid, es in by.items():
        pending = []
        for i, e in enumerate(es):
            if e["event_type"] == "purchase":
                out |= {(sid, j): False for j in pending}
                pending = []
            elif state_after(es[: i + 1])["open_adds"] > 0:
                pending.append(i)
        out |= {(sid, j): True for j in pending}
    return out


def test_labels_stats_and_split(events, table):
    rows = dataset.examples(table).cache()
    want = plain_examples(events)
    assert {(r["session_id"], r["event_index"]): r["abandoned"] for r in rows.collect()} == want
    stats = dataset.dataset_stats(table, rows).first()
    with_cart = {s for s, _ in want}
    assert (stats["events"], stats["examples"], stats["sessions_with_cart"]) == (len(events), len(want), len(with_cart))
    assert stats["sessions_converted"] == len({s for (s, _), v in want.items() if not v})
    split = dataset.time_split(rows, 0.6).cache()
    starts = sorted({r["session_start"] for r in rows.collect()})
    cutoff = starts[max(0, int(len(starts) * 0.6) - 1)]
    assert all(r["is_train"] == (r["session_start"] <= cutoff) for r in split.collect())
    assert dataset.session_overlap(split).count() == 0
    with pytest.raises(ValueError):
        dataset.split_cutoff(rows, 1.0)


def test_metrics(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300), 2)
    y = rng.random(300) < p
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, p, strict=True)], "y boolean, p double")
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y] for b in p[~y]]
    r = metrics.evaluate(df).first()
    assert r["roc_auc"] == pytest.approx(float(np.mean(pairs)))
    ap, tp, seen = 0.0, 0, 0
    for level in sorted(set(p), reverse=True):
        pos = int(y[p == level].sum())
        tp, seen = tp + pos, seen + int((p == level).sum())
        ap += pos * tp / seen
    assert r["average_precision"] == pytest.approx(ap / y.sum())
    assert r["brier"] == pytest.approx(float(np.mean((p - y) ** 2))) and r["base_rate"] == pytest.approx(float(y.mean()))
    bins = {x["bin"]: x["n"] for x in metrics.calibration(df).collect()}
    assert sum(bins.values()) == 300 and bins[9] == int((p >= 0.9).sum())
    one = metrics.evaluate(spark.createDataFrame([(True, 0.5)], "y boolean, p double")).first()
    assert one["roc_auc"] is None


def test_ensemble_forms_agree(spark, table):
    e = demo_ensemble()
    rows = dataset.examples(table)
    inline = scored(rows, e).toPandas()
    raw = e.raw(inline[list(sessions.FEATURES)].to_numpy(float))
    assert np.allclose(inline["probability"], 1 / (1 + np.exp(-raw)))
    assert Ensemble.from_json(e.to_json()) == e
    big = Ensemble(**{**e.__dict__, "feature": e.feature * 40, "threshold": e.threshold * 40, "left": e.left * 40, "right": e.right * 40, "leaf": e.leaf * 40, "value": e.value * 40, "missing_left": e.missing_left * 40, "offsets": [0, *(11 * k + o for k in range(40) for o in e.offsets[1:])]})
    walked = scored(rows, big).toPandas()
    assert np.allclose(walked["probability"], 1 / (1 + np.exp(-(0.25 + 40 * (raw - 0.25)))))
    with pytest.raises(ValueError):
        Ensemble(**{**e.__dict__, "features": sessions.FEATURES[::-1]})
    assert len(permutation_importance(rows, e)) == 27


def test_training_and_export(spark, table):
    rows = dataset.examples(table).cache()
    model = train_trees(rows, iterations=3, depth=3, min_leaf=2)
    from siltmill.operators.model import assemble

    want = [r["probability"][1] for r in model.transform(assemble(rows).orderBy("session_id", "event_index")).collect()]
    got = [r["probability"] for r in scored(rows, export(model)).orderBy("session_id", "event_index").collect()]
    assert np.allclose(got, want)
    assert train_logistic(rows).transform(assemble(rows)).count() == rows.count()


def test_expiry_uses_own_partition(spark):
    df = spark.createDataFrame([(0, "a", 100), (0, "b", 5000), (1, "c", 100), (1, "d", 1900)], "partition int, session_id string, ts long")
    assert [r["session_id"] for r in sessions.expired_sessions(df).collect()] == ["a"]
