from __future__ import annotations

import random

import pytest

from siltmill.operators import search as s
from siltmill.operators.index import build_index, index_shape, posting_lists, top_terms
from siltmill.operators.search import Options
from tests.reference_fold import bm25, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [" ".join(rng.choices(WORDS, weights=range(12, 0, -1), k=rng.randrange(0, 12))) for _ in range(60)]


def built(spark, corpus, size):
    df = spark.createDataFrame([(i, t, 100 + i) for i, t in enumerate(corpus)], "n long, text string, ts long")
    return build_index(df, ["text", "absent"], size, order=["n"]).cache()


@pytest.mark.parametrize("size", [60, 16])
def test_brute_force(spark, corpus, size):
    index = built(spark, corpus, size)
    segments = [[tokens(t) for t in corpus[i : i + size]] for i in range(0, len(corpus), size)]
    for query in ("alpha beta", "kappa theta", "gamma", "nothing", "alpha nothing", "the", "alpha alpha zeta"):
        for mode in ("and", "or"):
            for whole in (False, True):
                want = bm25(segments, query, mode, whole)
                got = {(r["segment"], r["doc_id"]): r["score"] for r in s.matches(index, query, Options(mode, global_stats=whole)).collect()}
                assert got.keys() == want.keys()
                assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = [(r["rank"], r["segment"], r["doc_id"]) for r in s.search(index, "alpha", Options("or", global_stats=True), digits=9).collect()]
    best = sorted(bm25(segments, "alpha", "or", True).items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    assert top == [(i + 1, *k) for i, (k, _) in enumerate(best)]


def test_sharding_does_not_change_global_scores(spark, corpus):
    scores = []
    for size in (60, 7):
        got = s.matches(built(spark, corpus, size), "alpha beta", Options("or", global_stats=True)).collect()
        scores.append({r["segment"] * size + r["doc_id"]: round(r["score"], 9) for r in got})
    assert scores[0] == scores[1]


def test_paging(spark, corpus):
    index = built(spark, corpus, 16)
    whole = [tuple(r) for r in s.search(index, "alpha", Options(top_k=100)).collect()]
    pages = [tuple(r) for o in range(0, len(whole) + 5, 5) for r in s.search(index, "alpha", Options(top_k=5, offset=o)).collect()]
    assert pages == whole and s.total_hits(index, "alpha").first()[0] == len(whole)


def test_pruning(spark, corpus):
    index = built(spark, corpus, 16)
    o = Options("or", start=100 + 20, end=100 + 33, global_stats=True)
    assert {r["segment"] for r in s.matches(index, "alpha", o).collect()} <= {1, 2}
    cost = s.cost(index, "alpha", o).first()
    assert (cost["segments_total"], cost["segments_searched"], cost["segments_pruned"]) == (4, 2, 2)
    inside = s.matches(index, "alpha", Options("or", start=120, end=133, exact_window=True)).collect()
    assert {r["segment"] * 16 + r["doc_id"] for r in inside} == {i for i, t in enumerate(corpus) if "alpha" in t and 20 <= i <= 33}


def test_plan_pushes_terms_down(spark, corpus, tmp_path):
    index = built(spark, corpus, 16)
    index.postings.write.parquet(str(tmp_path / "p"))
    stored = type(index)(index.docs, spark.read.parquet(str(tmp_path / "p")), index.termdict, index.segments)
    plan = s.search(stored, "alpha beta")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(term, [alpha,beta])" in plan and "TakeOrderedAndProject" in plan


def test_shape_and_lists(spark, corpus):
    index = built(spark, corpus, 16)
    toks = [tokens(t) for t in corpus]
    r = index_shape(index).first()
    assert (r["num_docs"], r["num_terms"], r["num_postings"]) == (60, len({t for d in toks for t in d}), sum(len(set(d)) for d in toks))
    assert r["avg_length"] == pytest.approx(sum(map(len, toks)) / 60)
    lists = {(x["segment"], x["term"]): x for x in posting_lists(index).collect()}
    assert all(list(x["doc_ids"]) == sorted(x["doc_ids"]) and sum(x["gaps"]) == x["doc_ids"][-1] for x in lists.values())
    df = {t: sum(t in d for d in toks) for t in {t for d in toks for t in d}}
    assert [tuple(x) for x in top_terms(index, 3).collect()] == sorted(((t, n) for t, n in df.items()), key=lambda x: (-x[1], x[0]))[:3]


def test_sets_and_bad_options(spark, corpus):
    index = built(spark, corpus, 16)
    p = [index.postings.filter(f"term = '{t}'") for t in ("alpha", "beta", "gamma")]
    has = lambda *ts: {i for i, t in enumerate(corpus) if all(x in tokens(t) for x in ts)}
    assert {r[0] * 16 + r[1] for r in s.intersect(*p).collect()} == has("alpha", "beta", "gamma")
    assert {r[0] * 16 + r[1] for r in s.union(*p).collect()} == has("alpha") | has("beta") | has("gamma")
    for bad in ({"mode": "xor"}, {"offset": -1}, {"k1": -1.0}, {"b": 2.0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_empty_index(spark):
    index = build_index(spark.createDataFrame([], "n long, text string"), ["text"], 10, position="n")
    r = index_shape(index).first()
    assert (r["num_docs"], r["num_postings"], r["avg_length"]) == (0, 0, 0.0)
    assert s.search(index, "alpha").collect() == []
