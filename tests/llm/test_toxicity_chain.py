"""The classifier chain against a plain one: vocabulary by counting, dense fits, out-of-fold odds."""

from __future__ import annotations

import numpy as np
import pytest

from siltmill.llm import toxicity


def plain_fit(x, y, steps=150):
    """Penalised logistic regression on dense rows; the last column of the result is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    penalty = np.append(np.full(x.shape[1] - 1, toxicity.PENALTY), 0.0)
    m = v = 0.0
    for t in range(1, steps + 1):
        grad = (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + penalty * w) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.2 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(260):
        quality, toxic = int(rng.random() < 0.5), int(rng.random() < 0.3)
        words = [f"w{k}" for k in rng.integers(0, 60, 30)]
        words += ["good"] * (quality and rng.random() < 0.9) + ["vile", "Scum!"] * (toxic and rng.random() < 0.9)
        rows.append((i, " ".join(words)))
        labels.append((i, quality, toxic))
    rows += [(1000 + k, rows[5][1]) for k in range(40)] + [(2000, None)]
    labels += [(1000 + k, 1, 0) for k in range(40)] + [(2000, 1, 1), (3000, 1, 1), (7, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_is_plain(table):
    docs, labels = table
    chain = toxicity.train(docs, labels)
    # Rows of equal words are one text with the mean of their labels.
    text = {r[0]: r[1] for r in docs.collect()}
    groups: dict[frozenset, list] = {}
    for i, *y in labels.collect():
        if text.get(i) is not None and None not in y:
            groups.setdefault(frozenset(toxicity.words(text[i])), []).append((i, y))
    rows = sorted((min(i for i, _ in g), w, np.mean([y for _, y in g], axis=0)) for w, g in groups.items())
    y = np.array([r[2] for r in rows])
    n = len(rows)
    vocabulary = []
    for word in sorted({w for r in rows for w in r[1]}):
        has = np.array([word in r[1] for r in rows])
        df = has.sum()
        if df < max(toxicity.MIN_DOCS, n // toxicity.MIN_SHARE):
            continue
        share = y.mean(axis=0)
        lean = (y[has].sum(axis=0) - df * share) ** 2 / (df * share * (1 - share))
        if (lean >= toxicity.LEAST_LEAN).any():
            vocabulary.append(word)
    assert sorted(chain.vocabulary) == vocabulary and {"vile", "scum"} <= set(vocabulary)
    x = np.array([[w in r[1] for w in sorted(chain.vocabulary, key=chain.vocabulary.get)] for r in rows], float)
    np.testing.assert_allclose(chain.weights[0], plain_fit(x, y[:, 0]), atol=1e-8)
    # The second link is fitted on odds from models that have not seen the row's fold, and not on others.
    fold = np.array([(r[0] * 2654435761 >> 7) % toxicity.FOLDS for r in rows])
    outside = np.zeros(n)
    for f in range(toxicity.FOLDS):
        w = plain_fit(x[fold != f], y[fold != f, 0])
        outside[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    np.testing.assert_allclose(chain.weights[1], plain_fit(np.column_stack([x, outside]), y[:, 1]), atol=1e-8)
    w = chain.weights[0]
    leaked = plain_fit(np.column_stack([x, x @ w[:-1] + w[-1]]), y[:, 1])
    assert abs(leaked - chain.weights[1]).max() > 1e-4
    # A prediction goes through the chain in order.
    got = toxicity.toxicity(docs, labels, chain=chain).collect()
    for r in got:
        own = np.array([w in toxicity.words(text[r["doc_id"]]) for w in sorted(chain.vocabulary, key=chain.vocabulary.get)], float)
        first = own @ w[:-1] + w[-1]
        second = np.append(own, first) @ chain.weights[1][:-1] + chain.weights[1][-1]
        assert r["p_toxic"] == pytest.approx(1 / (1 + np.exp(-second)), abs=1e-9) and r["toxic"] == (second > 0)


def test_bound_is_exact(table, monkeypatch):
    docs, labels = table
    monkeypatch.setattr(toxicity, "MAX_ROWS", 100)
    seen = []
    keep = toxicity.written

    def spy(df):
        out = keep(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "written", spy)
    toxicity.train(docs, labels)
    assert 60 < seen[0] <= 100
