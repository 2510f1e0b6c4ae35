"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over the words of a text. Each later model
also gets the earlier categories' probabilities (as log odds). The chain has as many links as there are label columns:
the labels here have one category of toxicity, and quality, which goes before it. While training, those come out of fold: the
labelled rows are split into FOLDS parts, and a row's probability is that of a model that has not seen its
part, so later models learn from probabilities as uncertain as they will meet.

Words are features by presence. The vocabulary has every word that leans LEAST_LEAN or more from independence of
some category (by the chi-square statistic) among those in at least MIN_DOCS labelled texts, or one in MIN_SHARE
of them if that is more. Rows of equal words are one text, with the mean of their labels: a group of copies counts
once, and no word takes another's place. All this is learned from at most MAX_ROWS labelled rows, picked by a hash
of their id, the one bounded sample here; so the labels used can be broadcast and texts are never shuffled, only
the sample's words are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, map_batches, written

FOLDS = 5
MIN_DOCS, MIN_SHARE = 3, 2_000
#: Least chi-square statistic of a word: among many thousand words, chance alone hardly ever gives so much.
LEAST_LEAN = 30.0
#: The documented bound on labelled rows that the models are fitted on.
MAX_ROWS = 20_000
PENALTY = 0.3
THRESHOLD = 0.5
#: In this order; each label column holds 0 or 1.
CATEGORIES = ("quality", "toxic")


def words(text: str | None) -> set[str]:
    """The distinct lower-cased words of a whole text: runs of letters and digits at white space's edge."""
    if not text:
        return set()
    return {w.strip(_EDGE) for w in text.lower().split()}


#: Punctuation that may stand around a word.
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’„…¿¡–—"


@dataclass
class Chain:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]  # for each category: vocabulary, earlier log odds, bias

    def odds(self, text: str | None) -> list[float]:
        look = self.vocabulary
        at = [look[w] for w in words(text) if w in look]
        got: list[float] = []
        for w in self.weights:
            n = len(look)
            got.append(float(w[at].sum() + sum(a * b for a, b in zip(w[n:-1], got, strict=True)) + w[-1]))
        return got


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class _Rows:
    """Sparse rows of ones, and a few dense columns."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.n, self.width = len(lists), width
        self.col = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def fit_logistic(rows: _Rows, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 150) -> np.ndarray:
    """Penalised logistic regression by accelerated gradient descent, on the rows where ``use`` is true."""
    n, k = rows.width, dense.shape[1]
    w = np.zeros(n + k + 1)
    total = max(1, int(use.sum()))
    share = np.clip(y[use].mean() if use.any() else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _sigmoid(rows.times(w[:n]) + dense @ w[n:-1] + w[-1])
        g = np.where(use, p - y, 0.0)
        grad = np.concatenate([rows.back(g), dense.T @ g, [g.sum()]]) / total
        grad[:-1] += PENALTY * w[:-1] / total
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.2 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Learns a chain from the labelled rows. Rows whose id, text or any label is null are left out.

    Without any labelled row the chain says one half for everything but calls nothing toxic.
    """
    said = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    said = said.dropna().groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    there = said.count()
    # Thinned to hardly more than the bound, so that the one task that cuts to the bound sees few rows. A rerun picks
    # the same ones.
    near = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, there))) < int(MAX_ROWS + 5 * MAX_ROWS**0.5)
    said = said.filter(near).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_ROWS)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    k = len(categories)
    ys = ", ".join(f"y{i} int" for i in range(k))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = [sorted(words(t)) for t in batch.column("text").to_pylist()]
            same = [hashlib.sha256("\n".join(w).encode()).digest() for w in found]
            return {"doc_id": batch.column("doc_id"), "same": same, "w": found} | {f"y{i}": batch.column(f"y{i}") for i in range(k)}

        return each

    rows = map_batches(texts.join(F.broadcast(said), "doc_id").select("doc_id", "text", *[f"y{i}" for i in range(k)]), make, f"doc_id long, same binary, w array<string>, {ys}")
    labelled = written(rows.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("w").alias("w"), *[F.avg(f"y{i}").alias(f"y{i}") for i in range(k)]).drop("same"))
    totals = labelled.agg(F.count("*"), *[F.coalesce(F.sum(f"y{i}"), F.lit(0.0)) for i in range(k)]).first()
    n, positive = totals[0], totals[1:]
    if not n:
        return Chain(categories, {}, [np.zeros(i + 1) for i in range(k)])
    seen = labelled.select(F.explode("w").alias("word"), *[f"y{i}" for i in range(k)]).groupBy("word").agg(F.count("*").alias("df"), *[F.sum(f"y{i}").alias(f"p{i}") for i in range(k)]).filter(F.col("df") >= max(MIN_DOCS, n // MIN_SHARE))
    leans = F.lit(False)
    for i in range(k):
        share = positive[i] / n
        if 0 < share < 1:
            leans |= (F.col(f"p{i}") - F.col("df") * share) ** 2 / (F.col("df") * share * (1 - share)) >= LEAST_LEAN
    vocabulary = {w: i for i, w in enumerate(sorted(r[0] for r in seen.filter(leans).select("word").collect()))}

    def place():
        def each(batch: pa.RecordBatch) -> dict:
            at = [[vocabulary[x] for x in w if x in vocabulary] for w in batch.column("w").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "w": at} | {f"y{i}": batch.column(f"y{i}") for i in range(k)}

        return each

    sample = map_batches(labelled, place, f"doc_id long, w array<int>, {ys.replace('int', 'double')}").orderBy("doc_id").toPandas()
    rows = _Rows([np.array(w, np.int64) for w in sample["w"]], len(vocabulary))
    fold = sample["doc_id"].map(lambda x: (x * 2654435761 >> 7) % FOLDS).to_numpy()
    dense, weights = np.zeros((rows.n, 0)), []
    for i in range(k):
        y = sample[f"y{i}"].to_numpy(float)
        weights.append(fit_logistic(rows, dense, y, np.ones(rows.n, bool)))
        if i + 1 < k:
            outside = np.zeros(rows.n)
            for f in range(FOLDS):
                w = fit_logistic(rows, dense, y, fold != f)
                z = rows.times(w[: rows.width]) + dense @ w[rows.width : -1] + w[-1]
                outside[fold == f] = z[fold == f]
            dense = np.column_stack([dense, outside])
    return Chain(categories, vocabulary, weights)


def _score(chain: Chain, prefix: str):
    def make():
        def each(texts: list) -> dict:
            z = np.array([chain.odds(t) for t in texts]).reshape(len(texts), -1)
            p = _sigmoid(z)
            return {f"{prefix}{c}": p[:, i] for i, c in enumerate(chain.categories)}

        return each

    return make


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability column for each category. Null and empty texts have no words and get the
    models' base rates. Every row and column stays; the added names must be free."""
    return append_columns(docs, text_col, _score(chain, prefix), ", ".join(f"{prefix}{c} double" for c in chain.categories))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: Chain | None = None) -> DataFrame:
    """doc_id, p_quality, p_toxic, toxic (p_toxic over THRESHOLD) for each row, repeated rows included.

    Null and empty texts have no words and get the models' base rates; null ids stay null; an empty table gives an
    empty result; other columns are ignored.
    """
    chain = chain or train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = score(rows, chain).drop("text")
    return out.withColumn("toxic", F.col("p_toxic") > THRESHOLD)
