"""Tree ensembles as flat arrays, their scoring, and training with Spark's own learners."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sessions import FEATURES

VERSION = 1
#: Ensembles up to so many nodes are scored as one expression; larger ones by a vectorised walk.
INLINE_NODES = 400


@dataclass
class Ensemble:
    """All trees' nodes one after the other; children are counted from their tree's start."""

    baseline: float
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    leaf: list[bool]
    value: list[float]
    missing_left: list[bool]
    offsets: list[int]
    features: tuple[str, ...] = FEATURES
    metrics: dict = field(default_factory=dict)
    version: int = VERSION

    def __post_init__(self):
        self.features = tuple(self.features)
        if self.features != FEATURES:
            raise ValueError(f"the model's features are {self.features}, not {FEATURES}")
        if self.version != VERSION:
            raise ValueError(f"model version {self.version} is not supported")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        return cls(**json.loads(text))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Baseline and leaves' sum for rows of features. All rows walk a tree together, a level at a time."""
        if x.ndim != 2 or x.shape[1] != len(FEATURES):
            raise ValueError(f"expected rows of {len(FEATURES)} features, got {x.shape}")
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        leaf, value, missing = np.array(self.leaf, bool), np.array(self.value, float), np.array(self.missing_left, bool)
        out, rows = np.full(len(x), float(self.baseline)), np.arange(len(x))
        for start in self.offsets[:-1]:
            at = np.full(len(x), start)
            while not leaf[at].all():
                v = x[rows, np.where(leaf[at], 0, feature[at])]
                go_left = np.where(np.isnan(v), missing[at], v <= threshold[at])
                at = np.where(leaf[at], at, start + np.where(go_left, left[at], right[at]))
            out += value[at]
        return out

    def expression(self) -> Column:
        """The same as one column expression."""

        def node(start: int, i: int) -> Column:
            k = start + i
            if self.leaf[k]:
                return F.lit(float(self.value[k]))
            x = F.col(self.features[self.feature[k]])
            go_left = x <= self.threshold[k]
            unknown = x.isNull() | F.isnan(x)
            test = (go_left & ~unknown) | unknown if self.missing_left[k] else go_left & ~unknown
            return F.when(test, node(start, self.left[k])).otherwise(node(start, self.right[k]))

        total = F.lit(float(self.baseline))
        for start in self.offsets[:-1]:
            total = total + node(start, 0)
        return total

    def sql(self) -> str:
        """The same in SQL."""

        def node(start: int, i: int) -> str:
            k = start + i
            if self.leaf[k]:
                return repr(float(self.value[k]))
            test = f"{self.features[self.feature[k]]} <= {self.threshold[k]!r}"
            return f"CASE WHEN {test} THEN {node(start, self.left[k])} ELSE {node(start, self.right[k])} END"

        return " + ".join([repr(float(self.baseline)), *(node(s, 0) for s in self.offsets[:-1])])


def sigmoid(raw: Column) -> Column:
    """The logistic function; exp of a large number is never taken."""
    small = F.exp(-F.abs(raw))
    return F.when(raw >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def score_column(ensemble: Ensemble) -> Column:
    """The probability from the 27 feature columns."""
    if len(ensemble.feature) <= INLINE_NODES:
        return sigmoid(ensemble.expression())

    @F.pandas_udf("double")
    def raw(*columns):
        import pandas as pd

        return pd.Series(ensemble.raw(np.column_stack([c.to_numpy(float) for c in columns])))

    return sigmoid(raw(*FEATURES))


def scored(rows: DataFrame, ensemble: Ensemble, name: str = "probability") -> DataFrame:
    return rows.withColumn(name, score_column(ensemble))


def demo_ensemble() -> Ensemble:
    """Three small trees for queries that need some model."""
    at = FEATURES.index
    f = [at("cart_size"), 0, 0, at("duration"), at("view_ratio"), 0, 0, 0, at("log_cart_value"), 0, 0]
    return Ensemble(
        baseline=0.25, feature=f, threshold=[1.5, 0.0, 0.0, 86_400.0, 0.25, 0.0, 0.0, 0.0, 4.5, 0.0, 0.0],
        left=[1, 0, 0, 1, 2, 0, 0, 0, 1, 0, 0], right=[2, 0, 0, 4, 3, 0, 0, 0, 2, 0, 0],
        leaf=[False, True, True, False, False, True, True, True, False, True, True],
        value=[0.0, -0.4, 0.3, 0.0, 0.0, 0.35, -0.2, 0.6, 0.0, -0.15, 0.45], missing_left=[True] * 11, offsets=[0, 3, 8, 11],
    )


def assemble(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train_trees(rows: DataFrame, label: str = "abandoned", iterations: int = 200, depth: int = 5, rate: float = 0.08, min_leaf: int = 40, seed: int = 0, held: float = 0.15, key: str = "session_id"):
    """Gradient-boosted trees; the fitted Spark model.

    Boosting ends early when it no longer betters the sessions held out for that, ``held`` of all by a hash of their
    name (rows without the column are held out by themselves).
    """
    from pyspark.ml.classification import GBTClassifier

    name = F.col(key) if key in rows.columns else F.struct(*FEATURES)
    data = assemble(rows.withColumns({"label": F.col(label).cast("double"), "held": F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1000)) < int(1000 * held)}))
    model = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, seed=seed)
    if held and data.filter("held").limit(1).count():
        model = model.setParams(validationIndicatorCol="held", validationTol=0.001)
    return model.fit(data)


def train_logistic(rows: DataFrame, label: str = "abandoned"):
    """The baseline: logistic regression on standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    steps = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", maxIter=200)]
    return Pipeline(stages=steps).fit(assemble(rows.withColumn("label", F.col(label).cast("double"))))


def export(model) -> Ensemble:
    """A fitted tree model as flat arrays; categorical splits and more than two classes are refused.

    Spark's margin counts twice in its logistic function, so leaves take that factor.
    """
    if model.numClasses != 2:
        raise ValueError("only two classes are supported")
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "leaf", "value")}
    offsets = [0]
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[tuple] = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(())
            if node.numDescendants() == 0:
                nodes[at] = (0, 0.0, 0, 0, True, 2 * weight * node.prediction())
                return at
            split = node.split()
            if "Continuous" not in split.getClass().getName():
                raise ValueError("categorical splits are not supported")
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right, False, 0.0)
            return at

        walk(tree._call_java("rootNode"))
        for node in nodes:
            for key, v in zip(out, node, strict=True):
                out[key].append(v)
        offsets.append(offsets[-1] + len(nodes))
    return Ensemble(baseline=0.0, missing_left=[True] * len(out["feature"]), offsets=offsets, **out)


def permutation_importance(rows: DataFrame, ensemble: Ensemble, label: str = "abandoned", repeats: int = 3, max_rows: int = 20_000, seed: int = 0) -> list[tuple[str, float]]:
    """Loss of average precision when a feature's values are dealt to other rows, largest first.

    Measured on at most ``max_rows`` rows, a documented bound of the measure itself; they are gathered and all
    features are permuted in one vectorised pass each.
    """
    sample = rows.select(label, *FEATURES).orderBy(F.xxhash64(*FEATURES)).limit(max_rows).toPandas()
    x, y = sample[list(FEATURES)].to_numpy(float), sample[label].to_numpy(bool)

    def precision(v: np.ndarray) -> float:
        raw = ensemble.raw(v)
        order = np.argsort(-raw, kind="stable")
        hit, s = y[order], raw[order]
        last = np.append(s[1:] != s[:-1], True)
        tp, seen = np.cumsum(hit)[last], np.nonzero(last)[0] + 1
        return float((np.diff(tp, prepend=0) * tp / seen).sum() / max(1, hit.sum()))

    rng, whole = np.random.default_rng(seed), precision(x)
    out = []
    for j, name in enumerate(FEATURES):
        drops = []
        for _ in range(repeats):
            mixed = x.copy()
            mixed[:, j] = rng.permutation(mixed[:, j])
            drops.append(whole - precision(mixed))
        out.append((name, float(np.mean(drops))))
    return sorted(out, key=lambda t: -t[1])
