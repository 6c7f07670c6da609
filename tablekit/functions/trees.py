"""Spark's tree models as arrays: walks of whole batches, outputs of the first trees of an ensemble, exact Shapley values.

The nodes come from the model's own saved form. They are as large as the model, which the driver holds anyway, and go to
the tasks with the job; rows are worked on where they lie, in Arrow batches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession, functions as F

from tablekit.functions.session import shared_root


@dataclass
class Forest:
    """Nodes of all trees end to end. value has a column per output: class shares of a node, or its one prediction.

    The output is the weighted mean of the trees' values where `mean` is set, and their weighted sum otherwise.
    """

    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weights: np.ndarray
    mean: bool

    def __len__(self) -> int:
        return len(self.weights)

    def walk(self, x: np.ndarray, tree: int, depth: int | None = None) -> np.ndarray:
        """The node in which each row of x ends, or is after `depth` steps."""
        at = np.full(len(x), self.start[tree])
        rows, steps = np.arange(len(x)), 0
        while len(rows) and (depth is None or steps < depth):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            steps += 1
        return at

    def outputs(self, x: np.ndarray, sizes: list[int] | None = None, depth: int | None = None) -> list[np.ndarray]:
        """The output of the first n trees, for every n of sizes (all trees without)."""
        sizes = sizes or [len(self)]
        total, spent = np.zeros((len(x), self.value.shape[1])), 0.0
        out: dict[int, np.ndarray] = {}
        for t in range(min(max(sizes), len(self))):
            total = total + self.weights[t] * self.value[self.walk(x, t, depth)]
            spent += self.weights[t]
            out[t + 1] = total / spent if self.mean else total
        return [out[min(n, len(self))] for n in sizes]

    def base(self) -> np.ndarray:
        """The mean output over what each tree was grown on, by the shares of rows that its nodes hold."""
        roots = self.value_means()[self.start[:-1]]
        total = (self.weights[:, None] * roots).sum(axis=0)
        return total / self.weights.sum() if self.mean else total

    def value_means(self) -> np.ndarray:
        """Per node the mean of the leaves below it, weighted by their rows."""
        out = self.value.copy()
        for node in range(len(self.feature) - 1, -1, -1):  # children come after their parent
            if self.feature[node] >= 0:
                a, b = self.left[node], self.right[node]
                out[node] = (self.cover[a] * out[a] + self.cover[b] * out[b]) / self.cover[node]
        return out

    def paths(self):
        """Per leaf: weight times value, and per feature on the way (feature, low, high, share): what its splits ask of the
        feature, and the share of rows that they let through."""
        scale = self.weights / self.weights.sum() if self.mean else self.weights
        for t in range(len(self)):
            stack = [(int(self.start[t]), {})]
            while stack:
                node, asked = stack.pop()
                j = int(self.feature[node])
                if j < 0:
                    yield scale[t] * self.value[node], [(f, *a) for f, a in asked.items()]
                    continue
                low, high, share = asked.get(j, (-np.inf, np.inf, 1.0))
                cut = float(self.threshold[node])
                for child, a, b in ((self.left[node], low, min(high, cut)), (self.right[node], max(low, cut), high)):
                    stack.append((int(child), {**asked, j: (a, b, share * float(self.cover[child] / self.cover[node]))}))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values (row, feature, output): absent features follow the shares of rows at the splits.

        On the way to a leaf a feature lets a row through or not (o = 1 or 0) or, absent, a share z of rows. The mean over all
        orders of the other features is the integral of the product of (1 - t) z + t o over t from 0 to 1, a polynomial,
        which as many points as half its degree integrate exactly.
        """
        out = np.zeros((len(x), x.shape[1], self.value.shape[1]))
        rules: dict[int, tuple] = {}
        for value, asked in self.paths():
            if not asked:
                continue
            names = [a[0] for a in asked]
            low, high, share = (np.array([a[k] for a in asked]) for k in (1, 2, 3))
            own = x[:, names]
            through = ((own > low) & (own <= high)).astype(float)
            n = len(asked) // 2 + 1
            if n not in rules:
                point, weight = np.polynomial.legendre.leggauss(n)
                rules[n] = ((point + 1) / 2, weight / 2)
            part = np.zeros_like(through)
            for t, w in zip(*rules[n]):
                factor = (1 - t) * share + t * through
                part += w * factor.prod(axis=1)[:, None] / factor
            out[:, names] += ((through - share) * part)[:, :, None] * value
        return out


def _nodes(spark: SparkSession, model):
    """The saved nodes of a model, in order: (tree, id, stats, prediction, left, right, feature, threshold, rows)."""
    path = f"{shared_root(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in saved.columns else ""
    tree = F.col("treeID") if node else F.lit(0).alias("treeID")
    fields = ["id", "impurityStats", "prediction", "leftChild", "rightChild", "split.featureIndex", "rawCount"]
    cut = F.get(F.col(f"{node}split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold")
    return saved.select(tree, *[F.col(node + f) for f in fields], cut, F.col(f"{node}split.numCategories").alias("kinds")).orderBy("treeID", "id").toArrow()


def forest(spark: SparkSession, model, shares: bool) -> Forest:
    """The arrays of a fitted tree, forest or boosted ensemble of pyspark.ml. shares: values are class shares."""
    table = _nodes(spark, model)
    column = lambda name: table.column(name).to_numpy()
    tree = column("treeID")
    start = np.append(np.flatnonzero(np.diff(tree, prepend=-1)), len(tree))
    offset = start[tree]
    if (column("kinds")[column("featureIndex") >= 0] != -1).any():
        raise ValueError("splits on categories have no arrays")
    stats = np.array(table.column("impurityStats").to_pylist(), dtype=float)
    value = stats / stats.sum(axis=1, keepdims=True) if shares else column("prediction")[:, None].astype(float)
    # Statistics are class weights, or the weight, sum and sum of squares of a regression.
    cover = stats.sum(axis=1) if shares else stats[:, 0]
    left, right = column("leftChild"), column("rightChild")
    weights = getattr(model, "treeWeights", None) or [1.0]
    boosted = type(model).__name__.startswith("GBT")
    return Forest(
        start, column("featureIndex").astype(np.int64), np.nan_to_num(column("threshold").astype(float)), np.where(left >= 0, left + offset, -1),
        np.where(right >= 0, right + offset, -1), value, cover, np.array(weights, float), not boosted,
    )


def _inner(model) -> list:
    inner = getattr(model.stage, "model", None)
    return inner.models if type(inner).__name__ == "OneVsRestModel" else [inner]


def has_trees(model) -> bool:
    """Is the fitted model a tree, a forest or boosted trees?"""
    return all(any(word in type(m).__name__ for word in ("DecisionTree", "RandomForest", "GBT")) for m in _inner(model))


def tree_parts(spark: SparkSession, model) -> list[Forest]:
    """The forests of a fitted model with trees: one, or one per class where boosting sets each against the rest."""
    return [forest(spark, m, not type(m).__name__.startswith("GBT") and model.classes is not None) for m in _inner(model)]
