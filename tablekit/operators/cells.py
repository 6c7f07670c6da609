"""Decision trees on counted cells.

Spark's trees know a feature only by the split points that it lies between, so that rows between the same points are equal
to them. The points depend on the features and the seed alone: they are found once for all candidates of a training table,
the rows of a cell are counted, and a tree on the counts has the nodes of the tree on the rows.

A forest counts the rows of a cell anew for every tree: n rows that are each drawn Poisson(1) times are drawn Poisson(n) times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions import trees
from tablekit.functions.columns import as_vector, col, numeric_or_zero
from tablekit.operators import models
from tablekit.operators.evaluate import run_parallel

#: Bins that Spark gives a feature, features whose cells are counted, and places of a table of cells that make a partition.
BINS, FEATURES, PART = 32, 4, 100_000
#: Training rows, over all fits that run at once, from which split points are taken.
ROWS_AT_ONCE = 50_000_000
#: Tables with fewer rows are fitted on them: there a job costs more than its pass over the rows.
LEAST_ROWS = 100_000
#: A forest is grown on cells from so many rows on, with at most so many cells and at least so many rows a cell.
BAGGED_ROWS, BAGGED_CELLS, ROWS_A_CELL = 10_000_000, 4_000_000, 8
#: Rows from which a forest takes its split points, as many as Spark's forest does.
SAMPLE = 10_000
#: Trees of a forest on cells that are grown at once.
TREES_AT_ONCE = 5


def split_points(rows: DataFrame, feature: str, seed: int) -> list[float] | None:
    """The points at which Spark's trees on rows may split the feature; None where some may be missing.

    They come from a sample that depends on the rows and the seed, not on the label: a tree that predicts the feature from
    itself splits at all of them.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    data = rows.select(as_vector([feature], rows).alias("_x"), numeric_or_zero(rows, feature).alias("_y"))
    model = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", maxBins=BINS, maxDepth=models.OPEN_DEPTH, seed=seed).fit(data)
    found = trees.forest(rows.sparkSession, model, False)
    points = np.unique(found.threshold[found.feature >= 0]).tolist()
    if len(points) < BINS - 1 and data.select("_y").distinct().limit(BINS + 1).count() > len(points) + 1:
        return None
    return points


def _place(x: Column, points: list[float]) -> Column:
    """1 and the number of points below x."""

    def among(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first + 1)
        middle = (first + last) // 2
        return F.when(x <= points[middle], among(first, middle)).otherwise(among(middle + 1, last))

    return among(0, len(points))


@dataclass
class Counted:
    """A table of training cells, its frame for Spark, and a table of test cells: the features' places, the label and _n rows."""

    features: list[str]
    label: str
    classes: list[str]
    table: DataFrame
    training: DataFrame
    test: DataFrame
    rows: int
    cells: int
    seed: int

    def fit(self, params: dict) -> models.FittedModel:
        """A decision tree on the training cells. A leaf counts rows, not cells, so its least size is given as a weight."""
        least = params.get("min_samples_leaf", 1)
        estimator, kind, ignored = models._spark_estimator(
            "decision_tree", models.CLASSIFICATION, {**params, "min_samples_leaf": 1}, len(self.classes), self.rows, self.seed
        )
        # As many bins as let Spark read every cell for its split points: no feature has more than BINS places.
        estimator = estimator.setWeightCol("_n").setMaxBins(max(BINS, math.isqrt(self.cells) + 1))
        if self.rows < 2 * least:
            estimator = estimator.setMaxDepth(0)
        elif least > 1:
            estimator = estimator.setMinWeightFractionPerNode((least - 0.5) / self.rows)
        stage = models.SparkStage(estimator.fit(self.training), kind)
        return models.FittedModel("decision_tree", models.CLASSIFICATION, self.features, self.label, self.classes, stage, dict(params), ignored)

    def close(self):
        self.table.unpersist()
        self.test.unpersist()


def count_cells(training: DataFrame, test: DataFrame, label: str, features: list[str], points: list[list[float]], seed: int) -> Counted | None:
    """The cells of both tables; None where the training rows have a single class."""
    names = [f"_b{i}" for i in range(len(features))]
    parts = 1 + math.prod(len(p) + 1 for p in points) // PART

    def counted(rows: DataFrame) -> DataFrame:
        places = [_place(numeric_or_zero(rows, c), p).alias(b) for b, c, p in zip(names, features, points)]
        return rows.select(*places, col(label)).groupBy(*names, col(label)).agg(F.count("*").alias("_n")).coalesce(parts).persist()

    table = counted(training)
    frame, classes = models.training_frame(table, names, label, models.CLASSIFICATION, ["_n"])
    if len(classes) < 2:
        table.unpersist()
        return None
    cells, rows = table.agg(F.count("*"), F.sum("_n")).first()
    return Counted(names, label, classes, table, frame, counted(test), rows, cells, seed)


def sampled_points(rows: DataFrame, features: list[str], n: int, seed: int) -> list[list[float]]:
    """At most BINS - 1 split points of each feature, from a sample of about SAMPLE of the n rows: halfway between all its values,
    or between those next to its quantiles."""
    some = rows.select(*[col(c) for c in features])
    sample = np.array(some.sample(min(1.0, SAMPLE / n), seed).collect(), dtype=float).reshape(-1, len(features))
    found = []
    for x in sample.T:
        values, counts = np.unique(x, return_counts=True)
        at = np.arange(len(values) - 1)
        if len(values) > BINS:
            wanted = len(x) * np.arange(1, BINS) / BINS
            at = np.unique(np.abs(np.cumsum(counts)[:-1, None] - wanted[None, :]).argmin(axis=0))
        points = (values[at] + values[at + 1]) / 2
        found.append(points[~np.isnan(points)].tolist())
    return found


@dataclass
class Bags:
    """Cells of training rows: the features' places, _label and _bags, how often each tree has drawn a row of the cell."""

    places: dict[str, str]
    table: DataFrame
    cells: int
    trees: int
    seed: int

    def importances(self, features: list[str]) -> np.ndarray:
        """The mean importance of some of the features over the trees of a classifying forest grown on them alone."""
        from pyspark.ml.classification import RandomForestClassifier

        x = as_vector([self.places[c] for c in features], self.table).alias("_x")
        subset = "sqrt" if self.trees > 1 else "all"

        def grow(tree: int) -> np.ndarray:
            drawn = self.table.select(x, "_label", F.element_at("_bags", tree + 1).cast("double").alias("_n")).filter("_n > 0")
            # As many bins as let Spark read every cell for its split points: no feature has more than BINS places.
            forest = RandomForestClassifier(
                featuresCol="_x", labelCol="_label", weightCol="_n", numTrees=1, bootstrap=False,
                featureSubsetStrategy=subset, maxBins=max(BINS, math.isqrt(self.cells) + 1), seed=self.seed + tree,
            )
            return forest.fit(drawn).featureImportances.toArray()

        return np.mean(run_parallel([lambda t=t: grow(t) for t in range(self.trees)], TREES_AT_ONCE), axis=0)

    def close(self):
        self.table.unpersist()


def count_bags(rows: DataFrame, features: list[str], trees: int, seed: int) -> Bags | None:
    """The cells of rows(features..., _label) with their draws for each tree; None where rows are few or nearly as few as cells."""
    n = rows.count()
    if n < BAGGED_ROWS:
        return None
    points = sampled_points(rows, features, n, seed)
    if math.prod(len(p) + 1 for p in points) > BAGGED_CELLS:
        return None
    names = [f"_b{i}" for i in range(len(features))]
    placed = rows.select(*[_place(col(c), p).alias(b) for b, c, p in zip(names, features, points)], "_label")
    counted = placed.groupBy(*names, "_label").agg(F.count("*").alias("_n")).persist()
    cells = counted.count()
    if cells * ROWS_A_CELL > n:
        counted.unpersist()
        return None

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            bags = rng.poisson(batch.column("_n").to_numpy()[:, None], (len(batch), trees))
            column = pa.FixedSizeListArray.from_arrays(pa.array(bags.reshape(-1)), trees).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*names, "_label", "_bags"])

    # In a fixed order in a fixed number of parts, so that the draws depend on the cells and the seed alone.
    ordered = counted.repartition(1 + cells // PART, *names, "_label").sortWithinPartitions(*names, "_label")
    schema = ", ".join(f"{b} int" for b in names) + ", _label double, _bags array<bigint>"
    drawn = ordered.mapInArrow(draw, schema)
    label = F.col("_label").alias("_label", metadata=rows.schema["_label"].metadata)
    table = drawn.select(*names, label, "_bags").persist()
    table.count()
    counted.unpersist()
    return Bags(dict(zip(features, names)), table, cells, trees, seed)
