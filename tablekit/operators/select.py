"""Feature selection. Every method returns a Selection; its report is (feature, score, kept)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from tablekit.functions.columns import as_vector, col, local_table, numeric_columns, numeric_or_zero
from tablekit.operators import cells
from tablekit.operators.profile import correlation_matrix, distinct_counts


@dataclass
class Selection:
    method: str
    features: list[str]
    kept: list[str]
    scores: dict[str, float | None] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    best_fitness: float | None = None

    @property
    def dropped(self) -> list[str]:
        return [c for c in self.features if c not in self.kept]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)

    def report(self, spark) -> DataFrame:
        rows = [(c, self.scores.get(c), c in self.kept) for c in self.features]
        return local_table(spark, rows, "feature string, score double, kept boolean")


def _coerced(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: numeric_or_zero(df, c) for c in names})


def select_variance(df: DataFrame, features: list[str] | None = None, threshold: float = 0.0) -> Selection:
    """Keep features whose population variance is above the threshold."""
    names = features or numeric_columns(df)
    x = _coerced(df, names)
    row = x.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    scores = {c: row[f"v{i}"] for i, c in enumerate(names)}
    return Selection("variance", names, [c for c in names if (scores[c] or 0.0) > threshold], scores)


def select_correlation(df: DataFrame, features: list[str] | None = None, threshold: float = 0.05) -> Selection:
    """Drop a feature when its |r| with any earlier one, kept or not, is above the threshold."""
    names = features or numeric_columns(df)
    r = correlation_matrix(_coerced(df, names), names) if len(names) > 1 else {}
    scores = {c: max((abs(r[e, c]) for e in names[:i]), default=0.0) for i, c in enumerate(names)}
    return Selection("correlation", names, [c for c in names if scores[c] <= threshold], scores)


def is_class_label(df: DataFrame, label: str) -> bool:
    """A string (or boolean) target, or one with fewer than ten values."""
    kind = df.schema[label].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return True
    return distinct_counts(df, [label])[label] < 10


def anova_scores(df: DataFrame, features: list[str], label: str) -> dict[str, float | None]:
    """One-way F per feature from per-class counts, sums and spreads: one grouped aggregate."""
    x = _coerced(df, features)
    groups = x.groupBy(col(label).alias("g")).agg(
        F.count("*").alias("n"),
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(features)],
    )
    totals = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        *[
            F.struct(
                F.sum(F.col("n") * F.col(f"m{i}")).alias("s"),
                F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}")).alias("ss"),
                F.sum(F.col("n") * F.col(f"v{i}")).alias("w"),
            ).alias(f"t{i}")
            for i in range(len(features))
        ],
    ).first()
    k, n = totals["k"], totals["n"]
    scores = {}
    for i, c in enumerate(features):
        t = totals[f"t{i}"]
        between, within = t["ss"] - t["s"] ** 2 / n, t["w"]
        usable = k > 1 and n > k and within > 0
        scores[c] = max(between, 0.0) / (k - 1) / (within / (n - k)) if usable else None
    return scores


def regression_scores(df: DataFrame, features: list[str], label: str) -> dict[str, float | None]:
    """F = r^2 / (1 - r^2) * (n - 2) per feature: one aggregate."""
    x = _coerced(df, [*features, label])
    row = x.agg(F.count("*").alias("n"), *[F.corr(col(c), col(label)).alias(f"r{i}") for i, c in enumerate(features)]).first()
    scores = {}
    for i, c in enumerate(features):
        r = row[f"r{i}"]
        if r is None or r != r:
            scores[c] = None
        else:
            scores[c] = math.inf if r * r >= 1 else r * r / (1 - r * r) * (row["n"] - 2)
    return scores


def select_kbest(df: DataFrame, label: str, k: int = 10, features: list[str] | None = None) -> Selection:
    """The k features with the highest ANOVA F (class labels) or regression F."""
    names = features or numeric_columns(df, exclude=(label,))
    scorer = anova_scores if is_class_label(df, label) else regression_scores
    scores = scorer(df, names, label)
    ranked = sorted(names, key=lambda c: (-(scores[c] if scores[c] is not None else -1.0), names.index(c)))
    best = set(ranked[: min(k, len(names))])
    return Selection("kbest", names, [c for c in names if c in best], scores)


def select_rfe(
    df: DataFrame, label: str, k: int = 10, features: list[str] | None = None, trees: int = 50, seed: int = 42
) -> Selection:
    """Recursive elimination by random-forest importance, max(1, (d - k) // 5) features per round.

    A classifying forest of many rows in few cells is grown on bootstrap counts of the cells (`cells.count_bags`).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import RandomForestRegressor

    names = features or numeric_columns(df, exclude=(label,))
    k = min(k, len(names))
    step = max(1, (len(names) - k) // 5)
    classes = is_class_label(df, label)
    data = _coerced(df.filter(col(label).isNotNull()), names)
    if classes:
        data = data.withColumn("_y", col(label).cast("string"))
        data = StringIndexer(inputCol="_y", outputCol="_label").fit(data).transform(data)
    else:
        data = data.withColumn("_label", numeric_or_zero(df, label))
    data = data.select(*[col(c) for c in names], "_label")
    bags = cells.count_bags(data, names, trees, seed) if classes and len(names) > k else None
    if bags is None:
        data = data.persist()
    make = RandomForestClassifier if classes else RandomForestRegressor
    left, history, rank = list(names), [], {}
    while len(left) > k:
        if bags:
            importance = bags.importances(left)
        else:
            vectors = data.select(as_vector(left, data).alias("_x"), "_label")
            model = make(featuresCol="_x", labelCol="_label", numTrees=trees, seed=seed).fit(vectors)
            importance = model.featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: importance[i])
        gone = {left[i] for i in order[: min(step, len(left) - k)]}
        for c in gone:
            rank[c] = -float(len(left) - k)
        history.append({"n_features": len(left), "dropped": sorted(gone)})
        left = [c for c in left if c not in gone]
    if bags:
        bags.close()
    else:
        data.unpersist()
    return Selection("rfe", names, left, {c: rank.get(c, 0.0) for c in names}, history)


def top_importances(importances: DataFrame, n: int = 20) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
