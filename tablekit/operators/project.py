"""Projection: principal components of the mean-filled, standard-scaled numeric columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import as_vector, col, local_table, numeric_columns
from tablekit.operators.clean import FillModel, fit_fill
from tablekit.operators.scale import ScaleModel, fit_scaler


@dataclass
class Projection:
    """Fill, scale and rotate; the sign of a component makes its largest loading positive."""

    features: list[str]
    fill: FillModel
    scaler: ScaleModel
    pca: object
    signs: list[float]
    method_used: str = "pca"

    @property
    def ratios(self) -> list[float]:
        return [float(v) for v in self.pca.explainedVariance]

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep..., pc1, pc2, ..."""
        ready = self.scaler.transform(self.fill.transform(df))
        scored = self.pca.transform(ready.withColumn("_x", as_vector(self.features, ready)))
        parts = vector_to_array("_pc")
        axes = [(F.element_at(parts, i + 1) * F.lit(s)).alias(f"pc{i + 1}") for i, s in enumerate(self.signs)]
        return scored.select(*[col(c) for c in keep], *axes)

    def explained(self, spark) -> DataFrame:
        """(component, ratio, cumulative)."""
        rows, total = [], 0.0
        for i, r in enumerate(self.ratios, 1):
            total += r
            rows.append((i, r, total))
        return local_table(spark, rows, "component int, ratio double, cumulative double")


def fit_pca(df: DataFrame, features: list[str] | None = None, k: int = 2) -> Projection:
    """min(k, columns, rows) components."""
    names = features or numeric_columns(df)
    k = min(k, len(names), df.count())
    fill = fit_fill(df, names, [], "mean")
    filled = fill.transform(df)
    scaler = fit_scaler(filled, names, "standard")
    ready = scaler.transform(filled)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(ready.select(as_vector(names, ready).alias("_x")))
    loadings = model.pc.toArray()
    signs = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    return Projection(names, fill, scaler, model, signs)


def project(df: DataFrame, method: str = "pca", features: list[str] | None = None, k: int = 2) -> Projection:
    """Any requested non-linear method (umap, tsne) is served by principal components."""
    if method.lower() not in ("pca", "umap", "tsne", "t-sne"):
        raise ValueError(f"unknown projection method: {method}")
    return fit_pca(df, features, k)


def plot_points(df: DataFrame, keys: list[str], features: list[str], labels: DataFrame) -> DataFrame:
    """(id, x, y, ...label columns): the first two components joined to labels by id."""
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    model = fit_pca(df, features, 2)
    placed = model.transform(df.withColumn("id", ident), ["id"]).withColumnRenamed("pc1", "x")
    placed = placed.withColumnRenamed("pc2", "y") if "pc2" in placed.columns else placed.withColumn("y", F.lit(0.0))
    return placed.join(labels, "id")
