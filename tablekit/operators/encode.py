"""Encoding categorical columns, and the other column transforms of the preparation step."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import categorical_columns, col, long_form, numeric_columns
from tablekit.functions.quantiles import exact_quantiles
from tablekit.functions.ordering import number_rows
from tablekit.functions.session import broadcast_if_small
from tablekit.operators.profile import distinct_counts

#: Columns with at most this many values are one-hot encoded, the others by frequency.
ONE_HOT_MAX = 20


@dataclass
class EncodeModel:
    """one_hot: column -> sorted categories. frequency: column -> table (value, share)."""

    one_hot: dict[str, list[str]] = field(default_factory=dict)
    frequency: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def output_columns(self) -> list[str]:
        hot = [f"{c}_{v}" for c, values in self.one_hot.items() for v in values[1:]]
        return hot + [f"{c}_freq" for c in self.frequency]

    def transform(self, df: DataFrame) -> DataFrame:
        flags = {
            f"{c}_{v}": F.coalesce((col(c).cast("string") == v).cast("int"), F.lit(0))
            for c, values in self.one_hot.items()
            for v in values[1:]
        }
        if flags:
            df = df.withColumns(flags)
        for i, (c, table) in enumerate(self.frequency.items()):
            lookup = table.select(F.col("value").alias(f"_v{i}"), F.col("share").alias(f"{c}_freq"))
            df = df.join(broadcast_if_small(lookup), col(c).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        return df.drop(*self.one_hot, *self.frequency)


def fit_encoder(df: DataFrame, columns: list[str] | None = None, one_hot_max: int = ONE_HOT_MAX) -> EncodeModel:
    """One-hot (sorted, first dropped, null all zero) up to one_hot_max values, else share of non-null rows."""
    names = columns if columns is not None else categorical_columns(df)
    distinct = distinct_counts(df, names)
    model = EncodeModel()
    small = [c for c in names if distinct[c] <= one_hot_max]
    if small:
        found = long_form(df, small, "string").filter("value is not null").distinct().collect()
        for c in small:
            model.one_hot[c] = sorted(r["value"] for r in found if r["column"] == c)
    for c in names:
        if distinct[c] > one_hot_max:
            model.frequency[c] = frequencies(df, c)
    return model


def frequencies(df: DataFrame, name: str) -> DataFrame:
    """(value, share of non-null rows): counted by value, divided by a one-row total."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(col(name))).first()[0]
    return counts.select("value", (F.col("n") / F.lit(float(total or 1))).alias("share"))


def label_encode(df: DataFrame, name: str, output: str | None = None) -> DataFrame:
    """Codes 0.. in sorted value order; null stays null."""
    values = df.filter(col(name).isNotNull()).select(col(name).alias("_v")).distinct()
    codes = number_rows(values, ["_v"], output or f"{name}_code")
    return df.join(broadcast_if_small(codes), col(name) == F.col("_v"), "left").drop("_v")


def winsorise(df: DataFrame, columns: list[str] | None = None, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Clip each column to its lower and upper quantiles."""
    names = columns or numeric_columns(df)
    bounds = exact_quantiles(df, names, [lower, upper])
    return df.withColumns(
        {
            c: F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi) in bounds.items()
            if lo is not None
        }
    )


def polynomial(df: DataFrame, columns: list[str]) -> DataFrame:
    """Squares and pairwise products: {a}_sq and {a}_x_{b}."""
    new = {f"{c}_sq": col(c).cast("double") * col(c).cast("double") for c in columns}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            new[f"{a}_x_{b}"] = col(a).cast("double") * col(b).cast("double")
    return df.withColumns(new)


def bin_edges(df: DataFrame, columns: list[str], bins: int = 5) -> dict[str, list[float]]:
    """Inner edges of equally filled bins per column, duplicates removed."""
    cuts = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return {c: sorted(set(e for e in edges if e is not None)) for c, edges in cuts.items()}


def bin_columns(df: DataFrame, columns: list[str], bins: int = 5, edges: dict[str, list[float]] | None = None) -> DataFrame:
    """{column}_bin = number of edges at or below the value; null stays null."""
    edges = edges or bin_edges(df, columns, bins)
    out = {}
    for c in columns:
        number = F.lit(0)
        for e in edges[c]:
            number = number + (col(c) >= F.lit(e)).cast("int")
        out[f"{c}_bin"] = F.when(col(c).isNotNull(), number)
    return df.withColumns(out)


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 5) -> DataFrame:
    """(feature, mi): mutual information (nats) between binned columns and the label, from joint counts."""
    from pyspark.sql import Window

    binned = bin_columns(df.filter(col(label).isNotNull()), columns, bins)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), col(f"{c}_bin").alias("bin")) for c in columns]
    )
    joint = (
        binned.select(col(label).cast("string").alias("label"), F.inline(pairs))
        .filter("bin is not null")
        .groupBy("feature", "bin", "label")
        .agg(F.count("*").alias("n"))
    )
    by_feature = Window.partitionBy("feature")
    parts = joint.withColumns(
        {
            "total": F.sum("n").over(by_feature),
            "nb": F.sum("n").over(Window.partitionBy("feature", "bin")),
            "nl": F.sum("n").over(Window.partitionBy("feature", "label")),
        }
    )
    share = F.col("n") / F.col("total")
    gain = share * F.log(F.col("n") * F.col("total") / (F.col("nb") * F.col("nl")))
    return parts.groupBy("feature").agg(F.sum(gain).alias("mi"))
