"""Synthetic minority rows: SMOTE and ADASYN over the exact neighbour join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import col, numeric_or_zero
from tablekit.functions.hashing import unit_interval, with_hash_cutoffs
from tablekit.functions.neighbours import knn_join, point_table
from tablekit.functions.session import collect_bounded, cut_lineage
from tablekit.operators.models import MAX_CLASSES
from tablekit.operators.sample import class_counts, oversample

NEIGHBOURS = 5


def _counts(df: DataFrame, label: str) -> dict:
    """Rows per class; a null label is no class, and its rows only pass through."""
    known = class_counts(df, label).filter("label is not null")
    return {r["label"]: r["n"] for r in collect_bounded(known, MAX_CLASSES, "classes")}


def _new_rows(per_row: DataFrame, near: DataFrame, k: int, seed: int) -> DataFrame:
    """(parent, copy, x): per_row(id, x, copies) meets a hash-chosen neighbour, and the new point lies a
    hash-chosen part of the way to it."""
    copies = per_row.filter("copies > 0").select("id", "x", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    pick = F.md5(F.concat_ws("~", "id", "copy", F.lit(f"{seed}:neighbour")))
    drawn = copies.withColumns(
        {
            "rank": (F.floor(unit_interval(pick) * k) + 1).cast("int"),
            "u": unit_interval(F.md5(F.concat_ws("~", "id", "copy", F.lit(f"{seed}:step")))),
        }
    )
    targets = near.select("id", "rank", F.col("nx"))
    met = drawn.join(targets, ["id", "rank"])
    u = F.col("u")
    moved = F.transform(F.arrays_zip("x", "nx"), lambda p: p["x"] + (p["nx"] - p["x"]) * u)
    return met.select(F.col("id").alias("parent"), "copy", moved.alias("x"))


def _with_targets(near: DataFrame, points: DataFrame) -> DataFrame:
    """near with the neighbour's coordinates."""
    there = points.select(F.col("id").alias("neighbour"), F.col("x").alias("nx"))
    return near.join(there, "neighbour")


def _finish(df: DataFrame, keys: list[str], features: list[str], label: str, parts: list[DataFrame]) -> DataFrame:
    """Original rows (features coerced to numbers) and synthetic ones: features..., label, source_id, synthetic."""
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    result = df.select(
        *[numeric_or_zero(df, c).alias(c) for c in features], col(label), ident.alias("source_id"), F.lit(False).alias("synthetic")
    )
    for part in parts:
        result = result.unionByName(
            part.select(
                *[F.element_at("x", i + 1).alias(c) for i, c in enumerate(features)],
                F.col("_label").cast(df.schema[label].dataType).alias(label),
                F.concat_ws("~", "parent", "copy").alias("source_id"),
                F.lit(True).alias("synthetic"),
            )
        )
    return result


def _even_copies(points: DataFrame, wanted: int, n: int, seed: int) -> DataFrame:
    """points with copies that add up to wanted: wanted // n each, one more for the rows that hash lowest."""
    digest = F.md5(F.concat_ws("~", "id", F.lit(f"{seed}:copies")))
    cut = with_hash_cutoffs(points, digest, F.array(F.lit(wanted % n).cast("bigint")))
    more = (F.col("_h") <= F.element_at("_cut", 1)).cast("bigint")
    return cut.select("id", "x", (F.lit(wanted // n) + more).alias("copies"))


def _fallback(df: DataFrame, keys, features, label, seed) -> DataFrame:
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    grown = oversample(df, keys, label, seed)
    return grown.select(
        *[numeric_or_zero(df, c).alias(c) for c in features],
        col(label),
        F.concat_ws("~", ident, F.when(F.col("copy") > 0, F.col("copy").cast("string"))).alias("source_id"),
        (F.col("copy") > 0).alias("synthetic"),
    )


def smote(df: DataFrame, keys: list[str], features: list[str], label: str, seed: int = 42) -> DataFrame:
    """Every class grows to the majority count with points between a row and one of its
    k = min(smallest class - 1, 5) nearest rows of the same class; fewer than two rows in the smallest
    class gives plain oversampling."""
    counts = _counts(df, label)
    smallest, largest = min(counts.values()), max(counts.values())
    if smallest < 2:
        return _fallback(df, keys, features, label, seed)
    k = min(smallest - 1, NEIGHBOURS)
    parts = []
    for value, n in counts.items():
        if n == largest:
            continue
        points = cut_lineage(point_table(df.filter(col(label) == F.lit(value)), keys, features))
        near = _with_targets(knn_join(points, points, k, exclude_self=True), points)
        parts.append(_new_rows(_even_copies(points, largest - n, n, seed), near, k, seed).withColumn("_label", F.lit(value)))
    return _finish(df, keys, features, label, parts)


def adasyn(df: DataFrame, keys: list[str], features: list[str], label: str, seed: int = 42) -> DataFrame:
    """As smote, but a row gets copies in proportion to the share of other classes among its k nearest rows
    of any class. A class whose rows have no such neighbours has no hard rows to prefer: its copies are spread evenly, as
    smote does. Fewer than three rows in the smallest class gives plain oversampling."""
    counts = _counts(df, label)
    smallest, largest = min(counts.values()), max(counts.values())
    if smallest < 3:
        return _fallback(df, keys, features, label, seed)
    k = min(smallest - 1, NEIGHBOURS)
    everyone = cut_lineage(point_table(df, keys, features, {"cls": col(label).cast("string")}))
    parts = []
    for value, n in counts.items():
        if n == largest:
            continue
        points = everyone.filter(F.col("cls") == F.lit(str(value)))
        around = knn_join(points, everyone, k, exclude_self=True, carry="cls")
        hardness = around.groupBy("id").agg(F.avg((F.col("cls") != F.lit(str(value))).cast("double")).alias("r"))
        hardness = cut_lineage(points.select("id", "x").join(hardness, "id"))
        total = hardness.agg(F.sum("r")).first()[0]
        own = points.select("id", "x")
        if total:
            per_row = hardness.select("id", "x", F.round(F.col("r") / total * (largest - n)).cast("bigint").alias("copies"))
        else:
            per_row = _even_copies(own, largest - n, n, seed)
        near = _with_targets(knn_join(own, own, k, exclude_self=True), own)
        parts.append(_new_rows(per_row, near, k, seed).withColumn("_label", F.lit(value)))
    return _finish(df, keys, features, label, parts)
