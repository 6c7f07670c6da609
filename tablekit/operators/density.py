"""Density clustering over a grid whose cells are no wider than the radius.

Points in one cell are all within the radius of each other. A cell with min_samples points is therefore
core as a whole and needs no pairs; only points of thinner cells, fewer than min_samples each, are
compared with the points of nearby cells, so the work stays linear in the rows. Two full cells are linked
by comparing bounding boxes of ever finer sub-cells until the question is settled. Clusters are the
connected components of the core cells.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions.components import connected_components
from tablekit.functions.neighbours import knn_join, measured, point_table, radius_join
from tablekit.functions.ordering import number_rows
from tablekit.functions.session import cut_lineage
from tablekit.operators.scale import fit_scaler

#: Points of a cell per salt; box refinements, and point pairs below which the rest is compared directly.
SALT_ROWS, LEVELS, DIRECT_PAIRS = 20_000, 16, 1_000_000


def _cell(x: Column, side: float) -> Column:
    return F.concat_ws(",", F.transform(x, lambda v: F.floor(v / side).cast("string")))


def _gaps(lo_a, hi_a, lo_b, hi_b, d: int) -> list[Column]:
    """Per coordinate the least difference of points of two boxes."""
    return [
        F.greatest(F.element_at(lo_a, j) - F.element_at(hi_b, j), F.element_at(lo_b, j) - F.element_at(hi_a, j), F.lit(0.0))
        for j in range(1, d + 1)
    ]


def _spans(lo_a, hi_a, lo_b, hi_b, d: int) -> list[Column]:
    """Per coordinate the largest difference of points of two boxes."""
    return [
        F.greatest(F.element_at(hi_a, j) - F.element_at(lo_b, j), F.element_at(hi_b, j) - F.element_at(lo_a, j))
        for j in range(1, d + 1)
    ]


def _within(differences: list[Column], eps: float, metric: str) -> Column:
    """Is a vector of non-negative differences no longer than eps?"""
    total = F.lit(0.0)
    for g in differences:
        total = F.greatest(total, g) if metric == "chebyshev" else total + (g * g if metric == "euclidean" else g)
    return total <= (eps * eps if metric == "euclidean" else eps)


def _close(a: Column, b: Column, eps: float, metric: str) -> Column:
    """Are two points within eps of each other?"""
    part = {"euclidean": lambda p, q: (p - q) * (p - q)}.get(metric, lambda p, q: F.abs(p - q))
    join = (lambda s, v: F.greatest(s, v)) if metric == "chebyshev" else (lambda s, v: s + v)
    return F.aggregate(F.zip_with(a, b, part), F.lit(0.0), join) <= (eps * eps if metric == "euclidean" else eps)


def _side(eps: float, d: int, metric: str) -> float:
    """The width of cells whose points are all within eps of each other."""
    return eps / {"euclidean": math.sqrt(d), "manhattan": d, "chebyshev": 1}[metric] * (1 - 1e-12)


def _boxes(points: DataFrame, by: list[str], d: int) -> DataFrame:
    return points.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.min(F.element_at("x", j)) for j in range(1, d + 1)]).alias("lo"),
        F.array(*[F.max(F.element_at("x", j)) for j in range(1, d + 1)]).alias("hi"),
    )


def _near_cells(cells: DataFrame, eps: float, side: float, d: int, metric: str) -> DataFrame:
    """(a, b) for ordered pairs of different cells whose boxes come within eps."""
    left = cells.select(F.col("cell").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = cells.select(F.col("cell").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    if d <= 3:
        reach = math.ceil(eps / side)
        offsets = [o for o in itertools.product(range(-reach, reach + 1), repeat=d) if any(o)]
        place = F.transform(F.split("a", ","), lambda v: v.cast("bigint"))
        shifted = F.array(
            *[
                F.concat_ws(",", *[(F.element_at(place, j + 1) + o[j]).cast("string") for j in range(d)])
                for o in offsets
            ]
        )
        pairs = left.withColumn("b", F.explode(shifted)).join(right, "b")
    else:
        middle = F.zip_with("lo", "hi", lambda p, q: (p + q) / 2)
        centres = cells.select(F.col("cell").alias("id"), middle.alias("x"))
        links = radius_join(centres, centres, 2 * eps * (1 + 1e-9), metric).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
        pairs = links.join(left, "a").join(right, "b")
    return pairs.filter(_within(_gaps(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"), d), eps, metric)).select("a", "b")


def _compare(some: DataFrame, others: DataFrame, near: DataFrame, eps: float, metric: str) -> DataFrame:
    """(id, cell, other, other_cell) for pairs within eps across near cells. `some` must hold few points
    per cell; `others` may hold hot cells, whose points are spread over salts."""
    salts = others.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / SALT_ROWS), F.lit(1)).alias("salts"))
    near = near.join(salts, near["b"] == salts["cell"]).select("a", "b", "salts")
    left = (
        some.select("id", "x", "cell")
        .join(near, some["cell"] == near["a"])
        .select("id", "x", "cell", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    )
    right = (
        others.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("cell").alias("other_cell"))
        .join(salts.select(F.col("cell").alias("other_cell"), "salts"), "other_cell")
        .withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")))
    )
    pairs = left.join(right, (F.col("b") == F.col("other_cell")) & (left["salt"] == right["salt"]))
    return pairs.filter(_close(F.col("x"), F.col("y"), eps, metric)).select("id", "cell", "other", "other_cell")


def _full_links(points: DataFrame, pairs: DataFrame, eps: float, side: float, d: int, metric: str) -> DataFrame:
    """(a, b) among pairs of full cells that hold points within eps of each other.

    State: pairs of sub-cells not settled yet. Boxes farther apart than eps drop out, boxes wholly within
    eps settle their cells, the rest is split once more, until the points left make few pairs.
    """
    linked = None
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    for level in range(LEVELS + 1):
        parent = _cell(F.col("x"), side / 2 ** max(level - 1, 0)).alias("parent")
        fine = points.select("x", _cell(F.col("x"), side / 2**level).alias("sub"), parent)
        wanted = open_pairs.select(F.col("sa").alias("parent")).union(open_pairs.select("sb")).distinct()
        boxes = _boxes(fine.join(wanted, "parent", "left_semi"), ["parent", "sub"], d)
        a, b = (
            boxes.select(
                F.col("parent").alias(f"s{p}"), F.col("sub").alias(f"n{p}"), F.col("n").alias(f"k{p}"),
                F.col("lo").alias(f"lo_{p}"), F.col("hi").alias(f"hi_{p}"),
            )
            for p in ("a", "b")
        )
        sides = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
        children = open_pairs.join(a, "sa").join(b, "sb").filter(_within(_gaps(*sides, d), eps, metric))
        children = cut_lineage(
            children.select(
                "a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"), (F.col("ka") * F.col("kb")).alias("work"),
                _within(_spans(*sides, d), eps, metric).alias("all"),
            )
        )
        settled = children.filter("all").select("a", "b").distinct()
        linked = settled if linked is None else linked.union(settled)
        left = children.filter("not all").join(settled, ["a", "b"], "left_anti")
        work = left.agg(F.sum("work")).first()[0]
        if not work:
            return linked
        open_pairs = left.select("a", "b", "sa", "sb")
        if work <= DIRECT_PAIRS:
            break
    inside = points.select("x", _cell(F.col("x"), side / 2**level).alias("sub"))
    ends = open_pairs.join(inside.select(F.col("sub").alias("sa"), "x"), "sa")
    ends = ends.join(inside.select(F.col("sub").alias("sb"), F.col("x").alias("y")), "sb")
    return linked.union(ends.filter(_close(F.col("x"), F.col("y"), eps, metric)).select("a", "b").distinct())


def dbscan_points(points: DataFrame, eps: float, min_samples: int, d: int, metric: str = "euclidean") -> DataFrame:
    """(id, cluster) for a point table: clusters numbered by their smallest id, noise -1."""
    points = measured(points, metric)
    if metric == "cosine":  # lengths of 1: the squared distance is twice one minus the cosine
        eps, metric = math.sqrt(2 * eps), "euclidean"
    side = _side(eps, d, metric)
    points = cut_lineage(points.select("id", "x", _cell(F.col("x"), side).alias("cell")))
    cells = cut_lineage(_boxes(points, ["cell"], d))
    near = cut_lineage(_near_cells(cells, eps, side, d, metric))
    full = cells.filter(F.col("n") >= min_samples).select("cell")
    thin = points.join(full, "cell", "left_anti")
    seen = _compare(thin, points, near, eps, metric).groupBy("id").agg(F.count("*").alias("seen"))
    sized = thin.join(cells.select("cell", "n"), "cell").join(seen, "id", "left")
    thin = cut_lineage(
        sized.select("id", "x", "cell", (F.col("n") + F.coalesce("seen", F.lit(0)) >= min_samples).alias("core"))
    )
    thin_core = thin.filter("core").drop("core")
    core = points.join(full, "cell", "left_semi").select("id", "x", "cell").unionByName(thin_core.select("id", "x", "cell"))
    thin_links = _compare(thin_core, core, near, eps, metric).select(F.col("cell").alias("a"), F.col("other_cell").alias("b"))
    both_full = near.filter("a < b").join(full.select(F.col("cell").alias("a")), "a", "left_semi").join(
        full.select(F.col("cell").alias("b")), "b", "left_semi"
    )
    full_points = points.join(full, "cell", "left_semi")
    edges = thin_links.distinct().unionByName(_full_links(full_points, both_full, eps, side, d, metric).select("a", "b"))
    core_cells = core.select(F.col("cell").alias("id")).distinct()
    component = cut_lineage(connected_components(core_cells, edges).select(F.col("id").alias("cell"), "component"))
    inside = core.select("id", "cell").join(component, "cell")
    names = number_rows(inside.groupBy("component").agg(F.min("id").alias("first")), ["first"], "cluster")
    component = component.join(names.select("component", "cluster"), "component").select("cell", "cluster")
    core_labels = core.select("id", "cell").join(component, "cell").select("id", "cluster")
    edge_points = thin.filter("not core").drop("core")
    same_cell = edge_points.select("id", "cell").join(component, "cell").select("id", "cluster")
    touching = _compare(edge_points, core, near, eps, metric).select("id", F.col("other_cell").alias("cell")).distinct()
    borders = touching.join(component, "cell").select("id", "cluster").unionByName(same_cell)
    borders = borders.groupBy("id").agg(F.min("cluster").alias("cluster"))
    labels = core_labels.unionByName(borders)
    return points.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def _scaled(df: DataFrame, features: list[str], scale: bool) -> DataFrame:
    return fit_scaler(df, features, "standard").transform(df) if scale else df


def dbscan(
    df: DataFrame, keys: list[str], features: list[str], eps: float = 0.5, min_samples: int = 5, scale: bool = True,
    metric: str = "euclidean",
) -> DataFrame:
    """(id, cluster): density clusters on standard-scaled features; a point counts itself. metric: euclidean, manhattan,
    chebyshev or cosine (eps is then one minus the cosine)."""
    points = point_table(_scaled(df, features, scale), keys, features)
    return dbscan_points(points, eps, min_samples, len(features), metric)


def adaptive_density(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    min_cluster_size: int = 5,
    min_samples: int | None = None,
    scale: bool = True,
    metric: str = "euclidean",
) -> DataFrame:
    """(id, cluster): the radius is read off the knee of the k-distance curve, clusters below
    min_cluster_size become noise and the rest keep their order, renumbered from 0."""
    k = min_samples or min_cluster_size
    points = cut_lineage(point_table(_scaled(df, features, scale), keys, features))
    away = knn_join(points, points, k, exclude_self=True, metric=metric).filter(F.col("rank") == k)
    labels = cut_lineage(dbscan_points(points, knee(away), k, len(features), metric))
    sizes = labels.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cluster_size)
    kept = number_rows(sizes, ["cluster"], "new").select("cluster", "new")
    return labels.join(kept, "cluster", "left").select("id", F.coalesce("new", F.lit(-1)).cast("bigint").alias("cluster"))


def knee(away: DataFrame, points: int = 200) -> float:
    """The k-distance farthest below the chord of the sorted k-distance curve."""
    curve = away.agg(F.percentile_approx("distance", [i / points for i in range(points + 1)], 10_000)).first()[0]
    first, last = curve[0], curve[-1]
    drop = [first + (last - first) * i / points - v for i, v in enumerate(curve)]
    eps = curve[drop.index(max(drop))]
    return eps if eps > 0 else max(last, 1e-12)
