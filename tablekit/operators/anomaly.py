"""Anomaly detection: isolation forest and a kernel-mean boundary."""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import col, numeric_columns
from tablekit.functions.hashing import row_hash, with_hash_cutoffs
from tablekit.functions.neighbours import _matrix
from tablekit.functions.quantiles import exact_quantiles
from tablekit.functions.session import cut_lineage, spread
from tablekit.operators.clean import FillModel, fit_fill
from tablekit.operators.scale import ScaleModel, fit_scaler

#: Rows per isolation tree, rows of a series scored together, and rows of a series scored where its forest grows.
SUBSAMPLE, SLOT_ROWS, SHORT = 256, 50_000, 1_000
FEATURES = 256


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.md5("~".join(map(str, parts)).encode()).digest()[:4], "big")


def average_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(x: np.ndarray, rng) -> tuple[list, list, list, list]:
    """One isolation tree as parallel arrays: feature (-1 = leaf), cut, left child, path length at leaves."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    paths = average_path(np.arange(len(x) + 1))
    d = x.shape[1]
    if d == 1:
        x = np.sort(x, axis=0)
    draws = rng.random((2 * len(x) + 1, 2))
    feature, cut, left, path = [], [], [], []
    todo = deque([(x, 0)])
    while todo:
        part, depth = todo.popleft()
        node = len(feature)
        low, high = (part[:1].ravel(), part[-1:].ravel()) if d == 1 else (part.min(axis=0), part.max(axis=0))
        usable = np.flatnonzero(high > low)
        if depth >= limit or not len(usable):
            feature.append(-1), cut.append(0.0), left.append(0)
            path.append(depth + float(paths[len(part)]))
            continue
        j = int(usable[int(draws[node, 0] * len(usable))])
        at = float(low[j] + draws[node, 1] * (high[j] - low[j]))
        # Children are queued in order, so the left one's number is known now and the right one follows it.
        feature.append(j), cut.append(at), path.append(0.0), left.append(node + 1 + len(todo))
        if d == 1:
            k = int(np.searchsorted(part[:, 0], at))
            todo += [(part[:k], depth + 1), (part[k:], depth + 1)]
        else:
            side = part[:, j] < at
            todo += [(part[side], depth + 1), (part[~side], depth + 1)]
    return feature, cut, left, path


def _depths(x: np.ndarray, tree) -> np.ndarray:
    feature, cut, left, path = (np.asarray(v) for v in tree)
    node = np.zeros(len(x), dtype=int)
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return path[node].astype(float)
        rows = np.flatnonzero(inner)
        at = node[rows]
        node[rows] = left[at] + (x[rows, feature[at]] >= cut[at])


@dataclass
class Detector:
    """Fill, scale, score; rows scored below the threshold are anomalies."""

    features: list[str]
    fill: FillModel
    scaler: ScaleModel
    scorer: object
    output: str = "anomaly_score"
    threshold: float | None = None

    def scores(self, df: DataFrame) -> DataFrame:
        ready = self.scaler.transform(self.fill.transform(df.withColumns({f"_s{i}": col(c) for i, c in enumerate(self.features)})))
        return ready.withColumn(self.output, self.scorer(F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(len(self.features))]))).drop(
            *[f"_s{i}" for i in range(len(self.features))]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """df with anomaly_score and is_anomaly (1 / 0)."""
        return self.scores(df).withColumn("is_anomaly", (F.col(self.output) < F.lit(self.threshold)).cast("int"))

    def anomalies(self, df: DataFrame, n: int = 50) -> DataFrame:
        """The n lowest scores among the anomalies: a display, every anomaly is in transform."""
        return self.transform(df).filter("is_anomaly = 1").orderBy(self.output).limit(n)

    def summary(self, df: DataFrame) -> DataFrame:
        return self.transform(df).agg(
            F.count("*").alias("n_total"), F.sum("is_anomaly").alias("n_anomalies"), F.avg("is_anomaly").alias("anomaly_rate")
        )


def _prepare(df: DataFrame, features: list[str]):
    """Mean fill and standard scaling, fitted on copies so that the caller's columns stay as they are."""
    copies = df.withColumns({f"_s{i}": col(c).cast("double") for i, c in enumerate(features)})
    names = [f"_s{i}" for i in range(len(features))]
    fill = fit_fill(copies, names, [], "mean")
    scaler = fit_scaler(fill.transform(copies), names, "standard")
    return fill, scaler, scaler.transform(fill.transform(copies)), names


def _lowest(vectors: DataFrame, n: int, trees: int, sample: int, seed: int, near: bool) -> DataFrame:
    """(tree, t, h, x): for every tree the rows of vectors(x, h) with its `sample` lowest hashes, and a few more. near: only
    hashes below what `sample` of n rows stay under by twelve standard deviations, so that little leaves a task."""
    share = (sample + 12 * sample**0.5 + 64) / max(n, 1)
    bound = np.uint64(share * 2.0**64) if near and share < 1 else np.uint64(2**64 - 1)
    salts = np.array([_seed(seed, "tree", t) for t in range(trees)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keep(batches):
        held: pd.DataFrame | None = None
        for batch in batches:
            h = batch["h"].to_numpy(np.int64).view(np.uint64)
            for k in range(0, len(h), 4_096):
                t = (h[k : k + 4_096, None] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
                t = (t ^ (t >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                t ^= t >> np.uint64(29)
                row, tree = np.nonzero(t <= bound)
                part = pd.DataFrame({"tree": tree.astype(np.int32), "t": (t[row, tree] >> np.uint64(1)).astype(np.int64), "h": batch["h"].to_numpy()[k + row], "x": batch["x"].to_numpy()[k + row]})
                held = part if held is None else pd.concat([held, part], ignore_index=True)
                if len(held) > 4 * sample * trees:
                    held = held.sort_values(["t", "h"]).groupby("tree").head(sample)
        if held is not None and len(held):
            yield held.sort_values(["t", "h"]).groupby("tree").head(sample)

    return vectors.select("h", "x").mapInPandas(keep, "tree int, t long, h long, x array<double>")


def fit_isolation_forest(
    df: DataFrame,
    features: list[str] | None,
    keys: list[str],
    contamination: float = 0.1,
    trees: int = 100,
    seed: int = 42,
    sample: int = SUBSAMPLE,
) -> Detector:
    """Every tree grows on the `sample` rows whose keys hash lowest for it (all rows, if fewer), taken in one pass over the
    table: a task keeps the lowest rows of each tree, and the tasks' rows are merged per tree. score = -2 ** (-mean depth /
    c(sample)); the threshold is the exact contamination quantile."""
    features = features or numeric_columns(df, exclude=keys)
    fill, scaler, ready, names = _prepare(df, features)
    vectors = ready.select(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names]).alias("x"), F.xxhash64(*[col(k) for k in keys], F.lit(seed)).alias("h"))
    vectors = vectors.persist()
    n = vectors.count()
    drawn = _lowest(vectors, n, trees, sample, seed, True)
    if n > sample and drawn.groupBy("tree").count().filter(F.col("count") < sample).count():
        drawn = _lowest(vectors, n, trees, sample, seed, False)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = _matrix(pdf.sort_values(["t", "h"])["x"].iloc[:sample])
        feature, cut, left, path = _grow(x, np.random.default_rng(_seed(seed, tree)))
        return pd.DataFrame({"tree": [tree], "rows": [len(x)], "feature": [feature], "cut": [cut], "left": [left], "path": [path]})

    schema = "tree int, rows int, feature array<int>, cut array<double>, left array<int>, path array<double>"
    grown = spread(drawn, "tree").groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()
    vectors.unpersist()
    forest = [tuple(np.array(r[c]) for c in ("feature", "cut", "left", "path")) for r in grown]
    scale = float(np.mean(average_path([r["rows"] for r in grown]))) or 1.0
    shared = df.sparkSession.sparkContext.broadcast((forest, scale))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        forest, scale = shared.value
        m = _matrix(x)
        return pd.Series(-np.exp2(-sum(_depths(m, t) for t in forest) / len(forest) / scale)) if len(m) else pd.Series([], dtype=float)

    return _with_threshold(Detector(features, fill, scaler, score), df, contamination)


def _with_threshold(detector: Detector, df: DataFrame, share: float) -> Detector:
    scored = cut_lineage(detector.scores(df).select(detector.output))
    detector.threshold = exact_quantiles(scored, [detector.output], [share])[detector.output][0]
    return detector


def fit_kernel_boundary(
    df: DataFrame, features: list[str] | None, keys: list[str], nu: float = 0.1, seed: int = 42, size: int = FEATURES
) -> Detector:
    """Score = mean similarity to all rows under an RBF kernel of width 1 / d, through random Fourier
    features; the lowest nu (0.01 to 0.5) share is outside the boundary."""
    features = features or numeric_columns(df, exclude=keys)
    nu = min(0.5, max(0.01, nu))
    fill, scaler, ready, names = _prepare(df, features)
    d = len(features)
    rng = np.random.default_rng(seed)
    energy = ready.agg(F.avg(sum((F.pow(F.col(c), 2) for c in names), F.lit(0.0)))).first()[0] or float(d)
    gamma = 1.0 / max(energy, 1e-12)
    weights = rng.normal(0, np.sqrt(2 * gamma), size=(d, size))
    phase = rng.uniform(0, 2 * np.pi, size=size)

    def lift(m: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / size) * np.cos(m @ weights + phase)

    def sums(batches):
        total, count = np.zeros(size), 0
        for batch in batches:
            z = lift(_matrix(batch["x"]))
            total, count = total + z.sum(axis=0), count + len(z)
        yield pd.DataFrame({"i": np.arange(size), "s": total, "n": count})

    vectors = ready.select(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names]).alias("x"))
    parts = vectors.mapInPandas(sums, "i int, s double, n bigint").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"))
    mean = np.zeros(size)
    for r in parts.collect():
        mean[r["i"]] = r["m"] or 0.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(lift(_matrix(x)) @ mean) if len(x) else pd.Series([], dtype=float)

    return _with_threshold(Detector(features, fill, scaler, score), df, nu)


def _leaves(x: np.ndarray, size: int, trees: int, seed: int, name: str) -> tuple[np.ndarray, ...]:
    """Trees as _grow makes them, all at once, over draws of `size` of the values x: (tree, from, path) of the leaves of each
    tree by the value from which they hold."""
    own, draws = np.empty((trees, size)), np.empty((trees, 2 * size + 1))
    for t in range(trees):
        rng = np.random.default_rng(_seed(seed, name, t))
        own[t] = x[rng.choice(len(x), size=size, replace=False)]
        draws[t] = rng.random((2 * size + 1, 2))[:, 1]
    own.sort(axis=1)
    limit = int(np.ceil(np.log2(max(size, 2))))
    paths = average_path(np.arange(size + 1))
    tree, first, low, high = np.arange(trees), np.full(trees, -np.inf), np.zeros(trees, int), np.full(trees, size)
    before, leaves = np.zeros(trees, int), []
    for depth in range(limit + 1):
        # Nodes of a depth come tree by tree from left to right, which is how _grow numbers them.
        number = before[tree] + np.arange(len(tree)) - np.searchsorted(tree, tree)
        before += np.bincount(tree, minlength=trees)
        least, most = own[tree, np.minimum(low, size - 1)], own[tree, np.maximum(high - 1, 0)]
        inner = (high > low) & (most > least) & (depth < limit)
        leaves.append((tree[~inner], first[~inner], depth + paths[high[~inner] - low[~inner]]))
        tree, first, low, high, least, most = (v[inner] for v in (tree, first, low, high, least, most))
        if not len(tree):
            break
        cut = least + draws[tree, number[inner]] * (most - least)
        left, right = low.copy(), high.copy()
        while (left < right).any():
            middle = (left + right) // 2
            less = (left < right) & (own[tree, np.minimum(middle, size - 1)] < cut)
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
        pair = lambda a, b: np.column_stack([a, b]).ravel()
        tree, first, low, high = np.repeat(tree, 2), pair(first, cut), pair(low, left), pair(left, high)
    tree, first, path = (np.concatenate(v) for v in zip(*leaves))
    # Of leaves from the same value only the deepest right one, found last, can hold one.
    order = np.lexsort((first, tree))
    return tree[order], first[order], path[order]


def _forest_scores(leaves: tuple[np.ndarray, ...], trees: int, size: int, at: np.ndarray) -> np.ndarray:
    """Scores at ascending values."""
    tree, first, path = leaves
    start = np.searchsorted(at, first)
    end = np.append(start[1:], len(at))
    end[np.append(tree[1:] != tree[:-1], True)] = len(at)
    total = np.zeros(len(at))
    for depths in np.repeat(path, end - start).reshape(trees, len(at)):
        total += depths
    return -np.exp2(-(total / trees) / (float(average_path(size)) or 1.0))


def series_anomalies(
    data: DataFrame, contamination: float = 0.05, ties: list[str] = (), seed: int = 42, trees: int = 100, sample: int = SUBSAMPLE
) -> DataFrame:
    """(series, ts, value, anomaly_score, is_anomaly): a one-column forest over the values of each series.

    The sample * trees rows of a series that hash lowest are its pool, and each of its trees grows on `sample` rows of
    it; the threshold is the series' own quantile. A short series is its own pool and is scored where its forest grows.
    """
    order = list(ties) or ["ts"]
    digest = row_hash(["series", *order], seed)
    short = min(SHORT, sample * trees)
    sizes = data.groupBy("series").agg(F.count("*").alias("_n"))
    few, many = sizes.agg(F.count_if(F.col("_n") <= short), F.count_if(F.col("_n") > short)).first()
    parts = []
    if few or not many:
        own = data.join(sizes.filter(F.col("_n") <= short).select("series"), "series", "left_semi") if many else data
        parts.append(_scored_whole(own, digest, seed, trees, sample))
    if many:
        own = data.join(sizes.filter(F.col("_n") > short).select("series"), "series", "left_semi") if few else data
        parts.append(_scored_in_slots(own, order, digest, seed, trees, sample))
    scored = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    # Few distinct scores per series: count them, then take the quantile from the counts.
    counts = scored.groupBy("series", "anomaly_score").agg(F.count("*").alias("n"))
    limits = counts.groupBy("series").agg(F.percentile("anomaly_score", F.lit(contamination), F.col("n")).alias("_limit"))
    return scored.join(limits, "series").withColumn("is_anomaly", (F.col("anomaly_score") < F.col("_limit")).cast("int")).drop("_limit")


def _scored_whole(data: DataFrame, digest, seed: int, trees: int, sample: int) -> DataFrame:
    """data with anomaly_score, for short series."""

    @F.pandas_udf("array<double>")
    def scores(series: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for name, x in zip(series, values):
            x = np.asarray(x, float)
            size = min(sample, len(x))
            at, place = np.unique(x, return_inverse=True)
            out.append(_forest_scores(_leaves(x, size, trees, seed, name), trees, size, at)[place])
        return pd.Series(out, dtype=object)

    rest = [c for c in data.columns if c not in ("series", "value")]
    row = F.struct(digest.alias("_h"), "value", *[col(c) for c in rest])
    rows = spread(data, "series").groupBy("series").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    found = rows.withColumn("scores", scores("series", F.transform("rows", lambda r: r["value"])))
    each = found.select("series", F.explode(F.arrays_zip("rows", "scores")).alias("r"))
    return each.select(*[F.col("series") if c == "series" else F.col("r.rows")[c].alias(c) for c in data.columns], F.col("r.scores").alias("anomaly_score"))


def _scored_in_slots(data: DataFrame, order: list[str], digest, seed: int, trees: int, sample: int) -> DataFrame:
    """data with anomaly_score, for series of any length."""
    own = with_hash_cutoffs(data, digest, F.array(F.least(F.lit(sample * trees), F.col("n")).cast("bigint")), F.col("series"))
    slots = F.ceil(F.col("_n") / SLOT_ROWS)
    pool = own.filter(F.col("_h") <= F.element_at("_cut", 1)).select("series", "value", "_h")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["series"].iloc[0]
        x = pdf.sort_values("_h")["value"].to_numpy(float)
        size = min(sample, len(x))
        leaves = _leaves(x, size, trees, seed, name)
        # One column: a forest is a step function, so its scores where leaves begin say everything.
        cuts = np.unique(leaves[1])
        return pd.DataFrame({"series": [name], "cuts": [cuts[1:]], "scores": [_forest_scores(leaves, trees, size, cuts)]})

    forests = spread(pool, "series").groupBy("series").applyInPandas(grow, "series string, cuts array<double>, scores array<double>")
    # A long series is scored in slots of about SLOT_ROWS rows; its forest goes to each of them.
    keyed = own.withColumn("_slot", F.pmod(F.xxhash64("series", *order), slots)).select(*data.columns, "_slot")
    sizes = data.groupBy("series").agg(F.count("*").alias("_n"))
    copies = forests.join(sizes, "series").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1))).drop("_n")

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left.assign(anomaly_score=[]).drop(columns="_slot")
        cuts, scores = np.asarray(right["cuts"].iloc[0], float), np.asarray(right["scores"].iloc[0], float)
        return left.assign(anomaly_score=scores[np.searchsorted(cuts, left["value"].to_numpy(), side="right")]).drop(columns="_slot")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema) + ", anomaly_score double"
    return keyed.groupBy("series", "_slot").cogroup(copies.groupBy("series", "_slot")).applyInPandas(apply, schema)
