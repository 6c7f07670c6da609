"""Scaling: fit a few numbers per column, transform as a projection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.functions.columns import col, numeric_columns
from tablekit.functions.quantiles import exact_quantiles
from tablekit.functions.session import cut_lineage
from tablekit.operators.profile import NumericStats, numeric_stats


@dataclass
class ScaleModel:
    """method per table and parameters per column."""

    method: str
    params: dict[str, dict] = field(default_factory=dict)

    def expression(self, name: str) -> Column:
        p = self.params[name]
        value = F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
        if self.method == "quantile":
            return normal_quantile(interpolate(value, p["knots"]))
        if self.method == "power":
            value = yeo_johnson(value, p["lambda"])
        return (value - F.lit(p["centre"])) / F.lit(p["spread"])

    def transform(self, df: DataFrame) -> DataFrame:
        names = [c for c in self.params if c in df.columns]
        return df.withColumns({c: self.expression(c) for c in names}) if names else df


def mean_abs_skew(stats: dict[str, NumericStats]) -> float:
    """Mean absolute bias-adjusted skewness over the columns that have one."""
    values = [abs(s.adjusted_skew) for s in stats.values() if s.adjusted_skew is not None]
    return sum(values) / len(values) if values else 0.0


def auto_method(stats: dict[str, NumericStats]) -> str:
    skew = mean_abs_skew(stats)
    return "power" if skew > 1.0 else "quantile" if skew > 0.5 else "standard"


#: Knots of the empirical distribution, unless fit_scaler is told otherwise.
KNOTS = 1_000


def fit_scaler(
    df: DataFrame, columns: list[str] | None = None, method: str = "standard", knots: int = KNOTS
) -> ScaleModel:
    """standard (population std), minmax, robust, power, quantile (with `knots` points), auto or none."""
    names = columns if columns is not None else numeric_columns(df)
    if method == "none" or not names:
        return ScaleModel("none")
    if method == "robust":
        quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
        params = {
            c: {"centre": q[1], "spread": (q[2] - q[0]) or 1.0} for c, q in quartiles.items() if q[0] is not None
        }
        return ScaleModel("robust", params)
    stats = numeric_stats(df, names, skew=method == "auto")
    if method == "auto":
        method = auto_method(stats)
    known = {c: s for c, s in stats.items() if s.mean is not None}
    if method == "standard":
        return ScaleModel(method, {c: {"centre": s.mean, "spread": _spread(s)} for c, s in known.items()})
    if method == "minmax":
        return ScaleModel(method, {c: {"centre": s.min, "spread": (s.max - s.min) or 1.0} for c, s in known.items()})
    if method == "power":
        return _fit_power(df, known)
    if method == "quantile":
        return _fit_quantile(df, known, knots)
    raise ValueError(f"unknown scaling method: {method}")


def _spread(stats: NumericStats) -> float:
    """Population std, 1 for a constant column (also when rounding leaves a tiny residue)."""
    if not stats.std_pop or stats.min == stats.max:
        return 1.0
    return stats.std_pop


# -- power ------------------------------------------------------------------------------------------


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    two = 2.0 - lam
    down = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(1 - x, F.lit(two)) - 1) / two
    return F.when(x >= 0, up).otherwise(down)


#: Exponents tried per pass, the span of the first pass, and the number of passes.
_LAMBDAS, _SPAN, _PASSES = 21, (-3.0, 5.0), 4


def _known(c: str) -> Column:
    """A column as doubles, NaN as null."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def _fit_power(df: DataFrame, stats: dict[str, NumericStats]) -> ScaleModel:
    """Maximum-likelihood exponent per column: one aggregate per pass evaluates a grid for all columns,
    and the next pass zooms in on the best cell."""
    spans = {c: _SPAN for c in stats}
    best = {}
    for _ in range(_PASSES):
        grids = {c: [lo + (hi - lo) * i / (_LAMBDAS - 1) for i in range(_LAMBDAS)] for c, (lo, hi) in spans.items()}
        best = _best_lambda(df, grids, {c: s.mean or 0.0 for c, s in stats.items()})
        step = {c: (hi - lo) / (_LAMBDAS - 1) for c, (lo, hi) in spans.items()}
        spans = {c: (best[c] - step[c], best[c] + step[c]) for c in spans}
    names = list(stats)
    moments = df.agg(
        *[
            F.struct(
                F.avg(yeo_johnson(_known(c), best[c])).alias("m"),
                F.stddev_pop(yeo_johnson(_known(c), best[c])).alias("s"),
            ).alias(f"t{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    params = {}
    for i, c in enumerate(names):
        m = moments[f"t{i}"]
        spread = 1.0 if stats[c].min == stats[c].max else (m["s"] or 1.0)
        params[c] = {"lambda": best[c], "centre": m["m"], "spread": spread}
    return ScaleModel("power", params)


def _best_lambda(df: DataFrame, grids: dict[str, list[float]], centres: dict[str, float]) -> dict[str, float]:
    """Log-likelihood = -n/2 log var(transformed) + (lambda - 1) sum sign(x) log(|x| + 1), per column."""
    scores = likelihoods(df, grids, centres)
    best = {}
    for c, lams in grids.items():
        found = [(scores.get((c, i), -math.inf), -i) for i in range(len(lams))]
        score, at = max(found)
        best[c] = lams[-at] if score > -math.inf else 1.0
    return best


def likelihoods(df: DataFrame, grids: dict[str, list[float]], centres: dict[str, float]) -> dict[tuple[str, int], float]:
    """Log-likelihood per column and place in its grid, where the transformed column varies.

    Every task folds its rows to counts and sums per column and exponent; the sums are taken around the transformed
    centre of the column, so that they add up without loss."""
    names = list(grids)
    width = max(map(len, grids.values()), default=0)
    shifts = {c: [float(_yeo_johnson_at(np.array([centres[c]]), lam)[0]) for lam in grids[c]] for c in names}

    def fold(batches):
        total = np.zeros((len(names), width, 4))
        for batch in batches:
            for j, c in enumerate(names):
                x = batch[f"c{j}"].to_numpy(float)
                x = x[~np.isnan(x)]
                logs = float((np.sign(x) * np.log1p(np.abs(x))).sum())
                for i, lam in enumerate(grids[c]):
                    y = _yeo_johnson_at(x, lam) - shifts[c][i]
                    total[j, i] += len(x), logs, y.sum(), (y * y).sum()
        j, i = (v.ravel() for v in np.indices(total.shape[:2]))
        n, logs, s1, s2 = total.reshape(-1, 4).T
        yield pd.DataFrame({"j": j, "i": i, "n": n, "logs": logs, "s1": s1, "s2": s2})

    folded = df.select(*[_known(c).alias(f"c{j}") for j, c in enumerate(names)]).mapInPandas(fold, "j int, i int, n double, logs double, s1 double, s2 double")
    out = {}
    for r in folded.groupBy("j", "i").agg(*[F.sum(v).alias(v) for v in ("n", "logs", "s1", "s2")]).collect():
        c = names[r["j"]]
        spread = r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2 if r["n"] else 0.0
        if spread > 0:
            out[c, r["i"]] = -0.5 * r["n"] * math.log(spread) + (grids[c][r["i"]] - 1) * r["logs"]
    return out


def _yeo_johnson_at(x: np.ndarray, lam: float) -> np.ndarray:
    """yeo_johnson of an array."""
    two = 2.0 - lam
    up, down = np.maximum(x, 0.0), np.maximum(-x, 0.0)
    above = np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam
    below = -np.log1p(down) if abs(two) < 1e-12 else -(np.power(down + 1, two) - 1) / two
    return np.where(x >= 0, above, below)


# -- quantile ---------------------------------------------------------------------------------------

_CLIP = 5.199337582605575


def _fit_quantile(df: DataFrame, stats: dict[str, NumericStats], knots: int = KNOTS) -> ScaleModel:
    """Knots are the observed values at `knots` evenly spaced ranks (all ranks, if fewer), exact at every size."""
    return ScaleModel("quantile", {c: {"knots": _knots(df, c, s.count, min(knots, s.count))} for c, s in stats.items()})


def _knots(df: DataFrame, column: str, n: int, knots: int) -> list[tuple[float, float]]:
    """(value, mean probability) per distinct value at the ranks floor(i (n - 1) / (knots - 1)): ties map to the middle
    of their run, the ends to 0 and 1. Values are counted, sorted in ranges, and only those at a rank come back."""
    if knots < 2:
        first = df.select(F.min(_known(column))).first()[0]
        return [(0.0 if first is None else float(first), 0.0)]
    counts = df.select(_known(column).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    placed = cut_lineage(counts.sort("v").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(F.broadcast(starts), "part").withColumn("upto", F.col("start") + F.sum("n").over(inside))
    first = F.ceil((F.col("upto") - F.col("n")) * (knots - 1) / (n - 1))
    last = F.least(F.ceil(F.col("upto") * (knots - 1) / (n - 1)) - 1, F.lit(knots - 1))
    rows = upto.select("v", first.alias("a"), last.alias("b")).filter("a <= b").orderBy("v").collect()
    points = [(r["v"], (r["a"] + r["b"]) / 2 / (knots - 1)) for r in rows]
    if len(points) > 1:
        points[0] = (points[0][0], 0.0)
        points[-1] = (points[-1][0], 1.0)
    return points


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup by binary search, vectorised over Arrow batches."""
    xs = np.array([p[0] for p in points])
    ys = np.array([p[1] for p in points])

    @F.pandas_udf("double")
    def lookup(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, np.interp(v, xs, ys)))

    return F.nanvl(lookup(x), F.lit(None).cast("double"))


#: Acklam's published coefficients of the inverse normal distribution function (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal as a column expression, clipped near +-5.2."""
    q = p - 0.5
    r = q * q
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(_C, t) / (_poly(_D, t) * t + 1)
    signed = F.when(p < 0.5, tail).otherwise(-tail)
    value = F.when(F.least(p, 1 - p) <= 1e-7, F.when(p < 0.5, F.lit(-_CLIP)).otherwise(F.lit(_CLIP))).when(
        F.least(p, 1 - p) < 0.02425, signed
    ).otherwise(middle)
    return F.when(p.isNotNull(), F.greatest(F.least(value, F.lit(_CLIP)), F.lit(-_CLIP)))
