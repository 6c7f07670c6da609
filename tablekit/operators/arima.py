"""ARIMA(1,1,1), and its seasonal form (1,1,1)(1,1,1,s), by two-stage least squares.

Stage one regresses the differenced series on its own lags; stage two regresses it on its lag and the
lagged stage-one residuals (for the seasonal form also lags s and s + 1 of both). Both stages are sums
of per-chunk cross products, so long series are spread over tasks and short ones batched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.ordering import ordered_values
from tablekit.operators.forecast import CHUNK, Z95, chunks, forecast

#: Lags of the stage-one autoregression.
LONG_AR = 8
_RIDGE = 1e-9
#: Values of a series that is fitted whole, from its array.
SHORT = 1_000


def _difference(y: np.ndarray, seasonal: int | None) -> np.ndarray:
    """Differences aligned with y: the first positions that lack a predecessor are NaN."""
    w = np.full(len(y), np.nan)
    w[1:] = np.diff(y)
    if seasonal:
        d = w.copy()
        w[:] = np.nan
        w[seasonal:] = d[seasonal:] - d[:-seasonal]
    return w


def _design(w: np.ndarray, lags: list[int]) -> np.ndarray:
    x = np.full((len(w), len(lags)), np.nan)
    for j, lag in enumerate(lags):
        x[lag:, j] = w[:-lag]
    return x


def _ready(x: np.ndarray, y: np.ndarray, own: np.ndarray):
    ok = own & ~np.isnan(x).any(axis=1) & ~np.isnan(y)
    return np.column_stack([x[ok], y[ok]])


def _stage_one(w, lags):
    return np.column_stack([np.ones(len(w)), _design(w, lags)])


def _residuals(w, lags, beta):
    return w - _stage_one(w, lags) @ beta


def _stage_two(w, e, back):
    return np.column_stack([_design(w, back), _design(e, back)])


def _solve(sums: np.ndarray) -> np.ndarray:
    k = sums.shape[0] - 1
    a = sums[:k, :k]
    return np.linalg.solve(a + _RIDGE * (np.trace(a) / k + 1e-12) * np.eye(k), sums[:k, k])


def _sum_products(parts: DataFrame) -> DataFrame:
    cells = parts.select("series", F.posexplode("sums").alias("i", "v")).groupBy("series", "i").agg(F.sum("v").alias("v"))
    packed = cells.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    return packed.select("series", F.transform("c", lambda c: c["v"]).alias("sums"))


def _coefficients(parts: DataFrame, name: str) -> DataFrame:
    """Solve the summed normal equations per series: (series, name array, rss, rows)."""

    def solve(batches):
        for batch in batches:
            out = []
            for series, flat in batch.itertuples(index=False):
                flat = np.asarray(flat, float)
                rows, side = flat[-1], int(round((len(flat) - 1) ** 0.5))
                sums = flat[:-1].reshape(side, side)
                beta = _solve(sums)
                rss = max(sums[-1, -1] - 2 * beta @ sums[:-1, -1] + beta @ sums[:-1, :-1] @ beta, 0.0)
                out.append((series, beta, rss, rows))
            yield pd.DataFrame(out, columns=["series", name, "rss", "rows"])

    return _sum_products(parts).mapInPandas(solve, f"series string, {name} array<double>, rss double, rows double")


def arima_forecast(
    data: DataFrame, horizon: int = 10, ties: list[str] = (), seasonal: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """(series, step, index, forecast, lower, upper, method_used) with a 95 % band.

    Series with fewer rows than the two regressions have unknowns cannot be fitted; they get the linear trend with a
    band that widens by sqrt(step), and method_used says so.
    """
    back = [1, seasonal, seasonal + 1] if seasonal else [1]
    lags = sorted({*range(1, LONG_AR + 1), *back})
    reach = 2 * max(lags) + (seasonal or 0) + 2
    # Rows lost to differences and lags, and one equation more than unknowns, in either stage.
    lost = 1 + (seasonal or 0) + max(lags)
    needed = max(lost + len(lags) + 1, lost + max(back) + 2 * len(back) + 1)
    sizes = data.groupBy("series").agg(F.count("*").alias("n"))
    schema = "series string, step int, index bigint, forecast double, lower double, upper double"
    spans = sizes.agg(F.count_if(F.col("n").between(needed, SHORT)), F.count_if(F.col("n") > max(needed - 1, SHORT))).first()
    fitted = data.sparkSession.createDataFrame([], schema)
    if spans[0]:
        few = data.join(sizes.filter(F.col("n").between(needed, SHORT)).select("series"), "series", "left_semi")
        fitted = ordered_values(few, ties).mapInPandas(_whole(lags, back, seasonal, horizon, reach), schema)
    if spans[1]:
        many = data.join(sizes.filter(F.col("n") > max(needed - 1, SHORT)).select("series"), "series", "left_semi")
        fitted = fitted.unionByName(_in_chunks(many, sizes, horizon, ties, seasonal, chunk, lags, back, reach, schema))
    short = data.join(sizes.filter(F.col("n") < needed).select("series"), "series", "left_semi")
    fitted = fitted.withColumn("method_used", F.lit("sarima" if seasonal else "arima"))
    return fitted.unionByName(forecast(short, "trend_band", horizon, ties).withColumn("method_used", F.lit("trend_band")))


def _whole(lags, back, seasonal, horizon, reach):
    """Fit and project short series from their arrays, without a task's group for each of two stages."""

    def fit(x, w):
        z = _ready(x, w, np.ones(len(w), bool))
        sums = z.T @ z
        beta = _solve(sums)
        return beta, max(sums[-1, -1] - 2 * beta @ sums[:-1, -1] + beta @ sums[:-1, :-1] @ beta, 0.0), len(z)

    def run(batches):
        for batch in batches:
            out = []
            for name, values in batch.itertuples(index=False):
                y = np.asarray(values, float)
                w = _difference(y, seasonal)
                ar, _, _ = fit(_stage_one(w, lags), w)
                beta, rss, rows = fit(_stage_two(w, _residuals(w, lags, ar), back), w)
                out += _ahead(name, len(y), y[-_tail_rows(lags, seasonal, reach) :], ar, beta, rss, rows, lags, back, seasonal, horizon)
            yield pd.DataFrame(out, columns=["series", "step", "index", "forecast", "lower", "upper"])

    return run


def _tail_rows(lags, seasonal, reach) -> int:
    return reach + max(lags) + (seasonal or 0) + 2


def _ahead(name, n, y, ar, beta, rss, rows, lags, back, seasonal, horizon) -> list[tuple]:
    """The forecast rows of a series from its last values y and its coefficients."""
    values, spread = _project(y, ar, beta, lags, back, seasonal, horizon)
    sigma = (rss / max(rows - len(beta), 1)) ** 0.5
    out = []
    for h in range(horizon):
        band = Z95 * sigma * spread[h]
        out.append((name, h + 1, int(n + h), values[h], values[h] - band, values[h] + band))
    return out


def _in_chunks(long: DataFrame, sizes: DataFrame, horizon, ties, seasonal, chunk, lags, back, reach, schema: str) -> DataFrame:
    """Fit and project series of any length, chunk by chunk."""
    pieces = chunks(long, ties, reach, max(chunk, 2 * reach))
    pieces = pieces.persist()

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w = _difference(pdf["value"].to_numpy(float), seasonal)
        z = _ready(_stage_one(w, lags), w, pdf["own"].to_numpy(bool))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "sums": [np.append((z.T @ z).ravel(), len(z))]})

    products = "series string, sums array<double>"
    ar = _coefficients(pieces.groupBy("series", "chunk").applyInPandas(first, products), "ar").select("series", "ar")

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        w = _difference(pdf["value"].to_numpy(float), seasonal)
        e = _residuals(w, lags, np.asarray(pdf["ar"].iloc[0], float))
        z = _ready(_stage_two(w, e, back), w, pdf["own"].to_numpy(bool))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "sums": [np.append((z.T @ z).ravel(), len(z))]})

    with_ar = pieces.join(ar, "series")
    arma = _coefficients(with_ar.groupBy("series", "chunk").applyInPandas(second, products), "beta")
    tail_rows = _tail_rows(lags, seasonal, reach)
    ends = pieces.filter("own").join(sizes, "series").filter(F.col("pos") >= F.col("n") - tail_rows)
    ends = ends.groupBy("series", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("tail"))
    ends = ends.join(ar, "series").join(arma, "series").select("series", "n", "tail", "ar", "beta", "rss", "rows")

    def project(batches):
        for batch in batches:
            out = []
            for name, n, tail, ar_, beta, rss, rows in batch.itertuples(index=False):
                y = np.array([t["value"] for t in tail])
                out += _ahead(name, n, y, np.asarray(ar_), np.asarray(beta), rss, rows, lags, back, seasonal, horizon)
            yield pd.DataFrame(out, columns=["series", "step", "index", "forecast", "lower", "upper"])

    return ends.mapInPandas(project, schema)


def _project(y, ar, beta, lags, back, seasonal, horizon):
    """Point forecasts, and per step the root of the summed squared impulse responses."""
    p = len(back)
    phi, theta = beta[:p], beta[p:]
    w = _difference(y, seasonal)
    e = _residuals(w, lags, ar)
    w, e = list(np.nan_to_num(w)), list(np.nan_to_num(e))
    level = list(y)
    pulse_w, pulse_e, pulse_y = [], [], []
    start = len(w)
    for h in range(horizon):
        w.append(sum(phi[j] * w[start + h - lag] + theta[j] * e[start + h - lag] for j, lag in enumerate(back)))
        e.append(0.0)
        step = w[-1] + (level[-seasonal] - level[-seasonal - 1] if seasonal else 0.0)
        level.append(level[-1] + step)
        shock = 1.0 if h == 0 else 0.0
        pulse_e.append(shock)
        moved = shock + sum(
            phi[j] * pulse_w[h - lag] + theta[j] * pulse_e[h - lag] for j, lag in enumerate(back) if h - lag >= 0
        )
        pulse_w.append(moved)
        previous = pulse_y[-1] if pulse_y else 0.0
        season = 0.0
        if seasonal and h >= seasonal:
            season = pulse_y[h - seasonal] - (pulse_y[h - seasonal - 1] if h > seasonal else 0.0)
        pulse_y.append(previous + moved + season)
    spread = np.sqrt(np.cumsum(np.square(pulse_y)))
    return level[len(y) :], spread
