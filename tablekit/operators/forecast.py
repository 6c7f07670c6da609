"""Time series: always per series key, ordered by a time column, many series in one job.

Series may be long: statistics that need the order go through (series, bucket) windows or position
chunks with a short halo, never through one task per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablekit.functions.columns import categorical_columns, col, is_temporal, numeric_columns
from tablekit.functions.ordering import fill_along, with_position
from tablekit.operators.profile import date_columns, numeric_stats

Z95 = 1.96


def detect_date_column(df: DataFrame) -> str | None:
    """The first temporal column, or string column whose values all parse."""
    strings = date_columns(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
    return next((f.name for f in df.schema if is_temporal(df, f.name) or f.name in strings), None)


def default_target(df: DataFrame, exclude: list[str] = ()) -> str:
    """The numeric column with the largest variance."""
    names = numeric_columns(df, exclude)
    if not names:
        raise ValueError("no numeric column")
    stats = numeric_stats(df, names)
    return max(names, key=lambda c: stats[c].std_samp or 0.0)


def series(df: DataFrame, value: str, order_by: str, keys: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """The long form every operator here takes: series, ts, value (nulls dropped), ties."""
    name = F.concat_ws("~", *[col(k).cast("string") for k in keys]) if keys else F.lit("all")
    data = df.select(
        name.alias("series"), col(order_by).alias("ts"), col(value).cast("double").alias("value"), *[col(t) for t in ties]
    )
    return data.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def summary(data: DataFrame, min_rows: int = 10) -> DataFrame:
    """n, mean, std, min, max per series with at least min_rows observations."""
    return (
        data.groupBy("series")
        .agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .filter(F.col("n") >= min_rows)
    )


# -- regular grids ----------------------------------------------------------------------------------

_STEP = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}
_UNIT = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def regularise(data: DataFrame, frequency: str = "D", rows: int | None = None) -> DataFrame:
    """One row per period between the first and last observation of each series: (series, ts, value).

    The value is the mean of the period's observations; empty periods take the last value before them,
    leading ones the first after them.
    """
    unit, step = _UNIT[frequency], F.expr(_STEP[frequency])
    periods = data.groupBy("series", F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("ts")).agg(
        F.avg("value").alias("value")
    )
    spans = periods.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = spans.select("series", F.explode(F.sequence("a", "b", step)).alias("ts"))
    full = grid.join(periods, ["series", "ts"], "left")
    full = fill_along(full, ["value"], ["series"], "ts", rows=rows)
    return fill_along(full, ["value"], ["series"], "ts", backward=True, rows=rows)


def date_range(data: DataFrame) -> DataFrame:
    return data.groupBy("series").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))


# -- closed-form forecasts --------------------------------------------------------------------------


def _last(ties: list[str]) -> Column:
    return F.max_by("value", F.struct("ts", *[col(t) for t in ties]))


def _tail(data: DataFrame, n: int, ties: list[str]) -> DataFrame:
    """The last n rows per series with their distance from the end (1 = last); a per-task top n first."""
    back = Window.partitionBy("series").orderBy(F.desc("ts"), *[F.desc(t) for t in ties])
    return data.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)


def _steps(stats: DataFrame, horizon: Column) -> DataFrame:
    return stats.withColumn("step", F.explode(F.sequence(F.lit(1), horizon.cast("int"))))


METHODS = ("naive", "mean", "drift", "moving_avg", "linear", "exp_smoothing", "trend_band", "arima", "sarima")


def forecast(
    data: DataFrame, method: str = "naive", horizon: int = 10, ties: list[str] = (), min_rows: int | None = None
) -> DataFrame:
    """(series, step, index, forecast, lower, upper) for every series that is long enough.

    index is the 0-based position the step stands for. naive, mean and drift need horizon + 2 rows, the
    others 3. The band is +-1.96 sigma with the population sigma (1 when it is 0), widened by
    sqrt(0.5 * step) for linear and sqrt(step) for trend_band. drift evaluates the fitted line one step
    later than its index, linear exactly on it.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    if method in ("arima", "sarima"):
        from tablekit.operators.arima import arima_forecast

        return arima_forecast(data, horizon, ties, seasonal=12 if method == "sarima" else None)
    needed = min_rows or (horizon + 2 if method in ("naive", "mean", "drift") else 3)
    base = data.groupBy("series").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sigma"),
        _last(ties).alias("last"),
    )
    base = base.filter(F.col("n") >= needed).withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0))
    widen: Column = F.lit(1.0)
    step = F.col("step").cast("double")
    if method == "naive":
        value = F.col("last")
    elif method == "mean":
        value = F.col("mean")
    elif method == "moving_avg":
        recent = _tail(data, 7, ties).groupBy("series").agg(F.avg("value").alias("recent"))
        base, value = base.join(recent, "series"), F.col("recent")
    elif method == "exp_smoothing":
        from tablekit.operators.smoothing import fit_smoothing

        base, value = base.join(fit_smoothing(data, ties).select("series", "level"), "series"), F.col("level")
    else:
        base = base.join(trend(data, ties).drop("n"), "series")
        ahead = F.col("n") + step - (0 if method == "drift" else 1)
        value = F.col("intercept") + F.col("slope") * ahead
        if method == "linear":
            widen = F.sqrt(0.5 * step)
        elif method == "trend_band":
            widen = F.sqrt(step)
    rows = _steps(base, F.least(F.lit(horizon), F.col("n")) if method in ("naive", "mean", "drift") else F.lit(horizon))
    band = Z95 * F.col("sigma") * widen
    return rows.select(
        "series",
        "step",
        (F.col("n") + F.col("step") - 1).cast("bigint").alias("index"),
        value.alias("forecast"),
        (value - band).alias("lower"),
        (value + band).alias("upper"),
    )


def trend(data: DataFrame, ties: list[str] = ()) -> DataFrame:
    """(series, n, slope, intercept): least squares of the value on its 0-based position."""
    placed = with_position(data, ["series"], "ts", list(ties))
    x = F.col("_pos").cast("double")
    return placed.groupBy("series").agg(
        F.count("*").alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept")
    )


def envelope(data: DataFrame, ties: list[str] = (), min_rows: int = 3) -> DataFrame:
    """Per series: n, last observed value, mean, population std, min and max."""
    return (
        data.groupBy("series")
        .agg(
            F.count("*").alias("n"),
            _last(ties).alias("last_observed"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .filter(F.col("n") >= min_rows)
    )


def history(data: DataFrame, ties: list[str] = (), n: int = 100) -> DataFrame:
    """The last n observations per series for display: (series, back, ts, value)."""
    return _tail(data, n, list(ties)).select("series", F.col("back").cast("bigint").alias("back"), "ts", "value")


# -- chunks with a halo -----------------------------------------------------------------------------

#: Positions per chunk.
CHUNK = 200_000


def chunks(data: DataFrame, ties: list[str], halo: int, size: int = CHUNK) -> DataFrame:
    """(series, chunk, pos, value, own): each chunk also holds the `halo` rows before it (own = false)."""
    placed = with_position(data, ["series"], "ts", list(ties), "pos")
    home = F.floor(F.col("pos") / size)
    # A row is in the halo of every chunk whose start lies within `halo` positions after it.
    reach = F.floor((F.col("pos") + halo) / size)
    return placed.select(
        "series", "pos", "value", home.alias("home"), F.explode(F.sequence(home, reach)).alias("chunk")
    ).select("series", "chunk", "pos", "value", (F.col("home") == F.col("chunk")).alias("own"))


#: MacKinnon's published response surface for one variable with a constant (fixed values).
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    terms = _SMALL_P if tau <= _TAU_STAR else _LARGE_P
    z = sum(c * tau**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _lagged(pdf: pd.DataFrame, lags: int) -> np.ndarray:
    """Rows (1, y[t-1], dy[t-1..t-lags], dy[t]) for the chunk's own positions that have all lags."""
    pdf = pdf.sort_values("pos")
    y, pos, own = pdf["value"].to_numpy(float), pdf["pos"].to_numpy(), pdf["own"].to_numpy(bool)
    dy = np.diff(y)
    rows = np.flatnonzero(own & (np.arange(len(y)) >= lags + 1) & (pos >= lags + 1))
    columns = [np.ones(len(rows)), y[rows - 1]] + [dy[rows - 1 - k] for k in range(1, lags + 1)] + [dy[rows - 1]]
    return np.column_stack(columns)


def max_lag(n: int) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def stationarity(data: DataFrame, ties: list[str] = (), fixed_lag: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Augmented Dickey-Fuller with a constant: (series, n, lag, statistic, p_value, is_stationary).

    Chunks give cross products and series sums of them give every lag order. AIC picks the lag on the
    common sample; the statistic is refitted on the lag's own sample, whose extra rows come from the first
    few values of the series.
    """
    sizes = data.groupBy("series").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    top = max_lag(longest) if fixed_lag is None else fixed_lag
    pieces = chunks(data, ties, top + 1, max(chunk, 2 * top + 2)).join(sizes, "series")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        limit = max_lag(n) if fixed_lag is None else fixed_lag
        x = _lagged(pdf, limit)
        head = pdf[pdf["pos"] <= limit].sort_values("pos")["value"].to_numpy(float)
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "n": [n], "sums": [(x.T @ x).ravel()], "head": [head]})

    parts = pieces.groupBy("series", "chunk").applyInPandas(
        products, "series string, n bigint, sums array<double>, head array<double>"
    )
    heads = parts.filter(F.size("head") > 0).select(F.col("series").alias("_s"), "head")
    cells = parts.select("series", "n", F.posexplode("sums").alias("i", "v"))
    total = cells.groupBy("series", "n", "i").agg(F.sum("v").alias("v"))
    whole = total.groupBy("series", "n").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("cells"))
    whole = whole.join(heads, F.col("series") == F.col("_s")).select(
        "series", "n", F.transform("cells", lambda c: c["v"]).alias("sums"), "head"
    )

    def test(batches):
        for batch in batches:
            rows = []
            for s, n, sums, head in batch.itertuples(index=False):
                rows.append((s, n, *_adf(np.asarray(sums, float), np.asarray(head, float), fixed_lag)))
            yield pd.DataFrame(rows, columns=["series", "n", "lag", "statistic", "p_value", "is_stationary"])

    return whole.mapInPandas(
        test, "series string, n bigint, lag int, statistic double, p_value double, is_stationary boolean"
    )


def _adf(sums: np.ndarray, head: np.ndarray, fixed_lag: int | None):
    width = int(round(len(sums) ** 0.5))
    limit = width - 3
    common = sums.reshape(width, width)

    def fit(g):
        """t statistic of y[t-1] and AIC from cross products of (design, target)."""
        k, rows = g.shape[0] - 1, g[0, 0]
        a, b = g[:k, :k], g[:k, k]
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        rss = max(g[k, k] - beta @ b, 0.0)
        if rows <= k or rss <= 0:
            return math.nan, math.inf
        t = beta[1] / math.sqrt(rss / (rows - k) * inverse[1, 1])
        return t, rows * (math.log(2 * math.pi) + math.log(rss / rows) + 1) + 2 * k

    def order(lag):
        return [*range(lag + 2), width - 1]

    if fixed_lag is not None:
        lag = fixed_lag
    else:
        lag = min(range(limit + 1), key=lambda p: fit(common[np.ix_(order(p), order(p))])[1])
    own = common[np.ix_(order(lag), order(lag))]
    if lag < limit:
        first = pd.DataFrame({"pos": np.arange(len(head)), "value": head, "own": True})
        early = _lagged(first, lag)
        own = own + early.T @ early
    statistic, _ = fit(own)
    if math.isnan(statistic):
        return lag, None, None, None
    p = adf_p_value(statistic)
    return lag, statistic, p, p < 0.05
