"""Cross products as one distributed sum: the data behind every linear fit.

Each task folds its Arrow batches into small matrices with numpy and emits them once as (group, i, j,
value) rows; Spark sums those rows. Nothing but d x d numbers per group leaves a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import col


def gram(df: DataFrame, names: list[str], by: str | None = None) -> dict:
    """{group: d x d matrix of sums of products} over doubles without nulls; the group is 0 without by.

    Groups must be few (folds, instances): their matrices come to the driver.
    """
    d = len(names)
    grp = col(by).cast("bigint") if by else F.lit(0).cast("bigint")
    data = df.select(grp.alias("g"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def fold(batches):
        sums = {}
        for batch in batches:
            groups = batch["g"].to_numpy()
            x = batch.iloc[:, 1:].to_numpy(dtype=float)
            for g in np.unique(groups):
                part = x[groups == g]
                sums[g] = sums.get(g, 0.0) + part.T @ part
        i, j = np.divmod(np.arange(d * d), d)
        for g, m in sums.items():
            yield pd.DataFrame({"g": np.full(d * d, g), "i": i, "j": j, "v": m.ravel()})

    parts = data.mapInPandas(fold, "g bigint, i bigint, j bigint, v double")
    result: dict = {}
    for r in parts.groupBy("g", "i", "j").agg(F.sum("v").alias("v")).collect():
        result.setdefault(r["g"], np.zeros((d, d)))[r["i"], r["j"]] = r["v"]
    return result


def pairwise_correlation(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r per pair on pairwise-complete rows, for tables too wide for inline aggregates."""
    d = len(names)
    means = df.agg(*[F.coalesce(F.avg(F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    centre = np.array([means[f"m{i}"] for i in range(d)])
    data = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def fold(batches):
        total = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            ok = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sq = x * x
            total += np.stack([ok.T @ ok, x.T @ ok, ok.T @ x, sq.T @ ok, ok.T @ sq, x.T @ x])
        i, j = np.divmod(np.arange(d * d), d)
        flat = total.reshape(6, -1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": flat[k] for k in range(6)}})

    schema = "i bigint, j bigint, " + ", ".join(f"s{k} double" for k in range(6))
    sums = data.mapInPandas(fold, schema).filter("i <= j").groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    result = {}
    for r in sums.collect():
        n, sx, sy, sxx, syy, sxy = (r[f"s{k}"] for k in range(6))
        value = None
        if n > 1:
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            if vx > 0 and vy > 0:
                value = (sxy - sx * sy / n) / (vx * vy) ** 0.5
        result[names[r["i"]], names[r["j"]]] = value
    return result
