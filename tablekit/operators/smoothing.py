"""Simple exponential smoothing over series of any length.

The recursion is linear in the level it starts from, so a chunk of a series is summed up, for every
candidate weight, by how it maps the level and by a quadratic of its squared error in that level. Chunks
are folded by the tasks that hold them; a series then composes a handful of chunk summaries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import order_number
from tablekit.functions.ordering import ordered_values, with_bucket
from tablekit.functions.session import spread

#: Candidate smoothing weights.
WEIGHTS = [i / 100 for i in range(1, 100)]


#: Values of a block of the scan, and cells (values x weights) worked on at once.
SCAN, CELLS = 64, 1_000_000
#: Values of a series that is run from its array, such series run together, and values of a piece of a long series.
SHORT, TOGETHER, ROWS = 1_000, 256, 200_000


def _scan(e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """y with y[i] = q * y[i - 1] + e[i] from y[-1] = 0, for every row of e and its own q.

    Blocks of SCAN values are multiplied by the powers of q below the diagonal; what each block passes on is a recursion of
    the same kind over the blocks, with q ** SCAN.
    """
    rows, n = e.shape
    size = min(SCAN, n)
    blocks = -(-n // size) if n else 0
    if not n:
        return e
    lag = np.arange(size)[None, :] - np.arange(size)[:, None]
    powers = np.where(lag >= 0, q[:, None, None] ** np.maximum(lag, 0), 0.0)
    padded = np.zeros((rows, blocks * size))
    padded[:, :n] = e
    y = np.matmul(padded.reshape(rows, blocks, size), powers)
    if blocks > 1:
        carried = _scan(y[:, :-1, -1], q**size)
        y[:, 1:] += carried[:, :, None] * (q[:, None] ** np.arange(1, size + 1))[:, None, :]
    return y.reshape(rows, -1)[:, :n]


def _fold(values: np.ndarray, weights: np.ndarray):
    """Level map (a, b) and error quadratic (c0, c1, c2) of a chunk started from level s, for every weight.

    After the chunk the level is a * s + b; the squared one-step errors add up to c0 - 2 c1 s + c2 s^2.
    """
    n = len(values)
    out = np.zeros((5, len(weights)))
    if not n:
        out[0] = 1.0
        return out
    step = max(1, CELLS // n)
    for k in range(0, len(weights), step):
        w = weights[k : k + step]
        q = 1 - w
        level = _scan(w[:, None] * values, q)
        # The level before each value, from a start at zero and as a multiple of the start.
        miss = values - np.concatenate((np.zeros((len(w), 1)), level[:, :-1]), axis=1)
        share = q[:, None] ** np.arange(n)
        out[:, k : k + step] = q**n, level[:, -1], (miss * miss).sum(axis=1), (miss * share).sum(axis=1), (share * share).sum(axis=1)
    return out


def _run(series: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared one-step errors and last levels of many series for every weight: one step of the recursion for all at once."""
    sse, last = np.zeros((len(series), len(weights))), np.zeros((len(series), len(weights)))
    sizes = np.array([len(v) for v in series])
    longest_first = np.argsort(-sizes, kind="stable")
    for at in range(0, len(series), TOGETHER):
        own = longest_first[at : at + TOGETHER]
        values = np.zeros((sizes[own[0]], len(own)))
        for j, i in enumerate(own):
            values[: sizes[i], j] = series[i]
        level, total = np.repeat(values[0][:, None], len(weights), axis=1), np.zeros((len(own), len(weights)))
        for step in range(1, len(values)):
            k = int(np.searchsorted(-sizes[own], -step))
            miss = values[step, :k, None] - level[:k]
            total[:k] += miss * miss
            level[:k] += weights * miss
        sse[own], last[own] = total, level
    return sse, last


def fit_smoothing(data: DataFrame, ties: list[str] = (), weights: list[float] | None = None, rows: int | None = None) -> DataFrame:
    """(series, alpha, sse, level): the weight with the least squared one-step error and the last level.

    The level starts at the first value, which is not scored. Series of at most SHORT values run many at a time; only series of
    more than `rows` values are cut at time bounds, so that short ones do not fall into a group for every bound.
    """
    grid = np.array(weights or WEIGHTS)
    ties, limit = list(ties), rows or ROWS
    schema = "series string, alpha double, sse double, level double"
    sizes = data.groupBy("series").agg(F.count("*").alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    short = min(SHORT, limit)
    sized = data
    if longest > short:
        named = sizes.withColumnRenamed("series", "_s")
        sized = data.join(named, data["series"].eqNullSafe(named["_s"]), "left").drop("_s")

    def best(batches):
        for batch in batches:
            sse, level = _run([np.asarray(v, float) for v in batch["values"]], grid)
            found, every = sse.argmin(axis=1), np.arange(len(sse))
            yield pd.DataFrame({"series": batch["series"], "alpha": grid[found], "sse": sse[every, found], "level": level[every, found]})

    few = sized.filter(F.col("_n") <= short) if longest > short else sized
    fitted = ordered_values(few, ties, nulls_last=True).mapInPandas(best, schema)
    if longest <= short:
        return fitted
    many = sized.filter(F.col("_n") > short)
    place = F.coalesce(order_number(data, "ts"), F.lit(float("-inf")))
    cut = many.filter(F.col("_n") <= limit).withColumns({"_ord": place, "_bucket": F.lit(0)})
    if longest > limit:
        cut = cut.unionByName(with_bucket(many.filter(F.col("_n") > limit), "ts", limit)[0])
    return fitted.unionByName(_fit_folded(cut, ties, grid, limit, schema))


def _fit_folded(data: DataFrame, ties: list[str], grid: np.ndarray, limit: int, schema: str) -> DataFrame:
    """The same from rows with _ord, _bucket and _n, the values of the series: buckets are folded, then composed."""

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["_ord", *ties])["value"].to_numpy(float)
        rest = np.concatenate(_fold(values[1:], grid))
        # A series in one piece is never met as a later piece.
        whole = np.concatenate(_fold(values, grid)) if pdf["_n"].iloc[0] > limit else rest
        return pd.DataFrame(
            {"series": [pdf["series"].iloc[0]], "_bucket": [pdf["_bucket"].iloc[0]], "first": [values[0]], "whole": [whole], "rest": [rest]}
        )

    parts = spread(data.select("series", "_bucket", "_ord", "_n", "value", *ties), "series", "_bucket").groupBy("series", "_bucket").applyInPandas(
        summarise, "series string, _bucket int, first double, whole array<double>, rest array<double>"
    )
    chains = parts.groupBy("series").agg(
        F.sort_array(F.collect_list(F.struct("_bucket", "first", "whole", "rest"))).alias("parts")
    )

    def compose(batches):
        for batch in batches:
            rows = []
            for name, chain in batch.itertuples(index=False):
                level, sse = np.full(len(grid), chain[0]["first"]), np.zeros(len(grid))
                for i, part in enumerate(chain):
                    a, b, c0, c1, c2 = np.reshape(part["rest"] if i == 0 else part["whole"], (5, -1))
                    sse += c0 - 2 * c1 * level + c2 * level * level
                    level = a * level + b
                best = int(np.argmin(sse))
                rows.append((name, float(grid[best]), float(sse[best]), float(level[best])))
            yield pd.DataFrame(rows, columns=["series", "alpha", "sse", "level"])

    return chains.mapInPandas(compose, schema)
