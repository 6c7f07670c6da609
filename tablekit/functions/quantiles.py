"""Exact order statistics without gathering a column in one task.

A bracket around each wanted rank is narrowed by alternating two aggregate passes with map-side partials:
a sketch of the values inside the bracket gives a much tighter one, and a count of the rows below, at and
inside it keeps the rank exact. Hot values become bracket ends, where only their count matters, so ties
cannot stall the search. When few values are left inside, those alone are counted by value and read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions.columns import col
from tablekit.functions.session import collect_bounded

#: Non-null values up to which a plain percentile aggregate holds a whole column.
EXACT_ROWS = 20_000
#: Values inside a bracket from which on they are read, per target.
GATHER_ROWS = 20_000
#: Rank accuracy of a sketch (1 / ACCURACY) and the sketch steps kept either side of a rank.
ACCURACY = 10_000
MARGIN = 3


def _value(df: DataFrame, name: str) -> Column:
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def value_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count(_value(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(names)}


def exact_quantiles(
    df: DataFrame,
    names: list[str],
    probs: list[float],
    counts: dict[str, int] | None = None,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (the pandas / numpy default) per column."""
    if not names:
        return {}
    counts = counts or value_counts(df, names)
    if max(counts.values()) <= exact_rows:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(_value(df, c), levels).alias(f"q{i}") for i, c in enumerate(names)]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(names)}
    places = {c: [p * (counts[c] - 1) for p in probs] if counts[c] else [] for c in names}
    ranks = {c: sorted({f(x) for x in at for f in (math.floor, math.ceil)}) for c, at in places.items()}
    found = order_statistics(df, ranks, counts)
    result = {}
    for c in names:
        values = []
        for x in places[c]:
            low, high = found[c][math.floor(x)], found[c][math.ceil(x)]
            values.append(low + (high - low) * (x - math.floor(x)))
        result[c] = values or [None] * len(probs)
    return result


class _Bracket:
    """Values strictly between lo and hi, how many there are, and the ranks wanted among them."""

    def __init__(self, name: str, lo: float, hi: float, size: int, ranks: dict[int, int]):
        self.name, self.lo, self.hi, self.size, self.ranks = name, lo, hi, size, ranks

    def inside(self, df: DataFrame) -> Column:
        v = _value(df, self.name)
        return F.when((v > F.lit(self.lo)) & (v < F.lit(self.hi)), v)


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int] | None = None
) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks of each column's sorted non-null values."""
    result: dict[str, dict[int, float]] = {c: {} for c in ranks}
    names = [c for c in ranks if ranks[c]]
    if not names:
        return result
    counts = counts or value_counts(df, names)
    brackets = [_Bracket(c, -math.inf, math.inf, counts[c], {r: r for r in ranks[c]}) for c in names]
    while brackets:
        small = [b for b in brackets if b.size <= GATHER_ROWS]
        if small:
            _read(df, small, result)
        large = [b for b in brackets if b.size > GATHER_ROWS]
        brackets = _narrow(df, large, result) if large else []
    return result


def _narrow(df: DataFrame, brackets: list[_Bracket], result) -> list[_Bracket]:
    """Two passes: sketch the values around each rank, then count what the sketch points separate."""
    targets = [(b, rank, at) for b in brackets for rank, at in b.ranks.items()]
    sketches = []
    for i, b in enumerate(brackets):
        points = []
        for at in b.ranks.values():
            p = at / (b.size - 1)
            points += [max(p - MARGIN / ACCURACY, 0.0), min(p + MARGIN / ACCURACY, 1.0)]
        sketches.append(F.percentile_approx(b.inside(df), F.array(*[F.lit(p) for p in points]), ACCURACY).alias(f"q{i}"))
    row = df.agg(*sketches).first()
    spans = {}
    for i, b in enumerate(brackets):
        for j, rank in enumerate(b.ranks):
            spans.setdefault((b.name, b.lo, b.hi, row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]), []).append((rank, b.ranks[rank]))
    counts = []
    for i, (name, outer_lo, _, lo, hi) in enumerate(spans):
        v = _value(df, name)
        counts += [
            F.count_if((v > F.lit(outer_lo)) & (v <= F.lit(lo))).alias(f"lo{i}"),
            F.count_if((v > F.lit(outer_lo)) & (v < F.lit(hi))).alias(f"hi{i}"),
        ]
    row = df.agg(*counts).first()
    left = []
    for i, ((name, _, _, lo, hi), wanted) in enumerate(spans.items()):
        upto, before = row[f"lo{i}"], max(row[f"hi{i}"], row[f"lo{i}"])
        inner = {}
        for rank, at in wanted:
            if at < upto:
                result[name][rank] = lo
            elif at < before:
                inner[rank] = at - upto
            else:
                result[name][rank] = hi
        if inner:
            left.append(_Bracket(name, lo, hi, before - upto, inner))
    return left


def _read(df: DataFrame, brackets: list[_Bracket], result):
    """The few values inside the brackets, counted by value."""
    parts = F.array(*[F.struct(F.lit(i).alias("b"), b.inside(df).alias("v")) for i, b in enumerate(brackets)])
    touched = reduce(or_, [b.inside(df).isNotNull() for b in brackets])
    kept = df.filter(touched).select(F.inline(F.filter(parts, lambda p: p["v"].isNotNull())))
    counted = kept.groupBy("b", "v").agg(F.count("*").alias("n"))
    values: dict[int, list] = {}
    for r in collect_bounded(counted, GATHER_ROWS * len(brackets), "values inside the brackets"):
        values.setdefault(r["b"], []).append((r["v"], r["n"]))
    for i, b in enumerate(brackets):
        upto, ordered = 0, sorted(values.get(i, []))
        waiting = sorted((at, rank) for rank, at in b.ranks.items())
        for v, n in ordered:
            upto += n
            while waiting and waiting[0][0] < upto:
                result[b.name][waiting.pop(0)[1]] = v
