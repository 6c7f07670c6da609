"""Profiling: describe, missing, correlation, pages, column kinds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablekit.functions.columns import (
    categorical_columns,
    col,
    datetime_columns,
    is_temporal,
    local_table,
    long_form,
    normalise_missing,
    numeric_columns,
)
from tablekit.functions.quantiles import exact_quantiles


@dataclass
class NumericStats:
    """Moments of one numeric column."""

    count: int
    nulls: int
    mean: float | None
    std_samp: float | None
    std_pop: float | None
    min: float | None
    max: float | None
    skew: float | None

    @property
    def adjusted_skew(self) -> float | None:
        """Bias-adjusted skewness, the pandas form; null below three values, 0 for a constant."""
        n = self.count
        if n < 3 or self.mean is None:
            return None
        if not self.std_pop or self.skew is None or self.skew != self.skew:
            return 0.0
        return self.skew * (n * (n - 1)) ** 0.5 / (n - 2)


#: Widest table whose moments go into one ungrouped aggregate; wider ones are summed column by column in
#: long form, which keeps the generated code small.
MOMENTS_INLINE = 12


def _moments(v, skew: bool) -> list:
    return [
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.skewness(v) if skew else F.lit(None).cast("double")).alias("skew"),
    ]


def numeric_stats(df: DataFrame, names: list[str], skew: bool = False) -> dict[str, NumericStats]:
    """Moments of all columns in one aggregate pass; the third moment only on request."""
    if not names:
        return {}
    nothing = F.lit(None).cast("double")
    if len(names) > MOMENTS_INLINE:
        grouped = long_form(df, names, "double").groupBy("column").agg(
            F.struct(*_moments(F.nanvl("value", nothing), skew)).alias("s"), F.count(F.lit(1)).alias("rows")
        )
        found = {r["column"]: (r["s"].asDict(), r["rows"]) for r in grouped.collect()}
        empty = {"count": 0} | dict.fromkeys(["mean", "std_pop", "min", "max", "skew"])
        return {c: _stats(*found.get(c, (empty, 0))) for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.struct(*_moments(F.nanvl(col(c).cast("double"), nothing), skew)).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    return {c: _stats(row[f"s{i}"].asDict(), row["rows"]) for i, c in enumerate(names)}


def _stats(sums: dict, rows: int) -> NumericStats:
    n, pop = sums["count"], sums["std_pop"]
    samp = pop * (n / (n - 1)) ** 0.5 if n > 1 else None
    return NumericStats(**sums, nulls=rows - n, std_samp=samp)


def shape(df: DataFrame) -> DataFrame:
    """One row per column: position, physical type, row and column counts of the table."""
    rows = df.count()
    table = [(i, f.name, f.dataType.simpleString(), rows, len(df.columns)) for i, f in enumerate(df.schema)]
    return local_table(
        df.sparkSession, table, "position bigint, column string, dtype string, n_rows bigint, n_columns bigint"
    )


def describe(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """count, null_count, mean, std, min, quartiles and max per numeric column.

    Quartiles interpolate linearly and are exact; approx=True takes them from a sketch in the same pass.
    """
    names = columns or numeric_columns(df)
    stats = numeric_stats(df, names)
    if approx:
        row = df.agg(
            *[F.percentile_approx(col(c).cast("double"), [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, c in enumerate(names)]
        ).first()
        quartiles = {c: row[f"q{i}"] or [None] * 3 for i, c in enumerate(names)}
    else:
        quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75], {c: s.count for c, s in stats.items()})
    table = [
        (c, s.count, s.nulls, s.mean, s.std_samp, s.min, *quartiles[c], s.max) for c, s in stats.items()
    ]
    return local_table(
        df.sparkSession,
        table,
        "column string, count bigint, null_count bigint, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double",
    )


def value_frequencies(df: DataFrame, names: list[str], cast: str = "string") -> DataFrame:
    """(column, value, n): the counts of every distinct value, null included."""
    return long_form(df, names, cast).groupBy("column", "value").agg(F.count("*").alias("n"))


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """unique (null counts as a value), the most frequent value and its count; ties go to the smallest."""
    names = columns or categorical_columns(df)
    per_column = value_frequencies(df, names).groupBy("column").agg(
        F.count("*").alias("unique"),
        F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("best"),
    )
    return per_column.select(
        "column", "unique", F.col("best.value").alias("top"), (-F.col("best.col1")).alias("freq")
    )


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage (two decimals) per column."""
    df = normalise_missing(df)
    names = columns or df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    ).first()
    rows = row["rows"]
    table = [
        (c, rows - row[f"c{i}"], round(100.0 * (rows - row[f"c{i}"]) / rows, 2) if rows else 0.0)
        for i, c in enumerate(names)
    ]
    return local_table(df.sparkSession, table, "column string, missing bigint, missing_pct double")


def distinct_counts(df: DataFrame, names: list[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column."""
    if not names:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
        return {c: row[f"d{i}"] for i, c in enumerate(names)}
    counted = (
        value_frequencies(df, names).filter("value is not null").groupBy("column").agg(F.count("*").alias("d"))
    )
    found = {r["column"]: r["d"] for r in counted.collect()}
    return {c: found.get(c, 0) for c in names}


#: Types a value-frequency pass can compare as strings.
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def column_profile(df: DataFrame, order_by: list[str], approx: bool = False) -> DataFrame:
    """Physical and logical type, missing count and percentage, distinct count and the first five values.

    Logical types: integer, float, numeric (decimals), boolean, datetime, categorical, text, unknown. A
    string column is datetime when all its values parse, categorical when distinct / rows < 0.5.
    """
    df = normalise_missing(df)
    plain = [f.name for f in df.schema if isinstance(f.dataType, _PLAIN)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    rows = row["rows"]
    distinct = distinct_counts(df, plain, approx)
    heads = _first_values(df, plain, order_by)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    dates = date_columns(df, strings)
    table = []
    for i, field in enumerate(df.schema):
        c, nulls = field.name, rows - row[f"c{i}"]
        table.append(
            (
                c,
                field.dataType.simpleString(),
                _logical_type(field.dataType, c in dates, distinct.get(c, 0), rows),
                nulls,
                round(100.0 * nulls / rows, 2) if rows else 0.0,
                distinct.get(c),
                heads.get(c, [])[:5],
            )
        )
    return local_table(
        df.sparkSession,
        table,
        "column string, physical_type string, inferred_type string, missing bigint, missing_pct double, "
        "distinct bigint, samples array<string>",
    )


def _logical_type(kind: T.DataType, parses: bool, distinct: int, rows: int) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.StringType):
        if parses:
            return "datetime"
        return "categorical" if rows and distinct / rows < 0.5 else "text"
    return "unknown"


def _first_values(df: DataFrame, names: list[str], order_by: list[str], n: int = 10) -> dict[str, list[str]]:
    """The first n non-null values per column, by the order columns; a top-n per column, never a sort."""
    result = {}
    head = df.orderBy(*[col(c) for c in order_by]).select(*[col(c).cast("string").alias(c) for c in names]).limit(n).collect()
    for c in names:
        values = [r[c] for r in head if r[c] is not None]
        if len(values) < n and len(head) == n:
            values = [
                r[0]
                for r in df.filter(col(c).isNotNull())
                .orderBy(*[col(k) for k in order_by])
                .select(col(c).cast("string"))
                .limit(n)
                .collect()
            ]
        result[c] = values
    return result


def date_columns(df: DataFrame, names: list[str]) -> set[str]:
    """The string columns that have values, all of which parse as timestamps; one aggregate over the whole columns."""
    if not names:
        return set()
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)], *[F.count(col(c).try_cast("timestamp")).alias(f"p{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if row[f"n{i}"] and row[f"n{i}"] == row[f"p{i}"]}


#: Widest table whose pairwise correlations go into one aggregate expression list.
PAIRS_INLINE = 24


def correlation(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Pearson r of every pair of numeric columns on pairwise-complete rows: (col_a, col_b, r).

    Undefined values become 0. One pass: inline pair aggregates for narrow tables, per-partition cross
    products summed by pair for wide ones.
    """
    names = columns or numeric_columns(df)
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    matrix = correlation_matrix(df, names)
    table = [(a, b, round(matrix[a, b], digits) + 0.0) for a in names for b in names]
    return local_table(df.sparkSession, table, "col_a string, col_b string, r double")


def correlation_matrix(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float]:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    if len(names) <= PAIRS_INLINE:
        clean = df.select(
            *[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)]
        )
        at = {c: f"x{i}" for i, c in enumerate(names)}
        row = clean.agg(*[F.corr(at[a], at[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
        values = {pair: row[f"r{i}"] for i, pair in enumerate(pairs)}
    else:
        from tablekit.functions.grams import pairwise_correlation

        values = pairwise_correlation(df, names)
    result = {}
    for a, b in pairs:
        r = values[(a, b)]
        r = 0.0 if r is None or r != r or abs(r) == float("inf") else float(r)
        result[a, b] = result[b, a] = r
    return result


def page(df: DataFrame, order_by: list[str], number: int = 1, size: int = 50) -> DataFrame:
    """One page of rows in key order, with total_rows and total_pages.

    1 <= size <= 1000. Spark keeps only the first number * size rows per task, so deep pages should
    filter on the last key of the page before instead (`page_after`).
    """
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page must be >= 1 and size between 1 and 1000")
    total = df.count()
    rows = df.orderBy(*[col(c) for c in order_by]).offset((number - 1) * size).limit(size)
    return rows.withColumns({"total_rows": F.lit(total), "total_pages": F.lit(-(-total // size))})


def page_after(df: DataFrame, key: str, last, size: int = 50) -> DataFrame:
    """The page that follows the row whose unique key is `last`: a pushed-down range filter and a top-k."""
    rows = df if last is None else df.filter(col(key) > F.lit(last))
    return rows.orderBy(col(key)).limit(size)


def column_kinds(df: DataFrame) -> DataFrame:
    """One row per kind with the column names of that kind and the row count."""
    rows = df.count()
    table = [
        ("numeric", numeric_columns(df), rows),
        ("categorical", categorical_columns(df), rows),
        ("datetime", datetime_columns(df), rows),
    ]
    return local_table(df.sparkSession, table, "kind string, columns array<string>, n_rows bigint")
