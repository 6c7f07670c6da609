"""Cleaning and validation: fills, casts, outliers, checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablekit.functions.columns import (
    categorical_columns,
    col,
    is_temporal,
    local_table,
    long_form,
    normalise_missing,
    numeric_columns,
    numeric_or_zero,
)
from tablekit.functions.ordering import fill_along
from tablekit.functions.quantiles import exact_quantiles
from tablekit.operators.profile import missing, numeric_stats


def modes(df: DataFrame, names: list[str], cast: str) -> dict[str, object]:
    """The most frequent non-null value per column, ties to the smallest: counted by value first, so a
    hot value is one row before anything is compared."""
    if not names:
        return {}
    counted = long_form(df, names, cast).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"))
    return {r["column"]: r["best"][1] for r in best.collect()}


@dataclass
class FillModel:
    """Fill values per column; transform is a projection."""

    values: dict[str, object] = field(default_factory=dict)
    had_nulls: set[str] = field(default_factory=set)
    drop_null_rows: list[str] | None = None
    drop_columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        df = normalise_missing(df).drop(*self.drop_columns)
        if self.drop_null_rows is not None:
            df = df.na.drop("any", subset=self.drop_null_rows or None)
        filled = {}
        for c, v in self.values.items():
            if c in df.columns and v is not None:
                kind = df.schema[c].dataType
                if isinstance(kind, T.IntegralType) and isinstance(v, float) and not v.is_integer():
                    # An integer column becomes a double only if there was something to fill.
                    v, kind = (v, T.DoubleType()) if c in self.had_nulls else (round(v), kind)
                filled[c] = F.coalesce(col(c).cast(kind), F.lit(v).cast(kind))
        return df.withColumns(filled) if filled else df


def fit_fill(
    df: DataFrame,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    strategy: str = "mean",
    empty_category: str = "missing",
) -> FillModel:
    """mean (also auto), median, most_frequent / mode, drop. Categorical columns take their mode."""
    df = normalise_missing(df)
    numeric = numeric_columns(df) if numeric is None else numeric
    categorical = categorical_columns(df) if categorical is None else categorical
    if strategy == "drop":
        return FillModel(drop_null_rows=[])
    if strategy in ("most_frequent", "mode"):
        found = modes(df, numeric, "double")
        values = {c: found.get(c, 0.0) for c in numeric}
    elif strategy == "median":
        values = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
    elif strategy in ("mean", "auto", ""):
        means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else {}
        values = {c: means[f"m{i}"] for i, c in enumerate(numeric)}
    else:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    found = modes(df, categorical, "string")
    for c in categorical:
        values[c] = found.get(c, empty_category)
    integers = [c for c in numeric if isinstance(df.schema[c].dataType, T.IntegralType)]
    had_nulls = {c for c, share in missing_shares(df.select(*[col(c) for c in integers])).items() if share} if integers else set()
    return FillModel({c: v for c, v in values.items() if v is not None}, had_nulls)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    return normalise_missing(df).na.drop("any")


def fill_constant(df: DataFrame, columns: list[str] | None = None, value: str = "unknown") -> DataFrame:
    return df.na.fill(value, subset=columns or categorical_columns(df, booleans=False))


def columns_mostly_missing(df: DataFrame, threshold: float = 0.5) -> list[str]:
    """Columns whose missing share is above the threshold."""
    rows = missing_shares(df)
    return [c for c, share in rows.items() if share > threshold]


def missing_shares(df: DataFrame) -> dict[str, float]:
    df = normalise_missing(df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: (row["rows"] - row[f"c{i}"]) / row["rows"] if row["rows"] else 0.0 for i, c in enumerate(df.columns)}


def handle_missing(
    df: DataFrame,
    strategy: str = "auto",
    numeric_strategy: str = "mean",
    categorical_strategy: str = "mode",
    threshold: float = 0.5,
    keys: list[str] = (),
    order_by: str | None = None,
) -> DataFrame:
    """auto drops mostly-missing columns and fills the rest; drop only drops columns; fill only fills;
    none returns the table. forward_fill and backward_fill need order_by (and keys for many series)."""
    if strategy not in ("auto", "drop", "fill", "none"):
        raise ValueError(f"unknown strategy: {strategy}")
    df = normalise_missing(df)
    if strategy in ("auto", "drop"):
        df = df.drop(*[c for c in columns_mostly_missing(df, threshold) if c not in keys and c != order_by])
    if strategy not in ("auto", "fill"):
        return df
    skip = {*keys, order_by}
    numeric = [c for c in numeric_columns(df) if c not in skip]
    categorical = [c for c in categorical_columns(df, booleans=False) if c not in skip]
    if numeric_strategy in ("forward_fill", "backward_fill"):
        if order_by is None:
            raise ValueError(f"{numeric_strategy} needs order_by")
        df = fill_along(df, numeric, list(keys), order_by, backward=numeric_strategy == "backward_fill")
    else:
        df = fit_fill(df, numeric, [], numeric_strategy).transform(df)
    if categorical_strategy == "mode":
        df = fit_fill(df, [], categorical, "mean", "unknown").transform(df)
    elif categorical_strategy == "constant":
        df = fill_constant(df, categorical) if categorical else df
    elif categorical_strategy == "drop":
        df = df.na.drop("any", subset=categorical) if categorical else df
    else:
        raise ValueError(f"unknown categorical strategy: {categorical_strategy}")
    return df


def shape_report(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = [(stage, d.count(), len(d.columns)) for stage, d in (("before", before), ("after", after))]
    return local_table(before.sparkSession, rows, "stage string, n_rows bigint, n_columns bigint")


# -- casts ------------------------------------------------------------------------------------------


def cast_column(df: DataFrame, name: str, target: str) -> Column:
    """Bad numbers and dates become null; nulls stay null; booleans parse true / false."""
    value = col(name)
    if target == "numeric":
        kind = df.schema[name].dataType
        return value if isinstance(kind, T.NumericType) else value.cast("string").try_cast("double")
    if target == "datetime":
        return value.cast("timestamp_ntz") if is_temporal(df, name) else value.cast("string").try_cast("timestamp_ntz")
    if target in ("category", "string"):
        return value.cast("string")
    if target == "boolean":
        return value.try_cast("boolean")
    raise ValueError(f"unknown target type: {target}")


def convert_types(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumns({c: cast_column(df, c, t) for c, t in mapping.items() if c in df.columns})


def cast_report(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(column, target, success, original_type, new_type, n_lost): values that did not survive the cast."""
    known = [c for c in mapping if c in df.columns]
    lost = {}
    if known:
        row = df.agg(
            *[
                F.count_if(col(c).isNotNull() & cast_column(df, c, mapping[c]).isNull()).alias(f"l{i}")
                for i, c in enumerate(known)
            ]
        ).first()
        lost = {c: row[f"l{i}"] for i, c in enumerate(known)}
    after = convert_types(df, mapping).schema
    rows = [
        (c, t, c in lost, df.schema[c].dataType.simpleString() if c in lost else None,
         after[c].dataType.simpleString() if c in lost else None, lost.get(c))
        for c, t in mapping.items()
    ]
    return local_table(
        df.sparkSession,
        rows,
        "column string, target string, success boolean, original_type string, new_type string, n_lost bigint",
    )


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Feature columns as doubles: what is not a number becomes 0.0."""
    return df.withColumns({c: numeric_or_zero(df, c) for c in names})


# -- outliers ---------------------------------------------------------------------------------------


@dataclass
class OutlierBounds:
    """Strict bounds per column; flag and report are projections and one aggregate."""

    method: str
    threshold: float
    bounds: dict[str, tuple[float, float]]

    def outside(self, name: str) -> Column:
        low, high = self.bounds[name]
        value = F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
        return F.coalesce((value < low) | (value > high), F.lit(False))

    def outliers(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Every outlying value: keys..., column, value."""
        flags = F.array(
            *[
                F.when(self.outside(c), F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")))
                for c in self.bounds
            ]
        )
        found = df.select(*[col(k) for k in keys], F.inline(F.array_compact(flags)))
        return found

    def report(self, df: DataFrame) -> DataFrame:
        """(column, outlier_count, outlier_pct of non-null values, lower, upper)."""
        names = list(self.bounds)
        row = df.agg(
            *[F.count_if(self.outside(c)).alias(f"o{i}") for i, c in enumerate(names)],
            *[F.count(F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))).alias(f"n{i}") for i, c in enumerate(names)],
        ).first()
        rows = [
            (c, row[f"o{i}"], 100.0 * row[f"o{i}"] / row[f"n{i}"] if row[f"n{i}"] else 0.0, *self.bounds[c])
            for i, c in enumerate(names)
        ]
        return local_table(
            df.sparkSession, rows, "column string, outlier_count bigint, outlier_pct double, lower double, upper double"
        )


def fit_outliers(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: list[str] | None = None
) -> OutlierBounds:
    """iqr: beyond threshold * IQR from the quartiles. zscore: |x - mean| / std (ddof 1) > threshold."""
    names = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    if method == "iqr":
        quartiles = exact_quantiles(df, names, [0.25, 0.75])
        bounds = {
            c: (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
            for c, (q1, q3) in quartiles.items()
            if q1 is not None
        }
    elif method == "zscore":
        stats = numeric_stats(df, names)
        bounds = {
            c: (s.mean - threshold * s.std_samp, s.mean + threshold * s.std_samp)
            for c, s in stats.items()
            if s.mean is not None and s.std_samp
        }
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return OutlierBounds(method, threshold, bounds)


def isolation_outliers(df: DataFrame, keys: list[str], columns: list[str] | None = None, contamination: float = 0.1) -> DataFrame:
    """Per-column isolation-forest outliers: keys..., column, value, score."""
    from tablekit.operators.anomaly import fit_isolation_forest

    found = None
    for c in columns or [n for n in numeric_columns(df) if n not in keys]:
        rows = df.filter(col(c).isNotNull())
        scored = fit_isolation_forest(rows, [c], keys, contamination=contamination).transform(rows)
        part = scored.filter("is_anomaly = 1").select(
            *[col(k) for k in keys], F.lit(c).alias("column"), col(c).cast("double").alias("value"), "anomaly_score"
        )
        found = part if found is None else found.unionByName(part)
    return found


# -- validation -------------------------------------------------------------------------------------

#: What a column type name in a validation request accepts.
_TYPE_NAMES = {
    "numeric": (T.NumericType,),
    "integer": (T.IntegralType,),
    "float": (T.FloatType, T.DoubleType),
    "string": (T.StringType,),
    "categorical": (T.StringType, T.BooleanType),
    "boolean": (T.BooleanType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def validate(
    df: DataFrame,
    required: list[str] = (),
    types: dict[str, str] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """(check, column, status, n_bad): required and type violations are errors, range violations warnings."""
    rows = []
    for c in required:
        present = c in df.columns
        rows.append(("required", c, "ok" if present else "error", 0 if present else 1))
    for c, expected in (types or {}).items():
        if c in df.columns:
            good = isinstance(df.schema[c].dataType, _TYPE_NAMES[expected])
            rows.append(("type", c, "ok" if good else "error", 0 if good else 1))
    checked = {
        c: bounds for c, bounds in (ranges or {}).items()
        if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)
    }
    if checked:
        row = df.agg(
            *[F.count_if((col(c) < lo) | (col(c) > hi)).alias(f"r{i}") for i, (c, (lo, hi)) in enumerate(checked.items())]
        ).first()
        rows += [("range", c, "warning" if row[f"r{i}"] else "ok", row[f"r{i}"]) for i, c in enumerate(checked)]
    return local_table(df.sparkSession, rows, "check string, column string, status string, n_bad bigint")


def is_valid(report: DataFrame) -> bool:
    return report.filter("status = 'error'").limit(1).count() == 0
