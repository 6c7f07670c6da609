"""Column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=(), booleans: bool = True) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if booleans else (T.StringType,)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL) and f.name not in exclude]


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TEMPORAL)


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null, so that null is the only missing marker."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def numeric_or_zero(df: DataFrame, name: str) -> Column:
    """The column as a double; missing columns, bad values and nulls give 0.0."""
    if name not in df.columns:
        return F.lit(0.0)
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        value = col(name).cast("double")
    elif isinstance(kind, T.StringType):
        value = col(name).try_cast("double")
    else:
        return F.lit(0.0)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def order_number(df: DataFrame, name: str) -> Column:
    """A numeric or temporal column as a double that sorts the same way (microseconds for times)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return col(name).cast("double")
    raise TypeError(f"order column {name} must be numeric or temporal, not {kind.simpleString()}")


def long_form(df: DataFrame, names: list[str], cast: str, keep: list[str] = ()) -> DataFrame:
    """One row per (row, column): keep..., column, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast(cast).alias("value")) for c in names])
    kept = [col(c) for c in keep]
    return df.select(*kept, F.inline(pairs))


def as_vector(names: list[str], df: DataFrame) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*[numeric_or_zero(df, c) for c in names]))


def local_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-sized result (rows per column, class or model) as a DataFrame."""
    return spark.createDataFrame(rows, schema)
