"""Readers for the supported file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet"}
SUPPORTED = "csv, tsv, json (array of records or one record per line), parquet"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Header line first. Cells that do not fit the schema become null. Pass a schema on large inputs:
    without one the types cost an extra pass."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """An array of records per file; lines=True reads one record per line, which splits across tasks."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def format_of(path: str) -> str:
    """The format a path's suffix stands for; unknown suffixes are read as CSV."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = name[name.rfind(".") :] if "." in name else ""
    return SUFFIXES.get(suffix, "csv")


def read_any(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Read by explicit format or by suffix."""
    fmt = fmt or format_of(path)
    try:
        if fmt == "parquet":
            return read_parquet(spark, path)
        if fmt == "json":
            return read_json(spark, path, schema)
        if fmt == "tsv":
            return read_tsv(spark, path, schema)
        if fmt == "csv":
            return read_csv(spark, path, schema)
    except Exception as error:
        raise ValueError(f"cannot read {path} as {fmt}; supported formats: {SUPPORTED}") from error
    raise ValueError(f"unknown format {fmt}; supported formats: {SUPPORTED}")
