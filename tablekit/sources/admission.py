"""Landing-zone admission: which arriving files may be read, with a reason for each refusal."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Admission limits and magic numbers (fixed values).
ALLOWED = (".csv", ".xlsx", ".xls", ".parquet", ".json", ".tsv", ".txt")
MAX_BYTES = 200 * 1024 * 1024
MAX_NAME = 255
FORBIDDEN_CHARACTERS = '<>:"|?*'
WINDOWS_MAGIC, ELF_MAGIC = "4D5A", "7F454C46"


def list_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, magic): the leading four bytes of every file within the size limit. Larger files are
    only listed: the length filter is pushed down, so their content is never read. Spark plans no read for
    empty files, so those come from its file index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = files.filter(F.col("length") <= max_bytes)
    large = files.filter(F.col("length") > max_bytes)
    found = small.select("path", "length", F.hex(F.substring("content", 1, 4)).alias("magic")).unionByName(
        large.select("path", "length", F.lit("").alias("magic"))
    )
    listed = [(re.sub("^(\\w+):///", r"\1:/", unquote(p)),) for p in files.inputFiles()]
    empty = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti")
    return found.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit("").alias("magic")))


def name_problem(name: Column) -> Column:
    bad = name.contains("..") | name.startswith("/") | name.startswith("\\")
    for c in FORBIDDEN_CHARACTERS:
        bad = bad | name.contains(c)
    return bad | (F.length(name) > MAX_NAME) | (F.length(name) == 0)


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, admitted, reason) from (path, length, magic); the first rule that fails gives the reason."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    reason = (
        F.when(~suffix.isin(*ALLOWED), F.concat(F.lit("Invalid file extension: "), suffix))
        .when(name_problem(name), F.lit("Invalid filename"))
        .when(F.col("length") == 0, F.lit("Empty file"))
        .when(F.col("length") > max_bytes, F.lit("File size exceeds limit"))
        .when(F.col("magic").startswith(WINDOWS_MAGIC), F.lit("Executable file detected (MZ header)"))
        .when(F.col("magic") == ELF_MAGIC, F.lit("Executable file detected (ELF header)"))
    )
    return files.select("path", reason.isNull().alias("admitted"), reason.alias("reason"))
