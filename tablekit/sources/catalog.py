"""Dataset catalog: one Parquet folder per dataset and one catalog row per dataset.

The catalog is itself a small Parquet table of append-only entries; the newest entry of a dataset wins
and a deletion is an entry too, so concurrent writers never rewrite each other's files.
"""

from __future__ import annotations

from datetime import datetime, timezone
import re
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablekit.functions.columns import categorical_columns, datetime_columns, local_table, numeric_columns

SCHEMA = (
    "dataset_id string, filename string, n_rows bigint, n_columns bigint, column_names array<string>, "
    "numerical_columns array<string>, categorical_columns array<string>, datetime_columns array<string>, "
    "size_bytes bigint, uploaded_at timestamp, deleted boolean"
)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dataset_id: str) -> str:
        return f"{self.root}/datasets/{dataset_id}"

    def entry(self, df: DataFrame, dataset_id: str, filename: str, size: int | None, when=None) -> tuple:
        return (
            dataset_id,
            filename,
            df.count(),
            len(df.columns),
            df.columns,
            numeric_columns(df),
            categorical_columns(df),
            datetime_columns(df),
            size,
            when or datetime.now(timezone.utc),
            False,
        )

    def _append(self, rows: list[tuple]):
        local_table(self.spark, rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")

    def ingest(self, df: DataFrame, dataset_id: str, filename: str) -> DataFrame:
        """Write the table as Parquet, register it and return the stored form."""
        df.write.mode("overwrite").parquet(self.path(dataset_id))
        stored = self.get(dataset_id)
        self._append([self.entry(stored, dataset_id, filename, self.size(dataset_id))])
        return stored

    def get(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(self.path(dataset_id))

    def _files(self, glob: str) -> DataFrame:
        """Paths and lengths only: the content column is never read."""
        return (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(glob).select("path", "length", "modificationTime")
        )

    def size(self, dataset_id: str) -> int:
        return self._files(self.path(dataset_id)).agg(F.sum("length")).first()[0] or 0

    def list(self) -> DataFrame:
        """The live entries, newest per dataset."""
        newest = Window.partitionBy("dataset_id").orderBy(F.desc("uploaded_at"))
        entries = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/catalog")
        return entries.withColumn("_r", F.row_number().over(newest)).filter("_r = 1 and not deleted").drop("_r", "deleted")

    def metadata(self, dataset_id: str) -> DataFrame:
        return self.list().filter(F.col("dataset_id") == dataset_id)

    def delete(self, dataset_id: str, remove_files: bool = False):
        """Take a dataset out of the catalog; its files stay unless remove_files is set."""
        row = self.metadata(dataset_id).first()
        if row is None:
            raise KeyError(dataset_id)
        values = row.asDict() | {"uploaded_at": datetime.now(timezone.utc), "deleted": True}
        names = [part.strip().split(" ")[0] for part in re.split(r",\s*(?![^<]*>)", SCHEMA)]
        self._append([tuple(values[n] for n in names)])
        if remove_files:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(dataset_id))
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def rebuild(self) -> DataFrame:
        """Re-register every stored dataset that the catalog has never seen, from the files themselves; a deleted one
        stays deleted."""
        files = self._files(f"{self.root}/datasets")
        found = (
            files.withColumn("dataset_id", F.regexp_extract("path", r"/datasets/([^/]+)/", 1))
            .groupBy("dataset_id")
            .agg(F.sum("length").alias("size"), F.max("modificationTime").alias("at"))
        )
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalog")
        known = set()
        if hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            entries = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/catalog")
            known = {r["dataset_id"] for r in entries.select("dataset_id").distinct().collect()}
        rows = [
            self.entry(self.get(r["dataset_id"]), r["dataset_id"], r["dataset_id"], r["size"])
            for r in found.collect()
            if r["dataset_id"] not in known
        ]
        if rows:
            self._append(rows)
        return self.list()


def catalog_row(df: DataFrame, dataset_id: str) -> DataFrame:
    """The schema part of a catalog entry for any table: counts and column lists by kind."""
    row = (dataset_id, df.count(), len(df.columns), df.columns, numeric_columns(df), categorical_columns(df), datetime_columns(df))
    return local_table(
        df.sparkSession,
        [row],
        "dataset_id string, n_rows bigint, n_columns bigint, column_names array<string>, numerical_columns array<string>, "
        "categorical_columns array<string>, datetime_columns array<string>",
    )
