"""What the corpus operators share: text columns, Arrow batches cut by bytes, worker caches, tables written for reuse."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablekit.functions.columns import col
from tablekit.functions.session import cut_lineage, shared_root

#: Bytes of text that a task holds decoded at once, apart from a single longer text.
SLICE_BYTES = 6_000_000
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4_000_000


def worker_cache(key: tuple, build: Callable):
    """build() once per Python worker and key: functions travel with each job, this survives between jobs. A worker keeps
    one operator's things; those of the operator before it go."""
    store = sys.__dict__.setdefault("_tablekit_llm_cache", {})
    if key not in store:
        free_worker_cache()
        store[key] = build()
    return store[key]


def free_worker_cache() -> None:
    """Let go of what earlier operators left in this worker, before work that needs the memory."""
    store = sys.__dict__.setdefault("_tablekit_llm_cache", {})
    if store:
        store.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Hand memory that is free in this process back to the machine: workers outlive stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; a function so that only callers need the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are of BATCH_BYTES: both the JVM and the worker hold several at a time, and texts
    are large. A session that has set the size itself keeps it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("bB") == str(64 << 20):
        conf.set(name, str(BATCH_BYTES))
    return df


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, are left behind."""
    return df.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text_col: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of one take at most `most` bytes (a longer text comes alone)."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(text_col)).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size > most and i > at:
                yield batch.slice(at, i - at)
                at, size = i, n or 0
        if at < len(lengths):
            yield batch.slice(at)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str, text_col: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over byte-bounded slices; work returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for part in slices(batches, text_col, most):
            out = work(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in arrow], schema=arrow)
        out = part = None
        give_back()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["SLICE_BYTES", "col", "cut_lineage", "documents", "free_worker_cache", "give_back", "held_out", "map_slices", "shared_folder", "shuffle_width", "slices", "small_batches", "stored", "tokenizer_file", "worker_cache"]
