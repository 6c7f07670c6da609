"""Token ids in files of fixed-width bit-packed blocks.

File: MAGIC, then blocks, then a footer and its length. A block holds up to BLOCK ids of the whole file, each in `bits`
bits: 64 ids fill exactly `bits` 64-bit words, so packing and unpacking are 64 shifts of whole arrays. The footer
has the offset of every block and of every document, so any range of ids is read from its blocks alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekit.llm.common import documents, shared_folder, shuffle_width, slices, tokenizer_file, worker_cache
from tablekit.llm.words import Chunks, Memo

MAGIC = b"TKPACK01"
#: Ids in a block; a multiple of 64.
BLOCK = 1 << 16
#: Distinct chunks a worker remembers in each of two generations; about 60 MB.
REMEMBER = 350_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each (1 to 32), padded to a multiple of 64 ids."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data, as little-endian unsigned 32-bit integers."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, k] = lane & mask
    return lanes.reshape(-1)[:n]


class Writer:
    """One file: ids come document by document, blocks leave as they fill."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.stream.write(MAGIC)
        self.at, self.n = len(MAGIC), 0
        self.block_offsets: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n)
        self.waiting.append(ids)
        self.n += len(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, stop, BLOCK):
            data = pack(ids[k : min(k + BLOCK, stop)], self.bits)
            self.block_offsets.append(self.at)
            self.stream.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(last=True)
        known = np.array([d is not None for d in self.doc_ids], bool)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        head = json.dumps({"bits": self.bits, "block": BLOCK, "n": self.n, "docs": len(ids), "blocks": len(self.block_offsets)}).encode()
        footer = b"".join([struct.pack("<I", len(head)), head, np.array([*self.block_offsets, self.at], "<u8").tobytes(), np.array([*self.starts, self.n], "<u8").tobytes(), ids.tobytes(), np.packbits(known).tobytes()])
        self.stream.write(footer + struct.pack("<Q", len(footer)))


class Reader:
    """Random access to one file."""

    def __init__(self, stream, size: int):
        self.stream = stream
        (length,) = struct.unpack("<Q", stream.read_at(8, size - 8))
        footer = stream.read_at(length, size - 8 - length)
        (h,) = struct.unpack("<I", footer[:4])
        head = json.loads(footer[4 : 4 + h])
        self.bits, self.block, self.n, docs, blocks = (head[k] for k in ("bits", "block", "n", "docs", "blocks"))
        at = 4 + h
        self.block_offsets = np.frombuffer(footer, "<u8", blocks + 1, at)
        self.starts = np.frombuffer(footer, "<u8", docs + 1, at + 8 * (blocks + 1)).astype(np.int64)
        at += 8 * (blocks + 1 + docs + 1)
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.known = np.unpackbits(np.frombuffer(footer, np.uint8, -(-docs // 8), at + 8 * docs), count=docs).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (excluded) of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        first = int(self.block_offsets[a])
        data = self.stream.read_at(int(self.block_offsets[b + 1]) - first, first)
        n = min(self.n, (b + 1) * self.block) - a * self.block
        return unpack(data, self.bits, n)[start - a * self.block : stop - a * self.block]

    def spans(self, most: int = 64 * BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last excluded, their ids), in pieces of about `most` ids; a longer document comes alone."""
        k, docs = 0, len(self.doc_ids)
        while k < docs:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, "right")) - 1)
            yield k, j, self.ids(int(self.starts[k]), int(self.starts[j]))
            k = j


def open_at(path: str):
    """(file system, path in it) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class Encoder:
    """The library's ids of whole texts; distinct chunks of a slice go through it once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.memo = Memo(self._chunks, REMEMBER)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks, cut out of one array over all of them."""
        ids = [e.ids for e in self._batch([c if c[:1] == "\n" else " " + c for c in chunks])]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        data = np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum())).tobytes()
        cut = [0, *(np.cumsum(size) * 4).tolist()]
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _batch(self, texts: list[str]):
        return self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        own = Chunks(texts, "\n")
        out: list = [None] * len(texts)
        for i, ids in zip(own.rows.tolist(), own.join(self.memo.values(own.distinct), "<u4")):
            out[i] = ids[1:]  # without the line break put before the first chunk
        odd = np.flatnonzero(~own.plain).tolist()
        for i, e in zip(odd, self._batch([texts[i].as_py() for i in odd])):
            out[i] = np.array(e.ids, "<u4")
        return out


def write_ids(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> list[tuple]:
    """Encode df(doc_id, text) into files below a folder that driver and executors share, in ascending doc_id order.

    Returns (part, path, docs, ids) for each file, in order. Parts are ranges of doc_id; a part is sorted by id,
    nulls first, equal ids by text. A null text counts as empty and gives the end id alone. A task writes under a
    name of its own and renames at the end, so a repeated task replaces its file with the same bytes.
    """
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")
    source = documents(df)
    width = shuffle_width(df.sparkSession)
    edges = source.agg(F.percentile_approx("doc_id", [k / width for k in range(1, width)], 20 * width)).first()[0] if width > 1 else None
    edges = sorted(set(edges or []))
    # The range of an id, without a join: how many edges lie below it.
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("doc_id"))) if edges else F.lit(0)
    placed = source.repartitionById(len(edges) + 1, F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int"))

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder = worker_cache(("packed_ids", path), lambda: Encoder(path))
        system, root = open_at(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{number:06d}.ids"
        own = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as stream:
            writer = Writer(stream, bits_for(max(encoder.size, end_id + 1)))
            end = np.array([end_id], "<u4")
            for piece in slices(batches):
                for d, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text"))):
                    writer.add(d, np.concatenate((ids, end)))
            writer.close()
        if system.get_file_info(name).type != pafs.FileType.NotFound:
            system.delete_file(name)
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": [number], "docs": [len(writer.doc_ids)], "ids": [writer.n]})

    files = placed.sortWithinPartitions("doc_id", "text").mapInArrow(run, "part long, docs long, ids long").collect()
    root = folder.rstrip("/")
    return [(f["part"], f"{root}/part-{f['part']:06d}.ids", f["docs"], f["ids"]) for f in sorted(files)]


def read_documents(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of write_ids, read back from them."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows, base = [], 0
    for _, path, docs, ids in files:
        if docs:
            rows.append((path, base))
        base += ids
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                system, name = open_at(path)
                with system.open_input_file(name) as stream:
                    reader = Reader(stream, stream.size())
                    for a, b, ids in reader.spans():
                        edge = reader.starts[a : b + 1]
                        cut = (edge - edge[0]).tolist()
                        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(reader.doc_ids[a:b], pa.int64(), mask=~reader.known[a:b]),
                                "start": edge[:-1] + base,
                                "n_tokens": np.diff(edge),
                                "ids_crc32": pa.array([zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cut[:-1], cut[1:])], pa.int64()),
                            }
                        )

    wide = min(len(rows), 2048)
    return spark.createDataFrame(rows, "path string, base long").repartition(wide).mapInArrow(run, schema)


def packed_round_trip(df: DataFrame, tokenizer: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the ids of df(doc_id, text) as packed files and describe every document from the files.

    (doc_id, start, n_tokens, ids_crc32): start counts the ids of all documents before it in id order, n_tokens
    includes the end id, the checksum is over little-endian unsigned 32-bit ids. An empty table gives an empty table.
    """
    spark = df.sparkSession
    return read_documents(spark, write_ids(df, folder or shared_folder(spark, "packed-ids"), tokenizer, end_id))
