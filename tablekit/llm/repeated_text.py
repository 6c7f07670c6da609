"""Removal of byte strings that an earlier document has already.

Every byte that lies in a WINDOW-byte string which also starts in a document with a smaller id goes. No suffix of
the corpus travels: equal windows share a marked core (minimizers), so documents first send a hash of every marked
core and of the bytes around it.

1. Hashes meet by core. Where the bytes around a core are the same in several documents, all but the first of them
   lose all of these bytes. Where they differ, one document of each kind has to show its bytes.
2. Documents read the answers and send the bytes asked for, those of the windows that mark a core.
3. The bytes of a core meet in one task, which sorts all suffixes of WINDOW bytes deep and shallow; in a group of equal
   ones all documents but the first lose theirs.
4. Documents unite what they lose.

Documents are dealt out once, compressed; steps 2 and 4 read the same shuffle. Nothing is written but shuffles, and a task
works through its core or suffixes in parts of bounded size, so its memory does not follow the share of text that repeats.

A core that very many documents have is no hot spot: a task sends a core and its surroundings once, for the smallest
of its documents, and tells the others at once. A core with very many different surroundings is asked for single
windows, which meet by their own hash and so spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tablekit.llm.common import col, free_worker_cache, give_back, shuffle_width, slices, small_batches
from tablekit.llm.minimizers import CORE, REACH, WINDOW, core_hashes, eights, marked, mixed
from tablekit.llm.suffixes import equal_groups

#: Bytes of text hashed at once, and bytes of text in a round, within which equal hashes are sent once.
SLICE, ROUND = 500_000, 6_000_000
#: Compressed bytes of hashes that a bucket of cores answers at once, and windows whose suffixes are sorted at once.
ANSWERED, SORTED = 6_000_000, 400_000
#: Bytes asked for that a group of documents gathers before they leave.
SHOWN = 6_000_000
#: Different surroundings of a core from which on single windows are sent.
MANY = 1_024
#: A null id is greater than every other.
NULL_ID = 1 << 62
KEY_BITS, AROUND_BITS = 40, 48
COVER, SHOW, SHOW_WINDOWS = 1, 2, 3
_ROW = "target long, kind int, blob binary"


def to_blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed; the first ascends and is kept as steps."""
    parts = [np.int64(len(arrays[0])).tobytes()]
    for k, a in enumerate(arrays):
        a = np.asarray(a, np.int64)
        if k == 0:
            a = np.diff(a, prepend=0)
        parts.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def from_blobs(blobs: list[bytes], n_arrays: int, pick: Callable | None = None) -> list[np.ndarray]:
    """The arrays of the blobs, one after another; pick: which rows of a blob's arrays are wanted."""
    out: list[list[np.ndarray]] = [[] for _ in range(n_arrays)]
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        planes = np.frombuffer(data, np.uint8, offset=8).reshape(n_arrays, 8, n)
        arrays = [np.ascontiguousarray(planes[k].T).view(np.int64).reshape(-1) for k in range(n_arrays)]
        arrays[0] = np.cumsum(arrays[0])
        rows = pick(arrays) if pick else slice(None)
        for k in range(n_arrays):
            out[k].append(arrays[k][rows])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def doc_group(doc: np.ndarray, width: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(width)).astype(np.int64)


def row_key(doc: int, text: bytes) -> int:
    """Tells rows apart that share an id."""
    return xxhash.xxh3_64_intdigest(text, seed=doc & 0xFFFFFFFF) >> 1


class Marks:
    """The marked cores of some texts, laid end to end."""

    def __init__(self, texts: list[bytes], width: int):
        self.data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(size)
        words = eights(self.data)
        hashes = core_hashes(words)
        n = int(end[-1]) if len(end) else 0
        hashes = hashes[: max(0, n - CORE + 1)]
        # Windows over the edge of a text count as nothing: give them the least minimum there is.
        crosses = np.zeros(max(0, n - WINDOW + 1), bool)
        if len(crosses):
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, np.maximum(end - WINDOW + 1, end - size), 1)
            np.add.at(step, end, -1)
            crosses = np.cumsum(step)[: len(crosses)] > 0
        at, first, last = marked(hashes, crosses)
        self.text = np.searchsorted(end, at, "right")
        self.begin = (end - size)[self.text]
        # The bytes around a core are those of the windows that mark it: every window belongs to a core.
        self.left = at - first
        self.right = last + WINDOW - at
        h = hashes[at]
        self.bucket = ((h >> np.uint64(KEY_BITS)) % np.uint64(width)).astype(np.int64)
        self.key = (h & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
        self.at = at
        around = (self.left * 64 + self.right).astype(np.uint64)
        for o in (*range(-REACH, WINDOW - 8, 8), WINDOW - 8):
            place = at + np.minimum(np.maximum(o, -self.left), self.right - 8)
            around = mixed(around ^ words[place] * np.uint64(0xC2B2AE3D27D4EB4F))
        self.around = (around >> np.uint64(64 - AROUND_BITS)).astype(np.int64)


def _per_target(target: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each target, given an order that has targets together."""
    ordered = target[order]
    cut = np.flatnonzero(np.diff(ordered, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(ordered))):
        yield int(ordered[a]), order[a:b]


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["target", "kind", "blob"]
    )


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def send_hashes(width: int) -> Callable:
    """Per round: kind 0 to a bucket of cores (doc, key, around); kind 1 to a group of documents (joint hash of doc, core
    and around; COVER) for what a smaller document of the same round has in the same surroundings."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch | None:
        doc, bucket, key, around = (np.concatenate([h[k] for h in held]) for k in range(4))
        order = np.lexsort((doc, around, key, bucket))
        doc, bucket, key, around = doc[order], bucket[order], key[order], around[order]
        first = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (around[1:] != around[:-1])))[: len(doc)]
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        new = first | np.concatenate(([True], doc[1:] != doc[:-1]))[: len(doc)]
        out = []
        send = np.flatnonzero(first)
        for target, rows in _per_target(bucket, send[np.lexsort((doc[send], bucket[send]))]):
            out.append((target, 0, to_blob(doc[rows], key[rows], around[rows])))
        cover = np.flatnonzero(new & (doc > least))
        out.extend((target + width, 1, blob) for target, blob in _told(doc[cover], (bucket[cover] << KEY_BITS) | key[cover], around[cover], np.full(len(cover), COVER), width))
        return _rows(out) if out else None

    def run(batches):
        free_worker_cache()
        held, size = [], 0
        for part in slices(batches, most=SLICE):
            texts = _texts(part.column("text"))
            marks = Marks(texts, width)
            held.append((_ids(part.column("doc_id"))[marks.text], marks.bucket, marks.key, marks.around))
            size += len(marks.data)
            if size >= ROUND:
                out = emit(held)
                held, size = [], 0
                if out is not None:
                    yield out
        if held:
            out = emit(held)
            if out is not None:
                yield out

    return run


def answer(width: int) -> Callable:
    """One target of send_hashes: for a bucket of cores what each document shall do; what a task already knew goes on."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        kind = table.column("kind").to_pylist()
        blobs = table.column("blob").to_pylist()
        out = [(t - width, 1, b) for t, k, b in zip(table.column("target").to_pylist(), kind, blobs) if k == 1]
        hashes = [b for k, b in zip(kind, blobs) if k == 0]
        if hashes:
            bucket = table.column("target")[kind.index(0)].as_py()
            parts = 1 + sum(map(len, hashes)) // ANSWERED
            for part in range(parts):
                out.extend((target, 1, blob) for target, blob in acts(bucket, *from_blobs(hashes, 3, lambda arrays: arrays[1] % parts == part)))
        return pa.Table.from_batches([_rows(out)])

    def acts(bucket: int, doc: np.ndarray, key: np.ndarray, around: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(doc):
            return
        order = np.lexsort((doc, around, key))
        doc, key, around = doc[order], key[order], around[order]
        core = np.concatenate(([True], key[1:] != key[:-1]))
        kinds = core | np.concatenate(([True], around[1:] != around[:-1]))
        n_of = np.add.reduceat(kinds.astype(np.int64), np.flatnonzero(core))
        which = np.cumsum(core) - 1
        low = np.minimum.reduceat(doc, np.flatnonzero(core))[which]
        high = np.maximum.reduceat(doc, np.flatnonzero(core))[which]
        least = doc[np.maximum.accumulate(np.where(kinds, np.arange(len(doc)), 0))]
        many = n_of[which]
        act = np.where(doc > least, COVER, np.where((many > 1) & (low < high) & kinds, np.where(many > MANY, SHOW_WINDOWS, SHOW), 0))
        tell = np.flatnonzero(act)
        yield from _told(doc[tell], (np.int64(bucket) << KEY_BITS) | key[tell], around[tell], act[tell], width)

    return run


def _joint(doc: np.ndarray, core: np.ndarray, around: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed(doc.astype(np.uint64)) ^ core.astype(np.uint64)) + around.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _told(doc: np.ndarray, core: np.ndarray, around: np.ndarray, act: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """For each group of documents what they are told: joint hashes that ascend, and what to do."""
    group, joint = doc_group(doc, width), _joint(doc, core, around)
    for target, rows in _per_target(group, np.lexsort((joint, group))):
        yield target, to_blob(joint[rows], act[rows])


def pack_documents(width: int) -> Callable:
    """Rows of documents as compressed Arrow messages, one for each group of documents and slice."""

    def run(batches):
        for part in slices(batches, most=ROUND):
            group = doc_group(_ids(part.column("doc_id")), width)
            out = []
            for target, rows in _per_target(group, np.argsort(group, kind="stable")):
                own = part.take(pa.array(rows))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as stream:
                    stream.write_batch(own)
                out.append((target, 0, zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())))
            if out:
                yield _rows(out)

    return run


def _documents(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The documents of a group, in batches of about SLICE bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for blob in table.column("blob").to_pylist():
        for part in slices(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)), most=SLICE):
            n = part.column("text").nbytes
            if held and size + n > SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def show(width: int) -> Callable:
    """A group of documents and what it was told: kind 0 to itself (row, start, stop) of bytes to go; kind 1 to a bucket
    (doc, row, start, length, part) with the bytes asked for. Bytes gather over batches until SHOWN of them leave at once."""

    def emit(held: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        target, doc, row, start, length, part = (np.concatenate([h[k] for h in held]) for k in range(6))
        data = b"".join(h[6] for h in held)
        at = np.cumsum(length) - length
        for bucket, rows in _per_target(target, np.lexsort((start, row, doc, target))):
            head = to_blob(doc[rows], row[rows], start[rows], length[rows], part[rows])
            body = b"".join([data[x : x + n] for x, n in zip(at[rows].tolist(), length[rows].tolist())])
            yield bucket + width, 1, len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=3).compress(body)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        free_worker_cache()
        own = key[0].as_py()
        asked, act = from_blobs(right.column("blob").to_pylist(), 2)
        order = np.argsort(asked, kind="stable")
        asked, act = asked[order], act[order]
        out, cover, held, size = [], [], [], 0
        for batch in _documents(left) if len(asked) else ():
            texts = _texts(batch.column("text"))
            ids = _ids(batch.column("doc_id"))
            marks = Marks(texts, width)
            wanted = _joint(ids[marks.text], (marks.bucket << KEY_BITS) | marks.key, marks.around)
            lo, hi = np.searchsorted(asked, wanted, "left"), np.searchsorted(asked, wanted, "right")
            hit = np.flatnonzero(lo < hi)
            if not len(hit):
                continue
            # A document may be told both by a task and by a bucket; to lose the bytes wins.
            told = act[lo[hit]]
            for more in range(1, int((hi - lo).max())):
                extra = lo[hit] + more < hi[hit]
                told[extra] = np.minimum(told[extra], act[np.minimum(lo[hit] + more, len(act) - 1)][extra])
            rowed = np.array([row_key(int(d), t) for d, t in zip(ids, texts)], np.int64)
            text = marks.text[hit]
            start, length = marks.at[hit] - marks.left[hit], (marks.left + marks.right)[hit]
            begin = marks.begin[hit]
            go = told == COVER
            cover.append(joined(rowed[text[go]], (start - begin)[go], (start - begin + length)[go]))
            data = marks.data.tobytes()
            for what in (SHOW, SHOW_WINDOWS):
                pick = np.flatnonzero(told == what)
                if not len(pick):
                    continue
                if what == SHOW:
                    t, s, n, b = text[pick], start[pick], length[pick], begin[pick]
                    h = mixed(((marks.bucket[hit] << KEY_BITS) | marks.key[hit])[pick].astype(np.uint64))
                else:
                    count = length[pick] - WINDOW + 1
                    t, b = np.repeat(text[pick], count), np.repeat(begin[pick], count)
                    s = np.repeat(start[pick], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    n = np.full(len(s), WINDOW)
                    h = np.zeros(len(s), np.uint64)
                    words = eights(marks.data)
                    for o in (*range(0, WINDOW - 8, 8), WINDOW - 8):
                        h = mixed(h ^ words[s + o] * np.uint64(0xC2B2AE3D27D4EB4F))
                target, piece = (h % np.uint64(width)).astype(np.int64), (h >> np.uint64(56)).astype(np.int64)
                shown = b"".join([data[x : x + y] for x, y in zip(s.tolist(), n.tolist())])
                held.append((target, ids[t], rowed[t], s - b, n, piece, shown))
                size += len(shown)
            if size >= SHOWN:
                out.extend(emit(held))
                held, size = [], 0
        if held:
            out.extend(emit(held))
        if cover:
            out.append((own, 0, to_blob(*joined(*(np.concatenate([c[k] for c in cover]) for k in range(3))))))
        return pa.Table.from_batches([_rows(out)])

    return run


def sort_shown(width: int) -> Callable:
    """A bucket of shown bytes: kind 0 to groups of documents (row, start, stop) for what a smaller document shows too. What
    is for a group of documents already goes on."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        if table.column("kind")[0].as_py() == 0:
            return table
        heads, bodies = [], []
        for blob in table.column("blob").to_pylist():
            k = int.from_bytes(blob[:4], "little")
            heads.append(blob[4 : 4 + k])
            bodies.append(zstandard.ZstdDecompressor().decompress(blob[4 + k :]))
        doc, row, start, length, part = from_blobs(heads, 5)
        data, at = b"".join(bodies), np.cumsum(length) - length
        del bodies
        # Equal windows are in one part.
        parts = min(256, 1 + int((length - WINDOW + 1).sum()) // SORTED)
        turn = (part * parts) >> 8
        out = []
        for k in range(parts):
            own = np.flatnonzero(turn == k)
            shown = b"".join([data[x : x + n] for x, n in zip(at[own].tolist(), length[own].tolist())])
            out.extend(found(shown, doc[own], row[own], start[own], length[own]))
        return pa.Table.from_batches([_rows(out)])

    def found(shown: bytes, doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        count = length - WINDOW + 1
        segment = np.repeat(np.arange(len(doc)), count)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(length) - length)[segment] + inside
        order, group = equal_groups(np.frombuffer(shown, np.uint8), at)
        ids = doc[segment[order]]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(ids)))) if len(head) else ids
        gone = np.sort(order[ids > least])
        if len(gone):
            # Windows that follow each other in a segment become one piece.
            new = np.concatenate(([True], (np.diff(gone) > 1) | (segment[gone][1:] != segment[gone][:-1])))
            last = np.append(np.flatnonzero(new)[1:], len(gone)) - 1
            a, b = gone[new], gone[last]
            r, s, e = row[segment[a]], start[segment[a]] + inside[a], start[segment[b]] + inside[b] + WINDOW
            target = doc_group(doc[segment[a]], width)
            for own, rows in _per_target(target, np.lexsort((s, r, target))):
                yield own, 0, to_blob(r[rows], s[rows], e[rows])

    return run


def joined(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of rows united where they touch, in order."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    base = np.cumsum(fresh) << 32
    far = np.maximum.accumulate(base + stop) - base
    new = fresh | np.concatenate(([True], start[1:] > far[:-1]))[: len(row)]
    last = np.append(np.flatnonzero(new)[1:], len(row))[: int(new.sum())] - 1
    return row[new], start[new], far[last]


def united(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes in the union of pieces that ascend by start."""
    runs: list[tuple[int, int]] = []
    for a, b in zip(start.tolist(), stop.tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def finish(names: list[str], texts_out: bool) -> Callable:
    """A group of documents and the pieces they lose: rows with their numbers, or rows with the remaining text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        row, start, stop = from_blobs(right.column("blob").to_pylist(), 3)
        order = np.lexsort((start, row))
        row, start, stop = row[order], start[order], stop[order]
        tables = []
        for batch in _documents(left):
            texts, ids = _texts(batch.column("text")), _ids(batch.column("doc_id"))
            removed, spans, kept = [], [], []
            rowed = np.array([row_key(int(d), t) for d, t in zip(ids, texts)], np.int64)
            lo, hi = np.searchsorted(row, rowed, "left"), np.searchsorted(row, rowed, "right")
            for t, a, b in zip(texts, lo.tolist(), hi.tolist()):
                runs = united(start[a:b], stop[a:b])
                rest, at = [], 0
                for x, y in runs:
                    rest.append(t[at:x])
                    at = y
                rest.append(t[at:])
                kept.append(b"".join(rest) if runs else t)
                removed.append(sum(y - x for x, y in runs))
                spans.append(len(runs))
            if texts_out:
                at = batch.schema.get_field_index("text")
                # A cut may fall inside a character; what is left of it goes too.
                known = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(batch.column(at).to_pylist(), kept)]
                tables.append(pa.Table.from_batches([batch.set_column(at, batch.schema.field(at), pa.array(known, batch.schema.field(at).type))]))
            else:
                tables.append(
                    pa.table(
                        {
                            "doc_id": batch.column("doc_id"),
                            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                            "n_removed": pa.array(removed, pa.int64()),
                            "n_spans": pa.array(spans, pa.int64()),
                            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                        }
                    )
                )
        if tables:
            return pa.concat_tables(tables).select(names)
        return None

    return run


def _removed(df: DataFrame, schema: StructType | str, names: list[str], texts_out: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    width = shuffle_width(small_batches(df).sparkSession)
    plain = df.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    # Short documents have no window, so only longer ones send hashes.
    long = plain.filter(F.octet_length("text") >= WINDOW)
    told = long.mapInArrow(send_hashes(width), _ROW).groupBy("target").applyInArrow(answer(width), _ROW)
    # Both cogroups below read one shuffle of the documents.
    everything = df.mapInArrow(pack_documents(width), _ROW)
    shown = everything.groupBy("target").cogroup(told.groupBy("target")).applyInArrow(show(width), _ROW)
    gone = shown.groupBy("target").applyInArrow(sort_shown(width), _ROW)
    last = finish(names, texts_out)
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = last(left, right)
        return arrow.empty_table() if out is None else out.cast(arrow)

    return everything.groupBy("target").cogroup(gone.groupBy("target")).applyInArrow(run, schema)


def repeated_bytes(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of df(doc_id, text).

    A byte goes if a WINDOW-byte string of its document that covers it also starts in a document with a smaller id.
    Null texts count as empty; a null id is greater than all others, and rows with one id do not remove from each
    other. Repeated rows come out as often as they came in. An empty table gives an empty table.
    """
    plain = df.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _removed(plain, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", names, False)


def without_repeated_bytes(df: DataFrame) -> DataFrame:
    """df(doc_id, text, ...) with the repeated bytes cut out of text; null texts stay null, other columns as they are."""
    return _removed(df, df.schema, df.columns, True)
