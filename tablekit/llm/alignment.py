"""Alignment of two tokenizers' tokens over the same bytes, as Arrow tables.

The tokens of a slice of documents are two list columns. Flattened, with their parent indices and a cumulative sum of
token bytes that starts anew in each list, they become two tables keyed by (document, end). A hash join of the two on
that key finds the places where tokens of both end; its outer form lists every stretch between two ends, and each
stretch lies in exactly one token of either side: the stretches are the links. Links are counted per slice by a group-by,
Spark adds the counts up, and a last pass reads the stored links against them.

Texts are tokenised by the libraries, chunk by chunk where both tokenizers treat chunks alone, so that a chunk that a
worker remembers is not tokenised again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.common import documents, map_slices, stored, tokenizer_file, worker_cache
from tablekit.llm.token_counts import byte_alphabet
from tablekit.llm.words import Chunks, Memo

SPACE = "▁"
#: Tokens of both sides aligned at a time, characters of a piece of an odd text, links read at a time.
WINDOW, PIECE, READ = 250_000, 50_000, 500_000
#: Distinct chunks a worker remembers in each of two generations; about 75 MB in all.
REMEMBER = 180_000
#: Pairs of ids whose counts a worker holds at once; with more, the links are read once for each block of pairs.
BLOCK_PAIRS = 4_000_000
#: Place of the document in a (document, end) key.
_SHIFT = 40
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, most: int) -> list[str]:
    """The text cut at single spaces, which go, into pieces of about `most` characters; longer where it has no such place."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


class Pair:
    """The two tokenizers; encodes texts that have a space in front as lists of ids of both."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine
        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        names = {**spec["model"]["vocab"]}
        self.a_bytes = [b""] * (max([*names.values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode("utf-8")
        self.b_bytes = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(SPACE, " ").encode("utf-8"))
        self.a_table, self.b_table = _spellings(self.a_bytes), _spellings(self.b_bytes)
        self.a_length = pa.array(list(map(len, self.a_bytes)), pa.int64())
        self.b_length = pa.array(list(map(len, self.b_bytes)), pa.int64())
        # Decimal ids with what stands before them: the first token of a group, or a later one.
        self.a_text = [(b";%d" % i, b",%d" % i) for i in range(len(self.a_bytes))]
        self.b_text = [(b"|%d" % i, b",%d" % i) for i in range(len(self.b_bytes))]
        self.text = [t for pair in (self.a_text, self.b_text) for k in (0, 1) for t in [x[k] for x in pair]]
        self.memo = Memo(self.encode, REMEMBER)

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of both sides of every chunk. A chunk that begins with a line break follows other text; any other has
        a space in front."""
        line = [c[:1] == "\n" for c in chunks]
        whole = [c if own else " " + c for c, own in zip(chunks, line)]
        second = self.second.encode(chunks, num_threads=1) if chunks else []
        return self._packed(whole, [b[1:] if own else b for b, own in zip(second, line)])  # a line has no space of its own

    def spaced(self, found: list[str]) -> list[bytes]:
        """The same for pieces that all have a space in front, whatever they begin with."""
        return self._packed([" " + p for p in found], self.second.encode(found, num_threads=1))

    def _packed(self, whole: list[str], second: list[list[int]]) -> list[bytes]:
        """For each text 32-bit integers: twice the number of ids of the first side, plus one if both sides spell the text,
        and the ids of both."""
        first = [e.ids for e in self.first.encode_batch_fast(whole, add_special_tokens=False)]
        n = len(whole)
        texts = [t.encode("utf-8") for t in whole]
        want, size = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, n)
        edge = np.cumsum(size) - size
        good, flat, count = np.ones(n, bool), [], []
        for ids, table in ((first, self.a_table), (second, self.b_table)):
            count.append(np.fromiter(map(len, ids), np.int64, n))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(count[-1].sum())))
            good &= _sums(table[1][flat[-1]], count[-1]) == size
        for ids, c, table in zip(flat, count, (self.a_table, self.b_table)):
            own = ids[np.repeat(good, c)]
            equal = _gather(table[2], table[0][own], table[1][own]) == _gather(want, edge[good], size[good])
            good[np.flatnonzero(good)[_sums(~equal, size[good]) > 0]] = False
        out = np.empty(n + sum(map(len, flat)), "<u4")
        begin = np.arange(n) + np.cumsum(count[0] + count[1]) - count[0] - count[1]
        out[begin] = count[0] * 2 + good
        for ids, c, at in ((flat[0], count[0], begin + 1), (flat[1], count[1], begin + 1 + count[0])):
            out[np.repeat(at - (np.cumsum(c) - c), c) + np.arange(len(ids))] = ids
        packed, cut = out.tobytes(), [*(begin * 4).tolist(), 4 * len(out)]
        return [packed[i:j] for i, j in zip(cut[:-1], cut[1:])]

    def tokens(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Encoded chunks, which of them the texts consist of in order, and where each text begins among those."""
        own = Chunks(texts, "", SPACE)
        values = self.memo.values(own.distinct)
        size = np.zeros(len(texts), np.int64)
        size[own.rows] = np.diff(own.starts)
        parts = {int(i): pieces(texts[int(i)].as_py(), PIECE) for i in np.flatnonzero(~own.plain) if len(texts[int(i)].as_py())}
        for i, found in parts.items():
            size[i] = len(found)
        stop = np.cumsum(size)
        index = np.empty(int(stop[-1]) if len(stop) else 0, np.int64)
        plain = np.repeat(own.plain, size)
        index[plain] = own.index
        values = list(values)
        for i, found in parts.items():
            index[stop[i] - size[i] : stop[i]] = len(values) + np.arange(len(found))
            values.extend(self.spaced(found))
        return values, index, np.concatenate(([0], stop))


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] for every entry, end to end."""
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return flat[at]


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    stop = np.cumsum(size)
    return total[stop] - total[stop - size]


def _spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins among all their bytes, how long it is, and the bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(words), np.uint8)


def _ends(lists: pa.ListArray, length: pa.Array, name: str) -> tuple[pa.Table, pa.Array]:
    """(key, place) of every token's end, where the key is the list and the bytes up to there; and the tokens."""
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pc.take(length, flat))
    before = np.concatenate(([0], running.to_numpy()))[lists.offsets.to_numpy()[:-1]]
    end = pc.subtract(running, pc.take(pa.array(before), parent))
    key = pc.bit_wise_or(pc.shift_left(parent.cast(pa.int64()), _SHIFT), end)
    return pa.table({"key": key, name: pa.array(np.arange(len(flat)))}), flat


def align(a: pa.ListArray, b: pa.ListArray, pair: Pair) -> dict[str, np.ndarray]:
    """Links of the lists (which list each is in, and the two ids) and the decimal text of their groups, token by token.

    Both lists of a row must spell the same bytes, and no token may be empty.
    """
    ends_a, flat_a = _ends(a, pair.a_length, "a")
    ends_b, flat_b = _ends(b, pair.b_length, "b")
    met = ends_a.join(ends_b, "key", join_type="full outer", use_threads=False).combine_chunks()
    key = met.column("key").to_numpy()
    met = met.take(pa.array(np.argsort(key, kind="stable")))  # nearly in order already
    at_a, at_b = met.column("a").combine_chunks(), met.column("b").combine_chunks()
    both = pc.and_(at_a.is_valid(), at_b.is_valid()).to_numpy(zero_copy_only=False)
    link_a, link_b = pc.fill_null_backward(at_a).to_numpy(), pc.fill_null_backward(at_b).to_numpy()
    ids_a, ids_b = flat_a.to_numpy(), flat_b.to_numpy()
    # The group of a token is the number of cuts before it; a group's tokens of the first side precede the other's.
    cut_a, cut_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    cut_a[link_a[both]] = cut_b[link_b[both]] = 1
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n_groups = int(both.sum())
    stop_a, stop_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    later_a, later_b = np.concatenate(([0], 1 - cut_a[:-1])), np.concatenate(([0], 1 - cut_b[:-1]))
    n_a, n_b = len(pair.a_text), len(pair.b_text)
    text[np.arange(len(ids_a)) + np.concatenate(([0], stop_b))[group_a]] = ids_a + later_a * n_a
    text[np.arange(len(ids_b)) + stop_a[group_b]] = 2 * n_a + ids_b + later_b * n_b
    row = met.column("key").to_numpy() >> _SHIFT
    return {"row": row, "a": ids_a[link_a], "b": ids_b[link_b], "group_row": row[both], "text": text}


def _aligned(pair: Pair, texts: pa.Array) -> Iterator[dict]:
    """Per text its counts, the digest of its groups and its links as a * (number of b ids) + b."""
    values, index, starts = pair.tokens(texts)
    ids = np.frombuffer(b"".join(values), "<u4").astype(np.int64)
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    begin = np.cumsum(size) - size
    size_a, good = ids[begin] >> 1, (ids[begin] & 1).astype(bool)
    size_b, begin_a, begin_b = size - size_a - 1, begin + 1, begin + 1 + size_a
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    whole = np.ones(len(texts), bool)
    whole[doc[~good[index]]] = False
    used = whole[doc]
    doc, index = doc[used], index[used]
    out = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "digest": None, "links": []} for _ in range(len(texts))]
    spent = np.cumsum(size_a[index] + size_b[index])
    at = 0
    while at < len(index):
        stop = max(at + 1, int(np.searchsorted(spent, (spent[at - 1] if at else 0) + WINDOW, "right")))
        mine, rows = index[at:stop], doc[at:stop]
        first = np.flatnonzero(np.concatenate(([True], np.diff(rows) > 0)))
        lists = []
        for at_side, n_side in ((begin_a, size_a), (begin_b, size_b)):
            edge = np.concatenate(([0], np.cumsum(n_side[mine])))[np.append(first, len(mine))]
            lists.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(_gather(ids, at_side[mine], n_side[mine]))))
        found = align(*lists, pair)
        codes = found["a"] * len(pair.b_bytes) + found["b"]
        n_a, n_b = (np.diff(x.offsets.to_numpy()) for x in lists)
        n_groups, n_links = (np.bincount(found[c], minlength=len(first)) for c in ("group_row", "row"))
        cut_links, cut_text = np.cumsum(n_links), np.cumsum(n_a + n_b)
        text = found["text"].tolist()
        codes = codes.astype(np.uint32 if len(codes) and codes.max() < 1 << 32 else np.int64)
        for k, i in enumerate(rows[first].tolist()):
            r = out[i]
            for c, n in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
                r[c] += int(n[k])
            shown = b"".join(map(pair.text.__getitem__, text[cut_text[k] - n_a[k] - n_b[k] : cut_text[k]]))
            if r["digest"] is None:
                r["digest"], shown = hashlib.sha256(), shown[1:]
            r["digest"].update(shown)
            r["links"].append(codes[cut_links[k] - n_links[k] : cut_links[k]])
        at = stop
    return iter(out)


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The links of a batch, READ at a time: rows touched, links, and the row of each among those."""
    lists = batch.column("links")
    edge = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    edge = edge - edge[0]
    for k in range(0, len(flat), READ):
        part = flat[k : k + READ]
        row = np.searchsorted(edge, np.arange(k, k + len(part)), "right") - 1
        yield slice(int(row[0]), int(row[-1]) + 1), part, row - row[0]


def _pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): how many links hold each pair of ids, and whether no pair of its b id has more."""

    def run(batches):
        for batch in batches:
            for _, part, _ in _windows(batch):
                counted = pa.table({"code": part.astype(np.int64)}).group_by("code", use_threads=False).aggregate([([], "count_all")])
                yield from counted.select(["code", "count_all"]).rename_columns(["code", "n"]).to_batches()

    counts = linked.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts").withColumn("b", F.col("code") % n_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_counts(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """linked with n_best and count_sum, from the counts in as many blocks as bound what a worker holds."""
    context = linked.sparkSession.sparkContext
    counts = stored(counts, "pair-best")
    blocks = max(1, -(-counts.count() // BLOCK_PAIRS))
    linked = linked.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    schema = linked.schema
    for k in range(blocks):
        held = counts.filter(F.pmod(F.xxhash64("code"), F.lit(blocks)) == k).toArrow()
        order = np.argsort(held.column("code").to_numpy(), kind="stable")
        sent = context.broadcast(tuple(held.column(c).to_numpy()[order] for c in ("code", "n", "best")))

        def run(batches, sent=sent):
            code, n, best = sent.value
            for batch in batches:
                sums = {c: batch.column(c).to_numpy().copy() for c in ("n_best", "count_sum")}
                for rows, part, row in _windows(batch):
                    at = np.searchsorted(code, part)
                    at[at == len(code)] = 0
                    hit = code[at] == part if len(code) else np.zeros(len(part), bool)
                    at, row = at[hit], row[hit]
                    for c, value in (("n_best", best), ("count_sum", n)):
                        total = np.concatenate(([0], np.cumsum(value[at], dtype=np.int64)))
                        edge = np.searchsorted(row, np.arange(rows.stop - rows.start + 1))
                        sums[c][rows] += np.diff(total[edge])
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([pa.array(sums[c]) if c in sums else batch.column(c) for c in names], names)

        linked = linked.mapInArrow(run, schema)
        if k + 1 < blocks:
            linked = stored(linked, "aligned-block")
    return linked


def cross_alignment(df: DataFrame, byte_level: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of df(doc_id, text).

    A are the tokens of space + text by a byte-level BPE, B those of text by a sentencepiece model, which adds the space.
    Groups lie between offsets where tokens of both end; links are the A-B pairs whose byte ranges overlap; the count of
    a pair of ids is how many links of all rows hold it, and n_best counts links whose pair has the highest count of its B
    id (ties included). Null and empty texts, and those that the tokens of either side do not spell, have zeros and ''.
    Repeated rows and null ids come out as they went in, and count as often as they come; an empty table gives an empty
    table. Special strings in a text are plain text. Memory is bounded by windows of tokens but for a single word.
    """
    paths = byte_level or tokenizer_file("byte_bpe_50k.json"), piece_model or tokenizer_file("piece_bpe_32k.model")
    pair = Pair(*paths)
    n_b = len(pair.b_bytes)
    # A pair of ids is one number; it mostly fits 31 bits.
    kind, code = (pa.int32(), "int") if len(pair.a_bytes) * n_b < 1 << 31 else (pa.int64(), "long")
    del pair

    def work(batch: pa.RecordBatch) -> dict:
        pair = worker_cache(("alignment", *paths), lambda: Pair(*paths))
        rows = list(_aligned(pair, batch.column("text")))
        edge = np.concatenate(([0], np.cumsum([r["n_links"] for r in rows])))
        flat = [x for r in rows for x in r["links"]]
        links = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)).cast(kind))
        out = {c: [r[c] for r in rows] for c in ("n_a", "n_b", "n_groups", "n_links")}
        return {"doc_id": batch.column("doc_id"), **out, "groups_sha256": [r["digest"].hexdigest() if r["digest"] else "" for r in rows], "links": links}

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<" + code + ">"
    linked = stored(map_slices(documents(df), work, fields, most=1_000_000), "aligned", **{"parquet.block.size": 16 << 20})
    found = _with_counts(linked, _pair_counts(linked, n_b))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
