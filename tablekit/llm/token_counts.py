"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a slice, as the library cuts them, are one flat array of symbols with the starts of their rows. In every
round each row finds its lowest-ranked adjacent pair, all rows merge theirs at once, and rows without a pair leave. What
survives are the tokens, so the count is a length and no token is ever written out. A row of many bytes would need as many
rounds as it has ranks: it is merged alone, from a queue of its pairs.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tablekit.llm.common import documents, map_slices, tokenizer_file, worker_cache
from tablekit.llm.words import Chunks, CodeIndex, Memo

#: Bytes of a pre-token up to which it is merged in step with others.
IN_STEP = 1_024


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeTable:
    """Merges of a byte-level BPE file as sorted pair codes, with the rank and the result of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normaliser is needed")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(code, kind="stable")
        keep = np.concatenate(([True], np.diff(code[order]) > 0)) if len(code) else np.zeros(0, bool)
        self.code = code[order][keep]
        self.rank = order[keep].astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[self.rank] if len(code) else code
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.index = CodeIndex(self.code)
        self._ranks: dict | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, -1 where there is none."""
        return self.index.find(left * self.size + right)

    def ranks(self) -> dict[int, tuple[int, int]]:
        """Pair code -> (rank, result), made when a long row needs it."""
        if self._ranks is None:
            self._ranks = dict(zip(self.code.tolist(), zip(self.rank.tolist(), self.result.tolist())))
        return self._ranks


def merged_alone(table: MergeTable, word: bytes) -> int:
    """Number of tokens of one long byte string: its pairs wait in a queue by rank and place."""
    ranks, size = table.ranks(), table.size
    symbol = table.byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(symbol)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    queue = [(found[0], i, symbol[i], symbol[i + 1], found[1]) for i in range(n - 1) if (found := ranks.get(symbol[i] * size + symbol[i + 1]))]
    heapify(queue)
    while queue:
        _, i, left, right, result = heappop(queue)
        j = after[i]
        if symbol[i] != left or j < 0 or symbol[j] != right:
            continue  # one of the two has gone into another merge
        symbol[i], symbol[j] = result, -1
        k = after[i] = after[j]
        n -= 1
        if k >= 0:
            before[k] = i
            if found := ranks.get(result * size + symbol[k]):
                heappush(queue, (found[0], i, result, symbol[k], found[1]))
        h = before[i]
        if h >= 0 and (found := ranks.get(symbol[h] * size + result)):
            heappush(queue, (found[0], h, symbol[h], result, found[1]))
    return n


def surviving_symbols(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Number of tokens of each byte string, by merging all of them in step."""
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = n.copy()
    for i in np.flatnonzero(n > IN_STEP).tolist():
        counts[i] = merged_alone(table, words[i])
    rows = np.flatnonzero((n > 1) & (n <= IN_STEP))
    flat = table.byte_id[np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8)]
    size = n[rows]
    none = np.int64(1) << 60
    while len(rows):
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        row = np.repeat(np.arange(len(rows)), size)
        found = np.full(len(flat), -1, dtype=np.int64)
        if len(flat) > 1:
            found[:-1] = table.find(flat[:-1], flat[1:])
        found[start + size - 1] = -1  # the last symbol of a row has no right neighbour
        rank = np.where(found >= 0, table.rank[np.maximum(found, 0)] if len(table.rank) else none, none)
        least = np.minimum.reduceat(rank, start)
        chosen = (rank == least[row]) & (found >= 0)
        # Of overlapping equal pairs (x x x) the left one merges: keep every other of a run of neighbours.
        at = np.flatnonzero(chosen)
        if len(at):
            gap = np.concatenate(([True], np.diff(at) > 1))
            head = np.maximum.accumulate(np.where(gap, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            flat[at] = table.result[found[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            size = size - np.bincount(row[at], minlength=len(rows))
            flat, row = flat[stay], row[stay]
        go = (least < none) & (size > 1)
        counts[rows] = size
        if not go.all():
            flat = flat[go[row]]
            rows, size = rows[go], size[go]
    return counts


class Counter:
    """Counts the tokens of texts as the library does with special strings recognised."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        special = sorted(self.table.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = Memo(self.chunk_counts)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, by the library's own tables of letters and numbers."""
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def chunk_counts(self, words: list[str]) -> list[int]:
        found = [self.cut(w if w.startswith("\n") else " " + w) for w in words]
        distinct = list(set().union(*found)) if found else []
        known = dict(zip(distinct, surviving_symbols(self.table, [p.encode("utf-8") for p in distinct]).tolist()))
        return [sum(map(known.__getitem__, f)) for f in found]

    def text_counts(self, texts: pa.Array) -> np.ndarray:
        own = Chunks(texts, "\n", "|".join(map(regex.escape, self.table.special)))
        out = np.zeros(len(texts), np.int64)
        known = np.array(self.memo.values(own.distinct), np.int64)
        out[own.rows] = own.sums(known) - 1  # the line break put before the first chunk is a token of its own
        odd = {}
        for i in np.flatnonzero(~own.plain).tolist():
            text = texts[i].as_py()
            parts = self.split.split(text) if self.split else [text]
            odd[i] = [p for part in parts for p in self.cut(part)]
            out[i] = len(parts) - 1
        distinct = list(set().union(*odd.values()))
        pieces = dict(zip(distinct, surviving_symbols(self.table, [p.encode("utf-8") for p in distinct]).tolist()))
        for i, found in odd.items():
            out[i] += sum(map(pieces.__getitem__, found))
        return out


def count_tokens(df: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of df(doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids come out as they went in. A
    special string inside a text is one token. An empty table gives an empty table. One pass, no shuffle.
    tokenizer: path of a byte-level BPE file in JSON.
    """
    path = tokenizer or tokenizer_file("byte_bpe_50k.json")

    def work(batch: pa.RecordBatch) -> dict:
        counter = worker_cache(("token_counts", path), lambda: Counter(path))
        texts = batch.column("text")
        n = counter.text_counts(texts)
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": n, "over_limit": n > limit}

    return map_slices(documents(df), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
