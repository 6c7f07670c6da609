"""Texts as lists of chunks that a tokenizer treats independently, and a bounded memory of what each chunk gives.

A chunk begins at a single space or line break between two characters that are not white space. No token of the
tokenizers used here reaches over such a place, so the tokens of a text are those of its chunks in order, and each
distinct chunk of a slice is tokenised once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks a worker remembers in each of its two generations.
REMEMBER = 250_000


class Memo:
    """Chunk -> value in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = REMEMBER):
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, distinct: list[str]) -> list:
        """The value of each of the distinct chunks."""
        young, old = self.young, self.old
        out = list(map(young.get, distinct))
        missing = [k for k, v in enumerate(out) if v is None]
        if old:
            again = list(map(old.get, [distinct[k] for k in missing]))
            for k, v in zip(missing, again):
                if v is not None:
                    out[k] = young[distinct[k]] = v
            missing = [k for k, v in zip(missing, again) if v is None]
        wanted = [distinct[k] for k in missing]
        for k, w, v in zip(missing, wanted, self.encode(wanted)):
            out[k] = young[w] = v
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out


#: White space other than the space and the line break.
_OTHER_SPACE = r"\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class Chunks:
    """The plain texts of an array as chunks: distinct ones, their number in reading order, and where texts begin.

    A text is plain when every run of white space is one space or one line break between other characters. A chunk is
    what stands between spaces; one that follows a line break has it in front. The first chunk of a text has `first`
    in front.
    """

    def __init__(self, texts: pa.Array, first: str = "", odd: str = ""):
        texts = texts.cast(pa.large_string())
        pattern = rf"^$|^[ \n]|[ \n]$|[ \n][ \n]|[{_OTHER_SPACE}]" + (f"|{odd}" if odd else "")
        self.plain = ~pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        own = texts.filter(pa.array(self.plain))
        marked = pc.replace_substring(own, "\n", " \n")
        if first:
            marked = pc.binary_join_element_wise(pa.scalar(first, pa.large_string()), marked, pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(marked, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        self.starts = lists.offsets.to_numpy().astype(np.int64) - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
        self.index = coded.indices.to_numpy()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.rows = np.flatnonzero(self.plain)

    def sums(self, of_distinct: np.ndarray) -> np.ndarray:
        """Per plain text the sum of a number of its chunks."""
        total = np.concatenate(([0], np.cumsum(of_distinct[self.index], dtype=np.int64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def join(self, of_distinct: list[bytes], dtype: str) -> list[np.ndarray]:
        """Per plain text the arrays of its chunks, one behind the other."""
        flat = np.frombuffer(b"".join(of_distinct), dtype)
        size = np.fromiter(map(len, of_distinct), np.int64, len(of_distinct)) // flat.dtype.itemsize
        begin = np.cumsum(size) - size
        own = size[self.index]
        stop = np.cumsum(own)
        at = np.repeat(begin[self.index] - (stop - own), own) + np.arange(int(stop[-1]) if len(stop) else 0)
        ids = flat[at]
        edge = np.concatenate(([0], stop))[self.starts]
        return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


class CodeIndex:
    """Positions of distinct non-negative 64-bit codes, found many at a time by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(4, int(np.ceil(np.log2(max(len(codes), 1) * 8))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int64)
        at, left = self._slot(codes), np.arange(len(codes))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Position of each code, -1 where there is none."""
        out = np.full(len(code), -1, dtype=np.int64)
        if not len(self.codes):
            return out
        todo, at, wanted = np.arange(len(code)), self._slot(code), code
        while len(todo):
            hit = self.slots[at]
            same = (hit >= 0) & (self.codes[hit] == wanted)
            out[todo[same]] = hit[same]
            on = (hit >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
            wanted = code[todo]
        return out
