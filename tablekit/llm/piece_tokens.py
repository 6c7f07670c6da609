"""SentencePiece BPE encoding through a prefix table, and decoding.

Merging pieces by score gives every prefix of a word exactly one last token. The table holds it for each prefix: an
automaton lists the pieces that end at a place, and the one that may follow the last token of the prefix before it
is the entry. Ids are then read off backwards from the end of the word. All distinct words of a slice are filled in
step, place by place, as numpy arrays.

Whether a token may follow another is a question about the two alone. Each piece has a derivation tree; along the
right edge of the first and the left edge of the second, symbols exist from the merge that makes them to the merge
that takes them up. The pair is possible unless two symbols that face each other at the same time form a piece whose
turn comes before either of them is taken up.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tablekit.llm.common import documents, map_slices, small_batches, tokenizer_file, worker_cache
from tablekit.llm.words import Chunks, CodeIndex, Memo

SPACE = "▁"
#: Words up to this length are filled in step; longer ones one by one.
IN_STEP = 64
#: Distinct chunks a worker remembers in each of two generations; about 25 MB in all.
REMEMBER = 60_000
#: Slots of the memory of pair answers.
PAIR_BITS = 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_START, _NONE = -1, -2


class PrefixTable:
    """The pieces of a BPE model with byte fallback, and the encoder over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and the identity normaliser is needed")
        self.byte = [0] * 256
        pieces: dict[str, tuple[float, int]] = {}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
            elif p.type == NORMAL:
                pieces[p.piece] = (p.score, i)
        runs = {p: v for p, v in pieces.items() if len(p) > 1 and not p.strip(SPACE)}
        if any(SPACE in p[1:] and p not in runs for p in pieces) or {s for s, _ in runs.values()} - {min((s for s, _ in pieces.values()), default=0)}:
            raise ValueError("pieces may hold a space only in front, and runs of spaces must merge last")
        self.run_id = {len(p): i for p, (_, i) in runs.items()} | {1: pieces[SPACE][1]}
        words = {p: v for p, v in pieces.items() if p not in runs}
        # Merges come by descending score; single characters exist from the start.
        by_turn = sorted((p for p in words if len(p) > 1), key=lambda p: -words[p][0])
        self.turn = {p: k + 1 for k, p in enumerate(by_turn)} | {p: 0 for p in words if len(p) == 1}
        self.id_of = {p: v[1] for p, v in words.items()}
        self.known = {p for p in words if len(p) == 1}
        n = len(model.pieces)
        self.length = np.zeros(n, np.int64)
        parts: dict[str, tuple[str, str]] = {}
        usable = list(self.known)
        for p in by_turn:
            whole = self._merge(list(p))
            if len(whole) == 1:
                usable.append(p)
                parts[p] = whole[0]
        for p in usable:
            self.length[self.id_of[p]] = len(p)
        self._automaton(usable)
        self._edges(usable, parts, n)
        self._scalar: tuple[list, list, dict] | None = None
        self._answers: dict[int, bool] = {}
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.memo = Memo(self.encode_chunks, REMEMBER)

    def _merge(self, symbols: list[str]) -> list:
        """Plain merging of a short list by turn, leftmost first; a whole piece is returned as its two last parts."""
        last = None
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                t = self.turn.get(symbols[k] + symbols[k + 1])
                if t is not None and (best is None or t < best):
                    best, at = t, k
            if best is None:
                return symbols
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return [last or symbols[0]]

    def _automaton(self, usable: list[str]) -> None:
        """The trie of the pieces as one index over (state, character); accept has the piece that ends in a state."""
        step: dict[tuple[int, int], int] = {}
        accept = [-1]
        for p in usable:
            state = 0
            for c in map(ord, p):
                if (state, c) not in step:
                    step[state, c] = len(accept)
                    accept.append(-1)
                state = step[state, c]
            accept[state] = self.id_of[p]
        self.steps = CodeIndex(np.array([(s << 21) | c for s, c in step], np.int64))
        self.goes_to = np.array(list(step.values()), np.int64)
        self.accept = np.array(accept, np.int64)

    def matches(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length from 1 up: where pieces of that length start in the text, and which they are."""
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        at, state, out = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        while len(at):
            n = len(out)
            inside = at + n < len(letters)
            at, state = at[inside], state[inside]
            found = self.steps.find((state << 21) | letters[at + n])
            go = found >= 0
            at, state = at[go], self.goes_to[found[go]]
            token = self.accept[state]
            ends = token >= 0
            out.append((at[ends], token[ends]))
        return out

    def _edges(self, usable: list[str], parts: dict, n: int) -> None:
        """For every piece the symbols along its right and left edge, with the turns that make and take them."""
        never = np.int64(1) << 40

        def edge(p: str, side: int) -> list[tuple[int, int, int]]:
            out, taken = [], never
            while True:
                out.append((self.id_of[p], self.turn[p], int(taken)))
                if p not in parts:
                    return out
                taken, p = self.turn[p], parts[p][side]

        right = {self.id_of[p]: edge(p, 1) for p in usable}
        left = {self.id_of[p]: edge(p, 0) for p in usable}
        depth = max((len(x) for x in [*right.values(), *left.values()]), default=1)
        self.right = np.full((n, depth, 3), -1, np.int64)
        self.left = np.full((n, depth, 3), -1, np.int64)
        for table, edges in ((self.right, right), (self.left, left)):
            for i, x in edges.items():
                table[i, : len(x)] = x
        code, turn = [], []
        for p, t in self.turn.items():
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    code.append((a << 20) | b)
                    turn.append(t)
        order = np.argsort(np.array(code, np.int64))
        self.merge_code = np.array(code, np.int64)[order]
        self.merge_turn = np.array(turn, np.int64)[order]

    def _fit(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """May second follow first, from the derivation edges."""
        good = np.ones(len(first), bool)
        rights, lefts = self.right[first], self.left[second]
        for i in range(rights.shape[1]):
            x, made_x, taken_x = rights[:, i, 0], rights[:, i, 1], rights[:, i, 2]
            if not (x >= 0).any():
                break
            for j in range(lefts.shape[1]):
                y, made_y, taken_y = lefts[:, j, 0], lefts[:, j, 1], lefts[:, j, 2]
                rows = np.flatnonzero((x >= 0) & (y >= 0) & good & (made_x < taken_y) & (made_y < taken_x))
                if not len(rows):
                    continue
                code = (x[rows] << 20) | y[rows]
                at = np.minimum(np.searchsorted(self.merge_code, code), len(self.merge_code) - 1)
                hit = self.merge_code[at] == code
                rows, turn = rows[hit], self.merge_turn[at[hit]]
                # Equal turns go leftmost first: before the same merge inside second, after the same inside first.
                good[rows[(turn < taken_x[rows]) & (turn <= taken_y[rows])]] = False
        return good

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """May second follow first; answers are remembered by pair."""
        out = first == _START
        rows = np.flatnonzero(first >= 0)
        code = (first[rows] << 20) | second[rows]
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        hit = self.pair_key[slot] == code
        out[rows[hit]] = self.pair_fits[slot[hit]]
        if not hit.all():
            new, where = np.unique(code[~hit], return_inverse=True)
            answer = self._fit(new >> 20, new & ((1 << 20) - 1))
            out[rows[~hit]] = answer[where]
            at = ((new.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_key[at], self.pair_fits[at] = new, answer
            held = self.pair_key[at] == new  # of two new pairs in one slot the last key stays, and so must its answer
            self.pair_fits[at[held]] = answer[held]
        return out

    def fits_alone(self, first: int, second: int) -> bool:
        """The same for one pair, without arrays: for long words, whose places depend on one another."""
        code = (first << 20) | second
        answer = self._answers.get(code)
        if answer is not None:
            return answer
        if self._scalar is None:
            edges = [[[tuple(x) for x in own if x[0] >= 0] for own in table.tolist()] for table in (self.right, self.left)]
            self._scalar = *edges, dict(zip(self.merge_code.tolist(), self.merge_turn.tolist()))
        rights, lefts, turns = self._scalar
        answer = True
        for x, made_x, taken_x in rights[first]:
            for y, made_y, taken_y in lefts[second]:
                if made_x < taken_y and made_y < taken_x:
                    turn = turns.get((x << 20) | y)
                    if turn is not None and turn < taken_x and turn <= taken_y:
                        answer = False
                        break
            if not answer:
                break
        if len(self._answers) >= 1 << PAIR_BITS:
            self._answers.clear()
        self._answers[code] = answer
        return answer

    def encode_in_step(self, words: list[str]) -> list[bytes]:
        """Ids of short words of known characters, packed as little-endian 32-bit integers."""
        if not words:
            return []
        text = "\n".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        begin_of = np.repeat(begin, size + 1)
        found = self.matches(text)
        most = len(found)
        end = np.concatenate([s + k for k, (s, _) in enumerate(found)])
        token = np.concatenate([t for _, t in found])
        length = np.repeat(np.arange(most) + 1, [len(s) for s, _ in found])
        # By place in the word, longest pieces first: the key is small, so that sorting it is a counting sort.
        key = ((end - begin_of[end]) * most + (most - length)).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        end, token = end[order], token[order]
        stops = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=int(size.max()) * most))))
        last = np.full(len(text) + 1, _NONE, np.int64)
        for k in np.flatnonzero(np.diff(stops)):
            e, t = end[stops[k] : stops[k + 1]], token[stops[k] : stops[k + 1]]
            open_ = last[e] == _NONE
            e, t = e[open_], t[open_]
            before = e - (most - k % most)
            good = self.fits(np.where(before < begin_of[e], _START, last[before]), t)
            last[e[good]] = t[good]
        # Backwards: every word steps from its end to the token before.
        at = begin + size - 1
        rows = np.arange(len(words))
        back: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            tokens = last[at]
            back.append((rows, tokens))
            at = at - self.length[np.maximum(tokens, 0)]
            go = (at >= begin[rows]) & (tokens >= 0)
            rows, at = rows[go], at[go]
        count = np.zeros(len(words), np.int64)
        for r, _ in back:
            count[r] += 1
        stop = np.cumsum(count)
        flat = np.empty(int(stop[-1]), np.int64)
        for k, (r, tokens) in enumerate(back):
            flat[stop[r] - 1 - k] = tokens
        if (flat < 0).any():
            raise AssertionError("a prefix without a last token")
        packed = flat.astype("<u4").tobytes()
        cut = [0, *(stop * 4).tolist()]
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def encode_long(self, word: str) -> list[int]:
        """The same table filled place by place for one word, with byte fallback for unknown characters."""
        last: list[int] = [_NONE] * len(word)
        for k, c in enumerate(word):
            if c not in self.known:
                last[k] = -3
        found = self.matches(word)
        end = np.concatenate([s + k for k, (s, _) in enumerate(found)]) if found else np.zeros(0, np.int64)
        token = np.concatenate([t for _, t in found]) if found else end
        order = np.lexsort((-self.length[token], end))
        for e, t in zip(end[order].tolist(), token[order].tolist()):
            if last[e] != _NONE:
                continue
            k = e - int(self.length[t])
            before = _START if k < 0 or last[k] == -3 else last[k]
            if before == _START or before >= 0 and self.fits_alone(before, t):
                last[e] = t
        out: list[int] = []
        end = len(word) - 1
        while end >= 0:
            t = last[end]
            if t == -3:
                out.extend(self.byte[b] for b in reversed(word[end].encode("utf-8")))
                end -= 1
            elif t < 0:
                raise AssertionError("a prefix without a last token")
            else:
                out.append(t)
                end -= int(self.length[t])
        return out[::-1]

    def space_run(self, n: int) -> list[int]:
        """Ids of n spaces that no word took up: all runs merge with one score, so the leftmost pair goes first."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            # Everything left of the new single has settled; merging with it can set off merges further left.
            while len(done) > 1 and done[-2] + done[-1] in self.run_id:
                done[-2:] = [done[-2] + done[-1]]
        return [self.run_id[k] for k in done]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks: a line break and what follows, or a word with its spaces in front.

        A chunk that begins with a line break has no space; one that begins with the space mark has all of its
        spaces written out; any other stands for one space and the word.
        """
        word_of: list[str] = []
        extra: list[int] = []
        for c in chunks:
            if c[:1] == "\n":
                word_of.append(c[1:])
                extra.append(-1)
            elif c[:1] == SPACE:
                bare = c.lstrip(SPACE)
                word_of.append(SPACE + bare)
                extra.append(len(c) - len(bare) - 1)
            else:
                word_of.append(SPACE + c)
                extra.append(0)
        distinct = list(dict.fromkeys(word_of))
        known = self.known
        short = [w for w in distinct if 0 < len(w) <= IN_STEP and known.issuperset(w)]
        table = dict(zip(short, self.encode_in_step(short)))
        for w in distinct:
            if w not in table:
                table[w] = np.array(self.encode_long(w), "<u4").tobytes()
        newline = np.array([self.byte[10]], "<u4").tobytes()
        single = np.array([self.run_id[1]], "<u4").tobytes()
        out = []
        for w, n in zip(word_of, extra):
            ids = table[w]
            if n == -1:
                ids = newline + ids
            elif n > 0:
                free = ids[:4] == single
                ids = np.array(self.space_run(n + free), "<u4").tobytes() + (ids[4:] if free else ids)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of whole texts, without begin or end ids."""
        own = Chunks(texts, "", SPACE)
        out: list = [None] * len(texts)
        for i, ids in zip(own.rows.tolist(), own.join(self.memo.values(own.distinct), "<u4")):
            out[i] = ids
        for i in np.flatnonzero(~own.plain).tolist():
            text = texts[i].as_py()
            parts = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []
            distinct = list(dict.fromkeys(parts))
            known = dict(zip(distinct, self.encode_chunks(distinct)))
            out[i] = np.frombuffer(b"".join([known[c] for c in parts]), "<u4")
        return out


def encode_decode(df: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_same) for every row of df(doc_id, text).

    Ids are those of the library with an end id; the digest is that of the decimal ids joined by one space. The
    text is decoded from the ids again, and decoded_same says whether it is the text that went in. A null text counts
    as empty (the end id alone). Repeated rows and null ids come out as they went in; an empty table gives an
    empty table. One pass, no shuffle.
    """
    path = model or tokenizer_file("piece_bpe_32k.model")

    def load():
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return PrefixTable(path), library, library.eos_id(), [str(i).encode() for i in range(library.get_piece_size())]

    def work(batch: pa.RecordBatch) -> dict:
        table, library, end, decimal = worker_cache(("piece_tokens", path), load)
        texts = batch.column("text").to_pylist()
        n, ids_digest, text_digest, same = [], [], [], []
        for text, packed in zip(texts, table.encode(batch.column("text"))):
            ids = packed.tolist()
            ids.append(end)
            decoded = library.decode(ids)
            n.append(len(ids))
            ids_digest.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
            text_digest.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            same.append(decoded == text)
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids_digest, "decoded_sha256": text_digest, "decoded_same": same}

    return map_slices(documents(small_batches(df)), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_same boolean", most=1_000_000)
