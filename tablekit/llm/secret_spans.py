"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds what they miss.

A text is a chain of tokens: runs of letters and digits, and single other characters. The field tags each token as
outside, begin or inside of a secret. Its features are the token's shape (length, mix of characters, how often they
change), its neighbours, gaps and features of the whole file, all hashed into one table of weights. It is fitted on
windows of text around matches of the patterns and elsewhere, some with the value or the name before it exchanged, so
that it learns surroundings and shapes rather than the patterns. Viterbi decoding works on blocks of the chain at once:
the best way through each block for every tag at its ends, then the chain of blocks, then the blocks again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.common import documents, map_slices

#: The patterns, their kinds in order, and the least length of what counts (of the value for assign).
PATTERNS = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
#: What a text must hold for a match, for a quick first look.
_MAY = {"assign": r"(?i)(password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{16}"}
#: The kind of the spans that the field adds, and their least length.
TAGGED, LEAST = "tagged", 8
#: Windows of text that the field is fitted on: around matches, and elsewhere; characters on either side.
SAMPLE, AROUND = 500, 90
#: Hashed weights, steps of the fit, its rate and penalty, and the share of features that a step looks at: what is left
#: out by chance is learnt from the others.
WEIGHTS, STEPS, RATE, PENALTY, LOOKED = 1 << 16, 60, 0.15, 2e-5, 0.6
#: Names and alphabets put in place of the found ones when fitting.
NAMES = ["pwd", "auth", "credential", "private_key", "access_key", "bearer", "client_id", "clé", "passphrase", "signing_key"]
ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"]
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Tokens of a block of the decoder, tokens whose features are held at once, characters cut into tokens at once.
BLOCK, HELD, CHARS = 64, 1_000_000, 2_000_000

_SPACE, _LOW_HEX, _LOW, _UP, _DIGIT, _SYMBOL, _OTHER = range(7)
_CLASS = np.full(128, _SYMBOL, np.uint8)
for _chars, _kind in (("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", _SPACE), ("abcdef", _LOW_HEX), ("ghijklmnopqrstuvwxyz", _LOW), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UP), ("0123456789", _DIGIT)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_BREAK = re.compile(r"[\x00-/:-@\[-`{-\x7f]")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def base_spans(text: str, kinds=tuple(PATTERNS)) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start of the value, its end) of the patterns' matches, in order of start and kind."""
    out = []
    for kind in kinds:
        pattern, group, least = PATTERNS[kind]
        out += [(kind, m.start(), m.end(), m.start(group), m.end(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def all_base_spans(texts: pa.Array) -> list[list[tuple[str, int, int, int, int]]]:
    """base_spans of every text; most texts are passed over at the first look."""
    texts = texts.cast(pa.large_string())
    may = {kind: pc.match_substring_regex(texts, look).to_numpy(zero_copy_only=False) for kind, look in _MAY.items()}
    out: list[list] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(np.logical_or.reduce(list(may.values()))).tolist():
        out[i] = base_spans(texts[i].as_py(), tuple(k for k in PATTERNS if may[k][i]))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Tokens:
    """Tokens of texts, end to end: text, place in it, and what the features are made of."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.cumsum(size + 1) - size - 1
        joined = "\n".join(texts)
        found: list[tuple] = []
        file = np.zeros((len(texts), 3), np.int64)
        at = 0
        while at < len(joined):
            stop = at + CHARS
            if stop < len(joined):
                cut = _BREAK.search(joined, stop)
                stop = cut.start() if cut else len(joined)
            found.append(self._cut(joined[at:stop], at, file))
            at = stop
        names = ("start", "end", "word", "shape", "coarse", "text")
        kinds = (np.int64, np.int64, np.uint32, np.uint16, np.uint16, np.int32)
        for k, (name, kind) in enumerate(zip(names, kinds)):
            setattr(self, name, np.concatenate([f[k] for f in found]).astype(kind) if found else np.zeros(0, kind))
        # Of the whole file: the shares of symbols, of digits and of signs of assignment, in steps of about a half.
        share = file / np.maximum(size, 1)[:, None]
        steps = np.clip(np.log2(share * 512 + 1), 0, 7).astype(np.uint64)
        self.file = steps[:, 0] * np.uint64(64) + steps[:, 1] * np.uint64(8) + steps[:, 2]

    def __len__(self) -> int:
        return len(self.start)

    def _cut(self, part: str, at: int, file: np.ndarray) -> tuple:
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = np.where(code < 128, _CLASS[np.minimum(code, 127)], _OTHER).astype(np.uint8)
        symbol = kind == _SYMBOL
        edge = np.clip(np.append(self.offset - at, len(code)), 0, len(code))
        for k, mark in enumerate((symbol, kind == _DIGIT, (code == 61) | (code == 58))):
            total = np.concatenate(([0], np.cumsum(mark)))
            file[:, k] += np.diff(total[edge])
        space = kind == _SPACE
        new = ~space & np.concatenate(([True], symbol[1:] | symbol[:-1] | space[:-1]))
        start = np.flatnonzero(new)
        if not len(start):
            empty = np.zeros(0, np.int64)
            return (empty,) * 6
        last = ~space & np.concatenate((symbol[:-1] | symbol[1:] | space[1:], [True]))
        end = np.flatnonzero(last) + 1
        # A polynomial of the lower-case letters, taken from sums over the whole part.
        lower = (code + np.where(kind == _UP, 32, 0)).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lower * _powers(_BASE, len(code)), dtype=np.uint64)))
        word = ((sums[end] - sums[start]) * _powers(_INVERSE, len(code))[start] + (end - start).astype(np.uint64)) * _FACTOR
        change = np.concatenate(([0], np.cumsum(np.concatenate(([False], kind[1:] != kind[:-1])))))
        n = end - start
        held = [np.add.reduceat(np.concatenate((kind == k, [False])).astype(np.int64), np.column_stack((start, end)).ravel())[::2] > 0 for k in (_LOW_HEX, _LOW, _UP, _DIGIT, _OTHER)]
        mix = sum(h.astype(np.int64) << k for k, h in enumerate(held))
        length = np.digitize(n, [2, 4, 8, 12, 16, 24, 40])
        turns = np.digitize((change[end] - change[start + 1]) * 8 // np.maximum(n, 1), [1, 2, 3, 4])
        shape = (mix * 8 + length) * 5 + turns
        letters = held[0] | held[1]
        coarse = np.minimum(length, 5) * 16 + (held[3] & (letters | held[2])) * 8 + (held[2] & letters) * 4 + np.minimum(turns, 2) + 1
        text = np.searchsorted(self.offset, start + at, "right") - 1
        own = symbol[start]
        return start + at, end + at, word >> np.uint64(32), np.where(own, 2_000 + code[start] % 128, shape), np.where(own, 0, coarse), text

    def features(self, at: int, stop: int) -> np.ndarray:
        """Places in the table of weights, a row for each token from at to stop and a column for each feature."""
        n = stop - at
        index = np.arange(at, stop)

        def near(k: int, values: np.ndarray, none: int) -> np.ndarray:
            other = index + k
            inside = (other >= 0) & (other < len(self))
            other = np.clip(other, 0, max(len(self) - 1, 0))
            inside &= self.text[other] == self.text[index]
            return np.where(inside, values[other], none).astype(np.uint64)

        word, shape = self.word[index].astype(np.uint64), self.shape[index].astype(np.uint64)
        before = [near(-k, self.word, 1) for k in (1, 2, 3, 4)]
        after = near(1, self.word, 1)
        gap = (near(-1, self.end, 0) == self.start[index].astype(np.uint64)).astype(np.uint64) * np.uint64(2) + (near(1, self.start, 0) == self.end[index].astype(np.uint64))
        coarse = self.coarse[index].astype(np.uint64)
        mixed = coarse * np.uint64(0x1000193)
        columns = [
            shape,
            coarse,
            coarse * np.uint64(4) + gap,
            word,
            *before,
            after,
            near(-1, self.coarse, 999) * np.uint64(1_024) + coarse * np.uint64(4) + gap,
            near(1, self.coarse, 999) * np.uint64(1_024) + coarse * np.uint64(4) + gap,
            mixed ^ before[0] * np.uint64(31) ^ before[1] * np.uint64(1_009),
            mixed ^ before[1] * np.uint64(17) ^ before[2] * np.uint64(5),
            mixed ^ self.file[self.text[index]] * np.uint64(65_537),
        ]
        out = np.empty((n, len(columns)), np.uint16)
        for k, c in enumerate(columns):
            h = (c + np.uint64(k + 1)) * _FACTOR
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
            out[:, k] = (h >> np.uint64(48)).astype(np.uint16)
        return out


class Field:
    """Weights of a linear-chain conditional random field over three tags."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.weights, self.steps, self.first = weights, steps, first

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k in range(features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best tags; the chain starts anew with each text."""
        n = len(tokens)
        if not n:
            return np.zeros(0, np.uint8)
        held = max(HELD // BLOCK, 1) * BLOCK
        parts = range(0, n, held)
        kept: dict[int, np.ndarray] = {}
        begins = np.concatenate(([True], np.diff(tokens.text) > 0))

        def moves(at: int) -> np.ndarray:
            """(block, place, from, to) for a part; places after the last token keep the tag."""
            if at in kept:
                return kept[at]
            stop = min(at + held, n)
            score = self.scores(tokens.features(at, stop))[:, None, :] + np.where(begins[at:stop, None, None], self.first[None, None, :], self.steps[None])
            blocks = -(-(stop - at) // BLOCK)
            rest = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
            full = np.concatenate((score, np.broadcast_to(rest, (blocks * BLOCK - (stop - at), 3, 3)))).reshape(blocks, BLOCK, 3, 3)
            if n <= held:
                kept[at] = full
            return full

        entries, now = [], np.array([0.0, -np.inf, -np.inf])
        for at in parts:
            m = moves(at)
            way = m[:, 0]
            for k in range(1, BLOCK):
                way = (way[:, :, :, None] + m[:, k, None, :, :]).max(axis=2)
            own = np.empty((len(way), 3))
            for b, w in enumerate(way):
                own[b] = now
                now = (now[:, None] + w).max(axis=0)
                now = now - now.max()
            entries.append(own)
        back = []
        for at, own in zip(parts, entries):
            m, v = moves(at), own
            pointers = np.empty((len(own), BLOCK, 3), np.uint8)
            for k in range(BLOCK):
                reach = v[:, :, None] + m[:, k]
                pointers[:, k] = reach.argmax(axis=1)
                v = reach.max(axis=1)
            back.append(pointers)
        back = np.concatenate(back)
        through = np.broadcast_to(np.arange(3, dtype=np.uint8), (len(back), 3))
        for k in range(BLOCK - 1, -1, -1):
            through = np.take_along_axis(back[:, k], through.astype(np.int64), axis=1)
        leaves, tag = np.empty(len(back), np.int64), int(now.argmax())
        for b in range(len(back) - 1, -1, -1):
            leaves[b] = tag
            tag = int(through[b, tag])
        out = np.empty((len(back), BLOCK), np.uint8)
        tag, rows = leaves, np.arange(len(back))
        for k in range(BLOCK - 1, -1, -1):
            out[:, k] = tag
            tag = back[rows, k, tag].astype(np.int64)
        return out.reshape(-1)[:n]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the secrets tagged in each text."""
        tokens = Tokens(texts)
        tag = self.tags(tokens)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        first = np.flatnonzero(tag == BEGIN)
        if len(first):
            outside = np.flatnonzero(np.concatenate((tag != INSIDE, [True])))
            last = outside[np.searchsorted(outside, first + 1)] - 1
            for i, s, e in zip(tokens.text[first].tolist(), tokens.start[first].tolist(), tokens.end[last].tolist()):
                at = int(tokens.offset[i])
                out[i].append((s - at, e - at))
        return out


def _labels(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    out = np.zeros(len(tokens), np.int64)
    for i, own in enumerate(spans):
        for s, e in own:
            a, b = np.searchsorted(tokens.start, [s + tokens.offset[i], e + tokens.offset[i]])
            if b > a:
                out[a:b] = INSIDE
                out[a] = BEGIN
    return out


def fit_field(windows: list[tuple[str, list[tuple[int, int]]]], steps: int = STEPS) -> Field:
    """A field fitted to (text, spans of secrets) by gradient steps on the penalised likelihood."""
    tokens = Tokens([t for t, _ in windows])
    weights, moves, first = np.zeros((WEIGHTS, 3)), np.zeros((3, 3)), np.zeros(3)
    never = np.zeros((3, 3))
    never[OUTSIDE, INSIDE] = -1e4
    start_never = np.array([0, 0, -1e4])
    if not len(tokens):
        return Field(weights, moves + never, np.array([0.0, -1e4, -1e4]))
    label = _labels(tokens, [s for _, s in windows])
    features = tokens.features(0, len(tokens)).astype(np.int64)
    rows, n = np.unique(tokens.text, return_counts=True)
    lane = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    most = int(n.max())
    mask = np.zeros((len(rows), most), bool)
    mask[lane, place] = True
    gold = np.zeros((len(rows), most), np.int64)
    gold[lane, place] = label
    rng = np.random.default_rng(1)
    follows = np.flatnonzero(place > 0)
    gold_moves = np.bincount(label[follows - 1] * 3 + label[follows], minlength=9).reshape(3, 3)
    gold_first = np.bincount(label[place == 0], minlength=3)
    speed = [np.zeros_like(x) for x in (weights, moves, first)]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(steps):
        t, s = moves + never, first + start_never
        e = np.zeros((len(rows), most, 3))
        looked = rng.random(features.shape) < LOOKED
        e[lane, place] = (weights[features] * looked[:, :, None]).sum(axis=1)
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = s + e[:, 0]
        for k in range(1, most):
            step = total(ahead[:, k - 1, :, None] + t, 1) + e[:, k]
            ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
        z = total(ahead[:, -1], 1)
        for k in range(most - 2, -1, -1):
            step = total(t + (e[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(mask[:, k + 1, None], step, 0.0)
        share = np.exp(ahead + behind - z[:, None, None])[lane, place]
        both = np.exp(ahead[:, :-1, :, None] + t + (e + behind)[:, 1:, None, :] - z[:, None, None, None])
        both = (both * mask[:, 1:, None, None]).sum(axis=(0, 1))
        miss = -share
        miss[np.arange(len(label)), label] += 1
        seen, n_seen = features[looked], looked.sum(axis=1)
        grow = np.column_stack([np.bincount(seen, np.repeat(miss[:, k], n_seen), WEIGHTS) for k in range(3)])
        grows = [grow / len(label) - PENALTY * weights, (gold_moves - both) / len(label) - PENALTY * moves, (gold_first - share[place == 0].sum(axis=0)) / len(label) - PENALTY * first]
        for x, g, v in zip((weights, moves, first), grows, speed):
            v += g * g
            x += RATE * g / (np.sqrt(v) + 1e-8)
    return Field(weights, moves + never, first + start_never)


def _cut_window(text: str, s: int, e: int, known: list) -> tuple[str, list[tuple[int, int]]]:
    at, stop = max(0, s - AROUND), min(len(text), e + AROUND)
    return text[at:stop], [(max(a, at) - at, min(b, stop) - at) for _, _, _, a, b in known if a < stop and b > at]


def sample_windows(df: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int]]]]:
    """At most `sample` windows around matches of the patterns and as many elsewhere, half of those around long words, as
    (text, spans), the same for every partitioning: those with the least hashes of text and place."""
    long_word = re.compile(r"[A-Za-z0-9+/_.=@-]{9,}")

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for text, known in zip(batch.column("text").to_pylist(), all_base_spans(batch.column("text"))):
            # Each text gives one window of each kind at most, at a place that follows from its length.
            turn = len(text) * 2_654_435_761 % (1 << 32)
            if known:
                _, _, _, a, b = known[turn % len(known)]
                rows.append((0, *_cut_window(text, a, b, known)))
            at = turn % max(len(text), 1)
            rows.append((1, *_cut_window(text, at, at, known)))
            odd = long_word.search(text, at) or long_word.search(text)
            if odd:
                rows.append((2, *_cut_window(text, odd.start(), min(odd.end(), odd.start() + AROUND), known)))
        spans = [",".join(f"{a}:{b}" for a, b in r[2]) for r in rows]
        return {"kind": [r[0] for r in rows], "window": [r[1] for r in rows], "spans": spans}

    found = map_slices(documents(df).select("text"), work, "kind int, window string, spans string")
    out = []
    for kind, n in ((0, sample), (1, sample // 2), (2, sample - sample // 2)):
        own = found.filter((F.col("kind") == kind) & (F.length("window") > 0)).dropDuplicates(["window", "spans"])
        rows = own.orderBy(F.xxhash64("window", "spans"), "window", "spans").limit(n).collect()
        out += [(r["window"], [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]) for r in rows]
    return out


def varied(windows: list[tuple[str, list[tuple[int, int]]]], seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """The windows, and for each with a secret three more: one with another value, two with another name as well."""
    rng = np.random.default_rng(seed)
    out = list(windows)
    for text, spans in windows:
        if not spans:
            continue
        for rename in (False, True, True):
            parts, own, at, size = [], [], 0, 0
            for s, e in spans:
                lead = text[at:s]
                if rename:
                    name = NAMES[int(rng.integers(len(NAMES)))]
                    named = re.search(r"""\w+(["']?\x20*[:=]\x20*["']?)$""", lead)
                    lead = lead[: named.start()] + name + named.group(1) if named else f"{lead}{name}{(' = ', ': ', '=', '=%s' % chr(34))[int(rng.integers(4))]}"
                alphabet = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
                value = "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(rng.integers(10, 44))))
                parts += [lead, value]
                own.append((size + len(lead), size + len(lead) + len(value)))
                size, at = own[-1][1], e
            out.append(("".join([*parts, text[at:]]), own))
    return out


def fit_secrets(df: DataFrame, sample: int = SAMPLE) -> Field:
    """The field for df(text), from a bounded sample of windows."""
    return fit_field(varied(sample_windows(df, sample)))


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(df: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_tagged, spans) for every row of df(doc_id, text).

    Spans are kind:start:end in code points, ordered by start, then kind. The patterns' spans always stay; the field adds
    spans of kind `tagged` that have LEAST characters and overlap none of them. base_sha256 is the digest of the
    patterns' spans alone. A null text counts as empty: no spans, and the digest of the empty text. Repeated rows and
    null ids come out as they went in; an empty table gives an empty table. One pass over the texts.
    """
    weights = Field(field.weights.astype(np.float32), field.steps, field.first)
    order = {k: i for i, k in enumerate([*PATTERNS, TAGGED])}

    def work(batch: pa.RecordBatch) -> dict:
        known = all_base_spans(batch.column("text"))
        tagged = weights.spans(batch.column("text").to_pylist())
        out: dict[str, list] = {f"n_{k}": [] for k in order} | {"base_sha256": [], "spans": []}
        for base, more in zip(known, tagged):
            own = [(k, s, e) for k, s, e, _, _ in base]
            for k in PATTERNS:
                out[f"n_{k}"].append(sum(x[0] == k for x in own))
            out["base_sha256"].append(hashlib.sha256(_shown(own).encode()).hexdigest())
            added = list(_apart(more, own))
            out[f"n_{TAGGED}"].append(len(added))
            out["spans"].append(_shown(sorted([*own, *added], key=lambda x: (x[1], order[x[0]]))))
        return {"doc_id": batch.column("doc_id"), **out}

    fields = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_tagged long, spans string"
    return map_slices(documents(df), work, fields, most=2_000_000)


def _apart(spans: list[tuple[int, int]], known: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Of the spans those long enough that overlap no known one; both come in order of start."""
    covered, k = -1, 0
    for s, e in spans:
        while k < len(known) and known[k][1] < e:
            covered = max(covered, known[k][2])
            k += 1
        if e - s >= LEAST and covered <= s:
            yield TAGGED, s, e
