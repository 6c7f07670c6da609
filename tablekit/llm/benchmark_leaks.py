"""Benchmark decontamination: every passage of every document is a BM25 query against an index of benchmark items.

Scores are relative: BM25 of the passage for an item over BM25 of the item's own text, so one threshold fits items of
any length. Words are weighed once over all items; tasks build the index in shards of bounded size in the shared folder,
read them one at a time, and ask in three steps:

- Essential terms. The most frequent terms are set aside as long as they lift no item to a given part of the threshold.
  A passage in which no item collects what its other terms must give cannot retrieve anything; this is counted for
  all passages of a slice at once.
- Block-max WAND over the postings of the passages that are left retrieves all items at or above the threshold.
- A retrieved item counts if both its question and its answer overlap with the passage in SHARE of their word shingles.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tablekit.llm.common import col, documents, give_back, map_slices, small_batches, shared_folder, slices, stored, worker_cache
from tablekit.llm.packed_ids import open_at

K1, B = 1.2, 0.75
#: Relative score from which items are retrieved, words in a shingle, share of shingles that must be found.
THRESHOLD, SHINGLE, SHARE = 0.5, 5, 0.8
#: Part of the threshold that the set-aside terms of an item may reach together.
SET_ASIDE = 0.45
#: Postings in a block, items in a shard, bytes of item text in a shard.
BLOCK, SHARD_ITEMS, SHARD_BYTES = 16, 20_000, 16_000_000
#: Least step of passages, in white-space words. A passage has two steps; an item is looked for in passages whose step is
#: the least power of two times STEP that it fits in, whatever other items there are.
STEP = 64
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?…。？！])\s+|\n+")
_END = 1 << 60


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is cut in the middle."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    cut = (len(whole) + 1) // 2
    return whole[:cut], whole[cut:]


def shingles(tokens: list[str]) -> set[tuple]:
    n = min(SHINGLE, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


class Index:
    """Postings with relative impacts of some items (item_id, text); items without words are left out.

    weighed is (number of items, their mean length, items by word) over the whole benchmark that the items are a shard of;
    without it they are all of it.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, weighed: tuple[int, float, dict[str, int]] | None = None):
        self.threshold = threshold
        kept = [(i, t, Counter(words(t))) for i, t in items]
        kept = [x for x in kept if x[2]]
        self.ids = [x[0] for x in kept]
        self.parts = [tuple(map(shingles, question_and_answer(t))) for _, t, _ in kept]
        self.sizes = [tuple(min(SHINGLE, len(p)) for p in question_and_answer(t)) for _, t, _ in kept]
        own_df = Counter(w for _, _, c in kept for w in c)
        if weighed is None:
            weighed = len(kept), sum(sum(c.values()) for _, _, c in kept) / max(len(kept), 1), own_df
        n, mean, df = weighed
        step = np.array([step_of(len(t.split())) for _, t, _ in kept], np.int64)
        self.vocab = {w: k for k, w in enumerate(sorted(own_df, key=lambda w: (-df[w], w)))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        common = np.zeros(len(kept))
        for i, (_, _, c) in enumerate(kept):
            size = sum(c.values())
            impact = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                postings[self.vocab[w]].append((i, x / own))
        # Terms by falling frequency; the first `self.common` of them together stay below their part of the threshold.
        self.common = 0
        for p in postings:
            more = common.copy()
            for i, x in p:
                more[i] += x
            if kept and more.max() >= SET_ASIDE * threshold:
                break
            common, self.common = more, self.common + 1
        self.need = threshold - common - 1e-9
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.highest = [max(x) for x in self.impacts]
        self.lasts = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]
        self.block_highest = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        size = np.array([len(p) for p in self.items], np.int64)
        flat_items = np.array([i for p in self.items for i in p], np.int64)
        flat_impacts = np.array([x for p in self.impacts for x in p])
        flat_term = np.repeat(np.arange(len(size)), size)
        # The postings of the items of each step: where those of a term begin, items and impacts; and the items.
        self.by_step = {}
        for own in sorted(set(step.tolist())):
            mine = step[flat_items] == own
            begin = np.concatenate(([0], np.cumsum(np.bincount(flat_term[mine], minlength=len(size)))))
            self.by_step[own] = begin, flat_items[mine], flat_impacts[mine], set(np.flatnonzero(step == own).tolist())

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items whose score for a set of terms reaches the threshold, by block-max WAND."""
        least = self.threshold - 1e-9
        found = []
        lists = [(self.items[t], self.impacts[t], self.highest[t], self.lasts[t], self.block_highest[t]) for t in terms]
        at = [0] * len(lists)
        now = [p[0][0] for p in lists]
        order = list(range(len(lists)))
        while True:
            order.sort(key=now.__getitem__)
            bound, pivot = 0.0, _END
            for k in order:
                if now[k] == _END:
                    break
                bound += lists[k][2]
                if bound >= least:
                    pivot = now[k]
                    break
            if pivot == _END:
                return found
            bound, beyond = 0.0, _END
            for k in order:
                if now[k] > pivot:
                    beyond = min(beyond, now[k])
                    break
                lasts = lists[k][3]
                b = bisect_left(lasts, pivot)
                if b < len(lasts):
                    bound += lists[k][4][b]
                    beyond = min(beyond, lasts[b] + 1)
            if bound >= least and now[order[0]] == pivot:
                score = 0.0
                for k in order:
                    if now[k] != pivot:
                        break
                    score += lists[k][1][at[k]]
                    at[k] += 1
                    now[k] = lists[k][0][at[k]] if at[k] < len(lists[k][0]) else _END
                if score >= least:
                    found.append((pivot, score))
                continue
            target = pivot if bound >= least else max(beyond, pivot + 1)
            for k in order:
                if now[k] >= target:
                    break
                p = lists[k][0]
                at[k] = bisect_left(p, target, at[k])
                now[k] = p[at[k]] if at[k] < len(p) else _END

    def overlaps(self, item: int, tokens: list[str]) -> bool:
        """Question and answer of an item are both found in a passage's words."""
        for part, n in zip(self.parts[item], self.sizes[item]):
            if part:
                have = {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
                if len(part & have) < SHARE * len(part):
                    return False
        return True

    def leaks(self, texts: pa.Array) -> list[dict[int, float]]:
        """Per text the ids of items found in it, with the best relative score."""
        out: list[dict[int, float]] = [{} for _ in range(len(texts))]
        if not self.ids or not len(texts):
            return out
        lists = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.dictionary_encode(lists.flatten())
        edge = lists.offsets.to_numpy().astype(np.int64)
        edge = edge - edge[0]
        chunk = coded.indices.to_numpy()
        terms_of = [[self.vocab[w] for w in words(c) if w in self.vocab] for c in coded.dictionary.to_pylist()]
        count = np.fromiter(map(len, terms_of), np.int64, len(terms_of))
        first = np.cumsum(count) - count
        flat = np.array([t for own in terms_of for t in own], np.int64)
        # One row per index word in the texts: its term and its place.
        n = count[chunk]
        at = np.repeat(np.arange(len(chunk)), n)
        term = flat[np.repeat(first[chunk], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        for step in self.by_step:
            self._leaks_of(step, texts, edge, at, term, out)
        return out

    def _leaks_of(self, step: int, texts: pa.Array, edge: np.ndarray, at: np.ndarray, term: np.ndarray, out: list[dict[int, float]]) -> None:
        """Add what passages of this step hold of the items that go with it."""
        begin, flat_items, flat_impacts, mine = self.by_step[step]
        text = np.searchsorted(edge, at, "right") - 1
        steps = (np.diff(edge) + step - 1) // step
        base = np.cumsum(steps) - steps
        # Two passages hold a place.
        later = base[text] + (at - edge[text]) // step
        inner = later > base[text]
        passage = np.concatenate((later, later[inner] - 1))
        terms = np.concatenate((term, term[inner]))
        pair = np.unique(passage * len(self.vocab) + terms)
        passage, terms = pair // len(self.vocab), pair % len(self.vocab)
        rare = terms >= self.common
        p, t = passage[rare], terms[rare]
        size = begin[t + 1] - begin[t]
        posting = np.repeat(begin[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        item = flat_items[posting]
        got, where = np.unique(np.repeat(p, size) * len(self.ids) + item, return_inverse=True)
        total = np.bincount(where, weights=flat_impacts[posting], minlength=len(got))
        asked = np.unique(got[total >= self.need[got % len(self.ids)]] // len(self.ids))
        if not len(asked):
            return
        own_text = np.searchsorted(base, asked, "right") - 1
        # Texts without words share a base with the next one; the last of them is the one that has passages.
        a, b = np.searchsorted(passage, asked), np.searchsorted(passage, asked, "right")
        plain = {}
        for k, d, x, y in zip(asked.tolist(), own_text.tolist(), a.tolist(), b.tolist()):
            hits = [h for h in self.retrieve(terms[x:y].tolist()) if h[0] in mine]
            if not hits:
                continue
            if d not in plain:
                plain = {d: texts[d].as_py().split()}
            start = (k - int(base[d])) * step
            tokens = words(" ".join(plain[d][start : start + 2 * step]))
            for i, score in hits:
                key = self.ids[i]
                if score > out[d].get(key, 0.0) and self.overlaps(i, tokens):
                    out[d][key] = score


def step_of(n: int) -> int:
    """The step of the passages in which an item of n white-space words is looked for."""
    return STEP << max(0, (max(n, 1) - 1) // STEP).bit_length()


def shards(benchmark: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """Paths of the items of benchmark(item_id, text) as indexes of bounded size in the shared folder. Null ids and texts
    do not count; of repeated rows one does.

    Spark counts items, lengths and items by word; a task builds a shard from its items and the counts of their words.
    """
    rows = benchmark.select(col("item_id").cast("long").alias("item_id"), col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    if not n:
        return []
    most_items, most_bytes = SHARD_ITEMS, SHARD_BYTES
    wide = max(-(-n // most_items), -(-size // most_bytes))

    def place(batches):
        """Items by shard: a partition starts a new one at the bounds."""
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 32, 0, 0
        for part in slices(batches):
            placed, n_words = [], []
            for text in part.column("text").to_pylist():
                if held >= most_items or size >= most_bytes:
                    shard, held, size = shard + 1, 0, 0
                held, size = held + 1, size + len(text.encode("utf-8"))
                placed.append(shard)
                n_words.append(len(words(text)))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(placed, pa.int64()), "item_id": part.column("item_id"), "text": part.column("text"), "n_words": pa.array(n_words, pa.int64())})

    apart = F.pmod(F.xxhash64("item_id", "text"), F.lit(wide)).cast("int")
    items = stored(rows.repartitionById(wide, apart).mapInArrow(place, "shard long, item_id long, text string, n_words long"), "leaks-items").filter("n_words > 0")
    n, mean = items.agg(F.count("*"), F.avg("n_words")).first()

    def tally(part: pa.RecordBatch) -> dict:
        found = Counter((s, w) for s, t in zip(part.column("shard").to_pylist(), part.column("text").to_pylist()) for w in set(words(t)))
        return {"shard": [s for s, _ in found], "word": [w for _, w in found], "n": list(found.values())}

    # One row per shard and word, so a word in all items is as many rows as there are shards.
    counts = map_slices(items, tally, "shard long, word string, n long").groupBy("shard", "word").agg(F.sum("n").alias("n"))
    df = counts.select("shard", "word", F.sum("n").over(Window.partitionBy("word")).alias("df"))
    folder = shared_folder(benchmark.sparkSession, "leaks-index")

    def build(own: pa.Table, df: pa.Table) -> pa.Table:
        known = dict(zip(df.column("word").to_pylist(), df.column("df").to_pylist()))
        index = Index(sorted(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist())), threshold, (n, mean, known))
        # Only the name that a finished task returns is read; what a lost one wrote has another name.
        path = f"{folder}/{uuid.uuid4().hex}.index"
        system, name = open_at(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as stream:
            pickle.dump({f: getattr(index, f) for f in _FIELDS}, stream, pickle.HIGHEST_PROTOCOL)
        return pa.table({"path": [path]})

    return [r["path"] for r in items.groupBy("shard").cogroup(df.groupBy("shard")).applyInArrow(build, "path string").collect()]


_FIELDS = ("threshold", "ids", "parts", "sizes", "vocab", "common", "need", "items", "impacts", "highest", "lasts", "block_highest", "by_step")


def _read(path: str) -> Index:
    system, name = open_at(path)
    index = Index.__new__(Index)
    with system.open_input_file(name) as stream:
        index.__dict__.update(pickle.load(stream))
    return index


def _shard(path: str) -> Index:
    """A shard, read once per worker as long as no other one is asked for: the cache lets go of the one before it."""
    return worker_cache(("benchmark_leaks", path), lambda: _read(path))


def leaks(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, contaminated, n_items, items array<long>, score) for every row of df(doc_id, text).

    items are the ids of the benchmark items found in the text, ascending; score is the best relative BM25 score of
    them, 0 without any. Null and empty texts hold nothing, null ids and repeated rows come out as they went in. An
    empty benchmark contaminates nothing. The score does not depend on how the items fall into shards. One pass over the
    documents, no shuffle of them; a task asks the shards one after the other, and reads all of them anew for each slice of
    documents if there are several.
    """
    schema = "doc_id long, contaminated boolean, n_items int, items array<long>, score double"
    paths = shards(benchmark, threshold)

    def work(batch: pa.RecordBatch) -> dict:
        found: list[dict] = [{} for _ in range(batch.num_rows)]
        for path in paths:
            for own, more in zip(found, _shard(path).leaks(batch.column("text"))):
                for i, score in more.items():  # an item with several texts may be in several shards
                    own[i] = max(score, own.get(i, 0.0))
        return {
            "doc_id": batch.column("doc_id"),
            "contaminated": [bool(f) for f in found],
            "n_items": [len(f) for f in found],
            "items": [sorted(f) for f in found],
            "score": [max(f.values(), default=0.0) for f in found],
        }

    return map_slices(documents(df), work, schema, most=1_000_000)


def without_leaks(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df(doc_id, text, ...) in which no benchmark item is found, with all their columns."""
    paths = shards(benchmark, threshold)

    def run(batches):
        for part in slices(batches, most=1_000_000):
            texts = pc.fill_null(part.column("text"), "")
            clean = np.ones(part.num_rows, bool)
            for path in paths:
                clean &= np.array([not f for f in _shard(path).leaks(texts)], bool)
            yield part.filter(pa.array(clean))
        give_back()

    return small_batches(df).mapInArrow(run, df.schema)
