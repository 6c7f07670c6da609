"""Language identification as inference in a mixture of languages.

Each language is a distribution over hashed character trigrams. A document is a mixture: every word comes from one
language with that language's trigram likelihood, and expectation-maximisation estimates the proportions. How many
languages a document has is a choice between nested sets, ordered by proportion, under a penalised likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.session import collect_bounded
from tablekit.llm.common import col, documents, held_out, map_slices, slices

#: Bins of trigrams, and the most languages a model may have.
BINS, LANGUAGES = 1 << 16, 500
#: Expectation-maximisation rounds and the change of proportions that ends them early.
ROUNDS, SETTLED = 30, 1e-4
#: Penalty per further language, in units of log(words).
PENALTY = 3.0
#: A word's evidence is divided by this: overlapping trigrams tell the same thing more than once.
OVERLAP = 2.0


@dataclass
class Words:
    """Words of a slice of texts: hashed trigrams, where words begin among them, and where documents begin among words."""

    bins: np.ndarray
    word_start: np.ndarray
    doc_of_word: np.ndarray


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, one behind the other with a space around each; which are letters; documents."""
    joined = " ".join(texts).lower() if not any(len(t.lower()) != len(t) for t in texts) else None
    if joined is None:
        texts = [t.lower() for t in texts]
        joined = " ".join(texts)
    code = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.concatenate((doc[:1], doc)) if len(doc) else np.zeros(len(code), np.int64)
    known, where = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in known.tolist()])[where]
    return code, letter, doc


def split_words(texts: list[str]) -> Words:
    """Trigrams that hold a letter in the middle, grouped to words (runs of letters)."""
    code, letter, doc = _letters(texts)
    plain = np.where(letter, code, 32).astype(np.uint64)
    middle = np.flatnonzero(letter[1:-1]) + 1 if len(code) > 2 else np.zeros(0, np.int64)
    mixed = (plain[middle - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (plain[middle] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (plain[middle + 1] * np.uint64(0x165667B19E3779F9))
    bins = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    first = np.concatenate(([True], np.diff(middle) > 1)) if len(middle) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    return Words(bins, start, doc[middle[start]])


@dataclass
class LanguageModel:
    """log_p[bin, language] of trigram bins, and the names of the languages."""

    names: list[str]
    log_p: np.ndarray


def fit_languages(df: DataFrame, lang_col: str = "lang") -> LanguageModel:
    """Trigram counts by language over all rows of df(doc_id, text, lang) that held_out() does not hold back.

    Rows with a null language or text do not count. Each task counts its slices as dense bins, so a language sends at
    most BINS numbers from a task. More than LANGUAGES languages are refused.
    """
    rows = df.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for part in slices(batches):
            names = np.array(part.column("lang").to_pylist(), dtype=object)
            texts = part.column("text").to_pylist()
            for name in dict.fromkeys(names.tolist()):
                words = split_words([texts[i] for i in np.flatnonzero(names == name)])
                total.setdefault(name, np.zeros(BINS, np.int64))
                total[name] += np.bincount(words.bins, minlength=BINS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bin": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # Sparse rows come together by language: LANGUAGES x BINS numbers at most.
    lists = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("x"))
    found = sorted(collect_bounded(lists, LANGUAGES, "languages"), key=lambda r: r["lang"])
    table = np.full((BINS, len(found)), 0.5)
    for k, r in enumerate(found):
        at = np.array([x["bin"] for x in r["x"]], np.int64)
        table[at, k] += np.array([x["n"] for x in r["x"]], float)
    return LanguageModel([r["lang"] for r in found], np.log(table / table.sum(axis=0)).astype(np.float32) if found else table.astype(np.float32))


def _mixture(like: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for n documents at once: proportions (n, languages) within the allowed sets, and log-likelihoods relative to
    each word's best language. like: (words, languages), scaled so that the best is 1. doc ascends."""
    start = np.searchsorted(doc, np.arange(n))
    full = np.bincount(doc, minlength=n)
    some = np.flatnonzero(full)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    for _ in range(ROUNDS):
        weighted = like * share[doc]
        weighted /= np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)
        new = share.copy()
        new[some] = np.add.reduceat(weighted, start[some], axis=0) / full[some, None]
        moved = np.abs(new - share).max(initial=0.0)
        share = new
        if moved < SETTLED:
            break
    fit = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300))
    return share, np.bincount(doc, weights=fit, minlength=n)


def infer(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts, languages) after the choice of sets, and the number of words of each text."""
    n, k = len(texts), len(model.names)
    words = split_words(texts)
    count = np.bincount(words.doc_of_word, minlength=n)
    share = np.zeros((n, k))
    if not k or not len(words.word_start):
        return share, count if k else np.zeros(n, np.int64)
    log_like = np.add.reduceat(model.log_p[words.bins], words.word_start, axis=0).astype(np.float64) / OVERLAP
    best = log_like.max(axis=1, keepdims=True)
    doc = words.doc_of_word
    start = np.searchsorted(doc, np.flatnonzero(count))
    some = np.flatnonzero(count)
    alone = np.full((n, k), -np.inf)
    alone[some] = np.add.reduceat(log_like - best, start, axis=0)
    like = np.exp(log_like - best)
    price = PENALTY * np.log(np.maximum(count, 2))
    single = alone.argmax(axis=1)
    share[some, single[some]] = 1.0
    value = alone[np.arange(n), single] - price
    # The full mixture bounds every smaller set: where it can't pay for a second language, one is best.
    every, fit = _mixture(like, doc, n, np.ones((n, k)))
    open_ = np.flatnonzero((count > 0) & (fit - 2 * price > value))
    order = np.argsort(-every, axis=1, kind="stable")
    for size in range(2, k + 1):
        open_ = open_[fit[open_] - size * price[open_] > value[open_]]
        if not len(open_):
            break
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        rows = place[doc] >= 0
        allowed = np.zeros((len(open_), k))
        np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
        own, own_fit = _mixture(like[rows], place[doc[rows]], len(open_), allowed)
        better = own_fit - size * price[open_] > value[open_]
        share[open_[better]] = own[better]
        value[open_[better]] = (own_fit - size * price[open_])[better]
    return share, count


def identify(df: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for every row of df(doc_id, text), from the text alone.

    lang_pred is the language of the largest proportion, score that proportion, languages all chosen ones with theirs
    by falling proportion. A text that is null or has no letter is `und` with score 0 and no languages; so is every
    text under a model without languages. Repeated rows and null ids come out as they went in. One pass, no shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.names, model.log_p))

    def work(batch: pa.RecordBatch) -> dict:
        model = LanguageModel(*sent.value)
        share, count = infer(model, batch.column("text").to_pylist())
        out: dict = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": [], "score": [], "languages": []}
        for row, n in zip(share, count):
            chosen = [] if not n else [(model.names[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 0]
            out["lang_pred"].append(chosen[0][0] if chosen else "und")
            out["score"].append(min(1.0, chosen[0][1]) if chosen else 0.0)
            out["languages"].append([{"lang": a, "share": b} for a, b in chosen])
        return out

    rows = documents(df).withColumn("held_out", held_out(F.col("doc_id")))
    return map_slices(rows, work, "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>", most=2_000_000)
