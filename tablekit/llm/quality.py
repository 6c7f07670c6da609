"""Quality scores from compression: how many bytes a dictionary of good text saves against one of bad text.

Two zstandard dictionaries are trained, on labelled good and on labelled bad text. The difference of the two
compressed sizes over the size of the text, beside their mean over that size (a text that repeats itself shrinks to
little with either), goes through a logistic curve fitted on other labelled rows and becomes a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablekit.llm.common import col, documents, give_back, held_out, map_slices, small_batches, slices, worker_cache

#: Labelled rows of each class that the dictionaries and the curve are fitted on; their texts count whole, in pieces.
DICTIONARY_ROWS, CURVE_ROWS = 4_000, 4_000
#: Characters in a piece, pieces of each class that reach the dictionary trainer, bytes of a dictionary.
PIECE, PIECES, DICTIONARY_BYTES = 4_096, 6_000, 112_640
LEVEL = 3
#: Differences count in full up to about 1 / SPREAD, beyond that by their logarithm.
SPREAD = 1_000.0


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def _compressors(self):
        def build(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=True)

        return worker_cache(("quality", hash((self.good, self.bad))), lambda: (build(self.good), build(self.bad)))

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: asinh(SPREAD * (bytes with the bad dictionary - bytes with the good one) / bytes of the text),
        log(mean of the two / bytes of the text), 1. All 0 for an empty text."""
        good, bad = self._compressors()
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            if text:
                g, b = len(good.compress(text)), len(bad.compress(text))
                out[i] = np.arcsinh(SPREAD * (b - g) / len(text)), np.log((g + b) / 2 / len(text)), 1.0
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weights of a logistic regression of y on the features x, by Newton steps. Standardised features carry a ridge of
    one, so few rows move the score little from the share of good ones."""
    mean = np.average(x[:, :2], axis=0, weights=weight)
    scale = np.sqrt(np.average((x[:, :2] - mean) ** 2, axis=0, weights=weight))
    scale = np.where(scale > 0, scale, 1.0)
    design = np.column_stack([(x[:, :2] - mean) / scale, np.ones(len(x))])
    ridge = np.diag([1.0, 1.0, 1e-6])
    beta = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:2] / scale
    return float(slopes[0]), float(slopes[1]), float(beta[2] - slopes @ mean)


def fit_quality(df: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 11) -> QualityModel:
    """Fit on rows of df(doc_id, text) that labels(doc_id, <label> 0/1) marks and held_out() does not hold back.

    Bounded sample: of each class and each of the two remaining crc32 folds the DICTIONARY_ROWS or CURVE_ROWS rows
    with the smallest hash of their id. One fold makes the dictionaries, the other the curve, with its classes
    weighted to their share of all labelled rows. Null labels and ids do not count; of two labels of one id the
    smaller one does. Without rows of both classes every score is the share of good rows, or 0.5 without any. An
    empty text says nothing: its score is 0.5.
    """
    spark = df.sparkSession
    marked = labels.select(col("doc_id").cast("long").alias("doc_id"), col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y")).filter(~held_out(F.col("doc_id")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    marked = marked.withColumns({"curve": fold == 2, "h": F.xxhash64("doc_id", F.lit(seed))})
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return QualityModel(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))))
    picked = [r for y in (0, 1) for curve, most in ((False, DICTIONARY_ROWS), (True, CURVE_ROWS)) for r in marked.filter((F.col("y") == y) & (F.col("curve") == curve)).orderBy("h", "doc_id").limit(most).collect()]
    sample = spark.createDataFrame([(r["doc_id"], r["y"], r["curve"]) for r in picked], "doc_id long, y int, curve boolean")
    rows = documents(df).join(F.broadcast(sample), "doc_id")
    pieces = (
        rows.filter(~F.col("curve"))
        .select("y", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE))).alias("k"))
        .select("y", F.substring("text", F.col("k").cast("int") * PIECE + 1, F.lit(PIECE)).alias("piece"), F.xxhash64("doc_id", "k", F.lit(seed)).alias("h"))
    )
    texts = {y: [r["piece"].encode("utf-8") for r in pieces.filter(F.col("y") == y).orderBy("h", "piece").limit(PIECES).collect()] for y in (0, 1)}
    model = QualityModel(_dictionary(texts[1]), _dictionary(texts[0]))
    sent = spark.sparkContext.broadcast((model.good, model.bad, model.weights))

    def work(batch: pa.RecordBatch) -> dict:
        x = QualityModel(*sent.value).features(batch.column("text"))
        return {"y": batch.column("y"), "difference": x[:, 0], "ratio": x[:, 1], "one": x[:, 2]}

    points = map_slices(rows.filter("curve").select("y", "text"), work, "y int, difference double, ratio double, one double").orderBy("difference", "ratio", "y").collect()
    y = np.array([p["y"] for p in points], float)
    if not 0 < y.sum() < len(y):
        model.weights = (1.0, 0.0, 0.0)
        return model
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum())) * len(y) / total
    model.weights = _curve(np.array([[p["difference"], p["ratio"], p["one"]] for p in points]), y, weight)
    return model


def score_quality(df: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of df(doc_id, text), from the text alone.

    A null text scores like an empty one, a null id counts as the empty text for held_out, repeated rows come out as
    they went in. One pass, no shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def work(batch: pa.RecordBatch) -> dict:
        scores = QualityModel(*sent.value).scores(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    return map_slices(documents(df).withColumn("held_out", held_out(F.col("doc_id"))), work, "doc_id long, held_out boolean, score double, predicted int", most=1_000_000)


def accepted(df: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of df(doc_id, text, ...) whose score is at least 0.5, with all their columns. Null and empty texts stay:
    their score is 0.5."""
    sent = df.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))

    def run(batches):
        for part in slices(batches, most=1_000_000):
            scores = QualityModel(*sent.value).scores(pa.compute.fill_null(part.column("text"), ""))
            yield part.filter(pa.array(scores >= 0.5))
        give_back()

    return small_batches(df).mapInArrow(run, df.schema)
