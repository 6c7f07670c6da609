"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets, whose vectors lie together as one matrix. A first round gives
every query a lower bound of its k-th product from the bucket of the longest vectors. In the second round a query
goes to those buckets whose longest vector could still reach the bound. There the bound becomes a local cosine
threshold: a high one prunes by the query's strongest coordinate, a lower one by length, and what is left is verified
by its product.

A bucket is sent to the few tasks that hold its blocks, before them, so the blocks that meet it stream past one copy. Only the
first bucket is broadcast: blocks with their queries are many, and their size in files says little about that in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablekit.llm.common import col, shuffle_width, stored

#: Vectors in a bucket, and queries in a block.
BUCKET_ROWS = 8_192
BLOCK_ROWS = 1_024
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.7

_PACKED = "part long, dim int, n int, ids binary, data binary, longest double, shortest double"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<long>) with v = floor(scale * x); rows with a null id, null vector, or null or non-finite
    components are left out, and of rows with one id the smallest vector stays."""
    wide = df.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    scaled = wide.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    return scaled.groupBy("vec_id").agg(F.min("v").alias("v"))


def _packs(frames: Iterator[pd.DataFrame], most: int, first: int) -> Iterator[pd.DataFrame]:
    """Rows (vec_id, v) of a partition as matrices of at most `most` rows, one output row each."""
    part = first
    held: list[pd.DataFrame] = []
    count = 0

    def out(rows: pd.DataFrame, part: int) -> pd.DataFrame:
        dims = rows["v"].map(len).to_numpy()
        data = np.zeros((len(rows), int(dims.max(initial=0))), np.int64)
        for k, v in enumerate(rows["v"]):
            data[k, : len(v)] = v
        norm = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        data, norm, ids = data[order], norm[order], rows["vec_id"].to_numpy(np.int64)[order]
        return pd.DataFrame({"part": [part], "dim": [data.shape[1]], "n": [len(ids)], "ids": [ids.astype("<i8").tobytes()], "data": [_narrow(data).tobytes()], "longest": [norm[0]], "shortest": [norm[-1]]})

    for frame in frames:
        while len(frame):
            take = frame.iloc[: most - count]
            held.append(take)
            count += len(take)
            frame = frame.iloc[len(take) :]
            if count == most:
                yield out(pd.concat(held), part)
                part, held, count = part + 1, [], 0
    if count:
        yield out(pd.concat(held), part)


def _packed(df: DataFrame, most: int) -> DataFrame:
    def run(frames):
        from pyspark import TaskContext

        yield from _packs(frames, most, TaskContext.get().partitionId() << 32)

    return df.mapInPandas(run, _PACKED)


def _narrow(data: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them all."""
    low, high = int(data.min(initial=0)), int(data.max(initial=0))
    return data.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(row, dim: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(row["data"]) // max(1, row["n"] * row["dim"]) or 8
    data = np.frombuffer(row["data"], f"<i{size}").reshape(row["n"], row["dim"]).astype(np.int64)
    if row["dim"] < dim:
        data = np.pad(data, ((0, 0), (0, dim - row["dim"])))
    return np.frombuffer(row["ids"], "<i8"), data


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: through doubles where they hold every sum exactly, else through int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(queries: np.ndarray, qids: np.ndarray, bounds: np.ndarray, bucket: np.ndarray, ids: np.ndarray, k: int, known: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, candidate ids, products) for up to k candidates of each query that reach its bound. known keeps
    what belongs to the bucket alone, for its next block."""
    norm = np.sqrt((bucket.astype(np.float64) ** 2).sum(axis=1))  # descending
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = bounds / (length * norm[0])
    local = np.where(np.isfinite(local), local, np.where(bounds > 0, 2.0, -1.0))
    by_coordinate = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9) & (norm[-1] > 0))
    by_length = np.flatnonzero((local <= 1 + 1e-9) & ~np.isin(np.arange(len(local)), by_coordinate))
    if len(by_coordinate):
        if "unit" not in known:
            known["unit"] = bucket / norm[:, None]
            known["lists"] = np.argsort(known["unit"], axis=0, kind="stable")
        unit, lists = known["unit"], known["lists"]
        for q in by_coordinate:
            v = queries[q] / length[q]
            f = int(np.argmax(np.abs(v)))
            # A unit vector at cosine t to v has its f-th coordinate within this distance of t * v_f ... v_f.
            t = min(1.0, local[q])
            reach = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - v[f] * v[f]))
            high = np.inf if abs(v[f]) >= t else abs(v[f]) * t + reach
            low = abs(v[f]) * t - reach
            lo, hi = (low, high) if v[f] >= 0 else (-high, -low)
            column = unit[lists[:, f], f]
            rows = lists[np.searchsorted(column, lo - 1e-9) : np.searchsorted(column, hi + 1e-9, "right"), f]
            rows = np.sort(rows[(norm[rows] * length[q] >= bounds[q] - 1e-6) & (ids[rows] != qids[q])])
            if len(rows):
                score = _products(queries[q : q + 1], bucket[rows])[0]
                keep = score >= bounds[q]
                yield q, *_picked(score[keep], ids[rows][keep], k)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(length[by_length] > 0, bounds[by_length] / length[by_length], -np.inf)
        reach = np.searchsorted(-norm, -(need - 1e-6), "right")
        far = int(reach.max(initial=0))
        score = _products(queries[by_length], bucket[:far])
        for i, q in enumerate(by_length):
            own, at = score[i, : reach[i]], ids[: reach[i]]
            keep = (own >= bounds[q]) & (at != qids[q])
            yield q, *_picked(own[keep], at[keep], k)


def _picked(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = _best(score, ids, k)
    return ids[best], score[best]


def top_products(df: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with the rows of df, other than
    its own id; ties to smaller ids. df and queries are (vec_id, v array<long>) with distinct ids, as
    integer_vectors gives them.

    Shorter vectors count as padded with zeros. A query with fewer candidates than k gets all of them. Empty tables
    give an empty table. Queries are a stated set: they meet the buckets in blocks, unless a bucket's longest vector
    rules them out.
    """
    spark = df.sparkSession
    schema = "query_id long, vec_id long, score long"
    width = shuffle_width(spark)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    # A range of lengths per task; the id splits a length that very many vectors share.
    ordered = df.withColumn("norm2", norm2).repartitionByRange(width, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "v")
    buckets = stored(_packed(ordered, BUCKET_ROWS), "norm-buckets")
    blocks = stored(_packed(queries.select("vec_id", "v").repartition(width, "vec_id"), BLOCK_ROWS), "query-blocks")
    # One row per bucket of thousands of vectors: ids and lengths only.
    edges = sorted(((r["longest"], r["part"]) for r in buckets.select("longest", "part").collect()), reverse=True)
    if not edges:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first = edges[0][1]

    def search(row, held: dict) -> pd.DataFrame:
        """A block of queries and the bucket that a task holds."""
        dim = max(row["dim"], held["row"]["dim"])
        if held.get("dim") != dim:
            held |= {"dim": dim, "bucket": _matrix(held["row"], dim), "known": {}}
        ids, bucket = held["bucket"]
        qids, qs = _matrix(row, dim)
        bounds = np.frombuffer(row["bounds"], "<f8") if row["bounds"] is not None else np.full(len(qids), -np.inf)
        none = np.zeros(0, np.int64)
        places, found, scores = [*zip(*_search(qs, qids, bounds, bucket, ids, k, held["known"]))] or [(), (), ()]
        asked_by = np.repeat(qids[np.array(places, np.int64)], [len(x) for x in found]) if places else none
        return pd.DataFrame({"query_id": asked_by, "vec_id": np.concatenate([none, *found]), "score": np.concatenate([none, *scores])})

    # The one bucket that every block meets at first goes to all tasks.
    longest_row = buckets.filter(F.col("part") == first).select("n", "dim", "ids", "data").collect()[0].asDict()
    sent = spark.sparkContext.broadcast(longest_row)

    def begin(frames):
        held = {"row": sent.value}
        for frame in frames:
            for _, row in frame.iterrows():
                yield search(row, held)

    asked = blocks.select(F.col("part").alias("q_part"), "dim", "n", "ids", "data", "longest")
    start = asked.withColumn("bounds", F.lit(None).cast("binary")).repartition(width, "q_part").mapInPandas(begin, schema)
    bound = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    # The bounds travel inside the blocks, in the order of their queries.
    blocks_of = asked.select("q_part", "ids").mapInPandas(lambda frames: (pd.DataFrame({"q_part": np.repeat(r["q_part"], len(i)), "at": np.arange(len(i)), "query_id": i}) for f in frames for _, r in f.iterrows() for i in [np.frombuffer(r["ids"], "<i8")]), "q_part long, at int, query_id long")
    bounds = (
        blocks_of.join(bound, "query_id", "left")
        .groupBy("q_part")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("b")))), lambda s: s["b"]).alias("b"))
    )
    bounded = stored(asked.join(bounds.hint("merge"), "q_part"), "bounded-blocks")
    longest, parts = [e[0] for e in edges], [e[1] for e in edges]
    # A bucket goes to so many tasks that all of them have work, several pieces of it each.
    salts = max(1, -(-8 * width // len(parts)))

    def route(frames):
        reach = -np.array(longest)
        for frame in frames:
            for _, row in frame.iterrows():
                b = np.asarray(row["b"], np.float64)
                least = b.min(initial=np.inf) / row["longest"] if row["longest"] > 0 else (-np.inf if b.min(initial=np.inf) <= 0 else np.inf)
                for part in parts[: int(np.searchsorted(reach, -(least - 1e-6), "right"))]:
                    yield pd.DataFrame({"part": [part], "q_part": [row["q_part"]], "dim": [row["dim"]], "n": [row["n"]], "ids": [row["ids"]], "data": [row["data"]], "bounds": [b.tobytes()]})

    routed = bounded.mapInPandas(route, "part long, q_part long, dim int, n int, ids binary, data binary, bounds binary").withColumn("salt", F.pmod(F.xxhash64("q_part"), F.lit(salts)).cast("int"))
    copies = buckets.select("part", F.lit(-1).cast("long").alias("q_part"), "dim", "n", "ids", "data", F.lit(None).cast("binary").alias("bounds"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = routed.unionByName(copies).repartition(width * 2, "part", "salt").sortWithinPartitions("part", "salt", "q_part")

    def meet(frames):
        held: dict = {}
        for frame in frames:
            for _, row in frame.iterrows():
                # A bucket has no block's number, so it comes before the blocks that are sent to it.
                if row["q_part"] < 0:
                    held = {"row": row}
                else:
                    yield search(row, held)

    found = met.mapInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
