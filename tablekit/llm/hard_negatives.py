"""Hard negatives from a packed R-tree.

Rows are put in sort-tile order (label, slab of the widest coordinate, second coordinate, id) by a range partitioning, so
that a label or a vector that many rows share is cut like any other. Each run of PART_ROWS rows is packed into leaves of
LEAF_ROWS with their minimum bounding boxes; a part is a node of the tree, the label one more coordinate of its box.

A box and an anchor give an interval of inner products, coordinate by coordinate. Each anchor takes its open leaves from
a queue by the upper ends of their intervals. A leaf is skipped when its interval misses the anchor's score windows or
ends below the k-th best found; at the k-th score itself only when no id in it is smaller. Anchors advance in step, so
that a round is a few matrix operations. Positives come from the same search with an open window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.llm.common import col, shuffle_width, stored

#: Rows of a part and of a leaf; coordinates along which a part is tiled; parts searched through one queue.
PART_ROWS, LEAF_ROWS, AXES, HELD = 2_048, 64, 4, 16
#: Anchors of a group, which a task keeps while parts stream by, anchors of a step, and parts of a shard.
GROUP_ROWS, STEP_ROWS, SHARD_PARTS = 16_384, 256, 64
#: Inner products stay exact below this.
_EXACT = float(1 << 53)
_NEVER = -np.inf

_PART = (
    "p int, part long, n int, label_low long, label_high long, reach double, ids binary, labels binary, data binary, anchor binary, "
    "leaf_low binary, leaf_high binary"
)


def labelled_vectors(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, label long, v array<long>) with v = floor(scale * x); rows with a null id, label or vector, or with null
    or non-finite components, are left out, and of rows with one id the smallest (label, v) stays."""
    wide = df.select(col(id_col).cast("long").alias("vec_id"), col(label_col).cast("long").alias("label"), col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = wide.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    scaled = kept.select("vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    return scaled.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    edge = column.offsets.to_numpy()
    size = np.diff(edge)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(edge[:-1] - edge[0], size)] = flat
    return out


def _spread(df: DataFrame) -> DataFrame:
    """(place, variance) of each coordinate, from sums that tasks make."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edge = lists.offsets.to_numpy()
            place = np.arange(len(flat)) - np.repeat(edge[:-1] - edge[0], np.diff(edge))
            n = np.bincount(place)
            sums = np.bincount(place, flat), np.bincount(place, flat * flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64()), *(pa.array(s, pa.float64()) for s in sums)], ["place", "n", "s", "ss"])

    sums = df.select("v").mapInArrow(run, "place int, n long, s double, ss double").groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    return sums.select("place", (F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("variance"))


def _tiles(data: np.ndarray, ids: np.ndarray, rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Rows in leaves: sorted along the first axis, cut into slabs of whole leaves, each tiled along the others."""
    leaves = -(-len(rows) // LEAF_ROWS)
    if leaves <= 1 or not axes:
        return [rows[k : k + LEAF_ROWS] for k in range(0, len(rows), LEAF_ROWS)]
    slabs = int(np.ceil(leaves ** (1 / len(axes)) - 1e-9))
    width = -(-leaves // slabs) * LEAF_ROWS
    rows = rows[np.lexsort((ids[rows], data[rows, axes[0]]))]
    return [t for k in range(0, len(rows), width) for t in _tiles(data, ids, rows[k : k + width], axes[1:])]


def _pack(p: int, part: int, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, anchor: np.ndarray) -> dict:
    wide = np.column_stack((data, labels))
    axes = [int(a) for a in np.argsort(-data.var(axis=0), kind="stable")[:AXES]]
    if labels.min() < labels.max():
        axes = [data.shape[1], *axes[:-1]]
    tiles = _tiles(wide, ids, np.arange(len(ids)), axes)
    order = np.concatenate(tiles)
    low = np.array([np.append(wide[t].min(axis=0), ids[t].min()) for t in tiles])
    high = np.array([wide[t].max(axis=0) for t in tiles])
    reach = np.sqrt((np.maximum(np.abs(low[:, : data.shape[1]]), np.abs(high[:, : data.shape[1]])).max(axis=0).astype(np.float64) ** 2).sum())
    size = np.array([len(t) for t in tiles], np.int64)
    pack = lambda a: np.ascontiguousarray(a, "<i8").tobytes()
    return {
        "p": p, "part": part, "n": len(ids), "label_low": int(labels.min()), "label_high": int(labels.max()), "reach": float(reach),
        "ids": pack(ids[order]), "labels": pack(labels[order]), "data": pack(data[order]), "anchor": anchor[order].astype(np.uint8).tobytes(),
        "leaf_low": pack(np.column_stack((size, low))), "leaf_high": pack(high),
    }


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def packed_tree(vectors: DataFrame, anchor: Column) -> tuple[DataFrame, int]:
    """The parts of the tree over (vec_id, label, v), one row each, and the number of coordinates."""
    n, dim, labels = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.approx_count_distinct("label")).first()
    width = shuffle_width(vectors.sparkSession)
    axes = [r["place"] for r in _spread(vectors).orderBy(F.desc("variance"), "place").limit(2).collect()]
    keyed = vectors.select("vec_id", "label", "v", anchor.alias("anchor"))
    for k, name in enumerate(("c1", "c2")):
        keyed = keyed.withColumn(name, F.coalesce(F.get("v", F.lit(axes[k])), F.lit(0)) if k < len(axes) else F.lit(0).cast("long"))
    slabs = int(np.ceil(np.sqrt(max(1, n / PART_ROWS / max(labels, 1)))))
    cuts = sorted(set(keyed.approxQuantile("c1", [k / slabs for k in range(1, slabs)], 1 / (8 * slabs)))) if slabs > 1 else []
    # Steps of the slab number: a row is in as many as there are cuts at or below it.
    slab = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda t: t <= F.col("c1"))) if cuts else F.lit(0)
    order = ["label", "slab", "c2", "vec_id"]
    placed = keyed.withColumn("slab", slab).repartitionByRange(max(width, -(-n // (8 * PART_ROWS))), *order).sortWithinPartitions(*order)
    arrow = _arrow(_PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = made = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids, own, flags = (table.column(c).to_numpy() for c in ("vec_id", "label", "anchor"))
            p = int(table.column("p")[0].as_py())
            return pa.RecordBatch.from_pylist([_pack(p, (p << 32) | made, ids, own, _rows(table.column("v"), dim), flags)], schema=arrow)

        for batch in batches:
            at = 0
            while at < len(batch):
                take = min(len(batch) - at, PART_ROWS - count)
                held.append(batch.slice(at, take))
                at, count = at + take, count + take
                if count == PART_ROWS:
                    yield out()
                    made, count = made + 1, 0
                    held.clear()
        if count:
            yield out()

    rows = placed.select(F.spark_partition_id().alias("p"), "vec_id", "label", "v", "anchor")
    return stored(rows.mapInArrow(run, _PART), "negative-parts"), dim


def _anchors(parts: DataFrame, groups: int, dim: int) -> DataFrame:
    """(anchor_group, query_id, label, v) of the anchors among the rows of the tree: neighbours of the order share a group."""
    tasks = (parts.agg(F.max("p")).first()[0] or 0) + 1

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                mine = np.frombuffer(r["anchor"], np.uint8).astype(bool)
                if mine.any():
                    own = np.frombuffer(r["data"], "<i8").reshape(-1, dim)[mine]
                    group = np.full(len(own), r["p"] * groups // tasks, np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dim, pa.int32()), pa.array(own.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(np.frombuffer(r["ids"], "<i8")[mine]), pa.array(np.frombuffer(r["labels"], "<i8")[mine]), lists], ["anchor_group", "query_id", "label", "v"]
                    )

    return parts.select("p", "anchor", "data", "ids", "labels").mapInArrow(run, "anchor_group int, query_id long, label long, v array<long>")


class Leaves:
    """The leaves of some parts side by side."""

    def __init__(self, parts: list[dict], dim: int):
        ids, labels, data, low, high = ([np.frombuffer(p[c], "<i8") for p in parts] for c in ("ids", "labels", "data", "leaf_low", "leaf_high"))
        low = np.concatenate([x.reshape(-1, dim + 3) for x in low])
        high = np.concatenate([x.reshape(-1, dim + 1) for x in high])
        self.low, self.high = low[:, 1 : dim + 1].astype(np.float64), high[:, :dim].astype(np.float64)
        self.label_low, self.label_high, self.least_id = low[:, dim + 1], high[:, dim], low[:, dim + 2]
        # Every leaf has LEAF_ROWS places, the last ones of some empty.
        size = low[:, 0]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(np.arange(len(size)) * LEAF_ROWS, size)
        places = len(size) * LEAF_ROWS
        self.data = np.zeros((places, dim))
        self.data[at] = np.concatenate(data).reshape(-1, dim)
        self.ids, self.labels, self.real = np.zeros(places, np.int64), np.zeros(places, np.int64), np.zeros(places, bool)
        self.ids[at], self.labels[at], self.real[at] = np.concatenate(ids), np.concatenate(labels), True
        shape = (len(size), LEAF_ROWS)
        self.data = self.data.reshape(*shape, dim)
        self.ids, self.labels, self.real = self.ids.reshape(shape), self.labels.reshape(shape), self.real.reshape(shape)


class Search:
    """The best `k` rows of each anchor in each of its score windows; the rows come as leaves, in any order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.same, self.k = ids, labels, vectors.astype(np.float64), same, k
        self.low, self.high = low, high  # anchors x windows
        self.score = np.full((*low.shape, k), _NEVER)
        self.found = np.full((*low.shape, k), np.iinfo(np.int64).max)
        self.opened = 0

    def add(self, leaves: Leaves) -> None:
        for k in range(0, len(self.ids), STEP_ROWS):
            self._step(slice(k, k + STEP_ROWS), leaves)

    def _step(self, rows: slice, leaves: Leaves) -> None:
        q, own, ids = self.vectors[rows], self.labels[rows], self.ids[rows]
        low, high = self.low[rows], self.high[rows]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        top = up @ leaves.high.T + down @ leaves.low.T
        bottom = up @ leaves.low.T + down @ leaves.high.T
        if max(-bottom.min(initial=0), top.max(initial=0)) >= _EXACT:
            raise ValueError("inner products of 2^53 and more are not exact")
        if self.same:
            fit = (leaves.label_low <= own[:, None]) & (own[:, None] <= leaves.label_high)
        else:
            fit = ~((leaves.label_low == own[:, None]) & (own[:, None] == leaves.label_high))
        fit &= (top >= low.min(axis=1)[:, None]) & (bottom <= high.max(axis=1)[:, None])
        queue = np.argsort(np.where(fit, -top, np.inf), axis=1, kind="stable")
        left = fit.sum(axis=1)
        score, found = self.score[rows], self.found[rows]
        live = np.flatnonzero(left)
        for turn in range(int(left.max(initial=0))):
            live = live[left[live] > turn]
            leaf = queue[live, turn]
            reach, floor = top[live, leaf], bottom[live, leaf]
            kth, last = score[live, :, -1], found[live, :, -1]
            # By queue order nothing better follows: an anchor is done when its reach is below every window's bound.
            going = (reach[:, None] >= np.maximum(low[live], kth)).any(axis=1)
            live, leaf, reach, floor, kth, last = (x[going] for x in (live, leaf, reach, floor, kth, last))
            if not len(live):
                break
            open_ = (reach[:, None] >= low[live]) & (floor[:, None] <= high[live])
            open_ &= (reach[:, None] > kth) | ((reach[:, None] == kth) & (leaves.least_id[leaf][:, None] < last))
            now = open_.any(axis=1)
            if not now.any():
                continue
            who, leaf = live[now], leaf[now]
            self.opened += len(who)
            s = np.matmul(leaves.data[leaf], q[who][:, :, None])[:, :, 0]
            good = leaves.real[leaf] & ((leaves.labels[leaf] == own[who][:, None]) == self.same) & (leaves.ids[leaf] != ids[who][:, None])
            self._merge(score, found, who, leaf, s, good, low, high, leaves.ids)
        self.score[rows], self.found[rows] = score, found

    def _merge(self, score, found, who, leaf, s, good, low, high, ids) -> None:
        keys, scores, names = [], [], []
        for w in range(low.shape[1]):
            hit = good & (s >= np.maximum(low[who, w], score[who, w, -1])[:, None]) & (s <= high[who, w][:, None])
            r, c = np.nonzero(hit)
            keys.append(who[r] * low.shape[1] + w)
            scores.append(s[r, c])
            names.append(ids[leaf[r], c])
        key, new, name = (np.concatenate(x) for x in (keys, scores, names))
        if not len(key):
            return
        touched = np.unique(key)
        flat_s, flat_n = score.reshape(-1, self.k), found.reshape(-1, self.k)
        key = np.concatenate((key, np.repeat(touched, self.k)))
        new = np.concatenate((new, flat_s[touched].reshape(-1)))
        name = np.concatenate((name, flat_n[touched].reshape(-1)))
        order = np.lexsort((name, -new, key))
        key, new, name = key[order], new[order], name[order]
        start = np.searchsorted(key, touched)
        at = start[:, None] + np.arange(self.k)
        flat_s[touched], flat_n[touched] = new[at], name[at]


def _searched(anchors: DataFrame, parts: DataFrame, dim: int, k: int, same: bool, groups: int) -> DataFrame:
    """(query_id, tag, vec_id, score): the first k of each window of anchors(anchor_group, query_id, label, v, windows)."""
    spark = parts.sparkSession
    n_parts = parts.count()
    shards = max(-(-n_parts // SHARD_PARTS), -(-2 * shuffle_width(spark) // max(groups, 1)), 1)
    of_part = F.pmod(F.xxhash64("part"), F.lit(shards)).cast("int")
    # A part goes to each group that has a label it needs; the equal join is on the shard, which every group visits.
    reach = anchors.groupBy("anchor_group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    visits = reach.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    wanted = (F.col("label_low") <= F.col("high")) & (F.col("low") <= F.col("label_high"))
    if not same:
        wanted = ~((F.col("label_low") == F.col("label_high")) & (F.col("low") == F.col("high")) & (F.col("label_low") == F.col("low")))
    payload = ["n", "reach", "ids", "labels", "data", "leaf_low", "leaf_high"]
    sent = parts.withColumn("shard", of_part).join(visits, (F.col("shard") == F.col("visit")) & wanted).select("anchor_group", "shard", *payload)
    asking = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asking = asking.select("anchor_group", "shard", "query_id", "label", "v", "windows")
    both = asking.unionByName(sent, allowMissingColumns=True)
    both = both.repartition(shuffle_width(spark), "anchor_group", "shard").sortWithinPartitions("anchor_group", "shard", F.col("reach").desc_nulls_first())
    schema = _arrow("query_id long, tag long, vec_id long, score long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, search, tags, held = None, [], None, None, []

        def begin():
            table = pa.concat_tables([pa.Table.from_batches([a]) for a in asked]).combine_chunks()
            own = table.column("windows").to_pylist()
            most = max(map(len, own))
            low, high, tags = np.full((len(own), most), np.inf), np.full((len(own), most), _NEVER), np.zeros((len(own), most), np.int64)
            for i, windows in enumerate(own):
                for w, x in enumerate(windows):
                    low[i, w] = _NEVER if x["low"] is None else x["low"]
                    high[i, w] = np.inf if x["high"] is None else x["high"]
                    tags[i, w] = x["tag"]
            return Search(table.column("query_id").to_numpy(), table.column("label").to_numpy(), _rows(table.column("v"), dim), low, high, k, same), tags

        def flush():
            if held:
                search.add(Leaves(held, dim))
                held.clear()

        def end():
            if search is None:
                return
            flush()
            i, w, r = np.nonzero(search.score > _NEVER)
            columns = search.ids[i], tags[i, w], search.found[i, w, r], search.score[i, w, r].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            keys = list(zip(batch.column("anchor_group").to_pylist(), batch.column("shard").to_pylist()))
            is_part = batch.column("n").is_valid().to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or is_part[i] != is_part[i - 1]), len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != key:
                    yield from end()
                    key, asked, search, tags = keys[a], [], None, None
                    held.clear()
                if not is_part[a]:
                    asked.append(batch.slice(a, b - a).select(["query_id", "label", "v", "windows"]))
                    continue
                if not asked and search is None:
                    continue
                if search is None:
                    search, tags = begin()
                    asked.clear()
                for i in range(a, b):
                    held.append({c: batch.column(c)[i].as_py() for c in payload})
                    if len(held) == HELD:
                        flush()
        yield from end()

    found = both.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    best = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vectors(vec_id, label, v).

    Anchors are the rows for which the condition `anchor` on vectors holds. A score is the inner product with the anchor;
    higher ones come first, ties by smaller id. Positives are the first other rows of the anchor's label. Negatives of a
    positive are the first rows of other labels with low * positive_score <= 100 * score <= high * positive_score; rank
    counts from 1. Fewer are returned where there are fewer, nothing for an anchor without positives, for a negative
    positive_score with low < high, or for an empty table. Shorter vectors are filled with zeros. Equal vectors are rows of
    their own; vec_id must be unique, as labelled_vectors makes it. Scores of 2^53 and more raise.
    """
    vectors = stored(vectors, "negative-vectors")
    parts, dim = packed_tree(vectors, anchor)
    groups = max(1, -(-vectors.filter(anchor).count() // GROUP_ROWS))
    anchors = stored(_anchors(parts, groups, dim), "negative-anchors")
    open_ = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")))
    near = _searched(anchors.withColumn("windows", open_), parts, dim, positives, True, groups)
    near = stored(near.select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    # Whole-number division that rounds up and down: pmod is never negative.
    at_least = F.expr(f"({low}L * positive_score + pmod(-({low}L * positive_score), 100L)) div 100L")
    at_most = F.expr(f"({high}L * positive_score - pmod({high}L * positive_score, 100L)) div 100L")
    windows = near.select("query_id", F.struct(F.col("positive_id").alias("tag"), at_least.alias("low"), at_most.alias("high")).alias("w")).filter("w.low <= w.high")
    windows = windows.groupBy("query_id").agg(F.array_sort(F.collect_list("w")).alias("windows"))
    far = _searched(anchors.join(windows, "query_id"), parts, dim, negatives, False, groups)
    out = far.withColumnRenamed("tag", "positive_id").join(near, ["query_id", "positive_id"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
