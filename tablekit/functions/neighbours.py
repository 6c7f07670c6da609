"""Exact nearest-neighbour joins without a cross join.

Points are packed in a tree of two levels. Coarse pivots, about sqrt(n / BLOCK) of them and enough for cells of half a PART,
cut the table into cells; a cell, in parts of bounded size, is split at medians into blocks of BLOCK points with boxes. The pivots and the reach of their
cells are all that a driver or a task holds of the whole table; boxes are rows, and a query meets those of the cells that
are open to it.

A query first scans the blocks nearest to it in its own cell, which bounds its k-th distance. Then it visits the blocks
that the bound leaves open, nearest first, in rounds that grow while the bound tightens. Places that many points or queries
share count once: of equal points only those with the first ids can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.functions.columns import col, numeric_or_zero
from tablekit.functions.hashing import unit_interval
from tablekit.functions.session import cut_lineage

#: Points of a block and of a part of a cell; blocks that a query scans first; blocks of the first round of visits, and
#: how many times more each later round has.
BLOCK, PART, FIRST, ROUND, GROW = 1_000, 200_000, 2, 8, 8
#: Cells in which a search with a given number of probes looks for blocks.
PROBED = 4
#: Rows whose distances are held at once.
STEP = 500
#: Coordinates from which a matrix product tells first which distances are worth summing up.
WIDE = 8
_SLACK = 1e-9
METRICS = ("euclidean", "manhattan", "chebyshev", "cosine")

_BLOCK = "coarse int, block long, n int, low array<double>, high array<double>, ids array<string>, data binary"


def point_table(df: DataFrame, keys: list[str], features: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, x, carried...): the id is the key columns joined with '~'."""
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    x = F.array(*[numeric_or_zero(df, c) for c in features])
    return df.select(ident.alias("id"), x.alias("x"), *[v.alias(k) for k, v in (carry or {}).items()])


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in values]) if len(values) else np.zeros((0, 0))


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _length(gaps: Iterable[np.ndarray], metric: str) -> np.ndarray:
    """Lengths from the differences of one coordinate after another."""
    total = None
    for g in gaps:
        g = np.square(g) if metric == "euclidean" else np.abs(g)
        total = g if total is None else np.maximum(total, g) if metric == "chebyshev" else total + g
    return np.sqrt(total) if metric == "euclidean" else total


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed coordinate by coordinate."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    return _length((a[:, j, None] - b[None, :, j] for j in range(a.shape[1])), metric)


def box_distances(a: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The least distance that a point of each box can have to each row of a."""
    if not a.shape[1]:
        return np.zeros((len(a), len(low)))
    return _length((np.maximum(np.maximum(low[None, :, j] - a[:, j, None], a[:, j, None] - high[None, :, j]), 0) for j in range(a.shape[1])), metric)


def _wider(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + _SLACK) + _SLACK


def _split(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of at most BLOCK, cut at the median of the widest coordinate."""
    if len(rows) <= BLOCK:
        return [rows]
    own = x[rows]
    j = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if x.shape[1] else 0
    half = -(-len(rows) // (2 * BLOCK)) * BLOCK
    order = rows[np.argsort(own[:, j], kind="stable")] if x.shape[1] else rows
    return [*_split(x, order[:half]), *_split(x, order[half:])]


class Tree:
    """Points(id, x[, carry]) as blocks with boxes, below coarse cells."""

    def __init__(self, points: DataFrame, metric: str = "euclidean", carry: str | None = None):
        self.metric, self.carry = metric, carry
        n = points.count()
        # So many that a cell mostly is one part: parts of one cell overlap.
        wanted = max(1, round((n / BLOCK) ** 0.5), -(-2 * n // PART) if n > PART else 1)
        digest = F.md5("id")
        # Four times the wanted share of hashes leaves enough rows to choose from, and few to compare.
        pool = points.filter(unit_interval(digest) < min(1.0, 4.0 * wanted / n)) if wanted > 1 else points
        picked = pool.select("x", digest.alias("h")).orderBy("h").limit(wanted).collect()
        self.pivots = np.unique(_matrix([r["x"] for r in picked]), axis=0) if picked else np.zeros((0, 0))
        self.size, self.reach = np.zeros(len(self.pivots), np.int64), np.full(len(self.pivots), -np.inf)
        self.schema = _BLOCK + (", carried array<string>" if carry else "")
        self.blocks = points.sparkSession.createDataFrame([], self.schema)
        if not n:
            return
        placed = cut_lineage(self._placed(points))
        for r in placed.groupBy("coarse").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect():
            self.size[r["coarse"]], self.reach[r["coarse"]] = r["n"], r["far"]
        parts = F.element_at(F.array(*[F.lit(int(-(-s // PART) or 1)) for s in self.size]), F.col("coarse") + 1)
        salted = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        self.blocks = cut_lineage(salted.groupBy("coarse", "part").applyInPandas(self._pack(), self.schema))

    def _pack(self) -> Callable:
        carry = self.carry

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            # Ids ascend in a block, so that of equal distances the first is the smallest id.
            rows = rows.sort_values("id", ignore_index=True)
            x = _matrix(rows["x"])
            coarse, part = int(rows["coarse"][0]), int(rows["part"][0])
            out = []
            for i, own in enumerate(_split(x, np.arange(len(rows)))):
                own = np.sort(own)
                row = [coarse, (coarse << 40) | (part << 16) | i, len(own), x[own].min(axis=0), x[own].max(axis=0), rows["id"].to_numpy()[own], x[own].astype("<f8").tobytes()]
                out.append(row + ([rows[carry].to_numpy()[own]] if carry else []))
            names = ["coarse", "block", "n", "low", "high", "ids", "data"] + (["carried"] if carry else [])
            return pd.DataFrame(out, columns=names)

        return pack

    def _placed(self, table: DataFrame) -> DataFrame:
        """table with coarse, its nearest pivot, and away, the distance to it."""
        pivots, metric = self.pivots, self.metric

        def nearest(batches):
            for batch in batches:
                x = _rows(batch.column("x"))
                cell, away = np.empty(len(x), np.int32), np.empty(len(x))
                for k in range(0, len(x), STEP):
                    d = distances(x[k : k + STEP], pivots, metric)
                    cell[k : k + STEP] = d.argmin(axis=1)
                    away[k : k + STEP] = d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "coarse", "away"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        return table.mapInArrow(nearest, schema + ", coarse int, away double")

    def _near_cells(self, places: DataFrame) -> DataFrame:
        """(place, x, bound, home, coarse) for the PROBED nearest cells of places(place, x); the bound is null."""
        pivots, metric = self.pivots, self.metric
        most = min(PROBED, len(pivots))

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    cell = np.argsort(distances(_rows(part.column("x")), pivots, metric), axis=1, kind="stable")[:, :most].reshape(-1).astype(np.int32)
                    out = part.take(pa.array(np.repeat(np.arange(len(part)), most)))
                    yield pa.RecordBatch.from_arrays([out.column("place"), out.column("x"), pa.nulls(len(cell), pa.float64()), pa.array(cell), pa.array(cell)], names=["place", "x", "bound", "home", "coarse"])

        return places.select("place", "x").mapInArrow(run, "place string, x array<double>, bound double, home int, coarse int")

    def _open_cells(self, asked: DataFrame, k: int) -> DataFrame:
        """(place, x, bound, home, coarse) for every cell that may hold a point within the bound of asked(place, x, bound,
        home). Where k points are known to be nearer than the bound, the bound shrinks."""
        pivots, metric, size, reach = self.pivots, self.metric, self.size, self.reach
        names = ["place", "x", "bound", "home"]

        def run(batches):
            for batch in batches:
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    d = distances(_rows(part.column("x")), pivots, metric)
                    bound = part.column("bound").to_numpy(zero_copy_only=False).astype(float)
                    if k:
                        far = np.where(size > 0, d + reach, np.inf)
                        order = np.argsort(far, axis=1)
                        enough = (np.cumsum(size[order], axis=1) >= k).argmax(axis=1)
                        if size.sum() >= k:
                            bound = np.minimum(bound, np.take_along_axis(far, order, axis=1)[np.arange(len(d)), enough])
                    row, cell = np.nonzero((d - reach <= _wider(bound)[:, None]) & (size > 0))
                    out = part.select(names).set_column(2, "bound", pa.array(bound)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32))], names=[*names, "coarse"])

        return asked.select(*names).mapInArrow(run, "place string, x array<double>, bound double, home int, coarse int")

    def _visits(self, asked: DataFrame, first: int) -> DataFrame:
        """(place, x, block, near) for asked(place, x, bound, home, coarse). A null bound asks for the `first` nearest blocks of
        the cell; otherwise for all within the bound, without those that were asked for at home."""
        metric = self.metric
        width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, -(-2 * width // max(len(self.pivots), 1)))
        boxes = self.blocks.select("coarse", "block", "low", "high").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = asked.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int")).unionByName(boxes, allowMissingColumns=True)
        both = both.repartition(width, "coarse", "salt").sortWithinPartitions("coarse", "salt", F.col("block").asc_nulls_last())

        def run(batches):
            key, boxes, low, high, block = None, [], None, None, None
            for batch, own, is_box in _runs(batches, ("coarse", "salt"), "block"):
                if own != key:
                    key, boxes, block = own, [], None
                if is_box:
                    boxes.append(batch.select(["block", "low", "high"]))
                    continue
                if not boxes and block is None:
                    continue
                if block is None:
                    table = pa.Table.from_batches(boxes).combine_chunks()
                    block, low, high = table.column("block").to_numpy(), *(_rows(table.column(c).combine_chunks()) for c in ("low", "high"))
                    boxes = []
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    near = box_distances(_rows(part.column("x")), low, high, metric)
                    bound = part.column("bound")
                    home = (part.column("home").to_numpy(zero_copy_only=False) == own[0]) & (first > 0)
                    order = np.lexsort((np.broadcast_to(block, near.shape), near))[:, :first]
                    seen = np.zeros(near.shape, bool)
                    np.put_along_axis(seen, order, True, axis=1)
                    asks_first = np.asarray(bound.is_null())
                    limit = _wider(bound.fill_null(np.inf).to_numpy(zero_copy_only=False))
                    open_ = np.where(asks_first[:, None], seen, (near <= limit[:, None]) & ~(seen & home[:, None]))
                    row, b = np.nonzero(open_)
                    out = part.select(["place", "x"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block[b]), pa.array(near[row, b])], names=["place", "x", "block", "near"])

        return both.mapInArrow(run, "place string, x array<double>, block long, near double")

    def _scanned(self, visits: DataFrame, pick: Callable, schema: str, all_blocks: bool) -> DataFrame:
        """What pick(places, x, points, ids, carried) gives for the visits(place, x, block) and the points of their blocks."""
        carry = self.carry
        width = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        points = self.blocks.drop("coarse", "low", "high")
        if not all_blocks:
            points = points.join(visits.select("block").distinct(), "block", "left_semi")
        both = visits.select("place", "x", "block").unionByName(points, allowMissingColumns=True)
        both = both.repartition(width, "block").sortWithinPartitions("block", F.col("n").desc_nulls_last())

        def run(batches):
            key, data, ids, carried = None, None, None, None
            for batch, own, is_block in _runs(batches, ("block",), "n"):
                if own != key:
                    key, data = own, None
                if is_block:
                    ids = batch.column("ids")[0].values.to_numpy(zero_copy_only=False)
                    carried = batch.column("carried")[0].values.to_numpy(zero_copy_only=False) if carry else None
                    data = np.frombuffer(batch.column("data")[0].as_py(), "<f8").reshape(len(ids), -1)
                    continue
                if data is None:
                    continue
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    yield pick(part.column("place"), _rows(part.column("x")), data, ids, carried)

        return both.mapInArrow(run, schema)

    def nearest(self, places: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(place, distance, neighbour, carried, rank): the k nearest points of every place(place, x), by (distance, id). With
        probes, only the points of so many blocks are looked at, those nearest in the nearest cells."""
        schema = "place string, distance double, neighbour string, carried string"

        metric = self.metric

        def pick(place: pa.Array, x: np.ndarray, data: np.ndarray, ids: np.ndarray, carried) -> pa.RecordBatch:
            row, at, d = nearest_pairs(x, data, k, metric)
            more = pa.array(carried[at], pa.string()) if carried is not None else pa.nulls(len(at), pa.string())
            return pa.RecordBatch.from_arrays([place.take(pa.array(row)), pa.array(d), pa.array(ids[at], pa.string()), more], names=["place", "distance", "neighbour", "carried"])

        def ranked(found: DataFrame) -> DataFrame:
            order = Window.partitionBy("place").orderBy("distance", "neighbour")
            return found.drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        if not len(self.pivots):
            return places.sparkSession.createDataFrame([], schema + ", rank int")
        if probes:
            turn = Window.partitionBy("place").orderBy("near", "block")
            some = self._visits(self._near_cells(places), probes).withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= probes)
            return ranked(self._scanned(some, pick, schema, True))
        first = FIRST
        home = self._placed(places).select("place", "x", F.lit(None).cast("double").alias("bound"), F.col("coarse").alias("home"), "coarse")
        found = ranked(self._scanned(self._visits(home, first), pick, schema, True))
        if self.blocks.count() <= first and len(self.pivots) <= 1:
            return found
        found = cut_lineage(found)
        asked = places.join(self._bounds(found, k), "place", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        asked = self._placed(asked).withColumnRenamed("coarse", "home")
        left = cut_lineage(self._visits(self._open_cells(asked, k), first))
        step = ROUND
        while not left.isEmpty():
            turn = Window.partitionBy("place").orderBy("near", "block")
            left = left.withColumn("turn", F.row_number().over(turn))
            now, later = left.filter(F.col("turn") <= step), left.filter(F.col("turn") > step)
            found = cut_lineage(ranked(found.select("place", "distance", "neighbour", "carried").unionByName(self._scanned(now, pick, schema, False))))
            bounded = later.join(self._bounds(found, k), "place", "left")
            near_enough = F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + _SLACK) + _SLACK)
            left = cut_lineage(bounded.filter(near_enough).select("place", "x", "block", "near"))
            step *= GROW
        return found

    @staticmethod
    def _bounds(found: DataFrame, k: int) -> DataFrame:
        """(place, bound): the k-th distance of the places that have k points."""
        return found.filter(F.col("rank") == k).select("place", F.col("distance").alias("bound"))

    def within(self, places: DataFrame, radius: float) -> DataFrame:
        """(place, neighbour, distance) for every point within the radius of a place(place, x)."""

        metric = self.metric

        def pick(place: pa.Array, x: np.ndarray, data: np.ndarray, ids: np.ndarray, carried) -> pa.RecordBatch:
            d = distances(x, data, metric)
            row, at = np.nonzero(d <= radius)
            return pa.RecordBatch.from_arrays([place.take(pa.array(row)), pa.array(ids[at], pa.string()), pa.array(d[row, at])], names=["place", "neighbour", "distance"])

        if not len(self.pivots):
            return places.sparkSession.createDataFrame([], "place string, neighbour string, distance double")
        asked = places.select("place", "x", F.lit(float(radius)).alias("bound"), F.lit(-1).alias("home"))
        visits = self._visits(self._open_cells(asked, 0), 0)
        return self._scanned(visits, pick, "place string, neighbour string, distance double", True)


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], mark: str) -> Iterator[tuple[pa.RecordBatch, tuple, bool]]:
    """Slices of sorted batches with one key and one kind; rows with a value in `mark` are blocks or boxes, one block each."""
    for batch in batches:
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        kind = np.asarray(batch.column(mark).is_valid())
        cut = kind.copy() if mark == "n" else np.zeros(len(batch), bool)
        cut[:1] = True
        for v in (*values, kind):
            cut[1:] |= v[1:] != v[:-1]
        edge = [*np.flatnonzero(cut).tolist(), len(batch)]
        for a, b in zip(edge[:-1], edge[1:]):
            yield batch.slice(a, b - a), tuple(v[a] for v in values), bool(kind[a])


def _best(d: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest per row, ties to the lower column."""
    if d.shape[1] <= k:
        return np.argsort(d, axis=1, kind="stable")
    some = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    picked = np.take_along_axis(d, some, axis=1)
    worst = picked.max(axis=1)
    order = np.take_along_axis(some, np.argsort(picked, axis=1, kind="stable"), axis=1)
    tied = np.flatnonzero((d <= worst[:, None]).sum(axis=1) > k)
    for r in tied:
        order[r] = np.argsort(d[r], kind="stable")[:k]
    return order


def nearest_pairs(x: np.ndarray, data: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of data, distance) of the k rows of data nearest to each row of x, by (distance, row of data).

    In many dimensions a matrix product gives squared distances up to rounding; only those that may be among the k nearest
    by its error bound are summed up coordinate by coordinate, as distances() does."""
    if metric == "euclidean" and x.shape[1] >= WIDE and 0 < k < len(data):
        own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", data, data)
        rough = own[:, None] + other[None, :] - 2 * (x @ data.T)
        if np.isfinite(rough).all():
            slack = 32 * x.shape[1] * np.finfo(float).eps * (own + other.max())
            row, at = np.nonzero(rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None])
            if len(row) <= 8 * k * len(x):
                a, b = x[row], data[at]
                d = _length((a[:, j] - b[:, j] for j in range(x.shape[1])), metric)
                order = np.lexsort((at, d, row))
                row, at, d = row[order], at[order], d[order]
                turn = np.arange(len(row)) - np.searchsorted(row, row, "left")
                return row[turn < k], at[turn < k], d[turn < k]
    d = distances(x, data, metric)
    best = _best(d, k)
    row, at = np.repeat(np.arange(len(d)), best.shape[1]), best.reshape(-1)
    return row, at, d[row, at]


def measured(table: DataFrame, metric: str) -> DataFrame:
    """x as the tree takes it: of length 1 for the cosine metric (a zero vector stays zero)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}; one of {', '.join(METRICS)}")
    if metric != "cosine":
        return table
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return table.withColumn("_norm", norm).withColumn("x", F.transform("x", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v))).drop("_norm")


def knn_join(
    queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, carry: str | None = None, metric: str = "euclidean", probes: int | None = None
) -> DataFrame:
    """(id, rank, neighbour, distance[, carried]): the k nearest points of every query, by (distance, id).

    queries and points are point tables; carry names one string column of points to bring along. metric: euclidean,
    manhattan, chebyshev or cosine (one minus the cosine; a zero vector is at 1/2 from all others). The result is exact; with
    probes, a query looks at the points of only so many blocks, and may miss some or find fewer than k.
    """
    found = k + 1 if exclude_self else k
    queries, points = measured(queries, metric), measured(points, metric)
    inner = "euclidean" if metric == "cosine" else metric
    # Of equal points only those with the first ids can be among the nearest of any query.
    order = Window.partitionBy("x").orderBy("id")
    points = points.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= found).drop("_r")
    tree = Tree(points, inner, carry)
    places = cut_lineage(queries.groupBy("x").agg(F.min("id").alias("place")))
    near = tree.nearest(places.select("place", "x"), found, probes)
    named = queries.select("id", "x").join(places, "x").select("id", "place")
    rows = named.join(near, "place")
    if exclude_self:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
        rows = rows.filter(F.col("neighbour") != F.col("id")).withColumn("rank", rank).filter(F.col("rank") <= k)
    distance = F.col("distance") * F.col("distance") / 2 if metric == "cosine" else F.col("distance")
    result = [F.col("id"), F.col("rank"), F.col("neighbour"), distance.alias("distance")]
    if carry:
        result.append(F.col("carried").alias(carry))
    return rows.select(*result)


def radius_join(queries: DataFrame, points: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """(id, neighbour, distance) for every point within the radius of a query, itself excluded."""
    queries, points = measured(queries, metric), measured(points, metric)
    cosine = metric == "cosine"
    tree = Tree(points, "euclidean" if cosine else metric)
    places = queries.select(F.col("id").alias("place"), "x")
    found = tree.within(places, (2 * radius) ** 0.5 if cosine else radius).filter(F.col("place") != F.col("neighbour"))
    distance = F.col("distance") * F.col("distance") / 2 if cosine else F.col("distance")
    return found.select(F.col("place").alias("id"), "neighbour", distance.alias("distance"))
