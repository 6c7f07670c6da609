"""Clustering: k-means, Ward over micro-clusters, spectral, quality measures, choice of k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import local_table
from tablekit.functions.neighbours import distances, knn_join, point_table
from tablekit.functions.ordering import number_rows
from tablekit.functions.session import broadcast_if_small, cut_lineage
from tablekit.operators.scale import fit_scaler

MICRO_CLUSTERS = 500
#: Centres in a block whose pairs are compared in one task.
CENTRE_BLOCK = 1_000
#: Points of a graph that Spark's power iteration takes at most. It builds the graph anew in every round and keeps all of them.
PIC_POINTS = 50_000
#: The least degree that a weight is divided by.
_LEAST_DEGREE = 2.0**-52


def scaled_points(df: DataFrame, keys: list[str], features: list[str], scale: bool = True) -> DataFrame:
    """The point table (id, x) of standard-scaled features."""
    ready = fit_scaler(df, features, "standard").transform(df) if scale else df
    return point_table(ready, keys, features)


def _vectors(points: DataFrame) -> DataFrame:
    return points.select("id", "x", array_to_vector("x").alias("v"))


def fit_kmeans(points: DataFrame, k: int = 3, seed: int = 42) -> KMeansModel:
    k = max(1, min(k, points.count() - 1))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(_vectors(points))


def kmeans(df: DataFrame, keys: list[str], features: list[str], k: int = 3, seed: int = 42, scale: bool = True) -> DataFrame:
    """(id, cluster)."""
    points = scaled_points(df, keys, features, scale).persist()
    model = fit_kmeans(points, k, seed)
    labels = model.transform(_vectors(points)).select("id", "cluster")
    return labels


def hierarchical(
    df: DataFrame, keys: list[str], features: list[str], k: int = 3, seed: int = 42, scale: bool = True, micro_clusters: int = MICRO_CLUSTERS
) -> DataFrame:
    """(id, cluster): `micro_clusters` k-means clusters (fewer rows give one less than there are), merged by Ward's
    criterion down to k."""
    points = scaled_points(df, keys, features, scale).persist()
    n = points.count()
    model = fit_kmeans(points, max(micro_clusters, k + 1), seed)
    micro = model.transform(_vectors(points)).select("id", F.col("cluster").alias("micro"))
    sizes = {r["micro"]: r["n"] for r in micro.groupBy("micro").agg(F.count("*").alias("n")).collect()}
    centres = {i: np.array(c) for i, c in enumerate(model.clusterCenters()) if i in sizes}
    merged = _ward(centres, sizes, min(k, max(n - 1, 1)))
    table = local_table(df.sparkSession, list(merged.items()), "micro int, cluster int")
    return micro.join(F.broadcast(table), "micro").select("id", "cluster")


def _ward(centres: dict[int, np.ndarray], sizes: dict[int, int], k: int) -> dict[int, int]:
    """Merge the pair with the least growth of the within-cluster sum of squares until k are left."""
    names = sorted(centres)
    x = np.stack([centres[i] for i in names])
    w = np.array([float(sizes[i]) for i in names])
    owner = np.arange(len(names))
    alive = np.ones(len(names), dtype=bool)
    cost = w[:, None] * w[None, :] / (w[:, None] + w[None, :]) * distances(x, x) ** 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(names) - k):
        a, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
        x[a] = (w[a] * x[a] + w[b] * x[b]) / (w[a] + w[b])
        w[a] += w[b]
        alive[b] = False
        owner[owner == b] = a
        row = w[a] * w / (w[a] + w) * ((x - x[a]) ** 2).sum(axis=1)
        row[~alive] = np.inf
        row[a] = np.inf
        cost[a, :], cost[:, a] = row, row
        cost[b, :], cost[:, b] = np.inf, np.inf
    numbers = {o: i for i, o in enumerate(sorted(set(owner.tolist())))}
    return {name: numbers[int(o)] for name, o in zip(names, owner)}


def spectral(
    df: DataFrame, keys: list[str], features: list[str], k: int = 3, neighbours: int = 10, iterations: int = 20, scale: bool = True
) -> DataFrame:
    """(id, cluster): power iteration on the symmetric nearest-neighbour similarity graph."""
    points = number_rows(scaled_points(df, keys, features, scale), ["id"], "n").persist()
    edges = knn_join(points, points, neighbours, exclude_self=True).select("id", "neighbour", "distance").persist()
    width = edges.agg(F.avg("distance")).first()[0] or 1.0
    weight = F.exp(-F.pow(F.col("distance") / F.lit(width), 2) / 2)
    names = points.select("id", "n")
    graph = (
        edges.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), weight.alias("weight"))
        .dropDuplicates(["a", "b"])
        .join(names.select(F.col("id").alias("a"), F.col("n").alias("src")), "a")
        .join(names.select(F.col("id").alias("b"), F.col("n").alias("dst")), "b")
        .select("src", "dst", "weight")
    )
    if points.count() > PIC_POINTS:
        found = power_clusters(graph, k, iterations)
    else:
        pic = PowerIterationClustering(k=k, maxIter=iterations, initMode="degree", weightCol="weight")
        found = pic.assignClusters(graph)
    edges.unpersist()
    return found.join(names, found["id"] == names["n"]).select(names["id"].alias("id"), "cluster")


def power_clusters(graph: DataFrame, k: int, iterations: int) -> DataFrame:
    """(id, cluster) of graph(src, dst, weight): the steps of Spark's power iteration from the degrees as joins and sums."""
    vector = power_vector(graph, iterations)
    data = vector.select(F.col("n").alias("id"), array_to_vector(F.array("x")).alias("v"))
    model = KMeans(k=k, seed=0, maxIter=20, featuresCol="v", predictionCol="cluster").fit(data)
    return model.transform(data).select("id", "cluster")


def power_vector(graph: DataFrame, iterations: int) -> DataFrame:
    """(n, x): the degrees of an undirected graph(src, dst, weight), each pair given once, multiplied up to `iterations` times by
    its row-normalised weights; it ends when the steps change less than 1e-5 of the mean entry.

    The links lie by their source, hashed, in memory or on disk for all rounds; a round shuffles products and writes the vector.
    """
    width = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = graph.filter("src <> dst")
    both = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    # The row of src is divided by its degree where the sums are taken, so that links need no join with degrees.
    links = both.repartition(width, "dst").sortWithinPartitions("dst").persist()
    degrees = cut_lineage(links.groupBy(F.col("dst").alias("n")).agg(F.sum("weight").alias("degree")))
    n, total = degrees.agg(F.count("*"), F.sum("degree")).first()
    vector = cut_lineage(degrees.select("n", "degree", (F.col("degree") / F.lit(total)).alias("x")))
    limit, last, change = max(1e-5 / max(n, 1), 1e-8), float("inf"), float("inf")
    for _ in range(iterations):
        if change <= limit:
            break
        sums = links.join(vector.select(F.col("n").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("n")).agg(F.sum(F.col("weight") * F.col("x")).alias("s"))
        scaled = F.col("s") / F.greatest("degree", F.lit(_LEAST_DEGREE))
        step = cut_lineage(vector.join(sums, "n").select("n", "degree", F.col("x").alias("old"), scaled.alias("y")))
        norm = step.agg(F.sum(F.abs("y"))).first()[0]
        x = F.col("y") / F.lit(norm)
        delta = step.agg(F.sum(F.abs(x - F.col("old")))).first()[0]
        change, last = abs(delta - last), delta
        vector = step.select("n", "degree", x.alias("x"))
    links.unpersist()
    return vector.select("n", "x")


# -- quality ----------------------------------------------------------------------------------------


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster, n) without noise."""
    return labels.filter("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))


def quality(points: DataFrame, labels: DataFrame, silhouette: bool = True) -> DataFrame:
    """(metric, value): Calinski-Harabasz from per-cluster sums, Davies-Bouldin from blocks of centres, noise and size
    figures, and the silhouette. Noise (-1) is left out of everything but its own count; any number of clusters will do.

    The silhouette is the squared-Euclidean one, which follows from per-cluster sums, at every size.
    """
    spark = points.sparkSession
    joined = points.join(labels, "id").select("id", "x", "cluster").persist()
    total, noise = joined.agg(F.count("*"), F.count_if(F.col("cluster") < 0)).first()
    inside = joined.filter("cluster >= 0")
    centres = _centres(inside)
    k, mean, std = centres.agg(F.count("*"), F.avg("n"), F.stddev_pop("n")).first()
    n = total - noise
    rows = [("n_clusters", float(k)), ("n_noise", float(noise)), ("noise_ratio", noise / total if total else 0.0)]
    if k:
        rows += [("cluster_size_mean", mean), ("cluster_size_std", std)]
    if k >= 2 and n > max(k, 2):
        rows += _separation(inside, centres, k, n)
        if silhouette:
            rows.append(("silhouette_squared", _silhouette(inside)))
    centres.unpersist()
    joined.unpersist()
    return local_table(spark, [(m, float(v)) for m, v in rows], "metric string, value double")


def _centres(inside: DataFrame) -> DataFrame:
    """(cluster, n, m), persisted: size and mean of every cluster."""
    first = inside.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    mean = F.array(*[F.avg(F.element_at("x", j + 1)) for j in range(d)]) if d else F.array().cast("array<double>")
    return inside.groupBy("cluster").agg(F.count("*").alias("n"), mean.alias("m")).persist()


def _separation(inside: DataFrame, centres: DataFrame, k: int, n: int) -> list[tuple[str, float]]:
    d = len(centres.first()["m"])
    away2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    own = away2("x", "m")
    spread = inside.join(broadcast_if_small(centres), "cluster").groupBy("cluster").agg(F.sum(own).alias("ss"), F.avg(F.sqrt(own)).alias("s"))
    # Each row of `about` is a cluster with its centre and spread.
    about = centres.join(spread, "cluster").persist()
    middle = about.agg(*[F.sum(F.col("n") * F.element_at("m", j + 1)) / n for j in range(d)]).first()
    centre = F.array(*[F.lit(float(v)) for v in middle])
    within, between = about.agg(F.sum("ss"), F.sum(F.col("n") * away2("m", centre))).first()
    ch = 1.0 if within == 0 else between / (k - 1) / (within / (n - k))
    db = _worst_ratios(about, k).agg(F.avg("worst")).first()[0]
    about.unpersist()
    return [("calinski_harabasz_score", ch), ("davies_bouldin_score", db)]


def _worst_ratios(about: DataFrame, k: int) -> DataFrame:
    """(cluster, worst): the largest (s + s') / distance of a cluster to any other one, from (cluster, m, s).

    Clusters are dealt to blocks by hash; every pair of blocks is compared in a task of its own.
    """
    blocks = -(-k // CENTRE_BLOCK)
    block = F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = about.select(F.col("cluster").cast("long").alias("cluster"), F.col("m").alias("m1"), F.col("s").alias("s1"), block.alias("a"), other.alias("b"))
    right = about.select(F.col("cluster").cast("long").alias("other"), F.col("m").alias("m2"), F.col("s").alias("s2"), block.alias("d"), other.alias("c"))

    def compare(mine: pa.Table, others: pa.Table) -> pa.Table:
        names = mine.column("cluster").to_numpy()
        if not len(names) or not others.num_rows:
            return pa.table({"cluster": pa.array([], pa.int64()), "worst": pa.array([], pa.float64())})
        gaps = distances(np.array(mine.column("m1").to_pylist()), np.array(others.column("m2").to_pylist()))
        gaps[names[:, None] == others.column("other").to_numpy()[None, :]] = np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = (mine.column("s1").to_numpy()[:, None] + others.column("s2").to_numpy()[None, :]) / gaps
        return pa.table({"cluster": pa.array(names, pa.int64()), "worst": ratios.max(axis=1)})

    return left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(compare, "cluster long, worst double").groupBy("cluster").agg(F.max("worst").alias("worst"))


def _silhouette(inside: DataFrame) -> float:
    """Mean of (outer - inner) / max(outer, inner), with mean squared distances to the own and the nearest other cluster."""
    data = inside.select(array_to_vector("x").alias("v"), F.col("cluster").cast("int").alias("cluster"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="cluster").evaluate(data)


def optimal_k(df: DataFrame, keys: list[str], features: list[str], max_k: int = 10, seed: int = 42, scale: bool = True) -> DataFrame:
    """(k, inertia, silhouette) for k = 2..max_k on one persisted table; the silhouette is the squared-Euclidean one."""
    points = scaled_points(df, keys, features, scale).persist()
    n = points.count()
    top = min(max_k, n - 1)
    if top < 2:
        raise ValueError("too few rows for more than one cluster")
    rows = []
    for k in range(2, top + 1):
        model = fit_kmeans(points, k, seed)
        labels = model.transform(_vectors(points)).select("id", "x", "cluster")
        found = labels.select("cluster").distinct().count()
        width = _silhouette(labels) if found > 1 else 0.0
        rows.append((k, float(model.summary.trainingCost), float(width)))
    points.unpersist()
    return local_table(df.sparkSession, rows, "k int, inertia double, silhouette double")


def choose_k(curve: DataFrame) -> DataFrame:
    """(rule, k) from (k, inertia, silhouette): the best silhouette; elbow_reference, the smallest drop of
    the inertia; and elbow, the largest second difference."""
    rows = sorted((r["k"], r["inertia"], r["silhouette"]) for r in curve.collect())
    ks = [r[0] for r in rows]
    inertia = np.array([r[1] for r in rows])
    silhouette = [r[2] for r in rows]
    steps, bends = np.diff(inertia), np.diff(inertia, n=2)
    table = [
        ("silhouette", ks[int(np.argmax(silhouette))]),
        ("elbow_reference", ks[int(np.argmax(steps))] if len(steps) else ks[0]),
        ("elbow", ks[int(np.argmax(bends)) + 1] if len(bends) else ks[0]),
    ]
    return local_table(curve.sparkSession, table, "rule string, k int")
