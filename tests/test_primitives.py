"""The shared primitives against brute force, with sizes forced small so that every split path runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions import neighbours, ordering, quantiles
from tablekit.functions.components import connected_components
from tablekit.functions.grams import gram, pairwise_correlation
from tablekit.functions.hashing import hash_cutoffs, row_hash
from tablekit.functions.session import collect_bounded, small_table


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(60_000) < 0.4, 7.0, rng.normal(0, 100, 60_000).round(3))
    y = np.where(rng.random(60_000) < 0.1, np.nan, rng.exponential(5, 60_000))
    pdf = pd.DataFrame({"id": np.arange(60_000), "x": x, "y": y})
    return pdf, spark.createDataFrame(pdf)


def test_narrowing_quantiles_match_numpy(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, ["x", "y"], probs, exact_rows=10)
    for c in ("x", "y"):
        expected = np.nanquantile(pdf[c], probs)
        assert np.allclose(found[c], expected, rtol=1e-12), c


def test_direct_quantiles_match_numpy(skewed):
    pdf, df = skewed
    found = quantiles.exact_quantiles(df, ["x", "y"], [0.25, 0.5])
    assert np.allclose(found["y"], np.nanquantile(pdf["y"], [0.25, 0.5]), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_hash_cutoffs_give_exact_ranks(spark):
    df = spark.range(5_000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    digest = row_hash(["id"], 1)
    ranks = F.array(F.lit(0).cast("bigint"), F.floor(F.col("n") / 3).cast("bigint"), F.col("n"), (F.col("n") + 5))
    table = {r["grp"]: r for r in hash_cutoffs(df, digest, ranks, F.col("g")).collect()}
    hashes = df.select("g", digest.alias("h")).toPandas()
    for g, part in hashes.groupby("g"):
        h = sorted(part["h"])
        assert table[g]["n"] == len(h)
        assert table[g]["cutoffs"] == ["", h[len(h) // 3 - 1] if len(h) >= 3 else "", h[-1], h[-1]]


def test_repeated_keys_stay_together(spark):
    df = spark.range(100).select(F.lit(1).alias("id"))
    row = hash_cutoffs(df, row_hash(["id"]), F.array(F.lit(50).cast("bigint"))).first()
    assert df.filter(row_hash(["id"]) <= row["cutoffs"][0]).count() == 100


@pytest.mark.parametrize("rows", [None, 300])
def test_positions_fills_and_sessions(spark, rows):
    rng = np.random.default_rng(1)
    n = 4_000
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.5, 0, rng.integers(0, 20, n)), "t": rng.integers(0, 900, n)})
    pdf["v"] = np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n))
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    ordered = pdf.sort_values(["k", "t", "id"])
    expected = ordered.assign(p=ordered.groupby("k").cumcount(), f=ordered.groupby("k")["v"].ffill(), b=ordered.groupby("k")["v"].bfill()).set_index("id").sort_index()
    got = ordering.with_position(df, ["k"], "t", ["id"], rows=rows).toPandas().set_index("id").sort_index()
    assert (got["_pos"] == expected["p"]).all()
    for backward, name in ((False, "f"), (True, "b")):
        got = ordering.fill_along(df, ["v"], ["k"], "t", ["id"], backward, rows).toPandas().set_index("id").sort_index()
        assert np.allclose(got["v"].astype(float), expected[name], equal_nan=True)
    gap = ordered.groupby("k")["t"].diff()
    numbers = (gap.isna() | (gap >= 3)).groupby(ordered["k"]).cumsum().to_frame("s").assign(id=ordered["id"]).set_index("id").sort_index()
    got = ordering.sessions(df, ["k"], "t", 3, ["id"], rows).toPandas().set_index("id").sort_index()
    assert (got["_session"] == numbers["s"]).all()


def test_fill_without_keys(spark):
    rows = [(i, float(i) if i % 4 == 0 else None) for i in range(1_000)]
    df = spark.createDataFrame(rows, "t int, v double")
    got = ordering.fill_along(df, ["v"], [], "t", rows=90).orderBy("t").collect()
    assert [r["v"] for r in got] == [float(i - i % 4) for i in range(1_000)]


def test_backward_fill_reads_each_row_once(spark):
    """A frame from the current row on is read anew for every row; the fill runs over the reverse order instead."""
    data = [(i, None if i % 7 == 0 else i // 3, None if i % 5 else float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, t int, v double").repartition(5)
    got = ordering.fill_along(df, ["v"], [], "t", ["id"], backward=True)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    expected, later = {}, None
    for i, _, v in sorted(data, key=lambda x: (-1 if x[1] is None else x[1], x[0]), reverse=True):
        later = later if v is None else v
        expected[i] = later
    for rows in (None, 60):
        cut = ordering.fill_along(df, ["v"], [], "t", ["id"], backward=True, rows=rows)
        assert {r["id"]: r["v"] for r in cut.collect()} == expected


def test_number_rows(spark):
    df = spark.range(1_000).select((F.col("id") * 7 % 1_000).alias("x"))
    got = ordering.number_rows(df, ["x"], "n").collect()
    assert all(r["x"] == r["n"] for r in got) and len(got) == 1_000


def _points(spark, x):
    return spark.createDataFrame([(str(i).zfill(5), [float(v) for v in row]) for i, row in enumerate(x)], "id string, x array<double>")


def _small_blocks(monkeypatch, block):
    for name, value in (("BLOCK", block), ("PART", 4 * block), ("ROUND", 2), ("GROW", 3), ("STEP", 29)):
        monkeypatch.setattr(neighbours, name, value)


def _unit(x):
    norm = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def _all_distances(x, metric):
    if metric == "cosine":
        return np.square(neighbours.distances(_unit(x), _unit(x))) / 2
    return neighbours.distances(x, x, metric)


def _scattered(d):
    rng = np.random.default_rng(d)
    return np.concatenate([rng.normal(size=(300, d)), rng.normal(5, 0.1, size=(100, d)), np.full((150, d), 2.0), np.zeros((2, d))])


@pytest.mark.parametrize("block, d, metric", [(4_000, 2, "euclidean"), (37, 1, "euclidean"), (11, 2, "manhattan"), (37, 6, "chebyshev"), (20, 3, "cosine"), (11, 2, "euclidean")])
def test_knn_join_is_exact(spark, monkeypatch, block, d, metric):
    if block < 1_000:
        _small_blocks(monkeypatch, block)
    x = _scattered(d)
    points = _points(spark, x)
    full = _all_distances(x, metric)
    for own in (True, False):
        got = neighbours.knn_join(points, points, 4, exclude_self=own, metric=metric).toPandas()
        assert len(got) == 4 * len(x)
        for i in range(0, len(x), 17):
            row = sorted((full[i, j], str(j).zfill(5)) for j in range(len(x)) if not (own and i == j))[:4]
            mine = got[got["id"] == str(i).zfill(5)].sort_values("rank")
            assert np.allclose(mine["distance"], [r[0] for r in row], atol=1e-9)
            if metric != "cosine":
                assert list(zip(mine["distance"], mine["neighbour"])) == row


def test_knn_join_of_other_queries(spark, monkeypatch):
    """Queries far from all points, fewer points than wanted, no points, no queries, carried text."""
    _small_blocks(monkeypatch, 7)
    x = np.random.default_rng(1).normal(size=(60, 2))
    points = _points(spark, x).withColumn("target", F.concat(F.lit("t"), "id"))
    queries = _points(spark, np.array([[50.0, 50.0], [0.0, 0.0], [0.0, 0.0]]))
    got = neighbours.knn_join(queries, points, 3, carry="target").collect()
    full = neighbours.distances(np.array([[50.0, 50.0], [0.0, 0.0], [0.0, 0.0]]), x)
    want = [(str(i).zfill(5), r + 1, str(j).zfill(5), f"t{j:05d}") for i in range(3) for r, j in enumerate(np.argsort(full[i])[:3])]
    assert sorted((r["id"], r["rank"], r["neighbour"], r["target"]) for r in got) == want
    assert neighbours.knn_join(queries, points, 100).count() == 180
    assert neighbours.knn_join(queries, points.limit(0), 3).collect() == []
    assert neighbours.knn_join(queries.limit(0), points, 3).collect() == []
    with pytest.raises(ValueError):
        neighbours.knn_join(queries, points, 3, metric="hamming")


def test_visits_of_a_query_do_not_grow_with_the_table(spark, monkeypatch):
    """Points scanned for a query: about the same for ten times the points."""
    _small_blocks(monkeypatch, 50)
    scanned = []
    real = neighbours.Tree._scanned

    def counted(self, visits, pick, schema, all_blocks):
        scanned.append(visits.join(self.blocks.select("block", "n"), "block").agg(F.sum("n")).first()[0] or 0)
        return real(self, visits, pick, schema, all_blocks)

    monkeypatch.setattr(neighbours.Tree, "_scanned", counted)
    each = []
    for n in (2_000, 20_000):
        scanned.clear()
        points = _points(spark, np.random.default_rng(n).uniform(size=(n, 2)))
        queries = points.filter("id < '00200'")
        assert neighbours.knn_join(queries, points, 5).count() == 1_000
        each.append(sum(scanned) / 200)
    assert each[1] < 2 * each[0] and each[1] < 1_000


def test_probes_find_most(spark, monkeypatch):
    """A search of a few blocks finds at least nine of ten of the nearest."""
    _small_blocks(monkeypatch, 50)
    points = _points(spark, np.random.default_rng(7).normal(size=(2_000, 3)))
    exact = {(r["id"], r["neighbour"]) for r in neighbours.knn_join(points, points, 5).collect()}
    some = {(r["id"], r["neighbour"]) for r in neighbours.knn_join(points, points, 5, probes=12).collect()}
    assert len(exact & some) >= 0.9 * len(exact)


@pytest.mark.parametrize("metric, radius", [("euclidean", 1.2), ("manhattan", 2.0), ("cosine", 0.1)])
def test_radius_join_is_exact(spark, monkeypatch, metric, radius):
    _small_blocks(monkeypatch, 30)
    x = np.random.default_rng(3).normal(size=(400, 5))
    points = _points(spark, x)
    got = {(r["id"], r["neighbour"]) for r in neighbours.radius_join(points, points, radius, metric).collect()}
    full = _all_distances(x, metric)
    expected = {(str(i).zfill(5), str(j).zfill(5)) for i, j in zip(*np.nonzero(full <= radius)) if i != j}
    assert len(got) > 1_000 and got == expected


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(170, 2))] + [(i, i + 1) for i in range(300, 360)] + [(0, i) for i in range(400, 450)]
    name = lambda i: str(i).zfill(4)
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a string, b string")
    nodes = spark.createDataFrame([(name(i),) for i in range(450)], "id string")
    parent = list(range(450))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {name(i): name(root(i)) for i in range(450)}


def test_gram_and_wide_correlation(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(g=np.arange(500) % 3)
    df = spark.createDataFrame(pdf).repartition(5)
    got = gram(df, list("abcd"), "g")
    for g in range(3):
        part = x[np.arange(500) % 3 == g]
        assert np.allclose(got[g], part.T @ part)
    holes = pdf[list("abcd")].mask(rng.random((500, 4)) < 0.2)
    found = pairwise_correlation(spark.createDataFrame(holes), list("abcd"))
    expected = holes.corr()
    assert all(abs(found[a, b] - expected.loc[a, b]) < 1e-9 for a, b in found)


def test_bounded_results(spark):
    with pytest.raises(ValueError):
        collect_bounded(spark.range(11), 10, "rows")
    assert small_table(spark.range(11), 10).count() == 11


@pytest.mark.parametrize("kind", ["spread", "ties", "far", "huge"])
def test_wide_neighbours_sum_up_few_distances(monkeypatch, kind):
    """The matrix product only spares distances: what is nearest, and how far, is the same to the last bit."""
    rng = np.random.default_rng(8)
    x, data = rng.normal(size=(60, 16)), rng.normal(size=(700, 16))
    if kind == "ties":
        x, data = np.round(x), np.round(data)
    if kind == "far":
        x, data = x * 1e-3 + 1e3, data * 1e-3 + 1e3
    if kind == "huge":
        data[5] = 1e200
    d = neighbours.distances(x, data)
    best = neighbours._best(d, 5)
    asked, whole = [], neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda *a: asked.append(1) or whole(*a))
    row, at, far = neighbours.nearest_pairs(x, data, 5, "euclidean")
    assert (row == np.repeat(np.arange(60), 5)).all() and (at == best.reshape(-1)).all() and (far == d[row, at]).all()
    if kind == "spread":
        assert not asked
