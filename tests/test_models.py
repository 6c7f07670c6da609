"""Models, evaluation, search, clustering, anomalies, series, explanation, streams."""

import itertools
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions.neighbours import distances
from tablekit.functions import hashing, trees
from tablekit.operators import anomaly, arima, cells, cluster, density, evaluate, explain, forecast, govern, models, project, search, smoothing
from tablekit.operators.sample import split_random, split_stratified
from tablekit.operators.score import align, score_batch
from tablekit.sources.model_store import ModelStore
from tablekit.streaming import jobs


@pytest.fixture(scope="module")
def tabular(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 3))
    pdf = pd.DataFrame(x, columns=["f1", "f2", "f3"]).assign(id=range(300))
    pdf["y"] = np.where(2 * pdf["f1"] + pdf["f2"] > 0, "yes", "no")
    pdf["value"] = 3 * pdf["f1"] - 2 * pdf["f2"] + 1
    pdf["three"] = np.where(pdf["f1"] > 0.5, "c", np.where(pdf["f1"] < -0.5, "a", "b"))
    return spark.createDataFrame(pdf).persist()


FEATURES = ["f1", "f2", "f3"]
SMALL = {"random_forest": {"n_estimators": 5, "max_depth": 4}, "gradient_boosting": {"n_estimators": 2}, "logistic_regression": {"max_iter": 15}}
PARAMS = SMALL | {"voting": {"members": SMALL}, "stacking": {"folds": 2, "members": SMALL, "meta": {"max_iter": 15}}}


@pytest.mark.parametrize("name", ["LogisticRegression", "KNeighbors", "SVM", "voting", "stacking"])
def test_classifiers(tabular, name):
    df = split_stratified(tabular, ["id"], "y", 0.3)
    result = models.train(df, "y", name, None, FEATURES, PARAMS.get(models.canonical(name)), ["id"])
    values = {r["metric"]: r["value"] for r in result.metrics.collect()}
    assert values["accuracy"] > 0.8 and values["roc_auc"] > 0.8
    assert result.model.problem == models.CLASSIFICATION and result.model.classes == ["no", "yes"]
    sums = result.model.transform(df).select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-6).count() == 0


@pytest.mark.parametrize("name", ["xgboost", "svm"])
def test_three_classes(tabular, name):
    params = {"n_estimators": 3} if name == "xgboost" else {}
    model = models.fit(tabular, "three", name, None, FEATURES, params, ["id"])
    assert model.classes == ["a", "b", "c"] and evaluate.score(model, tabular) > 0.6


@pytest.mark.parametrize("name", ["linear", "knn", "svr", "voting", "stacking"])
def test_regressors(tabular, name):
    df = split_random(tabular, ["id"], 0.3)
    result = models.train(df, "value", name, models.REGRESSION, FEATURES, PARAMS.get(models.canonical(name)), ["id"])
    assert {r["metric"]: r["value"] for r in result.metrics.collect()}["r2"] > 0.6


def test_linear_model_is_exact(tabular):
    model = models.fit(tabular, "value", "linear", models.REGRESSION, FEATURES)
    assert explain.model_coefficients(model) == pytest.approx({"f1": 3.0, "f2": -2.0, "f3": 0.0}, abs=1e-8)


def test_one_class_and_unknown_names(tabular):
    model = models.fit(tabular.withColumn("same", F.lit("x")), "same", "logistic", models.CLASSIFICATION, FEATURES)
    assert model.transform(tabular).select("prediction").distinct().first()[0] == "x"
    with pytest.raises(ValueError):
        models.canonical("perceptron")


def test_alignment_fills_missing_columns(spark, tabular):
    model = models.fit(tabular, "y", "decision_tree", None, FEATURES)
    unseen = spark.createDataFrame([(1, "0.5"), (2, "bad")], "k int, f1 string")
    assert align(unseen, FEATURES, ["k"]).orderBy("k").collect()[1][1:] == (0.0, 0.0, 0.0)
    scored = score_batch(model, unseen)
    assert scored.columns == ["k", "f1", "Prediction", "Confidence"] and scored.filter(F.col("Confidence").rlike(r"^\d+\.\d\d%$")).count() == 2


@pytest.mark.parametrize("method", ["stratified", "timeseries"])
def test_cross_validation(tabular, method):
    table = evaluate.cross_validate(tabular, "y", "decision_tree", None, FEATURES, {"max_depth": 4}, ["id"], method, 3, "id").collect()
    scores = [r["score"] for r in table]
    assert len(scores) == 3 and table[0]["mean"] == pytest.approx(np.mean(scores)) and table[0]["std"] == pytest.approx(np.std(scores))
    assert np.mean(scores) > 0.7


def test_leave_one_out_matches_refits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(25, 2))
    y = x @ [1.0, -1.0] + rng.normal(size=25)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y, id=range(25)))
    got = {r["id"]: r["prediction"] for r in evaluate.held_out(df, "y", "linear_regression", models.REGRESSION, ["a", "b"], {}, ["id"]).collect()}
    for i in range(25):
        keep = np.arange(25) != i
        design = np.column_stack([np.ones(24), x[keep]])
        beta = np.linalg.lstsq(design, y[keep], rcond=None)[0]
        assert got[i] == pytest.approx(beta @ [1, *x[i]], abs=1e-8)
    with pytest.raises(ValueError, match="k-fold"):
        evaluate.cross_validate(df, "y", "random_forest", models.REGRESSION, ["a", "b"], {}, ["id"], "loo")


def test_comparison_ranks_best_first_and_keeps_errors(tabular):
    df = split_random(tabular, ["id"], 0.3)
    table = evaluate.compare_models(df, "value", ["decision_tree", "linear", "nonsense"], models.REGRESSION, FEATURES, keys=["id"]).orderBy("rank").collect()
    assert table[0]["model_type"] == "linear_regression" and table[0]["score"] > 0.999
    assert table[2]["model_type"] == "nonsense" and table[2]["error"]


def test_learning_curve(tabular):
    curve = evaluate.learning_curve(tabular, "y", "decision_tree", None, FEATURES, {"max_depth": 3}, ["id"], 2, [0.2, 1.0]).orderBy("fraction").collect()
    assert [r["train_rows"] for r in curve] == [30, 150] and 0 <= curve[1]["test_score"] <= 1


def test_searches(tabular):
    grid, chosen = search.grid_search(tabular, "y", "decision_tree", None, FEATURES, ["id"], 2, {"max_depth": [1, 4], "min_samples_split": [2, 5]})
    best = grid.orderBy("rank").collect()
    assert len(best) == 4 and best[0]["rank"] == best[1]["rank"] == 1 and best[2]["rank"] == 3 and best[0]["ignored"] == "min_samples_split"
    assert chosen.params["max_depth"] == 4 and evaluate.score(chosen, tabular) > 0.9
    assert search.random_search(tabular, "y", "knn", None, FEATURES, ["id"], 2, 2)[0].count() == 2
    trials, model = search.bayesian_search(tabular, "value", "linear", models.REGRESSION, FEATURES, ["id"], 2, 3)
    assert trials.count() == 3 and evaluate.score(model, tabular) > 0.99
    assert [len(list(__import__("itertools").product(*g.values()))) for g in search.GRIDS.values()] == [81, 81, 18, 2, 27, 8, 12]


@pytest.mark.parametrize(
    "name, target, values, params",
    [
        ("gradient_boosting", "y", [1, 3, 6], {"max_depth": 2, "subsample": 0.8}),
        ("gradient_boosting", "value", [2, 5], {"max_depth": 2}),
        ("gradient_boosting", "three", [1, 4], {"max_depth": 2}),
        ("decision_tree", "y", [1, 2, 5, None], {}),
        ("decision_tree", "value", [1, 3], {"min_samples_leaf": 4}),
    ],
)
def test_nested_scores_are_those_of_separate_fits(tabular, name, target, values, params):
    problem = models.REGRESSION if target == "value" else models.CLASSIFICATION
    nested = search.NESTED[name]
    scoring = "neg_mean_absolute_error" if target == "value" else "f1_macro"
    test, train = tabular.filter("id % 3 = 0"), tabular.filter("id % 3 <> 0").persist()
    largest = models.fit(train, target, name, problem, FEATURES, {**params, nested: values[-1]}, ["id"])
    got = search.nested_scores(largest, test, nested, values, scoring)
    apart = [models.fit(train, target, name, problem, FEATURES, {**params, nested: v}, ["id"]) for v in values]
    assert got == pytest.approx([search._whole_score(m, test, scoring) for m in apart])
    assert target == "three" or len(set(got)) > 1


def test_a_tree_on_cells_is_the_tree_on_rows(spark):
    rows = spark.range(20_000, numPartitions=3).selectExpr(
        "id", "pmod(xxhash64(id), 9973) / 7D as a", "pmod(id * 7, 12) as b", "if(pmod(xxhash64(id, 1), 5) = 0, null, pmod(xxhash64(id, 2), 300)) as c"
    )
    rows = rows.selectExpr("*", "case when a + 3 * c > 900 or b = 4 then 'x' when pmod(xxhash64(id, 3), 9) = 0 then null else 'y' end as y").filter("y is not null")
    training, test = rows.filter("id % 4 > 0").persist(), rows.filter("id % 4 = 0")
    names, depths = ["a", "b", "c"], [2, 6, None]
    points = [cells.split_points(training, c, 42) for c in names]
    own = cells.count_cells(training, test, "y", names, points, 42)
    for params in ({}, {"min_samples_leaf": 3, "criterion": "entropy"}, {"min_samples_leaf": 5}):
        params = {**params, "max_depth": None}
        on_rows = models.fit(training, "y", "decision_tree", models.CLASSIFICATION, names, params, ["id"])
        on_cells = own.fit(params)
        assert on_cells.stage.model.numNodes == on_rows.stage.model.numNodes > 50
        scores = search.nested_scores(on_rows, test, "max_depth", depths, "f1_macro")
        assert search.nested_scores(on_cells, own.test, "max_depth", depths, "f1_macro", "_n") == scores
        assert search._whole_score(on_cells, own.test, "f1_macro", "_n") == search._whole_score(on_rows, test, "f1_macro")
    assert own.fit({"min_samples_leaf": 10_000}).stage.model.numNodes == 1
    own.close()
    training.unpersist()


def test_split_points_that_cannot_be_told(spark):
    rows = spark.range(1000).selectExpr("id", "id * 1e-12 as tiny", "1 as one")
    assert cells.split_points(rows, "tiny", 42) is None and cells.split_points(rows, "one", 42) == []


def test_many_candidates_share_cells(tabular, monkeypatch):
    space = {"min_samples_leaf": [1, 2, 3, 4], "criterion": ["gini", "entropy"], "max_depth": [1, 3]}
    every = [dict(zip(space, v)) for v in itertools.product(*space.values())]

    def ask():
        trials = search._Trials(tabular, "y", "decision_tree", None, FEATURES[:2], ["id"], 2, "kfold", 42, 4)
        own = [c is not None for c in trials.counted(8)]
        return own, trials.counted(4), [s[:2] for s in trials.run(every)]

    monkeypatch.setattr(cells, "LEAST_ROWS", 0)
    on_cells = ask()
    assert on_cells[:2] == ([True, True], [None, None])
    monkeypatch.setattr(cells, "FEATURES", 0)
    assert ask() == ([False, False], [None, None], on_cells[2])


def test_forest_prefixes_are_its_first_trees(tabular):
    model = models.fit(tabular, "three", "random_forest", models.CLASSIFICATION, FEATURES, {"n_estimators": 7, "max_depth": 4}, ["id"])
    (part,) = trees.tree_parts(tabular.sparkSession, model)
    rows = model.transform(tabular).orderBy("id").toPandas()
    x = rows[FEATURES].to_numpy()
    first, whole = part.outputs(x, [1, 7])
    assert np.allclose(whole, np.stack(rows["probability"]))
    assert np.allclose(first, part.value[part.walk(x, 0)])


def test_grid_of_a_forest_shares_fits(tabular):
    grid = search.GRIDS["random_forest"]
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    trials = search._Trials(tabular, "y", "random_forest", None, FEATURES, ["id"], 2, "kfold", 42, 4)
    groups = trials.groups([trials.effective(c) for c in every])
    assert len(every) == 81 and len(groups) == 9 and all(g[2] == [50, 100, 200] for g in groups)
    small = [dict(c, n_estimators=c["n_estimators"] // 50, max_depth=3) for c in every]
    scores = trials.run(small)
    assert trials.fits == 3 * 2 and len(scores) == 81 and min(s[0] for s in scores) > 0.7
    trials.close()


def test_scoring_names(tabular):
    pairs = {("a", "a"): 4, ("a", "b"): 1, ("b", "a"): 2, ("b", "b"): 3}
    value = lambda s: search._class_scores(pairs, s)
    assert value("accuracy") == 0.7 and value("precision") == 0.75 and value("recall") == 0.6
    assert value("f1") == pytest.approx(2 / 3) and value("balanced_accuracy") == pytest.approx(0.7)
    assert value("f1_macro") == pytest.approx((8 / 11 + 2 / 3) / 2) and value("recall_weighted") == pytest.approx(0.7)
    with pytest.raises(ValueError):
        search.grid_search(tabular, "y", "decision_tree", None, FEATURES, ["id"], 2, {"max_depth": [1]}, scoring="r2")
    with pytest.raises(ValueError):
        search._class_scores(pairs | {("c", "c"): 1}, "f1")
    found, model = search.random_search(tabular, "value", "linear", models.REGRESSION, FEATURES, ["id"], 2, 2, scoring="neg_root_mean_squared_error")
    best = found.orderBy("rank").first()
    assert -1e-6 < best["mean_score"] <= 0 and "true" in best["params"] and model.params == {"fit_intercept": True}


@pytest.mark.parametrize("name, target, params", [("decision_tree", "y", {"max_depth": 4}), ("random_forest", "three", {"n_estimators": 3, "max_depth": 3}), ("gradient_boosting", "value", {"n_estimators": 3}), ("gradient_boosting", "three", {"n_estimators": 2})])
def test_tree_shap_is_exact(tabular, name, target, params):
    """Against all subsets of the three features, and by the sum over the features of every row."""
    problem = models.REGRESSION if target == "value" else models.CLASSIFICATION
    model = models.fit(tabular, target, name, problem, FEATURES, params, ["id"])
    rows = explain.tree_shap(model, tabular, ["id"]).toPandas()
    outputs = 1 if target == "value" else 3 if target == "three" else 2
    assert len(rows) == 300 * 3 * outputs
    sums = rows.groupby(["id", "output"]).agg(shap=("shap", "sum"), base=("base", "first"), value=("value", "first"))
    assert np.allclose(sums["shap"], sums["value"] - sums["base"])
    if target != "value":
        means = sums.reset_index().groupby("output")["value"].mean()
        assert name != "decision_tree" or np.allclose(means, sums.reset_index().groupby("output")["base"].first())
    parts = trees.tree_parts(tabular.sparkSession, model)
    x = tabular.orderBy("id").limit(5).toPandas()[FEATURES].to_numpy()

    def known(part, row, some):
        """Output with only the features of `some` known."""
        scale = part.weights / part.weights.sum() if part.mean else part.weights

        def below(node):
            j = part.feature[node]
            if j < 0:
                return part.value[node]
            a, b = part.left[node], part.right[node]
            if j in some:
                return below(a if row[j] <= part.threshold[node] else b)
            return (part.cover[a] * below(a) + part.cover[b] * below(b)) / part.cover[node]

        return sum(s * below(n) for s, n in zip(scale, part.start))

    for i, row in enumerate(x):
        for part_at, part in enumerate(parts):
            for j in range(3):
                others = [k for k in range(3) if k != j]
                want = sum(
                    w * (known(part, row, {*s, j}) - known(part, row, set(s)))
                    for s, w in [((), 1 / 3), ((others[0],), 1 / 6), ((others[1],), 1 / 6), (tuple(others), 1 / 3)]
                )
                own = rows[(rows["id"] == i) & (rows["feature"] == FEATURES[j])]
                got = own["shap"].to_numpy() if len(parts) == 1 else own[own["output"] == model.classes[part_at]]["shap"].to_numpy()
                assert np.allclose(sorted(got), sorted(np.atleast_1d(want)))


def test_tree_shap_edges(tabular):
    model = models.fit(tabular, "y", "decision_tree", None, FEATURES, {"max_depth": 2}, ["id"])
    assert explain.tree_shap(model, tabular.limit(0), ["id"]).collect() == []
    holes = tabular.limit(3).withColumn("f1", F.lit(None).cast("double"))
    assert explain.tree_shap(model, holes, ["id"]).count() == 18
    with pytest.raises(ValueError):
        explain.tree_shap(models.fit(tabular, "value", "linear", models.REGRESSION, FEATURES, {}, ["id"]), tabular, ["id"])


def test_proposer_moves_towards_good_values():
    p = search._Proposer({"x": [0.0, 10.0], "kind": ["a", "b"]}, 0)
    trials = [({"x": float(x), "kind": "a" if x > 5 else "b"}, -abs(x - 8.0)) for x in range(11)] * 2
    drawn = p.propose(trials, 60)
    assert np.mean([abs(d["x"] - 8) for d in drawn]) < 2.5 and sum(d["kind"] == "a" for d in drawn) > 35


def test_model_store(spark, tabular, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    for name in ("svm", "knn", "stacking"):
        model = models.fit(tabular, "y", name, None, FEATURES, PARAMS.get(name), ["id"])
        store.save(model)
        again = store.load(model.model_id)
        a = {r["id"]: r["prediction"] for r in model.transform(tabular).collect()}
        assert a == {r["id"]: r["prediction"] for r in again.transform(tabular).collect()}
    assert store.list().count() == 3
    store.delete(model.model_id)
    assert store.list().count() == 2
    with pytest.raises(ZeroDivisionError):
        store.run("bad", "x", lambda: 1 / 0)
    assert store.runs().first()["status"] == "failed"


# -- clustering -------------------------------------------------------------------------------------


def planted(spark, d=2):
    rng = np.random.default_rng(0)
    blobs = [rng.normal(c, 0.15, size=(60, d)) for c in (0, 3, 6)]
    x = np.concatenate([*blobs, rng.uniform(-2, 9, size=(25, d)), np.full((40, d), 3.0)])
    names = [f"x{i}" for i in range(d)]
    return x, names, spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=[str(i).zfill(4) for i in range(len(x))]))


def brute_dbscan(x, eps, k):
    near = distances(x, x) <= eps
    core = near.sum(axis=1) >= k
    labels, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or labels[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if labels[j] < 0:
                labels[j] = number
                todo += [m for m in np.flatnonzero(near[j] & core) if labels[m] < 0]
        number += 1
    for i in np.flatnonzero(~core):
        around = labels[near[i] & core]
        labels[i] = around.min() if len(around) else -1
    return labels


@pytest.mark.parametrize("d,eps,k,direct", [(2, 0.3, 5, 0), (5, 0.8, 5, 10**6)])
def test_dbscan_matches_brute_force(spark, monkeypatch, d, eps, k, direct):
    monkeypatch.setattr(density, "DIRECT_PAIRS", direct)
    x, names, df = planted(spark, d)
    got = density.dbscan(df, ["id"], names, eps, k, scale=False).orderBy("id").toPandas()["cluster"]
    assert (got.to_numpy() == brute_dbscan(x, eps, k)).all()


def test_dbscan_links_full_cells_at_the_limit(spark, monkeypatch):
    """Two heavy cells whose closest points are just within, or just beyond, the radius."""
    for gap, expected, direct in ((0.999, 1, 0), (1.001, 2, 10**6)):
        monkeypatch.setattr(density, "DIRECT_PAIRS", direct)
        x = np.array([[0.0, i / 1000] for i in range(30)] + [[gap, i / 1000] for i in range(30)])
        df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=[str(i).zfill(3) for i in range(60)]))
        assert density.dbscan(df, ["id"], ["a", "b"], 1.0, 5, scale=False).select("cluster").distinct().count() == expected


def test_other_clusterings_find_the_blobs(spark):
    x, names, df = planted(spark)
    clean = df.filter("id < '0180'")
    truth = {str(i).zfill(4): i // 60 for i in range(180)}
    for labels in (
        cluster.kmeans(clean, ["id"], names, 3),
        cluster.hierarchical(clean, ["id"], names, 3),
        density.adaptive_density(clean, ["id"], names, 5),
    ):
        groups = {}
        for r in labels.filter("cluster >= 0").collect():
            groups.setdefault(r["cluster"], set()).add(truth[r["id"]])
        assert all(len(g) == 1 for g in groups.values()) and set().union(*groups.values()) == {0, 1, 2}
    assert cluster.spectral(clean, ["id"], names, 3, 8).select("cluster").distinct().count() <= 3
    assert cluster.choose_k(cluster.optimal_k(clean, ["id"], names, 5)).filter("rule = 'silhouette'").first()["k"] == 3


def test_power_vector_is_the_power_iteration_from_the_degrees(spark):
    rng = np.random.default_rng(5)
    n = 60
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (200, 2)) if a != b} | {(i, i + 1) for i in range(n - 1)})
    weights = rng.random(len(pairs))
    graph = spark.createDataFrame([(int(a), int(b), float(w)) for (a, b), w in zip(pairs, weights)] + [(3, 3, 5.0)], "src long, dst long, weight double")
    full = np.zeros((n, n))
    for (a, b), w in zip(pairs, weights):
        full[a, b] = full[b, a] = w
    x = full.sum(axis=1) / full.sum()
    for _ in range(7):
        y = full @ x / full.sum(axis=1)
        x = y / np.abs(y).sum()
    vector = cluster.power_vector(graph, 7)
    found = {r["n"]: r["x"] for r in vector.collect()}
    assert np.abs(np.array([found[i] for i in range(n)]) - x).max() < 1e-14
    # The rounds are cut off: reading the vector starts from the last one.
    assert "Join" not in vector._jdf.queryExecution().executedPlan().toString()


def test_large_graphs_are_clustered_as_by_sparks_power_iteration(spark, monkeypatch):
    from pyspark.ml.clustering import PowerIterationClustering

    pairs = [(c * 10 + i, c * 10 + j, 3.0**c) for c in range(3) for i in range(10) for j in range(i)]
    graph = spark.createDataFrame(pairs, "src long, dst long, weight double")

    def groups(labels):
        return {frozenset(g) for g in labels.groupBy("cluster").agg(F.collect_list("id")).toPandas().iloc[:, 1]}

    pic = PowerIterationClustering(k=3, maxIter=20, initMode="degree", weightCol="weight").assignClusters(graph)
    assert groups(cluster.power_clusters(graph, 3, 20)) == groups(pic) == {frozenset(range(c * 10, c * 10 + 10)) for c in range(3)}
    monkeypatch.setattr(cluster, "PIC_POINTS", 100)
    monkeypatch.setattr(PowerIterationClustering, "assignClusters", lambda self, graph: pytest.fail("the graph is too large"))
    x, names, df = planted(spark)
    labels = cluster.spectral(df.filter("id < '0180'"), ["id"], names, 3, 8)
    assert labels.count() == 180 and labels.select("cluster").distinct().count() <= 3


def test_trees_are_as_deep_as_asked(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.pow(F.lit(2.0), F.col("id")).alias("y"))
    fit = lambda **p: models.fit(df, "y", "decision_tree", models.REGRESSION, ["x"], p, ["id"])
    found = fit()
    assert found.depth == 30 and found.stage.model.depth > 10
    assert fit(max_depth=4).depth == 4
    with pytest.raises(ValueError):
        fit(max_depth=31)


def test_quality_edge_cases(spark):
    _, names, df = planted(spark)
    points = cluster.scaled_points(df, ["id"], names)
    one = points.select("id", F.lit(0).alias("cluster"))
    assert {r["metric"] for r in cluster.quality(points, one).collect()} == {"n_clusters", "n_noise", "noise_ratio", "cluster_size_mean", "cluster_size_std"}
    noise = points.select("id", F.lit(-1).alias("cluster"))
    assert {r["metric"]: r["value"] for r in cluster.quality(points, noise).collect()}["noise_ratio"] == 1.0


@pytest.mark.parametrize("block", [1_000, 40])
def test_quality_of_many_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "CENTRE_BLOCK", block)
    k = 5_001 if block == 1_000 else 150
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1_000, (k, 2))[np.arange(3 * k) % k] + rng.normal(size=(3 * k, 2))
    label = np.arange(3 * k) % k
    points = spark.createDataFrame([(str(i), p.tolist()) for i, p in enumerate(x)], "id string, x array<double>")
    labels = spark.createDataFrame([(str(i), int(c)) for i, c in enumerate(label)], "id string, cluster int")
    got = {r["metric"]: r["value"] for r in cluster.quality(points, labels, silhouette=False).collect()}
    m = np.stack([x[label == c].mean(axis=0) for c in range(k)])
    s = np.array([np.sqrt(((x[label == c] - m[c]) ** 2).sum(axis=1)).mean() for c in range(k)])
    worst = [max(np.delete((s[c] + s) / np.maximum(np.sqrt(((m - m[c]) ** 2).sum(axis=1)), 1e-300), c)) for c in range(k)]
    within, between = ((x - m[label]) ** 2).sum(), 3 * ((m - x.mean(axis=0)) ** 2).sum()
    assert (got["n_clusters"], got["cluster_size_mean"], got["cluster_size_std"], got["n_noise"]) == (k, 3, 0, 0)
    assert got["davies_bouldin_score"] == pytest.approx(np.mean(worst))
    assert got["calinski_harabasz_score"] == pytest.approx(between / (k - 1) / (within / (2 * k)))


def test_pca(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 0.1, 500), "c": rng.normal(size=500)}))
    model = project.fit_pca(df, k=5)
    assert len(model.ratios) == 3 and sum(model.ratios) == pytest.approx(1) and model.ratios[0] > 0.6
    scores = model.transform(df, ["a"]).toPandas()
    assert abs(np.corrcoef(scores["pc1"], scores["pc2"])[0, 1]) < 1e-6


# -- anomalies --------------------------------------------------------------------------------------


def test_planted_outliers_are_found(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(380, 2)), rng.uniform(8, 12, size=(20, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(400)))
    for model in (anomaly.fit_isolation_forest(df, ["a", "b"], ["id"], 0.05), anomaly.fit_kernel_boundary(df, ["a", "b"], ["id"], 0.05)):
        found = {r["id"] for r in model.transform(df).filter("is_anomaly = 1").collect()}
        assert len(found) == 20 and len(found & set(range(380, 400))) >= 16
        assert model.summary(df).first()["anomaly_rate"] == pytest.approx(0.05)
    assert anomaly.fit_isolation_forest(df, ["a", "b"], ["id"], 0.05).anomalies(df, 5).count() == 5


def test_isolation_forest_samples_large_tables(spark):
    far = F.col("id") < 60
    df = spark.range(6_000).select(
        "id", F.when(far, 500.0).otherwise(F.col("id") % 100).alias("x"), F.when(far, 500.0).otherwise(F.col("id") % 37).alias("y")
    )
    model = anomaly.fit_isolation_forest(df, ["x", "y"], ["id"], 0.1, trees=10)
    assert model.transform(df).filter("id < 60 and is_anomaly = 1").count() == 60


def test_isolation_forest_finds_a_lone_row_of_a_large_table(spark):
    """More rows than 100 trees draw, so the planted row may be in no tree's sample."""
    far = F.col("id") == 0
    df = spark.range(40_000).select(
        "id", F.when(far, 500.0).otherwise(F.col("id") % 100).alias("x"), F.when(far, 500.0).otherwise(F.col("id") % 37).alias("y")
    )
    assert anomaly.fit_isolation_forest(df, ["x", "y"], ["id"], 0.1).transform(df).filter("id = 0 and is_anomaly = 1").count() == 1


def test_series_anomalies(spark, monkeypatch):
    rows = [(f"s{k}", i, float(np.sin(i)) + (50.0 if i == 70 else 0.0)) for k in range(3) for i in range(100)]
    data = spark.createDataFrame(rows, "series string, ts int, value double")
    monkeypatch.setattr(anomaly, "SLOT_ROWS", 30)
    found = anomaly.series_anomalies(data, 0.05).filter("is_anomaly = 1").collect()
    assert {(r["series"], 70) for r in found if r["ts"] == 70} == {("s0", 70), ("s1", 70), ("s2", 70)}


def test_series_forests_grow_together_as_one_by_one():
    rng = np.random.default_rng(8)
    for n, size, trees in ((1, 1, 3), (2, 2, 5), (70, 70, 100), (300, 64, 40), (40, 40, 10)):
        x = rng.normal(size=n).round(1)
        at = np.unique(np.append(x, rng.normal(size=20)))
        grown = []
        for t in range(trees):
            own = np.random.default_rng(anomaly._seed(42, "s", t))
            grown.append(anomaly._grow(x[own.choice(n, size=size, replace=False)][:, None], own))
        depth = sum(anomaly._depths(at[:, None], t) for t in grown) / trees
        expected = -np.exp2(-depth / (float(anomaly.average_path(size)) or 1.0))
        assert (anomaly._forest_scores(anomaly._leaves(x, size, trees, 42, "s"), trees, size, at) == expected).all()


def test_short_series_are_scored_where_they_grow(spark, monkeypatch):
    rows = [(f"s{k}", i, float(np.sin(i * (k + 1)).round(2)) + (50.0 if i == 7 else 0.0)) for k in range(5) for i in range(10 + 30 * k)]
    data = spark.createDataFrame(rows, "series string, ts int, value double")
    calls = []
    monkeypatch.setattr(anomaly, "with_hash_cutoffs", lambda *a: calls.append(a) or anomaly_cutoffs(*a))
    anomaly_cutoffs = hashing.with_hash_cutoffs
    whole = anomaly.series_anomalies(data, 0.05).orderBy("series", "ts").collect()
    assert not calls
    monkeypatch.setattr(anomaly, "SHORT", 50)
    assert anomaly.series_anomalies(data, 0.05).orderBy("series", "ts").collect() == whole and calls
    monkeypatch.setattr(anomaly, "SHORT", 0)
    assert anomaly.series_anomalies(data, 0.05).orderBy("series", "ts").collect() == whole


# -- series -----------------------------------------------------------------------------------------


def walk(spark, n=900, keys=2):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(keys):
        e = rng.normal(size=n + k)
        w = np.zeros(n + k)
        for i in range(1, n + k):
            w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
        rows += [(f"s{k}", i, float(v)) for i, v in enumerate(100 + np.cumsum(w))]
    return spark.createDataFrame(rows, "series string, ts int, value double")


def test_smoothing_chunks_do_not_matter(spark):
    data = walk(spark, 500)
    whole = smoothing.fit_smoothing(data).orderBy("series").collect()
    cut = smoothing.fit_smoothing(data, rows=120).orderBy("series").collect()
    for a, b in zip(whole, cut):
        assert a["alpha"] == b["alpha"] and a["sse"] == pytest.approx(b["sse"]) and a["level"] == pytest.approx(b["level"])


def test_smoothing_scan_is_the_recursion(monkeypatch):
    rng = np.random.default_rng(2)
    weights = np.array([0.01, 0.3, 0.99, 1.0])
    for n in (0, 1, 2, 63, 64, 65, 5_000):
        values = 100 + rng.normal(size=n).cumsum()
        a, b, c0, c1, c2 = (np.ones(4), *(np.zeros(4) for _ in range(4)))
        for x in values:
            miss = x - b
            c0, c1, c2 = c0 + miss * miss, c1 + miss * a, c2 + a * a
            b, a = b + weights * miss, a * (1 - weights)
        for cells in (1_000_000, 3):
            monkeypatch.setattr(smoothing, "CELLS", cells)
            assert np.allclose(smoothing._fold(values, weights), [a, b, c0, c1, c2], rtol=1e-9, atol=1e-12)


def test_smoothing_of_short_series_is_not_cut(spark):
    """Short series run many at a time, however many rows there are: no group for every series and time bound."""
    rng = np.random.default_rng(3)
    held = {f"s{k}": rng.normal(size=1 + k % 40).cumsum() for k in range(400)} | {"long": rng.normal(size=1_500).cumsum()}
    rows = [(k, 7 * i + len(k), -i, float(v)) for k, values in held.items() for i, v in enumerate(values)]
    data = spark.createDataFrame(rows, "series string, ts int, id int, value double").repartition(6)
    short = smoothing.fit_smoothing(data.filter("series <> 'long'"), ["id"], rows=100)
    assert "FlatMapGroupsInPandas" not in short._jdf.queryExecution().optimizedPlan().toString()
    grid = np.array(smoothing.WEIGHTS)
    for found in (short, smoothing.fit_smoothing(data, ["id"], rows=100), smoothing.fit_smoothing(data, ["id"])):
        got = {r["series"]: r for r in found.collect()}
        assert len(got) in (400, 401)
        for k, r in got.items():
            level, sse = np.full(len(grid), held[k][0]), np.zeros(len(grid))
            for v in held[k][1:]:
                level, sse = level + grid * (v - level), sse + (v - level) ** 2
            i = int(np.argmin(sse))
            assert r["alpha"] == grid[i] and r["sse"] == pytest.approx(sse[i], abs=1e-9) and r["level"] == pytest.approx(level[i], abs=1e-9)


def test_smoothing_of_a_million_values(spark):
    data = spark.range(1_000_000).select(F.lit("s").alias("series"), F.col("id").alias("ts"), (F.sin(F.col("id") / 50) + F.col("id") % 7).alias("value"))
    start = time.time()
    (row,) = smoothing.fit_smoothing(data).collect()
    assert 0 < row["alpha"] < 0.2 and time.time() - start < 60


def test_stationarity_by_hand_and_by_chunks(spark):
    data = walk(spark, 700)
    for lag in (0, 2):
        for chunk in (10_000, 97):
            got = forecast.stationarity(data, fixed_lag=lag, chunk=chunk).orderBy("series").collect()
            for k, r in enumerate(got):
                y = data.filter(F.col("series") == f"s{k}").orderBy("ts").toPandas()["value"].to_numpy()
                dy = np.diff(y)
                t = np.arange(lag, len(dy))
                design = np.column_stack([np.ones(len(t)), y[t], *[dy[t - j] for j in range(1, lag + 1)]])
                beta, *_ = np.linalg.lstsq(design, dy[t], rcond=None)
                e = dy[t] - design @ beta
                se = np.sqrt(e @ e / (len(t) - design.shape[1]) * np.linalg.inv(design.T @ design)[1, 1])
                assert r["statistic"] == pytest.approx(beta[1] / se, rel=1e-5)
    auto = forecast.stationarity(data, chunk=150).orderBy("series").collect()
    one = forecast.stationarity(data).orderBy("series").collect()
    assert [r["lag"] for r in auto] == [r["lag"] for r in one] and auto[0]["statistic"] == pytest.approx(one[0]["statistic"], rel=1e-5)
    assert not one[0]["is_stationary"] and one[0]["p_value"] > 0.05


def test_mackinnon_points():
    assert forecast.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002)
    assert forecast.adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    assert forecast.adf_p_value(5) == 1.0 and forecast.adf_p_value(-30) == 0.0


def test_arima_recovers_the_process_and_ignores_chunks(spark):
    data = walk(spark, 3_000, 1)
    whole = arima.arima_forecast(data, 5).orderBy("step").collect()
    cut = arima.arima_forecast(data, 5, chunk=400).orderBy("step").collect()
    assert [r["forecast"] for r in whole] == pytest.approx([r["forecast"] for r in cut], rel=1e-6)
    y = data.orderBy("ts").toPandas()["value"].to_numpy()
    steps = np.diff([y[-1], *[r["forecast"] for r in whole]])
    assert steps[2] / steps[1] == pytest.approx(0.6, abs=0.08)
    width = [r["upper"] - r["lower"] for r in whole]
    assert width[0] == pytest.approx(2 * 1.96, rel=0.1) and width == sorted(width)


@pytest.mark.parametrize("seasonal", [None, 4])
def test_arima_of_short_series_needs_no_group_for_each(spark, monkeypatch, seasonal):
    data = walk(spark, 90, 5).unionByName(walk(spark, 8, 1).withColumn("series", F.lit("few")))
    found = arima.arima_forecast(data, 6, seasonal=seasonal)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(arima, "SHORT", 92)
    parts = arima.arima_forecast(data, 6, seasonal=seasonal).orderBy("series", "step").collect()
    whole = found.orderBy("series", "step").collect()
    assert len(parts) == len(whole) == 36
    for a, b in zip(whole, parts):
        assert (a["series"], a["step"], a["index"], a["method_used"]) == (b["series"], b["step"], b["index"], b["method_used"])
        assert [a[c] for c in ("forecast", "lower", "upper")] == pytest.approx([b[c] for c in ("forecast", "lower", "upper")])


def test_seasonal_arima_follows_the_season(spark):
    rng = np.random.default_rng(2)
    y = [10 * np.sin(2 * np.pi * i / 12) + 0.1 * i + rng.normal(0, 0.1) for i in range(240)]
    data = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "series string, ts int, value double")
    got = forecast.forecast(data, "sarima", 12).orderBy("step").collect()
    truth = [10 * np.sin(2 * np.pi * i / 12) + 0.1 * i for i in range(240, 252)]
    assert np.max(np.abs(np.array([r["forecast"] for r in got]) - truth)) < 1.0


def test_short_series_fall_back_or_drop(spark):
    data = spark.createDataFrame([("a", i, float(i)) for i in range(20)] + [("b", 0, 1.0)], "series string, ts int, value double")
    got = forecast.forecast(data, "arima", 3).filter("series = 'a'").orderBy("step").collect()
    assert [r["forecast"] for r in got] == pytest.approx([20, 21, 22])
    assert forecast.forecast(data, "naive", 3).select("series").distinct().count() == 1
    with pytest.raises(ValueError):
        forecast.forecast(data, "prophet")


def test_timeseries_fixture(spark):
    rows = [(f"2024-01-{i + 1:02d}", 100 + i + (5 if i % 2 == 0 else -5), i) for i in range(30)]
    df = spark.createDataFrame(rows, "date string, value bigint, trend bigint")
    assert forecast.detect_date_column(df) == "date" and forecast.default_target(df) == "value"
    data = forecast.series(df.withColumn("date", F.to_date("date")), "trend", "date")
    drift = forecast.forecast(data, "drift", 2).orderBy("step").collect()
    assert [r["forecast"] for r in drift] == pytest.approx([31, 32]) and [r["index"] for r in drift] == [30, 31]


# -- explanation ------------------------------------------------------------------------------------


def test_sampled_shapley_adds_up(tabular):
    model = models.fit(tabular, "value", "random_forest", models.REGRESSION, FEATURES, {"n_estimators": 5, "max_depth": 4})
    values = explain.sampled_shap(model, tabular, ["id"], 20, 5).groupBy("id").agg(F.sum("shap").alias("total"))
    background = explain.hash_sample(tabular, ["id"], 5, "42:background")
    base = model.transform(background).agg(F.avg("prediction")).first()[0]
    outputs = {str(r["id"]): r["prediction"] for r in model.transform(tabular).collect()}
    got = values.collect()
    assert len(got) == 20 and all(r["total"] == pytest.approx(outputs[r["id"]] - base, abs=1e-6) for r in got)


def test_sampled_shapley_for_classes(tabular):
    model = models.fit(tabular, "three", "decision_tree", None, FEATURES, {"max_depth": 3})
    values = explain.sampled_shap(model, tabular, ["id"], 10, 3)
    assert values.select("output").distinct().count() == 3
    assert explain.shap_summary(values).orderBy(F.desc("mean_abs_shap")).first()["feature"] == "f1"


def test_surrogate_recovers_a_linear_model(tabular):
    model = models.fit(tabular, "value", "linear", models.REGRESSION, FEATURES)
    picked = tabular.filter("id in (3, 4)")
    got = explain.local_surrogate(model, tabular, picked, ["id"], 400, top=2).collect()
    weights = {(r["id"], r["feature"]): r["weight"] for r in got}
    assert weights == pytest.approx({("3", "f1"): 3.0, ("3", "f2"): -2.0, ("4", "f1"): 3.0, ("4", "f2"): -2.0}, abs=0.02)


# -- governance and streams -------------------------------------------------------------------------


def test_masking_nested_values(spark):
    df = spark.createDataFrame([("abc", ["abcdefgh", None], ("x", 5), {"k": "longvalue"})], "s string, a array<string>, r struct<t: string, n: int>, m map<string,string>")
    row = govern.mask_columns(df, {"s": "confidential", "a": "confidential", "r": "restricted", "m": "confidential"}).first()
    assert row["s"] == "****" and row["a"] == ["ab****gh", None] and row["r"]["t"] == "******" and row["r"]["n"] == 5 and row["m"] == {"k": "lo****ue"}
    assert govern.mask_columns(df, {"s": "public"}).first()["s"] == "abc"


def test_encryption_hides_and_returns(spark):
    df = spark.createDataFrame([("secret",), ("",), (None,)], "s string")
    hidden = govern.encrypt_columns(df, ["s"], "k").persist()
    assert hidden.filter("s = 'secret'").count() == 0
    assert [r["s"] for r in govern.decrypt_columns(hidden, ["s"], "k").collect()] == ["secret", "", None]


def test_stream_scores_equal_batch(spark, tabular, tmp_path):
    model = models.fit(tabular, "y", "logistic", None, FEATURES, {"max_iter": 10})
    source = str(tmp_path / "in")
    tabular.select("id", *FEATURES).repartition(4).write.parquet(source)
    stream = jobs.read_stream(spark, source, spark.read.parquet(source).schema, max_files=1)
    jobs.score_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in score_batch(model, tabular.select("id", *FEATURES)).collect()}


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [(u, 1_700_000_000 + u + 600 * i + (8_000 if i > 5 else 0)) for u in range(4) for i in range(10)] + [(9, 1_800_000_000)]
    df = spark.createDataFrame(rows, "u int, s bigint").select("u", F.timestamp_seconds("s").alias("ts"))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    stream = jobs.read_stream(spark, source, df.schema)
    job = jobs.activity_sessions(stream, "u", "ts").writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
    job.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in jobs.activity_sessions(df, "u", "ts").collect()}
    assert got == {r for r in batch if r[0] != 9} and len(got) == 8


def test_profile_stream_is_idempotent(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 10 == 0, None).otherwise(F.lit(1.5)).alias("y"))
    source, state = str(tmp_path / "in"), str(tmp_path / "sums")
    df.repartition(5).write.parquet(source)
    for attempt in ("one", "two"):
        jobs.profile_stream(jobs.read_stream(spark, source, "x double, y double", max_files=2), state, str(tmp_path / attempt)).awaitTermination()
    got = {r["column"]: r for r in jobs.running_profile(spark, state).collect()}
    assert got["x"]["count"] == 100 and got["x"]["std"] == pytest.approx(np.std(np.arange(100), ddof=1)) and got["y"]["null_count"] == 10


def test_session_stream_closes_idle_sessions_and_drops_late_rows(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "who string, at timestamp"
    hour = lambda h: f"2024-01-01 {int(h):02d}:{int(h * 60 % 60):02d}:00"
    waves = [
        [("a", 0), ("a", 0.5), ("b", 0.25)],
        [("a", 1.25), ("c", 10)],  # the watermark goes to nine
        [("a", 0.75), ("b", 9.5), ("c", 10.5)],  # the first is late
        [("d", 20)],
    ]
    for wave in waves:
        spark.createDataFrame([(k, hour(h)) for k, h in wave], "who string, at string").select("who", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, schema, max_files=1)
        jobs.store_sessions(stream, "who", "at", target, state).awaitTermination()
    show = lambda df: sorted((r["who"], str(r["session_start"])[11:16], str(r["last_event"])[11:16], r["n"]) for r in df.collect())
    assert show(spark.read.parquet(target)) == [("a", "00:00", "01:15", 3), ("b", "00:15", "00:15", 1), ("b", "09:30", "09:30", 1), ("c", "10:00", "10:30", 2)]
    assert show(jobs.open_sessions(spark, state, "who")) == [("d", "20:00", "20:00", 1)]


def test_session_state_has_one_timer_a_key():
    class Held(list):
        def get(self):
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Handle:
        def __init__(self):
            self.timers, self.state = [], Held()

        def getListState(self, name, schema):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    at = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    handle, keeper, second = Handle(), jobs._OpenSessions(10_000_000), 1_000_000
    keeper.init(handle)
    rows = [{"micros": 100 * second * i + j} for i in range(50) for j in range(3)]
    assert list(keeper.handleInputRows(("a",), iter(rows), at(0))) == []
    assert len(handle.state) == 50 and handle.timers == [10_001]
    # The watermark has passed forty sessions: one timer closes them all and leaves one for the next.
    over = list(keeper.handleExpiredTimer(("a",), at(4_000_000), None))
    assert [(r["first"], r["n"]) for r in over] == [(100 * second * i, 3) for i in range(40)]
    assert len(handle.state) == 10 and handle.timers == [10_001, 4_010_001]
    # Rows of the first open session move its end, and idle sessions close with the key's next rows.
    assert list(keeper.handleInputRows(("a",), iter([{"micros": 4_005 * second}]), at(4_000_000))) == []
    assert handle.timers[2:] == [4_015_001]
    assert list(keeper.handleExpiredTimer(("a",), at(4_010_001), None)) == [] and len(handle.timers) == 3
    assert len(list(keeper.handleInputRows(("a",), iter([{"micros": 9_000 * second}]), at(6_000_000)))) == 10
    assert [tuple(x) for x in handle.state] == [(9_000 * second, 9_000 * second, 1)]


def test_session_stream_keeps_rows_of_a_null_key(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(None if i % 3 == 0 else i % 3, 1_700_000_000 + 1_000 * i + (90_000 if i > 20 else 0)) for i in range(40)] + [(None, 1_800_000_000)]
    df = spark.createDataFrame(rows, "u bigint, s bigint").select("u", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(source)
    jobs.store_sessions(jobs.read_stream(spark, source, df.schema), "u", "ts", target, state).awaitTermination()
    got = spark.read.parquet(target).unionByName(jobs.open_sessions(spark, state, "u"))
    batch = jobs.batch_sessions(df, "u", "ts").drop("session")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(*got.columns).collect()))
