"""Cleaning, scaling, encoding, selection, splits, preparation: fixtures, edge tables, properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.operators import cells, clean, encode, profile, recommend, resample, sample, scale, select
from tablekit.operators.genetic import select_genetic
from tablekit.plans.prepare import PrepareConfig, prepare
from tablekit.sources import admission, catalog, readers, sinks


def rows(df, *names):
    return {r[names[0]]: tuple(r[n] for n in names[1:]) if len(names) > 2 else r[names[1]] for r in df.collect()}


def test_profile_of_fixture(classification):
    table = {r["column"]: r for r in profile.describe(classification).collect()}
    assert table["age"]["count"] == 12 and table["age"]["min"] == 25
    assert table["churn"]["mean"] == pytest.approx(5 / 12)
    kinds = {r["column"]: r["inferred_type"] for r in profile.column_profile(classification, ["id"]).collect()}
    assert kinds["department"] == "categorical" and kinds["age"] == "integer"


def test_profile_finds_dates_and_booleans(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i + 1:02d}", f"text {i}", i % 2 == 0) for i in range(12)], "id int, d string, s string, b boolean")
    kinds = {r["column"]: r["inferred_type"] for r in profile.column_profile(df, ["id"]).collect()}
    assert kinds == {"id": "integer", "d": "datetime", "s": "text", "b": "boolean"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double")
    assert rows(profile.missing(df), "column", "missing") == {"x": 2}
    assert profile.describe(df).first()["null_count"] == 2


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert profile.describe(empty).first()["count"] == 0
    assert profile.missing(empty).first()["missing_pct"] == 0.0
    assert clean.fit_fill(empty).transform(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    assert clean.fit_fill(nulls, strategy="mode").transform(nulls).first() == (0.0, "missing")
    assert clean.columns_mostly_missing(nulls) == ["x", "s"]
    one = spark.createDataFrame([(3.0, "a")], "x double, s string")
    for method in ("standard", "minmax", "robust"):
        assert scale.fit_scaler(one, ["x"], method).transform(one).first()["x"] == 0.0


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(2.0, "b"), (1.0, "a"), (None, None)], "x double, s string")
    assert clean.fit_fill(df, strategy="most_frequent").values == {"x": 1.0, "s": "a"}


def test_null_fixture(with_nulls):
    assert clean.drop_incomplete(with_nulls).count() == 3
    filled = clean.handle_missing(with_nulls.drop("churn"), "auto")
    assert filled.na.drop("any").count() == 10
    assert rows(profile.missing(with_nulls), "column", "missing")["age"] == 2


def test_validation(classification):
    report = clean.validate(classification, ["age", "nope"], {"department": "numeric"}, {"age": (26, 100)})
    assert not clean.is_valid(report)
    assert rows(report.filter("check = 'range'"), "column", "n_bad") == {"age": 1}


def test_power_transform_removes_skew(spark):
    x = np.random.default_rng(0).exponential(10, 3_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    model = scale.fit_scaler(df, ["x"], "power")
    y = model.transform(df).toPandas()["x"]
    assert abs(y.skew()) < 0.3 and abs(y.mean()) < 1e-9 and y.std(ddof=0) == pytest.approx(1)
    grid = np.linspace(-1, 1.5, 501)

    def likelihood(lam):
        t = np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam
        return -0.5 * len(x) * np.log(t.var()) + (lam - 1) * np.log1p(x).sum()

    assert model.params["x"]["lambda"] == pytest.approx(grid[np.argmax([likelihood(g) for g in grid])], abs=0.01)


def test_quantile_transform_is_normal(spark):
    x = np.random.default_rng(0).exponential(10, 5_000)
    y = scale.fit_scaler(df := spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], "quantile").transform(df).toPandas()["x"]
    assert abs(y.mean()) < 0.05 and abs(y.std() - 1) < 0.05 and y.abs().max() < 5.2
    assert (np.argsort(np.argsort(y, kind="stable")) == np.argsort(np.argsort(x, kind="stable"))).mean() > 0.9


def test_inverse_normal(spark):
    p = spark.createDataFrame([(0.5,), (0.975,), (0.001,), (0.0,), (None,)], "p double")
    got = [r[0] for r in p.select(scale.normal_quantile(F.col("p"))).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1.959964, abs=1e-6)
    assert got[2] == pytest.approx(-3.090232, abs=1e-5) and got[3] == pytest.approx(-5.1993, abs=1e-3) and got[4] is None


def test_encoder_branches(spark):
    df = spark.createDataFrame([(f"v{i % 25:02d}", None if i == 0 else "ab"[i % 2], i) for i in range(100)], "wide string, narrow string, id int")
    model = encode.fit_encoder(df)
    out = model.transform(df)
    assert out.columns == ["id", "narrow_b", "wide_freq"] and set(model.output_columns) == {"narrow_b", "wide_freq"}
    assert out.filter("id = 0").first()["narrow_b"] == 0
    assert out.agg(F.sum("wide_freq")).first()[0] == pytest.approx(4.0)


def test_correlation_filter_drops_the_copy(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(100, 40)), columns=[f"feat_{i}" for i in range(40)])
    pdf["feat_corr"] = 0.999 * pdf["feat_0"]
    found = select.select_correlation(spark.createDataFrame(pdf), threshold=0.9)
    assert found.dropped == ["feat_corr"]


def test_kbest_agrees_with_spark_selector(spark):
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler

    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 300)
    pdf = pd.DataFrame({"a": y + rng.normal(size=300), "b": rng.normal(size=300), "c": 3 * y + rng.normal(size=300), "y": y})
    df = spark.createDataFrame(pdf)
    ours = select.select_kbest(df, "y", 2, ["a", "b", "c"])
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    theirs = UnivariateFeatureSelector(featuresCol="v", labelCol="y", outputCol="o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(2).fit(data)
    assert ours.kept == [["a", "b", "c"][i] for i in sorted(theirs.selectedFeatures)]


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_genetic_selection(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 8))
    signal = x[:, 0] * 2 + x[:, 3]
    pdf = pd.DataFrame(x, columns=[f"feat_{i}" for i in range(8)]).assign(id=range(100))
    pdf["y"] = (signal > 0).astype(int) if kind == "classification" else signal
    found = select_genetic(spark.createDataFrame(pdf), ["id"], "y", population=12, generations=8, max_features=8)
    assert 1 <= len(found.kept) <= 8 and set(found.kept) <= set(found.features) and found.history
    assert "feat_0" in found.kept
    assert [h["best_fitness"] for h in found.history] == sorted(h["best_fitness"] for h in found.history)


def test_genetic_selection_of_one_feature(spark):
    df = spark.createDataFrame([(i, float(i), int(i > 3)) for i in range(1, 7)], "id int, single_col double, y int")
    assert select_genetic(df, ["id"], "y").kept == ["single_col"]


def test_rfe_keeps_the_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(y=(x[:, 2] > 0).astype(int)))
    assert "c" in select.select_rfe(df, "y", 2, trees=10).kept


def test_rfe_of_many_rows_in_few_cells_grows_its_trees_on_counts(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 4000), "b": rng.integers(0, 5, 4000) * 0.5, "c": rng.integers(0, 3, 4000)})
    pdf["y"] = np.where((pdf["b"] > 1) ^ (rng.random(4000) < 0.1), "up", "down")
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(cells, "BAGGED_ROWS", 1000)
    fitted, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: fitted.append(data.count()) or fit(self, data))
    found = select.select_rfe(df, "y", 1, trees=6)
    assert found.kept == ["b"] and sorted(found.scores.values()) == [-2.0, -1.0, 0.0]
    assert len(fitted) == 12 and max(fitted) <= 4 * 5 * 3 * 2
    # The draws depend on the cells, not on how the rows are spread.
    assert select.select_rfe(df.repartition(7), "y", 1, trees=6).scores == found.scores


def test_bags_draw_every_row_poisson_times(spark, monkeypatch):
    monkeypatch.setattr(cells, "BAGGED_ROWS", 1000)
    df = spark.range(20_000).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("_label"))
    bags = cells.count_bags(df, ["x"], 200, 1)
    counts = np.array([r["_bags"] for r in bags.table.collect()])
    assert counts.shape == (10, 200) and bags.cells == 10
    # 2,000 rows a cell: mean 2,000 and variance 2,000 over 2,000 draws.
    assert abs(counts.mean() - 2000) < 5 and 1700 < counts.var() < 2300
    assert cells.count_bags(df.limit(500), ["x"], 2, 1) is None
    bags.close()


def test_split_points_of_a_forest_separate_all_of_few_values_and_cut_many_evenly(spark):
    df = spark.range(9_000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"))
    few, many, one = cells.sampled_points(df, ["few", "many", "one"], 9_000, 1)
    assert few == [0.5, 1.5] and one == [] and len(many) == 31
    assert np.abs(np.array(many) / 9_000 - np.arange(1, 32) / 32).max() < 0.001


def test_fold_sizes_follow_the_smallest_class(spark):
    df = spark.range(103).withColumn("y", (F.col("id") < 3).cast("int"))
    folded = sample.kfold_stratified(df, ["id"], "y", 5)
    assert folded.select("fold").distinct().count() == 3
    lonely = df.withColumn("y", (F.col("id") < 1).cast("int"))
    sizes = [r["count"] for r in sample.kfold_stratified(lonely, ["id"], "y", 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]


def imbalanced(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame(rng.normal(size=(150, 4)), columns=[f"col_{i}" for i in range(4)]).assign(id=range(150), target=[1] * 6 + [0] * 144)
    return spark.createDataFrame(pdf), [f"col_{i}" for i in range(4)]


def test_smote_counts_and_hull(spark):
    df, features = imbalanced(spark)
    grown = resample.smote(df, ["id"], features, "target").toPandas()
    assert (grown["target"] == 1).sum() == 144 and (grown["target"] == 0).sum() == 144
    old = df.filter("target = 1").toPandas()
    new = grown[(grown["target"] == 1) & grown["synthetic"]]
    for _, r in new.iterrows():
        parent = old[old["id"].astype(str) == r["source_id"].split("~")[0]][features].to_numpy(float)[0]
        step = r[features].to_numpy(float) - parent
        ends = old[features].to_numpy(float) - parent
        cos = ends @ step / np.maximum(np.linalg.norm(ends, axis=1) * np.linalg.norm(step), 1e-12)
        assert np.any((cos > 1 - 1e-9) & (np.linalg.norm(step) <= np.linalg.norm(ends, axis=1) + 1e-9)) or np.linalg.norm(step) < 1e-12


def test_adasyn_adds_minority_rows(spark):
    df, features = imbalanced(spark)
    grown = resample.adasyn(df, ["id"], features, "target")
    counts = rows(grown.groupBy("target").count(), "target", "count")
    assert counts[0] == 144 and abs(counts[1] - 144) <= 6


def test_adasyn_of_classes_far_apart_spreads_evenly(spark):
    """No row of the smaller class is near the other one: copies cannot follow that share, and still lie between its rows."""
    data = [(i, float(i % 4) + 1_000 * (i >= 12), int(i >= 12)) for i in range(42)]
    grown = resample.adasyn(spark.createDataFrame(data, "id int, x double, y int"), ["id"], ["x"], "y").toPandas()
    assert (grown["y"] == 0).sum() == 30 and (grown["y"] == 1).sum() == 30
    new = grown[grown["synthetic"]]
    assert (new["y"] == 0).all() and new["x"].between(0, 3).all()
    assert new["source_id"].str.split("~").str[0].value_counts().isin([1, 2]).all()


def test_smote_falls_back_to_oversampling(spark):
    df = spark.createDataFrame([(i, float(i), int(i == 0)) for i in range(10)], "id int, x double, y int")
    grown = resample.smote(df, ["id"], ["x"], "y")
    assert rows(grown.groupBy("y").count(), "y", "count") == {0: 9, 1: 9}


def test_prepared_model_transforms_unseen_rows(spark, classification):
    config = PrepareConfig(keys=["id"], target="churn", problem="Classification", scaling_method="robust", feature_selection={"method": "kbest", "max_features": 3})
    model, table = prepare(classification, config)
    assert len(model.features) == 3 and table.filter("split = 'test'").count() == 3
    unseen = spark.createDataFrame([(99, 31, None, "Sales", 4)], "id bigint, age bigint, salary bigint, department string, experience_years bigint")
    assert model.transform(unseen).na.drop("any").count() == 1
    assert model.steps[0] == "imputation=auto"


@pytest.mark.parametrize("method", ["variance", "rfe", "genetic"])
def test_prepare_with_every_selector(classification, method):
    config = PrepareConfig(keys=["id"], target="churn", problem="Classification", feature_selection={"method": method, "max_features": 2, "threshold": 0.95, "population_size": 6, "generations": 2})
    model, table = prepare(classification, config)
    assert model.features and set(model.features) <= set(table.columns)


def test_prepare_fit_on_train_and_options(classification):
    config = PrepareConfig(keys=["id"], target="churn", problem="Classification", fit_on="train", apply_polynomial=True, apply_binning=True, imbalance_handling={"method": "oversample"})
    model, table = prepare(classification, config)
    train = rows(table.filter("split = 'train'").groupBy("churn").count(), "churn", "count")
    assert train[0] == train[1] and "age_sq" in model.features and "age_bin" in model.features


def test_prepare_other_problems(classification):
    unsupervised, table = prepare(classification, PrepareConfig(keys=["id"], problem="Clustering"))
    assert table.filter("split = 'train'").count() == 12
    _, series = prepare(classification, PrepareConfig(keys=["id"], target="salary", problem="Forecasting", order_by="age"))
    assert series.filter("split = 'test'").count() == 3


def test_auto_configuration(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"skewed": rng.exponential(10, 200), "normal": rng.normal(size=200), "category": rng.choice(list("ABC"), 200), "target": [1] * 20 + [0] * 180})
    config = recommend.auto_configure(spark.createDataFrame(pdf), "target", "Classification")
    assert config["scaling_method"] in ("robust", "power") and config["imbalance_handling"]["method"] == "smote"


def test_recommendations_for_small_table(classification):
    titles = {r["title"] for r in recommend.recommend(classification).collect()}
    assert "Small Dataset Size" in titles and "Detected Problem Type" in titles
    steps = [r["step"] for r in recommend.recommended_steps(classification).orderBy("position").collect()]
    assert steps[:2] == ["encoding", "scaling"]


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        profile.page(spark.range(5), ["id"], 0, 10)
    with pytest.raises(ValueError):
        profile.page(spark.range(5), ["id"], 1, 1001)
    assert profile.page(spark.range(25), ["id"], 3, 10).first()["total_pages"] == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,s\n1,"a, ""b"""\nbad,c\n')
    (tmp_path / "a.json").write_text('[{"x": 1, "s": "a"}, {"x": 2, "s": "b"}]')
    (tmp_path / "a.unknown").write_text("x,s\n3,d\n")
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "a.csv"), schema="x int, s string").collect()] == [(1, 'a, "b"'), (None, "c")]
    assert readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_any(spark, str(tmp_path / "a.unknown")).first()["x"] == 3
    with pytest.raises(ValueError, match="supported formats"):
        readers.read_any(spark, str(tmp_path / "a.csv"), "xlsx")
    with pytest.raises(ValueError, match="supported formats"):
        readers.read_any(spark, str(tmp_path / "absent.parquet"))


def test_admission_of_files(spark, tmp_path):
    for name, content in {"ok.csv": b"a,b\n", "run.csv": b"MZ\x90\x00x", "elf.txt": b"\x7fELF\x01", "none.json": b"", "x.exe": b"abc", "big.tsv": b"x" * 50}.items():
        (tmp_path / name).write_bytes(content)
    table = admission.admit(admission.list_files(spark, str(tmp_path), 40), 40)
    got = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in table.collect()}
    assert got["ok.csv"] is None and got["none.json"] == "Empty file" and got["big.tsv"] == "File size exceeds limit"
    assert "MZ" in got["run.csv"] and "ELF" in got["elf.txt"] and got["x.exe"].startswith("Invalid file extension")


def test_catalog(spark, tmp_path, classification):
    store = catalog.Catalog(spark, str(tmp_path))
    store.ingest(classification, "people", "people.csv")
    assert store.metadata("people").first()["n_rows"] == 12 and store.size("people") > 0
    store.delete("people", remove_files=True)
    assert store.list().count() == 0
    with pytest.raises(KeyError):
        store.delete("people")


def test_partitions_prune(spark, tmp_path, classification):
    path = str(tmp_path / "split")
    sinks.save_partitions(sample.split_random(classification, ["id"], 0.25), path)
    test = sinks.load_partition(spark, path, "test")
    assert test.count() == 3
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
