"""Queries over orders and customers with a planted structure, so that learned operators have one right answer in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablekit.operators import anomaly, clean, cluster, density, evaluate, explain, models, project, resample, select
from tablekit.operators import forecast as fc
from tablekit.operators.genetic import select_genetic
from tablekit.operators.score import score_batch
from tablekit.plans.registry import query, r, rounded
from tablekit.sources import readers

KEYS = ["o_orderkey"]
FEATURES = ["band", "o_month", "o_region"]


def banded(t, classes: int = 2) -> DataFrame:
    """Orders in bands that lie far apart in one feature; the other features say nothing. `side` and `amount` follow the band."""
    band = F.col("o_orderkey") % classes
    return t("orders").select(
        "o_orderkey",
        (band * 1000.0).alias("band"),
        F.month("o_orderdate").alias("o_month"),
        (F.col("o_custkey") % 100).alias("o_region"),
        F.concat(F.lit("side"), band.cast("string")).alias("side"),
        (band * 10.0 + 10).alias("amount"),
    )


def held_out(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    test = F.col("o_orderkey") % 5 == 0
    return df.filter(~test), df.filter(test)


# -- models -----------------------------------------------------------------------------------------

#: Ensembles of few rounds: each round is a job, and one split is all there is to learn.
FEW = {"random_forest": {"n_estimators": 10}, "gradient_boosting": {"n_estimators": 3}}
CLASSIFIERS = {
    "random_forest": {}, "gradient_boosting": {"n_estimators": 10}, "logistic_regression": {}, "svm": {}, "voting": {"members": FEW},
    "stacking": {"folds": 3, "members": FEW},
}


def _classified(t, name: str, params: dict) -> DataFrame:
    train, test = held_out(banded(t))
    model = models.fit(train, "side", name, models.CLASSIFICATION, FEATURES, params, KEYS)
    return model.transform(test).select("o_orderkey", "prediction")


for _name, _params in CLASSIFIERS.items():
    query(f"planted_classes_{_name}", "select o_orderkey, 'side' || (o_orderkey % 2) as prediction from orders where o_orderkey % 5 = 0")(
        lambda t, n=_name, p=_params: _classified(t, n, p)
    )


def _regressed(t, name: str, params: dict) -> DataFrame:
    train, test = held_out(banded(t))
    model = models.fit(train, "amount", name, models.REGRESSION, FEATURES, params, KEYS)
    return rounded(model.transform(test).select("o_orderkey", "prediction"), 3)


#: Every tree of a forest takes all features here: one that draws features may not see the band.
for _name, _params in {"random_forest": {"max_features": "all"}, "gradient_boosting": {"n_estimators": 5}, "voting": {"members": FEW | {"random_forest": {"n_estimators": 10, "max_features": "all"}}}}.items():
    query(f"planted_values_{_name}", "select o_orderkey, (o_orderkey % 2) * 10.0::double + 10 as prediction from orders where o_orderkey % 5 = 0")(
        lambda t, n=_name, p=_params: _regressed(t, n, p)
    )


@query("planted_importances", "select 'band' as feature, 1.0::double as importance union all select 'o_month', 0.0 union all select 'o_region', 0.0")
def planted_importances(t):
    """All importance lies on the feature that makes the classes."""
    model = models.fit(banded(t), "side", "decision_tree", models.CLASSIFICATION, FEATURES)
    return rounded(select.top_importances(models.importances(t.spark, model)), 6)


@query(
    "planted_comparison",
    "select unnest(['random_forest', 'gradient_boosting', 'logistic_regression', 'decision_tree', 'k_neighbors']) as model_type, 1.0::double as score, 1.0::double as cv_mean, 0.0::double as cv_std, true as fitted",
)
def planted_comparison(t):
    """The five default models: all of them find the bands, on held-out rows and in every fold."""
    split = F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train")
    found = evaluate.compare_models(banded(t).withColumn("split", split), "side", problem=models.CLASSIFICATION, features=["band"], params={"random_forest": {"n_estimators": 20}, "gradient_boosting": {"n_estimators": 3}}, keys=KEYS, cv_method="kfold", cv_folds=2)
    return rounded(found.select("model_type", "score", "cv_mean", "cv_std", F.col("error").isNull().alias("fitted")))


@query("planted_learning_curve", "select unnest(range(1, 11)) / 10.0::double as fraction, 1.0::double as train_score, 1.0::double as test_score, 0.0::double as gap, 'good_fit' as diagnosis")
def planted_learning_curve(t):
    """The ten default fractions, and the verdict on the curve."""
    curve = evaluate.learning_curve(banded(t), "side", "decision_tree", models.CLASSIFICATION, FEATURES, {}, KEYS, 3)
    verdict = evaluate.diagnose(curve).select("diagnosis")
    return rounded(curve.select("fraction", "train_score", "test_score", "gap").join(F.broadcast(verdict)))


@query(
    "planted_evaluation",
    """select unnest(['accuracy', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'roc_auc']) as metric, 1.0::double as value""",
)
def planted_evaluation(t):
    """Every metric of a perfect model, on rows that lack a training column (it counts as zero)."""
    train, test = held_out(banded(t))
    model = models.fit(train, "side", "decision_tree", models.CLASSIFICATION, FEATURES, {}, KEYS)
    return rounded(evaluate.evaluate(model, test.drop("o_region")).filter("metric in ('accuracy', 'precision_weighted', 'recall_weighted', 'f1_weighted', 'roc_auc')"))


@query("planted_batch_scores", "select o_orderkey, 'side' || (o_orderkey % 2) as \"Prediction\", '100.00%' as \"Confidence\" from orders")
def planted_batch_scores(t):
    model = models.fit(banded(t), "side", "decision_tree", models.CLASSIFICATION, FEATURES)
    return score_batch(model, banded(t).drop("side")).select("o_orderkey", "Prediction", "Confidence")


@query("planted_surrogate", "select cast(o_orderkey as varchar) as id, 'o_month' as feature, 2.0::double as weight from orders where o_orderkey in (select o_orderkey from orders order by o_orderkey limit 5)")
def planted_surrogate(t):
    """Around any row the surrogate of a linear model has the model's own slope."""
    df = banded(t).withColumn("cost", F.col("o_month") * 2.0 + 3)
    model = models.fit(df, "cost", "linear_regression", models.REGRESSION, ["o_month"])
    found = explain.local_surrogate(model, df, df.orderBy("o_orderkey").limit(5), KEYS)
    return found.select("id", "feature", (F.round("weight", 2) + 0.0).alias("weight"))


# -- features ---------------------------------------------------------------------------------------


@query("planted_rfe", "select 'band' as feature")
def planted_rfe(t):
    found = select.select_rfe(banded(t).select("side", *FEATURES), "side", 1)
    return t.spark.createDataFrame([(c,) for c in found.kept], "feature string")


@query("planted_genetic", "select 'classes' as target, true as has_band, true as is_small union all select 'values', true, true")
def planted_genetic(t):
    """The genetic search keeps the feature that matters and drops another, for class and for number targets."""
    rows = []
    for name, label in (("classes", "side"), ("values", "amount")):
        df = banded(t, 3).select(*KEYS, *FEATURES, F.when(F.lit(label == "side"), F.col("side")).otherwise(F.col("amount").cast("string")).alias("y"))
        if label == "amount":
            df = df.withColumn("y", F.col("y").cast("double") + F.col("o_orderkey") % 97 / 1000.0)
        kept = select_genetic(df, KEYS, "y", FEATURES).kept
        rows.append((name, "band" in kept, len(kept) < 3))
    return t.spark.createDataFrame(rows, "target string, has_band boolean, is_small boolean")


@query(
    "planted_adasyn",
    """select true as between_rows, true as grown, count(*) as originals from orders where o_orderkey % 10 = 0 or o_orderkey % 3 = 0""",
)
def planted_adasyn(t):
    """New points of the smaller class lie on segments between two of its rows: here on one line, between its ends."""
    small = F.col("o_orderkey") % 10 == 0
    df = t("orders").filter(small | (F.col("o_orderkey") % 3 == 0)).select(
        "o_orderkey",
        F.when(small, "few").otherwise("many").alias("side"),
        F.when(small, F.col("o_orderkey") % 1009).otherwise(F.col("o_orderkey") % 1013).cast("double").alias("x"),
    ).withColumn("y", F.when(F.col("side") == "few", F.col("x") * 2 + 5).otherwise(F.col("x") * 2 + 9))
    new = resample.adasyn(df, KEYS, ["x", "y"], "side")
    on_line = F.abs(F.col("y") - F.col("x") * 2 - 5) < 1e-6
    inside = (F.col("x") >= 0) & (F.col("x") <= 1008)
    made = F.col("synthetic") == True  # noqa: E712
    return new.agg(F.bool_and(~made | ((F.col("side") == "few") & on_line & inside)).alias("between_rows"), (F.count_if(made) > 0).alias("grown"), F.count_if(~made).alias("originals"))


# -- clusters and anomalies -------------------------------------------------------------------------

PLACE = ["px", "py"]


def blobs(t) -> DataFrame:
    """Customers in three places far apart, of different spread."""
    k = F.col("c_custkey") % 3
    spread = F.when(k == 0, 1.0).when(k == 1, 3.0).otherwise(0.5)
    return t("customer").select("c_custkey", (k * 1000.0 + spread * (F.col("c_custkey") % 31)).alias("px"), (k * k * 700.0 + spread * (F.col("c_acctbal") % 29)).alias("py"))


def same_place(labels: DataFrame) -> DataFrame:
    """Every id with the least id of its cluster, whatever the clusters are called."""
    return labels.select("id", F.min(F.col("id").cast("long")).over(Window.partitionBy("cluster")).alias("first"))


FIRST_OF_PLACE = "select cast(c_custkey as varchar) as id, min(c_custkey) over (partition by c_custkey % 3) as first from customer"


@query("planted_kmeans", FIRST_OF_PLACE)
def planted_kmeans(t):
    return same_place(cluster.kmeans(blobs(t), ["c_custkey"], PLACE, 3))


@query("planted_hierarchical", FIRST_OF_PLACE)
def planted_hierarchical(t):
    return same_place(cluster.hierarchical(blobs(t), ["c_custkey"], PLACE, 3))


@query("planted_optimal_k", "select 'silhouette' as rule, 3 as k union all select 'elbow', 3")
def planted_optimal_k(t):
    return cluster.choose_k(cluster.optimal_k(blobs(t), ["c_custkey"], PLACE, 6)).filter("rule <> 'elbow_reference'")


@query(
    "planted_plot_points",
    f"""with p as (select c_custkey, c_acctbal as a, c_nationkey * 400.0::double as b from customer),
          z as (select c_custkey, (a - avg(a) over ()) / stddev_pop(a) over () as a, (b - avg(b) over ()) / stddev_pop(b) over () as b from p)
        select cast(c_custkey as varchar) as id, {r('greatest(abs(a + b), abs(a - b)) / sqrt(2)', 4)} as longer, {r('least(abs(a + b), abs(a - b)) / sqrt(2)', 4)} as shorter, c_custkey % 4 as cluster from z""",
)
def planted_plot_points(t):
    """With two columns the components are the sum and the difference of the scaled ones: signs and order aside."""
    df = t("customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 400).alias("place"))
    labels = df.select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 4).alias("cluster"))
    found = project.plot_points(df, ["c_custkey"], ["c_acctbal", "place"], labels)
    return rounded(found.select("id", F.greatest(F.abs("x"), F.abs("y")).alias("longer"), F.least(F.abs("x"), F.abs("y")).alias("shorter"), "cluster"), 4)


@query("planted_boundary", "select count(*) filter (o_orderkey % 211 = 0) as planted, count(*) filter (o_orderkey % 211 = 0) as found from orders")
def planted_boundary(t):
    """Rows far from all others lie outside the kernel boundary."""
    far = F.col("o_orderkey") % 211 == 0
    df = banded(t).select(*KEYS, *[F.when(far, F.lit(1e6) * (i + 1)).otherwise(F.col(c)).alias(c) for i, c in enumerate(["o_month", "o_region"])])
    found = anomaly.fit_kernel_boundary(df, ["o_month", "o_region"], KEYS, 0.05).transform(df)
    return found.agg(F.count_if(far).alias("planted"), F.count_if(far & (F.col("is_anomaly") == 1)).alias("found"))


@query("planted_column_outliers", "select o_orderkey, 'value' as column from orders where o_orderkey % 20 = 0")
def planted_column_outliers(t):
    """Per column, at a tenth of contamination: exactly the twentieth that is not zero."""
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, 1000 + F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("value"))
    return clean.isolation_outliers(df, KEYS, ["value"]).select("o_orderkey", "column")


# -- series and sources -----------------------------------------------------------------------------


def _days(t, value) -> DataFrame:
    """One row per day of the orders, with a value that follows a rule exactly."""
    day = t("orders").select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("n")).distinct().filter("n < 600")
    every = day.agg(F.max("n").alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("n"))
    return every.select(F.lit("s").alias("series"), F.col("n").alias("ts"), value(F.col("n")).alias("value"))


LAST_DAY = "(select max(date_diff('day', date '1995-01-01', o_orderdate::date)) as m from orders where date_diff('day', date '1995-01-01', o_orderdate::date) < 600)"


@query("planted_arima", f"select cast(k as integer) as step, {r('100 + 5.0 * (m + k)', 2)} as value from {LAST_DAY}, (select unnest(range(1, 6)) as k)")
def planted_arima(t):
    """A straight line goes on as it was."""
    found = fc.forecast(_days(t, lambda n: 100 + n * 5.0), "arima", 5, [])
    return rounded(found.select(F.col("step").cast("int").alias("step"), F.col("forecast").alias("value")), 2)


@query(
    "planted_seasonal_arima",
    f"select cast(k as integer) as step, {r('50 + 2.0 * (m + k) + 10 * ((m + k) % 12)', 1)} as value from {LAST_DAY}, (select unnest(range(1, 25)) as k)",
)
def planted_seasonal_arima(t):
    """A line with a season of twelve goes on as it was."""
    found = fc.forecast(_days(t, lambda n: 50 + n * 2.0 + (n % 12) * 10.0), "sarima", 24, [])
    return rounded(found.select(F.col("step").cast("int").alias("step"), F.col("forecast").alias("value")), 1)


@query("read_unknown_suffix", "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus from orders")
def read_unknown_suffix(t):
    """A folder of another suffix is read as comma-separated text."""
    path = f"{t.scratch('orders')}.dat"
    t("orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    return readers.read_any(t.spark, path).select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
