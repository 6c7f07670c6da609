"""Queries over models, search, clustering, projection, anomaly detection, explanation and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import local_table
from tablekit.operators import anomaly, cluster, density, evaluate, explain, models, project, search
from tablekit.operators.sample import kfold, kfold_stratified, split_random, split_stratified, time_series_folds
from tablekit.operators.score import score_batch
from tablekit.operators.select import top_importances
from tablekit.plans.registry import query, r, rounded
from tablekit.sources.model_store import ModelStore
from tablekit.streaming import jobs

KEYS = ["o_orderkey"]


def orders(t) -> DataFrame:
    """orders with a class target that depends on the features, and a stratified split."""
    p = F.col("o_totalprice")
    return t("orders").select(
        "o_orderkey",
        "o_totalprice",
        F.month("o_orderdate").alias("o_month"),
        (F.col("o_custkey") % 100).alias("o_region"),
        F.when(p + F.col("o_custkey") % 100 * 1000 > 300000, "high").otherwise("low").alias("size_class"),
        F.when(p > 350000, "a").when(p > 150000, "b").otherwise("c").alias("band"),
        (p * 0.5 + F.month("o_orderdate") * 1000.0).alias("cost"),
    )


FEATURES = ["o_totalprice", "o_month", "o_region"]


def split(t, label: str) -> DataFrame:
    return split_stratified(orders(t).select(*KEYS, *FEATURES, label), KEYS, label, 0.3)


def fitted_metrics(t, model: str, label: str, problem: str, params: dict) -> DataFrame:
    df = split(t, label) if problem == models.CLASSIFICATION else split_random(orders(t).select(*KEYS, *FEATURES, label), KEYS, 0.3)
    return rounded(models.train(df, label, model, problem, FEATURES, params, KEYS).metrics, 4)


CLASSIFIERS = {
    "random_forest": {"n_estimators": 10, "max_depth": 5},
    "gradient_boosting": {"n_estimators": 5},
    "logistic_regression": {"max_iter": 50},
    "decision_tree": {"max_depth": 5},
    "svm": {},
    "voting": {"members": {"random_forest": {"n_estimators": 5}, "gradient_boosting": {"n_estimators": 3}}},
    "stacking": {"folds": 3, "members": {"random_forest": {"n_estimators": 5, "max_depth": 4}, "gradient_boosting": {"n_estimators": 2}}},
}
for _name, _params in CLASSIFIERS.items():
    query(f"classify_{_name}")(lambda t, n=_name, p=_params: fitted_metrics(t, n, "size_class", models.CLASSIFICATION, p))
query("classify_boosting_three_classes")(
    lambda t: fitted_metrics(t, "xgboost", "band", models.CLASSIFICATION, {"n_estimators": 3})
)
REGRESSORS = {k: v for k, v in CLASSIFIERS.items() if k not in ("logistic_regression", "stacking")}
for _name, _params in REGRESSORS.items():
    query(f"regress_{_name}")(lambda t, n=_name, p=_params: fitted_metrics(t, n, "cost", models.REGRESSION, p))


@query(
    "linear_regression_one_feature",
    f"select 'slope' as term, {r('regr_slope(l_extendedprice, l_quantity)', 4)} as value from lineitem "
    f"union all select 'intercept', {r('regr_intercept(l_extendedprice, l_quantity)', 4)} from lineitem",
)
def linear_regression_one_feature(t):
    model = models.fit(t("lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice", "linear_regression", models.REGRESSION)
    rows = [("slope", float(model.stage.model.coefficients[0])), ("intercept", float(model.stage.model.intercept))]
    return rounded(local_table(t.spark, rows, "term string, value double"), 4)


def customers(t) -> DataFrame:
    return t("customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 400).alias("c_place"), "c_mktsegment")


KNN = """q as (select c_custkey, c_acctbal, c_nationkey * 400 as c_place, c_mktsegment, c_custkey % 3 = 0 as test from customer),
  d as (select a.c_custkey, b.c_mktsegment, b.c_acctbal, row_number() over (partition by a.c_custkey order by
          sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + (a.c_place - b.c_place) * (a.c_place - b.c_place)), cast(b.c_custkey as varchar)) as rk
        from q a, q b where a.test and not b.test)"""


@query(
    "neighbours_classify",
    f"""with {KNN}, v as (select c_custkey, c_mktsegment, count(*) as n from d where rk <= 5 group by all)
        select c_custkey, arg_min(c_mktsegment, (-n, c_mktsegment)) as prediction, {r('max(n) / 5.0')} as top_share from v group by c_custkey""",
)
def neighbours_classify(t):
    df = customers(t)
    test = F.col("c_custkey") % 3 == 0
    model = models.fit(df.filter(~test), "c_mktsegment", "k_neighbors", models.CLASSIFICATION, ["c_acctbal", "c_place"], keys=["c_custkey"])
    scored = model.transform(df.filter(test))
    return rounded(scored.select("c_custkey", "prediction", F.array_max("probability").alias("top_share")))


@query("neighbours_regress", f"with {KNN} select c_custkey, {r('avg(c_acctbal)', 4)} as prediction from d where rk <= 5 group by c_custkey")
def neighbours_regress(t):
    df = customers(t).withColumn("target", F.col("c_acctbal"))
    test = F.col("c_custkey") % 3 == 0
    model = models.fit(df.filter(~test), "target", "knn", models.REGRESSION, ["c_acctbal", "c_place"], {"n_neighbors": 5}, ["c_custkey"])
    return rounded(model.transform(df.filter(test)).select("c_custkey", "prediction"), 4)


@query(
    "decision_stump_discount",
    """with l as (select l_discount as x, case when l_discount + 0.03 * (l_linenumber % 2) > 0.05 then 'high' else 'low' end as y from lineitem),
         c as (select x, count(*) as n, count(*) filter (y = 'high') as h from l group by x),
         s as (select a.x as cut, sum(b.n) filter (b.x <= a.x) as nl, sum(b.h) filter (b.x <= a.x) as hl, sum(b.n) filter (b.x > a.x) as nr, sum(b.h) filter (b.x > a.x) as hr from c a, c b group by a.x having nr > 0),
         g as (select *, nl * 2 * (hl / nl) * (1 - hl / nl) + nr * 2 * (hr / nr) * (1 - hr / nr) as impurity from s),
         best as (select arg_min(cut, impurity) as cut, arg_min(hl / nl, impurity) as l, arg_min(hr / nr, impurity) as r from g)
       select x as l_discount, case when (case when x <= cut then l else r end) > 0.5 then 'high' else 'low' end as prediction from c, best""",
)
def decision_stump_discount(t):
    """A tree of one split, on a feature of eleven values: the split with the least Gini impurity."""
    label = F.when(F.col("l_discount") + 0.03 * (F.col("l_linenumber") % 2) > 0.05, "high").otherwise("low")
    df = t("lineitem").select("l_discount", label.alias("y"))
    model = models.fit(df, "y", "decision_tree", models.CLASSIFICATION, ["l_discount"], {"max_depth": 1})
    return model.transform(df.select("l_discount").distinct()).select("l_discount", "prediction")


@query("neighbours_embeddings")
def neighbours_embeddings(t):
    """Accuracy of the 5-neighbour vote on 64-dimensional vectors."""
    df = t("embeddings").select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    cut = split_stratified(df, ["vec_id"], "label", 0.3)
    features = [f"e{i}" for i in range(64)]
    model = models.fit(cut.filter("split = 'train'"), "label", "knn", models.CLASSIFICATION, features, keys=["vec_id"])
    return local_table(t.spark, [(float(evaluate.score(model, cut.filter("split = 'test'"))),)], "accuracy double")


@query("importances_forest")
def importances_forest(t):
    model = models.fit(split(t, "size_class"), "size_class", "random_forest", models.CLASSIFICATION, FEATURES, {"n_estimators": 10, "max_depth": 5})
    return rounded(top_importances(models.importances(t.spark, model)), 4)


# -- folds ------------------------------------------------------------------------------------------

DIGEST = "md5(concat_ws('~', o_orderkey, 42))"


def block_sql(k: int, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    return (
        f"select o_orderkey, case when rn < (n % {k}) * (n // {k} + 1) then rn // (n // {k} + 1) else n % {k} + (rn - (n % {k}) * (n // {k} + 1)) // (n // {k}) end as fold "
        f"from (select o_orderkey, row_number() over ({part}order by {DIGEST}) - 1 as rn, count(*) over ({part}) as n from orders)"
    )


@query("folds_kfold", block_sql(7))
def folds_kfold(t):
    return kfold(t("orders"), KEYS, 7).select("o_orderkey", "fold")


@query("folds_stratified", block_sql(5, "o_orderstatus"))
def folds_stratified(t):
    return kfold_stratified(t("orders"), KEYS, "o_orderstatus", 5).select("o_orderkey", "fold")


@query(
    "folds_time_series",
    f"""with p as (select o_orderkey, row_number() over (order by o_orderdate, {DIGEST}) - 1 as rn, count(*) over () as n, count(*) over () // 5 as size from orders),
          f as (select o_orderkey, rn, n, size, unnest(range(4)) as fold from p)
        select o_orderkey, cast(fold as integer) as fold, case when rn < n - (4 - fold) * size then 'train' else 'test' end as role from f where rn < n - (3 - fold) * size""",
)
def folds_time_series(t):
    return time_series_folds(t("orders"), KEYS, "o_orderdate", 4).select("o_orderkey", "fold", "role")


@query(
    "folds_time_series_null_dates",
    f"""with p as (select o_orderkey, row_number() over (order by case when o_orderkey % 7 = 0 then null else o_orderdate end nulls first, {DIGEST}) - 1 as rn, count(*) over () as n, count(*) over () // 5 as size from orders),
          f as (select o_orderkey, rn, n, size, unnest(range(4)) as fold from p)
        select o_orderkey, cast(fold as integer) as fold, case when rn < n - (4 - fold) * size then 'train' else 'test' end as role from f where rn < n - (3 - fold) * size""",
)
def folds_time_series_null_dates(t):
    df = t("orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    return time_series_folds(df, KEYS, "o_orderdate", 4).select("o_orderkey", "fold", "role")


@query("cross_validate_tree")
def cross_validate_tree(t):
    return rounded(evaluate.cross_validate(orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, {"max_depth": 3}, KEYS, "stratified", 3), 4)


@query(
    "leave_one_out_linear",
    f"""with o as (select o_orderkey, o_totalprice / 100000 as l, cast(o_custkey as double) as x from orders),
          s as (select regr_slope(l, x) as b, regr_intercept(l, x) as a, avg(x) as m, var_pop(x) * count(*) as sxx, count(*) as n from o)
        select o_orderkey, {r('l', 7)} as actual, {r('l - (l - a - b * x) / (1 - 1.0 / n - (x - m) * (x - m) / sxx)', 7)} as prediction from o, s""",
)
def leave_one_out_linear(t):
    df = t("orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("price"), "o_custkey")
    return rounded(evaluate.held_out(df, "price", "linear_regression", models.REGRESSION, ["o_custkey"], {}, KEYS), 7)


@query(
    "leave_one_out_neighbours",
    f"""with {KNN.replace("where a.test and not b.test", "where a.c_custkey <> b.c_custkey")},
          v as (select c_custkey, c_mktsegment, count(*) as n from d where rk <= 5 group by all),
          p as (select c_custkey, arg_min(c_mktsegment, (-n, c_mktsegment)) as prediction from v group by c_custkey)
        select count(*) as n, {r('avg((p.prediction = c.c_mktsegment)::int)')} as score from p join customer c using (c_custkey)""",
)
def leave_one_out_neighbours(t):
    found = evaluate.cross_validate(
        customers(t), "c_mktsegment", "k_neighbors", models.CLASSIFICATION, ["c_acctbal", "c_place"], {}, ["c_custkey"], "loo"
    )
    return rounded(found.select("n", "score"))


@query("compare_models_orders")
def compare_models_orders(t):
    names = ["decision_tree", "logistic_regression", "random_forest"]
    own = {"random_forest": {"n_estimators": 5}, "logistic_regression": {"max_iter": 30}}
    return rounded(evaluate.compare_models(split(t, "size_class"), "size_class", names, models.CLASSIFICATION, FEATURES, own, KEYS).drop("seconds"), 4)


@query("learning_curve_tree")
def learning_curve_tree(t):
    curve = evaluate.learning_curve(
        orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, {"max_depth": 3}, KEYS, 2, [0.25, 1.0]
    )
    return rounded(evaluate.diagnose(curve), 4)


@query(
    "diagnose_by_flag",
    f"""with c as (select l_returnflag as f, avg(l_discount) * 15 as a, avg(l_tax) * 15 as b from lineitem group by 1),
         m as (select {r('arg_max(a, f)', 4)} as a, {r('arg_max(b, f)', 4)} as b from c)
       select a as final_train_score, b as final_test_score, {r('a - b', 4)} as gap, case when a - b > 0.1 and a > 0.9 then 'overfitting'
         when a < 0.7 and b < 0.7 then 'underfitting' when a - b > 0.15 then 'high_variance' else 'good_fit' end as diagnosis from m""",
)
def diagnose_by_flag(t):
    curve = t("lineitem").groupBy("l_returnflag").agg(
        F.round(F.avg("l_discount") * 15, 4).alias("train_score"), F.round(F.avg("l_tax") * 15, 4).alias("test_score")
    )
    return rounded(evaluate.diagnose(curve.withColumnRenamed("l_returnflag", "fraction")), 4)


# -- search -----------------------------------------------------------------------------------------


@query("grid_search_tree")
def grid_search_tree(t):
    found, _ = search.grid_search(orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, KEYS)
    return rounded(found.drop("seconds"), 4)


STUMP_FOLDS = block_sql(3)


@query(
    "grid_search_stump",
    f"""with o as (select o.o_orderkey, month(o_orderdate) as x, (month(o_orderdate) + 4 * (o.o_orderkey % 3) > 8)::int as y, fold from orders o join ({STUMP_FOLDS}) f on f.o_orderkey = o.o_orderkey),
          c as (select k.fold, x, count(*) as n, sum(y) as h from o, (select unnest(range(3)) as fold) k where o.fold <> k.fold group by k.fold, x),
          s as (select a.fold, a.x as cut, sum(b.n) filter (b.x <= a.x) as nl, sum(b.h) filter (b.x <= a.x) as hl, sum(b.n) filter (b.x > a.x) as nr, sum(b.h) filter (b.x > a.x) as hr
                from c a join c b using (fold) group by a.fold, a.x having nr > 0),
          i as (select *, 'gini' as criterion, nl * 2 * (hl / nl) * (1 - hl / nl) + nr * 2 * (hr / nr) * (1 - hr / nr) as impurity from s
                union all select *, 'entropy', -(case when hl > 0 then hl * ln(hl / nl) else 0 end + case when hl < nl then (nl - hl) * ln(1 - hl / nl) else 0 end
                  + case when hr > 0 then hr * ln(hr / nr) else 0 end + case when hr < nr then (nr - hr) * ln(1 - hr / nr) else 0 end) from s),
          best as (select criterion, fold, arg_min(cut, impurity) as cut, arg_min(hl / nl, impurity) as l, arg_min(hr / nr, impurity) as r from i group by all),
          score as (select criterion, best.fold, avg((((case when x <= cut then l else r end) > 0.5)::int = y)::int) as s from o join best using (fold) group by all),
          m as (select criterion, avg(s) as mean_score, stddev_pop(s) as std_score from score group by criterion)
        select cast(rank() over (order by mean_score desc) as integer) as rank, '{{"criterion": "' || criterion || '", "max_depth": 1}}' as params, '' as ignored,
          {r('mean_score', 5)} as mean_score, {r('std_score', 5)} as std_score from m""",
)
def grid_search_stump(t):
    """Trees of one split on a feature of twelve values, for both criteria: folds, fits and scores have SQL."""
    month = F.month("o_orderdate")
    label = F.when(month + 4 * (F.col("o_orderkey") % 3) > 8, "1").otherwise("0")
    df = t("orders").select("o_orderkey", month.alias("x"), label.alias("y"))
    found, _ = search.grid_search(df, "y", "decision_tree", models.CLASSIFICATION, ["x"], KEYS, 3, {"criterion": ["gini", "entropy"], "max_depth": [1]})
    return rounded(found.drop("seconds"), 5)


@query("random_search_tree")
def random_search_tree(t):
    found, _ = search.random_search(orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, KEYS)
    return rounded(found.drop("seconds"), 4)


@query("bayesian_search_linear")
def bayesian_search_linear(t):
    space = {"max_depth": [2, 3, 4, 5], "min_samples_leaf": [1, 5]}
    found, _ = search.bayesian_search(orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, KEYS, 2, 4, None, space)
    return rounded(found.drop("seconds"), 4)


# -- clustering -------------------------------------------------------------------------------------

PLACE = ["c_acctbal", "c_place"]


def by_nation(t) -> tuple[DataFrame, DataFrame]:
    """Customer points, and labels by balance band (one band is noise)."""
    points = cluster.scaled_points(customers(t), ["c_custkey"], PLACE, scale=False)
    b = F.col("c_acctbal")
    band = F.when(b < 0, -1).when(b < 3000, 0).when(b < 6000, 1).otherwise(2)
    return points, t("customer").select(F.col("c_custkey").cast("string").alias("id"), band.alias("cluster"))


@query(
    "cluster_quality_customers",
    f"""with p as (select c_acctbal as x, c_nationkey * 400.0::double as y, case when c_acctbal < 0 then -1 when c_acctbal < 3000 then 0 when c_acctbal < 6000 then 1 else 2 end as c from customer),
          q as (select * from p where c >= 0), m as (select c, count(*) as n, avg(x) as mx, avg(y) as my from q group by c), g as (select avg(x) as gx, avg(y) as gy, count(*) as n from q),
          s as (select c, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) as s, sum(pow(x - mx, 2) + pow(y - my, 2)) as ss from q join m using (c) group by c),
          db as (select a.c, max((sa.s + sb.s) / sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) as v from m a join m b on a.c <> b.c join s sa on sa.c = a.c join s sb on sb.c = b.c group by a.c),
          i as (select *, row_number() over () as id from q),
          dist as (select a.id, a.c, b.c as o, sum(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from i a, i b group by a.id, a.c, b.c),
          w as (select id, dist.c, max(d / (n - 1)) filter (dist.c = o) as inner_, min(d / n) filter (dist.c <> o) as outer_ from dist join m on m.c = o group by id, dist.c)
        select 'n_clusters' as metric, 3.0::double as value union all select 'n_noise', count(*) from p where c < 0
        union all select 'noise_ratio', {r('avg((c < 0)::int)', 4)} from p
        union all select 'cluster_size_mean', {r('avg(n)', 4)} from m union all select 'cluster_size_std', {r('stddev_pop(n)', 4)} from m
        union all select 'calinski_harabasz_score', {r('(select sum(m.n * (pow(mx - gx, 2) + pow(my - gy, 2))) from m, g) / 2 / ((select sum(ss) from s) / ((select n from g) - 3))', 4)}
        union all select 'davies_bouldin_score', {r('avg(v)', 4)} from db
        union all select 'silhouette_squared', {r('avg((outer_ - inner_) / greatest(inner_, outer_))', 4)} from w""",
)
def cluster_quality_customers(t):
    return rounded(cluster.quality(*by_nation(t)), 4)


@query("kmeans_embeddings")
def kmeans_embeddings(t):
    df = t("embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(64)])
    return cluster.cluster_sizes(cluster.kmeans(df, ["vec_id"], [f"e{i}" for i in range(64)], 10))


@query("hierarchical_customers")
def hierarchical_customers(t):
    return cluster.cluster_sizes(cluster.hierarchical(customers(t), ["c_custkey"], PLACE, 4))


@query("spectral_customers")
def spectral_customers(t):
    return cluster.cluster_sizes(cluster.spectral(customers(t), ["c_custkey"], PLACE, 3))


DBSCAN = """p as (select cast(c_custkey as varchar) as id, c_acctbal as x, c_nationkey * 400.0::double as y from customer),
  e as (select a.id as a, b.id as b from p a, p b where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400.0 * 400.0),
  core as (select a as id from e group by a having count(*) >= 13),
  ce as (select a, b from e semi join core on a = core.id where b in (select id from core)),
  reach as (select id as a, id as b from core union select reach.a, ce.b from reach join ce on reach.b = ce.a),
  comp as (select a as id, min(b) as first from reach group by a),
  num as (select first, dense_rank() over (order by first) - 1 as cluster from (select distinct first from comp)),
  lab as (select id, cluster from comp join num using (first)),
  border as (select e.a as id, min(cluster) as cluster from e join lab on lab.id = e.b where e.a not in (select id from core) group by e.a)"""


@query(
    "dbscan_customers",
    f"with recursive {DBSCAN} select id, cast(coalesce(lab.cluster, border.cluster, -1) as bigint) as cluster from p left join lab using (id) left join border using (id)",
)
def dbscan_customers(t):
    return density.dbscan(customers(t), ["c_custkey"], PLACE, 400.0, 13, scale=False)


def dbscan_sql(columns: list[str], distance: str, eps: float, least: int) -> str:
    """The labels by all pairs: distance is an expression of p.x and q.x lists."""
    return f"""with recursive p as (select cast(c_custkey as varchar) as id, [{", ".join(columns)}]::double[] as x from customer),
      e as (select p.id as a, q.id as b from p, p q where {distance} <= {eps}),
      core as (select a as id from e group by a having count(*) >= {least}),
      ce as (select a, b from e semi join core on a = core.id where b in (select id from core)),
      reach as (select id as a, id as b from core union select reach.a, ce.b from reach join ce on reach.b = ce.a),
      comp as (select a as id, min(b) as first from reach group by a),
      num as (select first, dense_rank() over (order by first) - 1 as cluster from (select distinct first from comp)),
      lab as (select id, cluster from comp join num using (first)),
      border as (select e.a as id, min(cluster) as cluster from e join lab on lab.id = e.b where e.a not in (select id from core) group by e.a)
    select id, cast(coalesce(lab.cluster, border.cluster, -1) as bigint) as cluster from p left join lab using (id) left join border using (id)"""


FIVE = ["c_nationkey * 400.0", "(c_custkey % 7) * 300.0", "c_acctbal", "(c_custkey % 5) * 350.0", "(c_custkey % 3) * 250.0"]


@query("dbscan_five_features", dbscan_sql(FIVE, "list_distance(p.x, q.x)", 900.0, 6))
def dbscan_five_features(t):
    df = t("customer").select("c_custkey", *[F.expr(f"cast({c} as double)").alias(f"f{i}") for i, c in enumerate(FIVE)])
    return density.dbscan(df, ["c_custkey"], [f"f{i}" for i in range(5)], 900.0, 6, scale=False)


@query("dbscan_manhattan", dbscan_sql(["c_acctbal", "c_nationkey * 400.0"], "abs(p.x[1] - q.x[1]) + abs(p.x[2] - q.x[2])", 450.0, 9))
def dbscan_manhattan(t):
    return density.dbscan(customers(t), ["c_custkey"], PLACE, 450.0, 9, scale=False, metric="manhattan")


@query("dbscan_chebyshev", dbscan_sql(["c_acctbal", "c_nationkey * 400.0"], "greatest(abs(p.x[1] - q.x[1]), abs(p.x[2] - q.x[2]))", 399.5, 14))
def dbscan_chebyshev(t):
    return density.dbscan(customers(t), ["c_custkey"], PLACE, 399.5, 14, scale=False, metric="chebyshev")


@query("adaptive_density_customers")
def adaptive_density_customers(t):
    return density.adaptive_density(customers(t), ["c_custkey"], PLACE, 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query("optimal_k_customers")
def optimal_k_customers(t):
    return cluster.choose_k(cluster.optimal_k(customers(t), ["c_custkey"], PLACE))


@query(
    "choose_k_by_segment",
    """with c as (select 2 + row_number() over (order by o_orderpriority) - 1 as k, sum(o_totalprice) as v, avg(o_custkey) as s from orders group by o_orderpriority),
         d as (select k, v, s, lead(v) over (order by k) - v as step, lead(v, 2) over (order by k) - 2 * lead(v) over (order by k) + v as bend from c)
       select 'silhouette' as rule, cast(arg_max(k, s) as integer) as k from d union all select 'elbow_reference', cast(arg_max(k, step) as integer) from d
       union all select 'elbow', cast(arg_max(k, bend) + 1 as integer) from d""",
)
def choose_k_by_segment(t):
    """The selection rules on a curve made from five sums."""
    from pyspark.sql import Window

    sums = t("orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("inertia"), F.avg("o_custkey").alias("silhouette"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o_orderpriority")) + 1
    return cluster.choose_k(sums.select(place.alias("k"), "inertia", "silhouette"))


# -- projection and anomalies -----------------------------------------------------------------------


@query(
    "pca_two_columns",
    f"""with c as (select abs(corr(l_quantity, l_extendedprice)) as a from lineitem)
        select 1 as component, {r('(1 + a) / 2')} as ratio, {r('(1 + a) / 2')} as cumulative from c union all select 2, {r('(1 - a) / 2')}, 1.0 from c""",
)
def pca_two_columns(t):
    return rounded(project.fit_pca(t("lineitem"), ["l_quantity", "l_extendedprice"], 2).explained(t.spark))


@query("project_umap_orders")
def project_umap_orders(t):
    df = orders(t)
    return rounded(project.project(df, "umap", FEATURES, 2).transform(df, [*KEYS, "size_class"]))


@query("plot_points_customers")
def plot_points_customers(t):
    df = customers(t)
    return rounded(project.plot_points(df, ["c_custkey"], PLACE, by_nation(t)[1]))


@query(
    "isolation_mostly_zero",
    "select event_id, cast(event_id % 20 = 0 as integer) as is_anomaly from events",
)
def isolation_mostly_zero(t):
    """One column, zero but for a twentieth of the rows: at a tenth of contamination exactly those score lowest."""
    value = F.when(F.col("event_id") % 20 == 0, 1000 + F.col("value")).otherwise(F.lit(0.0))
    df = t("events").select("event_id", value.alias("value"))
    return anomaly.fit_isolation_forest(df, ["value"], ["event_id"], 0.1).transform(df).select("event_id", "is_anomaly")


@query("isolation_forest_labels")
def isolation_forest_labels(t):
    """Every row with its score and label."""
    df = orders(t)
    return rounded(anomaly.fit_isolation_forest(df, FEATURES, KEYS, 0.1).transform(df).select(*KEYS, "anomaly_score", "is_anomaly"))


@query("isolation_forest_orders")
def isolation_forest_orders(t):
    df = orders(t)
    found = anomaly.fit_isolation_forest(df, FEATURES, KEYS, 0.1)
    return found.summary(df)


@query(
    "isolation_forest_planted",
    """select count(*) as n_total, count(*) filter (o_orderkey % 211 = 0) as planted, count(*) filter (o_orderkey % 211 = 0) as found,
         true as within_share from orders""",
)
def isolation_forest_planted(t):
    """Orders moved far from all others, each in its own place: every one is an anomaly, and no more than the share are."""
    far, key = F.col("o_orderkey") % 211 == 0, F.col("o_orderkey")
    df = orders(t).select(*KEYS, *[F.when(far, F.col(c) + (i + 1) * (1e7 + key * 100)).otherwise(F.col(c)).alias(c) for i, c in enumerate(FEATURES)])
    found = anomaly.fit_isolation_forest(df, FEATURES, KEYS, 0.1).transform(df)
    hit, flagged = F.col("is_anomaly") == 1, F.col("is_anomaly")
    return found.agg(
        F.count("*").alias("n_total"), F.count_if(far).alias("planted"), F.count_if(far & hit).alias("found"), (F.sum(flagged) <= 0.1 * F.count("*") + 1).alias("within_share")
    )


@query("isolation_forest_lowest")
def isolation_forest_lowest(t):
    df = t("events").select("event_id", "value")
    return rounded(anomaly.fit_isolation_forest(df, ["value"], ["event_id"], 0.05).anomalies(df))


@query("kernel_boundary_orders")
def kernel_boundary_orders(t):
    df = orders(t)
    return anomaly.fit_kernel_boundary(df, FEATURES, KEYS, 0.1).summary(df)


# -- explanation ------------------------------------------------------------------------------------


@query(
    "linear_shap_lineitem",
    " union all ".join(
        f"select '{c}' as feature, {r(f'avg(abs({b} * ({c} - m)))', 4)} as mean_abs_shap from lineitem, (select avg({c}) as m from lineitem)"
        for c, b in (("l_quantity", 3.0), ("l_extendedprice", -0.25), ("l_discount", 1000.0))
    ),
)
def linear_shap_lineitem(t):
    return rounded(explain.linear_importance(t("lineitem"), {"l_quantity": 3.0, "l_extendedprice": -0.25, "l_discount": 1000.0}), 4)


@query("linear_shap_rows", f"select o_orderkey, 'o_totalprice' as feature, {r('0.5 * (o_totalprice - (select avg(o_totalprice) from orders))', 4)} as shap from orders")
def linear_shap_rows(t):
    return rounded(explain.linear_shap(t("orders"), {"o_totalprice": 0.5}, KEYS), 4)


@query("sampled_shap_forest")
def sampled_shap_forest(t):
    df = orders(t)
    model = models.fit(df, "cost", "random_forest", models.REGRESSION, FEATURES, {"n_estimators": 5, "max_depth": 4})
    return rounded(explain.shap_summary(explain.sampled_shap(model, df, KEYS, 50, 4)), 3)


@query("tree_shap_orders", "select o_orderkey, 2 as outputs, 6 as cells, 0.0::double as gap from orders")
def tree_shap_orders(t):
    """Exact Shapley values of every order for a tree without a depth limit: they add up to the output minus its mean."""
    df = orders(t)
    model = models.fit(df, "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, {}, KEYS)
    sums = explain.tree_shap(model, df, KEYS).groupBy("o_orderkey", "output").agg(F.count("*").alias("n"), (F.sum("shap") - F.first("value") + F.first("base")).alias("gap"))
    whole = sums.groupBy("o_orderkey").agg(F.count("*").cast("int").alias("outputs"), F.sum("n").cast("int").alias("cells"), F.max(F.abs("gap")).alias("gap"))
    return rounded(whole)


@query("local_surrogate_forest")
def local_surrogate_forest(t):
    df = orders(t)
    model = models.fit(df, "size_class", "random_forest", models.CLASSIFICATION, FEATURES, {"n_estimators": 5, "max_depth": 4})
    picked = explain.hash_sample(df, KEYS, 5)
    return rounded(explain.local_surrogate(model, df, picked, KEYS, 200))


# -- scoring and storage ----------------------------------------------------------------------------


def _tree(t) -> models.FittedModel:
    return models.fit(orders(t), "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, {"max_depth": 4}, KEYS)


@query("score_batch_orders")
def score_batch_orders(t):
    return score_batch(_tree(t), orders(t).select(*KEYS, "o_totalprice", "o_month"))


@query("score_batch_keys", "select o_orderkey, true as scored from orders")
def score_batch_keys(t):
    """Every record that comes in gets a prediction among the classes of the model."""
    model = _tree(t)
    scored = score_batch(model, orders(t).select(*KEYS, "o_totalprice", "o_month"))
    return scored.select("o_orderkey", F.col("Prediction").cast("string").isin(*[str(c) for c in model.classes]).alias("scored"))


@query("stream_scores_equal_batch", "select count(*) as n, true as same from orders")
def stream_scores_equal_batch(t):
    """Scores of a stream of files beside those of one batch."""
    source, target = t.scratch("arriving"), t.scratch("scored")
    orders(t).select(*KEYS, *FEATURES).repartition(3).write.parquet(source)
    schema = t.spark.read.parquet(source).schema
    model = _tree(t)
    stream = jobs.read_stream(t.spark, source, schema, max_files=1)
    jobs.score_stream(model, stream, target, t.scratch("score-state")).awaitTermination()
    one = t.spark.read.parquet(target).select("o_orderkey", F.col("Prediction").alias("p"))
    other = score_batch(model, orders(t).select(*KEYS, *FEATURES)).select("o_orderkey", F.col("Prediction").alias("q"))
    return one.join(other, "o_orderkey").agg(F.count("*").alias("n"), F.every(F.col("p").eqNullSafe(F.col("q"))).alias("same"))


@query("score_stream_orders")
def score_stream_orders(t):
    """The same scores from a stream of files as from one batch."""
    source, target = t.scratch("arriving"), t.scratch("scored")
    orders(t).select(*KEYS, *FEATURES).repartition(3).write.parquet(source)
    schema = t.spark.read.parquet(source).schema
    stream = jobs.read_stream(t.spark, source, schema, max_files=1)
    jobs.score_stream(_tree(t), stream, target, t.scratch("score-state")).awaitTermination()
    return t.spark.read.parquet(target).groupBy("Prediction").agg(F.count("*").alias("n"))


@query("model_store_round_trip", "select true as same, count(*) as n from orders")
def model_store_round_trip(t):
    store = ModelStore(t.spark, t.scratch("store"))
    model = _tree(t)
    store.save(model)
    again = store.load(model.model_id)
    df = orders(t)
    both = model.transform(df).select("o_orderkey", F.col("prediction").alias("p")).join(
        again.transform(df).select("o_orderkey", F.col("prediction").alias("q")), "o_orderkey"
    )
    return both.agg(F.every(F.col("p") == F.col("q")).alias("same"), F.count("*").alias("n"))


@query("training_run_log", "select 'job-1' as job_id, 'completed' as status, 'decision_tree' as model_type")
def training_run_log(t):
    store = ModelStore(t.spark, t.scratch("runs"))
    df = split(t, "size_class")
    store.run("job-1", "decision_tree", lambda: models.train(df, "size_class", "decision_tree", models.CLASSIFICATION, FEATURES, {"max_depth": 3}, KEYS))
    return store.runs().select("job_id", "status", "model_type")
