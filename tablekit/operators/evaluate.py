"""Model evaluation: metrics of a fitted model, cross-validation, comparison, learning curves."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablekit.functions.columns import col, local_table, numeric_columns, numeric_or_zero
from tablekit.functions.grams import gram
from tablekit.functions.hashing import row_hash, with_hash_cutoffs
from tablekit.operators import metrics as M
from tablekit.operators import models
from tablekit.operators.models import CLASSIFICATION, DEFAULT_MODELS, FittedModel, canonical
from tablekit.operators.sample import kfold, kfold_stratified, time_series_folds


def score(model: FittedModel, df: DataFrame) -> float:
    """Accuracy or R^2 on the rows that have a label: one aggregate."""
    scored = model.transform(df.filter(col(model.label).isNotNull()))
    if model.problem == CLASSIFICATION:
        hit = (col(model.label).cast("string") == F.col("prediction")).cast("double")
        return scored.agg(F.avg(hit)).first()[0]
    y = numeric_or_zero(scored, model.label)
    e = y - F.col("prediction")
    row = scored.agg(F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst")).first()
    return 1 - row["sse"] / row["sst"] if row["sst"] else 0.0


def evaluate(model: FittedModel, df: DataFrame) -> DataFrame:
    """(metric, value): every metric of the model's problem; the ROC area for two classes."""
    rows = df.filter(col(model.label).isNotNull())
    scored = model.transform(rows).persist()
    if model.problem != CLASSIFICATION:
        table = scored.select(numeric_or_zero(scored, model.label).alias("label"), "prediction")
        result = M.regression_metrics(table)
    else:
        table = scored.select(col(model.label).cast("string").alias("label"), "prediction", "probability")
        result = M.classification_metrics(table)
        if len(model.classes) == 2:
            with_score = table.withColumn("score", F.element_at("probability", 2))
            result = result.unionByName(M.roc_auc(with_score, model.classes[1]))
    values = [(r["metric"], r["value"]) for r in result.collect()]
    scored.unpersist()
    return local_table(df.sparkSession, values, "metric string, value double")


def assign_folds(
    df: DataFrame, keys: list[str], label: str, method: str = "kfold", folds: int = 5, order_by: str | None = None, seed: int = 42
) -> DataFrame:
    """kfold, stratified, or timeseries (which repeats rows with a role per fold)."""
    if method == "kfold":
        return kfold(df, keys, folds, seed)
    if method == "stratified":
        return kfold_stratified(df, keys, label, folds, seed)
    if method == "timeseries":
        return time_series_folds(df, keys, order_by, folds, seed)
    raise ValueError(f"unknown fold method: {method}")


def fold_pairs(folded: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    numbers = [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]
    if "role" in folded.columns:
        parts = [folded.filter(F.col("fold") == f) for f in numbers]
        return [(p.filter("role = 'train'"), p.filter("role = 'test'")) for p in parts]
    return [(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)) for f in numbers]


def run_parallel(tasks: list, parallelism: int) -> list:
    """Run Spark jobs from a few driver threads, as CrossValidator does."""
    from pyspark import inheritable_thread_target

    if not tasks:
        return []
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda task: task(), [inherit(t) for t in tasks]))


def cross_validate(
    df: DataFrame,
    label: str,
    model_type: str = "random_forest",
    problem: str | None = None,
    features: list[str] | None = None,
    params: dict | None = None,
    keys: list[str] = (),
    method: str = "kfold",
    folds: int = 5,
    order_by: str | None = None,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """(fold, score, mean, std): accuracy or R^2 per fold; the population std. loo is leave-one-out."""
    spark = df.sparkSession
    features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
    if method == "loo":
        return leave_one_out(df, label, model_type, problem, features, params, keys)
    problem = problem or models.guess_problem(df, label)
    needed = list(dict.fromkeys([*keys, *([order_by] if order_by else []), label, *features]))
    folded = assign_folds(df.select(*[col(c) for c in needed]), list(keys), label, method, folds, order_by, seed).persist()
    pairs = fold_pairs(folded)

    def job(train_rows, test_rows):
        return lambda: score(models.fit(train_rows, label, model_type, problem, features, params, keys, seed), test_rows)

    scores = run_parallel([job(a, b) for a, b in pairs], parallelism)
    folded.unpersist()
    mean, std = float(np.mean(scores)), float(np.std(scores))
    return local_table(spark, [(i, float(s), mean, std) for i, s in enumerate(scores)], "fold int, score double, mean double, std double")


def leave_one_out(df, label, model_type, problem, features, params, keys) -> DataFrame:
    """(n, score, rmse) without refitting: linear residuals over (1 - leverage), or neighbours without
    the row itself. score is the accuracy or R^2 of the held-out predictions."""
    name = canonical(model_type)
    held = held_out(df, label, name, problem, features, params or {}, list(keys))
    if problem == CLASSIFICATION:
        row = held.agg(F.count("*").alias("n"), F.avg((F.col("actual") == F.col("prediction")).cast("double")).alias("s")).first()
        rows = [(row["n"], row["s"], None)]
    else:
        e = F.col("actual") - F.col("prediction")
        row = held.agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop("actual") * F.count("*")).alias("sst")).first()
        rows = [(row["n"], 1 - row["sse"] / row["sst"] if row["sst"] else 0.0, (row["sse"] / row["n"]) ** 0.5)]
    return local_table(df.sparkSession, rows, "n bigint, score double, rmse double")


def held_out(df, label, name, problem, features, params, keys) -> DataFrame:
    """keys..., actual, prediction, each row predicted by a model that has not seen it."""
    rows = df.filter(col(label).isNotNull())
    kept = [col(k) for k in keys]
    if name == "linear_regression":
        # Centred columns keep the cross products well conditioned.
        raw = {"_y": label, **{f"_f{i}": c for i, c in enumerate(features)}}
        means = rows.agg(*[F.avg(numeric_or_zero(rows, c)).alias(n) for n, c in raw.items()]).first()
        centred = [(numeric_or_zero(rows, c) - F.lit(means[n])).alias(n) for n, c in raw.items()]
        x = rows.select(*kept, numeric_or_zero(rows, label).alias("actual"), F.lit(1.0).alias("_one"), *centred)
        names = ["_one", *[f"_f{i}" for i in range(len(features))]]
        g = gram(x, [*names, "_y"]).get(0)
        d = len(names)
        inverse = np.linalg.pinv(g[:d, :d])
        beta = inverse @ g[:d, d]

        # The leverage is a quadratic form of the row, so it stays a column expression.
        fitted = sum((F.col(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
        leverage = F.lit(0.0)
        for i, a in enumerate(names):
            inner = sum((F.col(b) * float(inverse[i, j]) for j, b in enumerate(names)), F.lit(0.0))
            leverage = leverage + F.col(a) * inner
        residual = (F.col("_y") - fitted) / F.greatest(1 - leverage, F.lit(1e-12))
        return x.select(*kept, "actual", (F.col("actual") - residual).alias("prediction"))
    if name == "k_neighbors":
        model = models.fit(rows, label, name, problem, features, params, keys)
        scored = model.stage.apply(rows, model, exclude_self=True)
        actual = col(label).cast("string") if problem == CLASSIFICATION else numeric_or_zero(rows, label)
        return scored.select(*kept, actual.alias("actual"), "prediction")
    raise ValueError(f"leave-one-out is only offered for linear_regression and k_neighbors; use k-fold for {name}")


def compare_models(
    df: DataFrame,
    label: str,
    model_types: list[str] = DEFAULT_MODELS,
    problem: str | None = None,
    features: list[str] | None = None,
    params: dict[str, dict] | None = None,
    keys: list[str] = (),
    cv_method: str | None = None,
    cv_folds: int = 5,
    seed: int = 42,
) -> DataFrame:
    """(rank, model_type, score, cv_mean, cv_std, seconds, error), best first. A model that fails keeps its
    error and ranks last."""
    problem = problem or models.guess_problem(df, label)
    features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
    needed = list(dict.fromkeys([*keys, label, "split", *features]))
    data = df.select(*[col(c) for c in needed]).persist()
    rows = []
    for name in model_types:
        start = time.time()
        own = (params or {}).get(name, {})
        try:
            training = data.filter("split = 'train'")
            model = models.fit(training, label, name, problem, features, own, keys, seed)
            value = score(model, data.filter("split = 'test'"))
            mean = std = None
            if cv_method:
                cv = cross_validate(training, label, name, problem, features, own, keys, cv_method, cv_folds, None, seed).first()
                mean, std = cv["mean"], cv["std"]
            rows.append((canonical(name), value, mean, std, time.time() - start, None))
        except Exception as error:
            rows.append((name, None, None, None, time.time() - start, str(error).split("\n")[0][:300]))
    data.unpersist()
    rows.sort(key=lambda r: -(r[1] if r[1] is not None else float("-inf")))
    return local_table(
        df.sparkSession,
        [(i, *r) for i, r in enumerate(rows, 1)],
        "rank int, model_type string, score double, cv_mean double, cv_std double, seconds double, error string",
    )


def learning_curve(
    df: DataFrame,
    label: str,
    model_type: str,
    problem: str | None = None,
    features: list[str] | None = None,
    params: dict | None = None,
    keys: list[str] = (),
    folds: int = 5,
    fractions: list[float] | None = None,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """(fraction, train_rows, train_score, test_score, gap): means over the folds. The training subsets are
    nested prefixes of the hash order."""
    spark = df.sparkSession
    fractions = fractions or [i / 10 for i in range(1, 11)]
    problem = problem or models.guess_problem(df, label)
    features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
    needed = list(dict.fromkeys([*keys, label, *features]))
    folded = kfold(df.filter(col(label).isNotNull()).select(*[col(c) for c in needed]), list(keys), folds, seed).persist()
    jobs, places = [], []
    for f, (training, test) in enumerate(fold_pairs(folded)):
        ranks = F.array(*[F.greatest(F.floor(F.col("n") * x), F.lit(1)).cast("bigint") for x in fractions])
        ordered = with_hash_cutoffs(training, row_hash(list(keys), f"{seed}:curve"), ranks).persist()
        for i in range(len(fractions)):
            part = ordered.filter(F.col("_h") <= F.element_at("_cut", i + 1)).drop("_h", "_n", "_cut")
            jobs.append(_curve_point(part, test, label, model_type, problem, features, params, keys, seed))
            places.append(i)
    results = run_parallel(jobs, parallelism)
    folded.unpersist()
    rows = []
    for i, x in enumerate(fractions):
        mine = np.array([r for r, p in zip(results, places) if p == i])
        n, a, b = mine.mean(axis=0)
        rows.append((float(x), int(n), float(a), float(b), float(a - b)))
    return local_table(spark, rows, "fraction double, train_rows bigint, train_score double, test_score double, gap double")


def _curve_point(part, test, label, model_type, problem, features, params, keys, seed):
    def job():
        model = models.fit(part, label, model_type, problem, features, params, keys, seed)
        return part.count(), score(model, part), score(model, test)

    return job


def diagnose(curve: DataFrame) -> DataFrame:
    """(final_train_score, final_test_score, gap, diagnosis) from the curve's last point."""
    last = curve.agg(
        F.max_by("train_score", "fraction").alias("final_train_score"), F.max_by("test_score", "fraction").alias("final_test_score")
    )
    a, b = F.col("final_train_score"), F.col("final_test_score")
    gap = a - b
    verdict = (
        F.when((gap > 0.1) & (a > 0.9), "overfitting")
        .when((a < 0.7) & (b < 0.7), "underfitting")
        .when(gap > 0.15, "high_variance")
        .otherwise("good_fit")
    )
    return last.select("final_train_score", "final_test_score", gap.alias("gap"), verdict.alias("diagnosis"))
