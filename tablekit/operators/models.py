"""Supervised models: fit on a table, predict on a table, importances."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions.columns import as_vector, col, local_table, numeric_columns, numeric_or_zero
from tablekit.functions.neighbours import knn_join, point_table
from tablekit.functions.session import collect_bounded

CLASSIFICATION, REGRESSION = "Classification", "Regression"

#: Model names and the spellings they answer to (fixed values).
ALIASES = {
    "random_forest": ("randomforest", "rf"),
    "gradient_boosting": ("gradientboosting", "gb", "gbt", "xgboost", "lightgbm", "catboost"),
    "logistic_regression": ("logisticregression", "logistic"),
    "linear_regression": ("linearregression", "linear"),
    "decision_tree": ("decisiontree", "dt"),
    "k_neighbors": ("kneighbors", "knn", "k_nearest_neighbors"),
    "svm": ("svc", "svr", "linear_svm"),
    "voting": ("voting_ensemble", "votingensemble"),
    "stacking": ("stacking_ensemble", "stackingensemble"),
}
DEFAULT_MODELS = ("random_forest", "gradient_boosting", "logistic_regression", "decision_tree", "k_neighbors")

#: The deepest trees that Spark grows: used when a forest or tree is asked for no depth limit; more is refused.
OPEN_DEPTH = 30
MAX_CLASSES = 1_000


def canonical(name: str) -> str:
    key = name.lower().replace("-", "_").replace(" ", "_")
    for model, others in ALIASES.items():
        if key == model or key in others:
            return model
    raise ValueError(f"unknown model type: {name}")


def tree_depth(name: str, params: dict) -> int | None:
    """The depth limit that the trees of a model get, None for a model without trees of its own."""
    if name not in ("random_forest", "decision_tree", "gradient_boosting"):
        return None
    depth = params.get("max_depth", 3 if name == "gradient_boosting" else None) or OPEN_DEPTH
    if depth > OPEN_DEPTH:
        raise ValueError(f"max_depth {depth}: trees of more than {OPEN_DEPTH} levels are not grown")
    return depth


@dataclass
class FittedModel:
    """A fitted model with its features, classes and how it was made.

    transform adds prediction (class name as text, or a number) and, for classifiers, probability (an
    array in class order).
    """

    model_type: str
    problem: str
    features: list[str]
    label: str
    classes: list[str] | None
    stage: object
    params: dict = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    model_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def depth(self) -> int | None:
        """The depth limit that was used."""
        return tree_depth(self.model_type, self.params)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stage.apply(df, self)

    def decode(self, index: Column) -> Column:
        names = F.array(*[F.lit(c) for c in self.classes])
        return F.element_at(names, index.cast("int") + 1)


def training_frame(df: DataFrame, features: list[str], label: str, problem: str, keep: list[str] = ()) -> tuple[DataFrame, list[str] | None]:
    """(kept..., _x vector, _y) without rows that have no label, and the sorted class names."""
    rows = df.filter(col(label).isNotNull())
    if problem != CLASSIFICATION:
        return rows.select(*[col(c) for c in keep], as_vector(features, df).alias("_x"), numeric_or_zero(df, label).alias("_y")), None
    names = collect_bounded(rows.select(col(label).cast("string").alias("v")).distinct(), MAX_CLASSES, "classes")
    classes = sorted((r["v"] for r in names), key=_class_order)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label).cast("string")) - 1
    return rows.select(*[col(c) for c in keep], as_vector(features, df).alias("_x"), index.cast("double").alias("_y")), classes


def _class_order(name: str):
    try:
        return (0, float(name), name)
    except ValueError:
        return (1, 0.0, name)


class SparkStage:
    """A pyspark.ml model over the vector column _x."""

    def __init__(self, model, kind: str, sigmoid: tuple[float, float] | None = None):
        self.model, self.kind, self.sigmoid = model, kind, sigmoid

    def apply(self, df: DataFrame, fitted: FittedModel) -> DataFrame:
        scored = self.model.transform(df.withColumn("_x", as_vector(fitted.features, df)))
        if fitted.problem != CLASSIFICATION:
            return scored.select(*[col(c) for c in df.columns], F.col("_p").alias("prediction"))
        if self.kind == "probability":
            probability = vector_to_array("_prob")
        elif self.kind == "margin":
            slope, offset = self.sigmoid
            up = 1 / (1 + F.exp(-(F.lit(slope) * F.element_at(vector_to_array("_raw"), 2) + F.lit(offset))))
            probability = F.array(1 - up, up)
        elif self.kind == "one_class":
            probability = F.array(F.lit(1.0))
        else:
            # One-against-rest margins have no probabilities of their own: squash each and normalise.
            squashed = F.transform(vector_to_array("_raw"), lambda m: 1 / (1 + F.exp(-m)))
            total = F.aggregate(squashed, F.lit(0.0), lambda s, v: s + v)
            probability = F.transform(squashed, lambda v: v / total)
        index = F.lit(0) if self.kind == "one_class" else F.col("_p")
        return scored.select(
            *[col(c) for c in df.columns], fitted.decode(index).alias("prediction"), probability.alias("probability")
        )

    @property
    def importances(self):
        m = self.model
        if hasattr(m, "featureImportances"):
            return m.featureImportances.toArray().tolist()
        if hasattr(m, "models"):
            parts = [SparkStage(x, "").importances for x in m.models]
            return [sum(v) / len(parts) for v in zip(*parts)]
        if hasattr(m, "coefficientMatrix"):
            rows = abs(m.coefficientMatrix.toArray())
            return rows.mean(axis=0).tolist()
        if hasattr(m, "coefficients"):
            return abs(m.coefficients.toArray()).tolist()
        return None


class _NoModel:
    """Stands in for a model when the training rows have a single class."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_p", F.lit(0.0))


def _one_against_rest(classifier):
    from pyspark.ml.classification import OneVsRest

    return OneVsRest(classifier=classifier, featuresCol="_x", labelCol="_y", predictionCol="_p", rawPredictionCol="_raw")


def _spark_estimator(name: str, problem: str, params: dict, n_classes: int, n_rows: int, seed: int):
    """(estimator, output kind, names of ignored parameters)."""
    from pyspark.ml import classification as C, regression as R

    p = dict(params)
    depth = tree_depth(name, p)
    p.pop("max_depth", None)
    classes = problem == CLASSIFICATION
    common = {"featuresCol": "_x", "labelCol": "_y", "predictionCol": "_p"}
    kind = "probability"
    if name == "random_forest":
        subset = p.pop("max_features", "auto") or "all"
        make = C.RandomForestClassifier if classes else R.RandomForestRegressor
        est = make(
            **common,
            numTrees=p.pop("n_estimators", 100),
            maxDepth=depth,
            minInstancesPerNode=p.pop("min_samples_leaf", 1),
            featureSubsetStrategy=str(subset),
            seed=seed,
        )
    elif name == "decision_tree":
        make = C.DecisionTreeClassifier if classes else R.DecisionTreeRegressor
        extra = {"impurity": p.pop("criterion", "gini")} if classes else {}
        est = make(**common, maxDepth=depth, minInstancesPerNode=p.pop("min_samples_leaf", 1), seed=seed, **extra)
    elif name == "gradient_boosting":
        settings = {
            "maxIter": p.pop("n_estimators", 100),
            "stepSize": p.pop("learning_rate", 0.1),
            "maxDepth": depth,
            "subsamplingRate": p.pop("subsample", 1.0),
            "seed": seed,
        }
        if not classes:
            est = R.GBTRegressor(**common, **settings)
        elif n_classes <= 2:
            est = C.GBTClassifier(**common, **settings)
        else:
            base = C.GBTClassifier(**common, **settings).setProbabilityCol("_prob").setRawPredictionCol("_raw")
            est, kind = _one_against_rest(base), "margins"
    elif name == "logistic_regression" and classes:
        est = C.LogisticRegression(
            **common,
            maxIter=p.pop("max_iter", 1000),
            regParam=1.0 / (p.pop("C", 1.0) * max(n_rows, 1)),
            elasticNetParam=1.0 if p.pop("penalty", "l2") == "l1" else 0.0,
            standardization=False,
        )
    elif name in ("linear_regression", "logistic_regression"):
        p.pop("max_iter", None), p.pop("C", None)
        est = R.LinearRegression(**common, solver="normal", regParam=0.0, fitIntercept=p.pop("fit_intercept", True))
        if classes:
            raise ValueError("linear regression does not classify")
    elif name == "svm":
        c = p.pop("C", 1.0)
        if classes:
            est = C.LinearSVC(**common, rawPredictionCol="_raw", regParam=1.0 / (c * max(n_rows, 1)), maxIter=100)
            kind = "margin"
            if n_classes > 2:
                est, kind = _one_against_rest(est), "margins"
        else:
            est = R.LinearRegression(**common, loss="huber", regParam=1.0 / (c * max(n_rows, 1)), maxIter=200)
    else:
        raise ValueError(f"{name} cannot be fitted for {problem}")
    if kind == "probability" and classes:
        est = est.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    return est, kind, sorted(p)


class NeighbourStage:
    """k nearest training rows by the exact neighbour join; the votes are grouped counts."""

    def __init__(self, points: DataFrame, k: int, weights: str):
        self.points, self.k, self.weights = points, k, weights

    def apply(self, df: DataFrame, fitted: FittedModel, exclude_self: bool = False) -> DataFrame:
        if not fitted.keys:
            raise ValueError("k_neighbors needs key columns to predict")
        queries = point_table(df, fitted.keys, fitted.features)
        near = knn_join(queries, self.points, self.k, exclude_self, carry="target")
        exact = F.max((F.col("distance") == 0).cast("int")).over(_per_query())
        weight = F.lit(1.0)
        if self.weights == "distance":
            weight = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        near = near.withColumn("weight", weight)
        if fitted.problem == CLASSIFICATION:
            shares = F.array(
                *[F.sum(F.when(F.col("target") == str(i), F.col("weight")).otherwise(0.0)) for i in range(len(fitted.classes))]
            )
            votes = near.groupBy("id").agg(shares.alias("votes"), F.sum("weight").alias("all"))
            best = F.array_position("votes", F.array_max("votes")) - 1
            answer = votes.select(
                F.col("id").alias("_id"),
                fitted.decode(best).alias("prediction"),
                F.transform("votes", lambda v: v / F.col("all")).alias("probability"),
            )
        else:
            mean = F.sum(F.col("target").cast("double") * F.col("weight")) / F.sum("weight")
            answer = near.groupBy("id").agg(mean.alias("prediction")).withColumnRenamed("id", "_id")
        ident = F.concat_ws("~", *[col(k).cast("string") for k in fitted.keys])
        return df.join(answer, ident == F.col("_id"), "left").drop("_id")

    importances = None


def _per_query():
    from pyspark.sql import Window

    return Window.partitionBy("id")


class VotingStage:
    """Several members scored in one chain: mean probability (soft), most votes (hard), or mean value."""

    def __init__(self, members: list[FittedModel], voting: str):
        self.members, self.voting = members, voting

    def member_columns(self, df: DataFrame) -> DataFrame:
        for i, m in enumerate(self.members):
            scored = m.transform(df)
            df = scored.withColumnRenamed("prediction", f"_pred{i}")
            if m.problem == CLASSIFICATION:
                df = df.withColumnRenamed("probability", f"_prob{i}")
        return df

    def apply(self, df: DataFrame, fitted: FittedModel) -> DataFrame:
        chain = self.member_columns(df)
        count = len(self.members)
        kept = [col(c) for c in df.columns]
        if fitted.problem != CLASSIFICATION:
            return chain.select(*kept, (sum(F.col(f"_pred{i}") for i in range(count)) / count).alias("prediction"))
        if self.voting == "soft":
            probability = mean_arrays([F.col(f"_prob{i}") for i in range(count)])
        else:
            votes = F.array(*[F.col(f"_pred{i}") for i in range(count)])
            probability = F.array(*[vote_share(votes, c, count) for c in fitted.classes])
        chain = chain.select(*kept, probability.alias("probability"))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return chain.select(*kept, fitted.decode(best).alias("prediction"), "probability")

    @property
    def importances(self):
        parts = [m.stage.importances for m in self.members if m.stage.importances]
        return [sum(v) / len(parts) for v in zip(*parts)] if parts else None


def vote_share(votes: Column, name: str, count: int) -> Column:
    return F.size(F.filter(votes, lambda v: v == name)) / F.lit(float(count))


def mean_arrays(arrays: list[Column]) -> Column:
    """Element-wise mean of equally long arrays."""
    total = arrays[0]
    for other in arrays[1:]:
        total = F.zip_with(total, other, lambda a, b: a + b)
    return F.transform(total, lambda v: v / len(arrays))


class StackingStage:
    """A meta-model over the members' outputs."""

    def __init__(self, base: VotingStage, meta: FittedModel):
        self.base, self.meta = base, meta

    @staticmethod
    def meta_columns(chain: DataFrame, members: list[FittedModel]) -> tuple[DataFrame, list[str]]:
        names = {}
        for i, m in enumerate(members):
            if m.problem == CLASSIFICATION:
                first = 1 if len(m.classes) == 2 else 0
                for c in range(first, len(m.classes)):
                    names[f"_m{i}_{c}"] = F.element_at(F.col(f"_prob{i}"), c + 1)
            else:
                names[f"_m{i}"] = F.col(f"_pred{i}")
        return chain.withColumns(names), list(names)

    def apply(self, df: DataFrame, fitted: FittedModel) -> DataFrame:
        chain, _ = self.meta_columns(self.base.member_columns(df), self.base.members)
        scored = self.meta.transform(chain)
        extra = ["probability"] if fitted.problem == CLASSIFICATION else []
        return scored.select(*[col(c) for c in df.columns], "prediction", *extra)

    @property
    def importances(self):
        return self.base.importances


def guess_problem(df: DataFrame, label: str) -> str:
    from tablekit.operators.select import is_class_label

    return CLASSIFICATION if is_class_label(df, label) else REGRESSION


def fit(
    df: DataFrame,
    label: str,
    model_type: str = "random_forest",
    problem: str | None = None,
    features: list[str] | None = None,
    params: dict | None = None,
    keys: list[str] = (),
    seed: int = 42,
) -> FittedModel:
    """Fit one model on every row of df that has a label."""
    name = canonical(model_type)
    problem = problem or guess_problem(df, label)
    features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
    params = dict(params or {})
    made = dict(problem=problem, features=features, label=label, params=params, keys=list(keys))
    if name in ("voting", "stacking"):
        return _fit_ensemble(df, name, label, problem, features, params, keys, seed)
    if name == "k_neighbors":
        rows = df.filter(col(label).isNotNull())
        frame, classes = training_frame(df, features, label, problem) if problem == CLASSIFICATION else (None, None)
        if problem == CLASSIFICATION:
            index = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label).cast("string")) - 1
            target = index.cast("string")
        else:
            target = numeric_or_zero(df, label).cast("string")
        points = point_table(rows, list(keys), features, {"target": target}).persist()
        stage = NeighbourStage(points, params.get("n_neighbors", 5), params.get("weights", "uniform"))
        ignored = sorted(set(params) - {"n_neighbors", "weights"})
        return FittedModel(name, classes=classes, stage=stage, ignored=ignored, **made)
    frame, classes = training_frame(df, features, label, problem)
    if classes is not None and len(classes) < 2:
        return FittedModel(name, classes=classes, stage=SparkStage(_NoModel(), "one_class"), **made)
    frame = frame.persist()
    try:
        rows = frame.count() if name in ("logistic_regression", "svm") else 0
        estimator, kind, ignored = _spark_estimator(name, problem, params, len(classes or []), rows, seed)
        model = estimator.fit(frame)
        sigmoid = _margin_sigmoid(model, frame) if kind == "margin" else None
    finally:
        frame.unpersist()
    return FittedModel(name, classes=classes, stage=SparkStage(model, kind, sigmoid), ignored=ignored, **made)


def _margin_sigmoid(model, frame: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the label on the margin."""
    from pyspark.ml.classification import LogisticRegression

    margins = model.transform(frame).select(
        array_to_vector(F.array(F.element_at(vector_to_array("_raw"), 2))).alias("m"), "_y"
    )
    fitted = LogisticRegression(featuresCol="m", labelCol="_y", maxIter=50).fit(margins)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def _members(problem: str, params: dict) -> list[tuple[str, dict]]:
    linear = "logistic_regression" if problem == CLASSIFICATION else "linear_regression"
    given = params.get("members", {})
    return [(m, given.get(m, {})) for m in ("random_forest", "gradient_boosting", linear)]


def _fit_ensemble(df, name, label, problem, features, params, keys, seed) -> FittedModel:
    from tablekit.operators.sample import kfold

    def fit_members(rows):
        return [fit(rows, label, m, problem, features, p, keys, seed) for m, p in _members(problem, params)]

    if name == "voting":
        members = fit_members(df)
        stage = VotingStage(members, params.get("voting", "soft"))
        return FittedModel("voting", problem, features, label, members[0].classes, stage, params, keys=list(keys))
    if not keys:
        raise ValueError("stacking needs key columns for its folds")
    folds = params.get("folds", 5)
    needed = list(dict.fromkeys([*keys, label, *features]))
    folded = kfold(df.filter(col(label).isNotNull()).select(*[col(c) for c in needed]), list(keys), folds, seed).persist()
    parts, names = None, []
    for f in range(folds):
        members = fit_members(folded.filter(F.col("fold") != f))
        held, names = StackingStage.meta_columns(
            VotingStage(members, "soft").member_columns(folded.filter(F.col("fold") == f)), members
        )
        held = held.select(col(label), *[F.col(c) for c in names])
        parts = held if parts is None else parts.unionByName(held)
    linear = "logistic_regression" if problem == CLASSIFICATION else "linear_regression"
    meta = fit(parts, label, linear, problem, names, params.get("meta", {}), (), seed)
    final = fit_members(folded)
    folded.unpersist()
    stage = StackingStage(VotingStage(final, "soft"), meta)
    return FittedModel("stacking", problem, features, label, meta.classes, stage, params, keys=list(keys))


def importances(spark, model: FittedModel) -> DataFrame:
    """(feature, importance): tree importances, or mean absolute coefficients over the classes."""
    values = model.stage.importances
    rows = sorted(zip(model.features, values), key=lambda r: (-r[1], r[0])) if values else []
    return local_table(spark, [(f, float(v)) for f, v in rows], "feature string, importance double")


@dataclass
class TrainResult:
    model: FittedModel
    metrics: DataFrame
    cv: DataFrame | None
    seconds: float


def train(
    df: DataFrame,
    label: str,
    model_type: str = "random_forest",
    problem: str | None = None,
    features: list[str] | None = None,
    params: dict | None = None,
    keys: list[str] = (),
    cv_method: str | None = None,
    cv_folds: int = 5,
    order_by: str | None = None,
    seed: int = 42,
) -> TrainResult:
    """Fit on split = 'train', measure on split = 'test', optionally cross-validate on the training rows."""
    from tablekit.operators.evaluate import cross_validate, evaluate

    start = time.time()
    features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
    training = df.filter(F.col("split") == "train")
    model = fit(training, label, model_type, problem, features, params, keys, seed)
    metrics = evaluate(model, df.filter(F.col("split") == "test"))
    cv = None
    if cv_method:
        cv = cross_validate(training, label, model_type, model.problem, features, params, keys, cv_method, cv_folds, order_by, seed)
    return TrainResult(model, metrics, cv, time.time() - start)
