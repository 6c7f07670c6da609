"""Hyper-parameter search: every candidate is a Spark cross-validation on one persisted, folded table.

Candidates that differ only in a nested parameter share their fits: the first trees of a forest or of a boosted ensemble are
a forest or ensemble of that size, and a tree cut at a depth is the tree grown to it. One fit per fold then scores all of
them in one pass over the fold's test rows. Classifying trees on few features are fitted on counted cells (operators/cells.py):
the rows of a fold are read for the split points and the counts, whatever the number of candidates.
"""

from __future__ import annotations

import itertools
import json
import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions import trees
from tablekit.functions.columns import col, local_table, numeric_columns, numeric_or_zero
from tablekit.operators import cells, models
from tablekit.operators.evaluate import assign_folds, fold_pairs, run_parallel
from tablekit.operators.models import canonical

#: Values tried by the grid search (fixed values).
GRIDS = {
    "random_forest": {
        "n_estimators": [50, 100, 200],
        "max_depth": [None, 10, 20],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
    },
    "gradient_boosting": {
        "n_estimators": [50, 100, 200],
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [3, 5, 7],
        "subsample": [0.8, 0.9, 1.0],
    },
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "solver": ["lbfgs", "liblinear"], "max_iter": [100, 500, 1000]},
    "linear_regression": {"fit_intercept": [True, False]},
    "decision_tree": {"max_depth": [None, 10, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "k_neighbors": {"n_neighbors": [3, 5, 7, 9], "weights": ["uniform", "distance"]},
    "svm": {"C": [0.1, 1.0, 10.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]},
}

#: Values drawn by the random search and bounding the Bayesian one (fixed values).
SPACES = {
    "random_forest": {
        "n_estimators": [50, 100, 150, 200, 250, 300],
        "max_depth": [None, 5, 10, 15, 20, 25],
        "min_samples_split": [2, 3, 5, 7, 10],
        "min_samples_leaf": [1, 2, 3, 4, 5],
        "max_features": ["sqrt", "log2", None],
    },
    "gradient_boosting": {
        "n_estimators": [50, 100, 150, 200, 250, 300],
        "learning_rate": [0.01, 0.05, 0.1, 0.15, 0.2, 0.25],
        "max_depth": [3, 5, 7, 9, 11],
        "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    },
    "logistic_regression": {
        "C": [0.01, 0.1, 1.0, 10.0, 100.0],
        "solver": ["lbfgs", "liblinear", "saga"],
        "max_iter": [100, 200, 500, 1000],
        "penalty": ["l2", "l1"],
    },
    "decision_tree": {
        "max_depth": [None, 5, 10, 15, 20, 25],
        "min_samples_split": [2, 3, 5, 7, 10],
        "min_samples_leaf": [1, 2, 3, 4, 5],
        "criterion": ["gini", "entropy"],
    },
    "k_neighbors": {
        "n_neighbors": [3, 5, 7, 9, 11, 15],
        "weights": ["uniform", "distance"],
        "algorithm": ["auto", "ball_tree", "kd_tree"],
    },
    "svm": {"C": [0.1, 1.0, 10.0, 100.0], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto"], "degree": [2, 3, 4]},
}

#: Parameters without a Spark counterpart: accepted, reported as ignored, and not searched twice.
WITHOUT_EFFECT = {"min_samples_split", "solver", "gamma", "kernel", "degree", "algorithm"}

#: Parameters whose smaller values are part of a fit with the largest one.
NESTED = {"random_forest": "n_estimators", "gradient_boosting": "n_estimators", "decision_tree": "max_depth"}
_NESTED_DEFAULT = {"n_estimators": 100, "max_depth": None}

SCHEMA = "rank int, params string, ignored string, mean_score double, std_score double, seconds double"


# -- scoring ----------------------------------------------------------------------------------------


def _class_scores(pairs: dict[tuple[str, str], float], scoring: str) -> float:
    """A score from counts of (actual, predicted)."""
    total = sum(pairs.values())
    if not total:
        return 0.0
    if scoring == "accuracy":
        return sum(n for (a, p), n in pairs.items() if a == p) / total
    names = sorted({c for pair in pairs for c in pair}, key=models._class_order)
    support = {c: sum(n for (a, _), n in pairs.items() if a == c) for c in names}
    guessed = {c: sum(n for (_, p), n in pairs.items() if p == c) for c in names}
    hit = {c: pairs.get((c, c), 0.0) for c in names}
    recall = {c: hit[c] / support[c] if support[c] else 0.0 for c in names}
    precision = {c: hit[c] / guessed[c] if guessed[c] else 0.0 for c in names}
    f1 = {c: 2 * hit[c] / (support[c] + guessed[c]) if support[c] + guessed[c] else 0.0 for c in names}
    if scoring == "balanced_accuracy":
        present = [c for c in names if support[c]]
        return sum(recall[c] for c in present) / len(present)
    values = {"precision": precision, "recall": recall, "f1": f1}[scoring.split("_")[0]]
    kind = scoring.partition("_")[2]
    if kind == "weighted":
        return sum(values[c] * support[c] for c in names) / total
    if kind == "macro":
        return sum(values.values()) / len(names)
    if len(names) > 2:
        raise ValueError(f"{scoring} is for two classes; use {scoring}_macro or {scoring}_weighted")
    return values[names[-1]]


CLASS_SCORING = ("accuracy", "balanced_accuracy", *(f"{m}{k}" for m in ("precision", "recall", "f1") for k in ("", "_macro", "_weighted")))
VALUE_SCORING = ("r2", "neg_mean_squared_error", "neg_root_mean_squared_error", "neg_mean_absolute_error")


def _value_score(n: float, squares: float, sizes: float, spread: float, scoring: str) -> float:
    """A score from the sums of squared and absolute errors and of squared deviations of the label."""
    if not n:
        return 0.0
    if scoring == "r2":
        return 1 - squares / spread if spread else 0.0
    return -{"neg_mean_squared_error": squares / n, "neg_root_mean_squared_error": (squares / n) ** 0.5, "neg_mean_absolute_error": sizes / n}[scoring]


def _whole_score(model, rows: DataFrame, scoring: str, weight: str | None = None) -> float:
    """Score of a fitted model on rows; weight: the column of how many rows a row of a classified table stands for."""
    scored = model.transform(rows)
    if model.problem == models.CLASSIFICATION:
        n = F.sum(weight) if weight else F.count("*")
        counts = scored.groupBy(col(model.label).cast("string").alias("a"), F.col("prediction").alias("p")).agg(n.alias("n"))
        return _class_scores({(r["a"], r["p"]): r["n"] for r in counts.collect()}, scoring)
    y = numeric_or_zero(scored, model.label)
    e = y - F.col("prediction")
    r = scored.agg(F.count("*").alias("n"), F.sum(e * e).alias("s"), F.sum(F.abs(e)).alias("a"), (F.var_pop(y) * F.count("*")).alias("v")).first()
    return _value_score(r["n"], r["s"] or 0.0, r["a"] or 0.0, r["v"] or 0.0, scoring)


def nested_scores(model, rows: DataFrame, name: str, values: list, scoring: str, weight: str | None = None) -> list[float]:
    """Scores on rows of the models that the values of a nested parameter stand for, from one fitted with the largest: one
    pass over the rows, which returns counts or sums. weight: as for _whole_score."""
    parts = trees.tree_parts(rows.sparkSession, model)
    classes = model.classes
    label = col(model.label).cast("string") if classes is not None else numeric_or_zero(rows, model.label)
    names = [f"x{i}" for i in range(len(model.features))]
    table = rows.select(*[numeric_or_zero(rows, c).alias(x) for x, c in zip(names, model.features)], label.alias("y"), (col(weight) if weight else F.lit(1)).cast("long").alias("n"))

    def variants(x: np.ndarray) -> list[np.ndarray]:
        """Per value the predicted class number, or the predicted value."""
        if name == "max_depth":
            by_part = [[p.outputs(x, None, models.OPEN_DEPTH if v is None else v)[0] for v in values] for p in parts]
        else:
            by_part = [p.outputs(x, list(values)) for p in parts]
        out = []
        for k in range(len(values)):
            own = [b[k] for b in by_part]
            if classes is None:
                out.append(own[0][:, 0])
            elif len(own) > 1:
                out.append(np.column_stack([o[:, 0] for o in own]).argmax(axis=1))
            else:
                out.append(own[0].argmax(axis=1) if own[0].shape[1] > 1 else (own[0][:, 0] > 0).astype(int))
        return out

    def tally(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = variants(batch[names].to_numpy(float))
            if classes is not None:
                parts_ = [pd.DataFrame({"k": k, "a": batch["y"].to_numpy(), "p": np.array(classes, object)[f], "n": batch["n"].to_numpy()}) for k, f in enumerate(found)]
                yield pd.concat(parts_).groupby(["k", "a", "p"])["n"].sum().reset_index()
            else:
                errors = [batch["y"].to_numpy() - f for f in found]
                yield pd.DataFrame({"k": range(len(found)), "n": float(len(batch)), "s": [float((e * e).sum()) for e in errors], "b": [float(np.abs(e).sum()) for e in errors]})

    if classes is not None:
        counts = table.mapInPandas(tally, "k int, a string, p string, n long").groupBy("k", "a", "p").agg(F.sum("n").alias("n")).collect()
        return [_class_scores({(r["a"], r["p"]): r["n"] for r in counts if r["k"] == k}, scoring) for k in range(len(values))]
    sums = {r["k"]: r for r in table.mapInPandas(tally, "k int, n double, s double, b double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "nsb"]).collect()}
    spread = table.agg((F.var_pop("y") * F.count("*")).alias("v")).first()["v"] or 0.0
    return [_value_score(sums[k]["n"], sums[k]["s"], sums[k]["b"], spread, scoring) if k in sums else 0.0 for k in range(len(values))]


class _Trials:
    """Scores candidates on one folded table; equal effective parameters count once, nested ones share their fits."""

    def __init__(self, df, label, model_type, problem, features, keys, folds, method, seed, parallelism, scoring=None):
        self.label, self.model = label, canonical(model_type)
        self.problem = problem or models.guess_problem(df, label)
        self.features = features or numeric_columns(df, exclude=(label, *keys, "fold"))
        self.keys, self.seed, self.parallelism = list(keys), seed, parallelism
        offered = CLASS_SCORING if self.problem == models.CLASSIFICATION else VALUE_SCORING
        self.scoring = scoring or offered[0]
        if self.scoring not in offered:
            raise ValueError(f"unknown scoring: {scoring}; one of {', '.join(offered)}")
        needed = list(dict.fromkeys([*keys, label, *self.features]))
        self.rows = df.filter(col(label).isNotNull()).select(*[col(c) for c in needed])
        self.folded = assign_folds(self.rows, self.keys, label, method, folds, None, seed).persist()
        self.pairs = fold_pairs(self.folded)
        self.done: dict[str, tuple[float, float, float]] = {}
        self.fits = 0

    def effective(self, params: dict) -> dict:
        return {k: v for k, v in params.items() if k not in WITHOUT_EFFECT}

    def groups(self, new: list[dict]) -> list[tuple[dict, str | None, list]]:
        """(shared parameters, nested parameter, its values in ascending order) of candidates that one fit serves."""
        name = NESTED.get(self.model)
        if name is None:
            return [(p, None, []) for p in new]
        size = lambda v: math.inf if v is None else v
        found: dict[str, tuple[dict, list]] = {}
        for p in new:
            rest = {k: v for k, v in p.items() if k != name}
            own = found.setdefault(json.dumps(rest, sort_keys=True), (rest, []))[1]
            value = p.get(name, _NESTED_DEFAULT[name])
            if value not in own:
                own.append(value)
        return [(rest, name, sorted(values, key=size)) for rest, values in found.values()]

    def counted(self, fits: int) -> list[cells.Counted | None]:
        """Per fold its cells, None where the fits read its rows: other models, many features, few fits or rows, split points
        that cannot be told, a single class."""
        none = [None] * len(self.pairs)
        # Split points of a feature take about as long as a fit on rows.
        few = len(self.features) <= cells.FEATURES and 2 * len(self.features) < fits
        if self.model != "decision_tree" or self.problem != models.CLASSIFICATION or not few:
            return none

        def points(rows, feature):
            return lambda: cells.split_points(rows, feature, self.seed)

        n = self.folded.count()
        if n < cells.LEAST_ROWS:
            return none
        at_once = max(1, min(self.parallelism, cells.ROWS_AT_ONCE // max(n, 1)))
        found = iter(run_parallel([points(a, c) for a, _ in self.pairs for c in self.features], at_once))
        out = []
        for a, b in self.pairs:
            own = [next(found) for _ in self.features]
            out.append(None if None in own else cells.count_cells(a, b, self.label, self.features, own, self.seed))
        return out

    def run(self, candidates: list[dict]) -> list[tuple[float, float, float]]:
        """(mean, std, seconds) per candidate; all fits of the new ones share the driver threads. Seconds of a shared fit are
        divided among its candidates."""
        new = {n: self.effective(c) for c in candidates if (n := self._key(c)) not in self.done}
        groups = self.groups(list(new.values()))
        counted = self.counted(len(groups))

        def job(rest, name, values, fold):
            def run():
                start = time.time()
                params = rest if name is None else {**rest, name: values[-1]}
                own, (train_rows, test_rows), weight = counted[fold], self.pairs[fold], None
                if own is not None:
                    model, test_rows, weight = own.fit(params), own.test, "_n"
                else:
                    model = models.fit(train_rows, self.label, self.model, self.problem, self.features, params, self.keys, self.seed)
                if len(values) > 1 and trees.has_trees(model):
                    scores = nested_scores(model, test_rows, name, values, self.scoring, weight)
                else:
                    scores = [_whole_score(model, test_rows, self.scoring, weight)] * max(len(values), 1)
                return scores, (time.time() - start) / len(scores)

            return run

        self.fits += len(groups) * len(self.pairs)
        results = run_parallel([job(*g, i) for g in groups for i in range(len(self.pairs))], self.parallelism)
        for own in counted:
            if own is not None:
                own.close()
        for i, (rest, name, values) in enumerate(groups):
            mine = results[i * len(self.pairs) : (i + 1) * len(self.pairs)]
            for k, value in enumerate(values or [None]):
                scores = np.array([s[k] for s, _ in mine])
                params = rest if name is None else {**rest, name: value}
                self.done[json.dumps(params, sort_keys=True)] = (float(scores.mean()), float(scores.std()), float(sum(t for _, t in mine)))
        return [self.done[self._key(c)] for c in candidates]

    def _key(self, candidate: dict) -> str:
        params, name = self.effective(candidate), NESTED.get(self.model)
        if name is not None:
            params = {**params, name: params.get(name, _NESTED_DEFAULT[name])}
        return json.dumps(params, sort_keys=True)

    def best(self, candidates: list[dict], scores) -> models.FittedModel:
        """The first of the best candidates, fitted on all rows that have a label."""
        first = max(range(len(candidates)), key=lambda i: scores[i][0])
        return models.fit(self.rows, self.label, self.model, self.problem, self.features, self.effective(candidates[first]), self.keys, self.seed)

    def table(self, spark, candidates: list[dict], scores) -> DataFrame:
        """Equal scores share a rank."""
        order = sorted(range(len(candidates)), key=lambda i: (-scores[i][0], i))
        rows, rank = [], 0
        for place, i in enumerate(order, 1):
            if place == 1 or scores[i][0] < scores[order[place - 2]][0]:
                rank = place
            unused = sorted(set(candidates[i]) & WITHOUT_EFFECT)
            rows.append((rank, json.dumps(candidates[i], sort_keys=True), ", ".join(unused), *scores[i]))
        return local_table(spark, rows, SCHEMA)

    def close(self):
        self.folded.unpersist()


def grid_search(
    df: DataFrame, label: str, model_type: str, problem: str | None = None, features: list[str] | None = None,
    keys: list[str] = (), folds: int = 5, grid: dict[str, list] | None = None, method: str = "kfold", seed: int = 42, parallelism: int = 4,
    scoring: str | None = None,
) -> tuple[DataFrame, models.FittedModel]:
    """(trials, best model): every combination of the grid, ranked by mean fold score, and the first of the best ones fitted
    on all rows. scoring: one of CLASS_SCORING (accuracy) or VALUE_SCORING (r2)."""
    grid = grid or GRIDS[canonical(model_type)]
    candidates = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return _search(df, label, model_type, problem, features, keys, folds, method, seed, parallelism, candidates, scoring)


def random_search(
    df: DataFrame, label: str, model_type: str, problem: str | None = None, features: list[str] | None = None,
    keys: list[str] = (), folds: int = 5, n_iter: int = 50, space: dict[str, list] | None = None, method: str = "kfold", seed: int = 42,
    parallelism: int = 4, scoring: str | None = None,
) -> tuple[DataFrame, models.FittedModel]:
    """(trials, best model) of n_iter different draws from the space (all of it when it is smaller)."""
    space = space or SPACES.get(canonical(model_type)) or GRIDS[canonical(model_type)]
    sizes = [len(v) for v in space.values()]
    total = math.prod(sizes)
    picks = np.random.default_rng(seed).choice(total, size=min(n_iter, total), replace=False)
    places = np.array(np.unravel_index(picks, sizes)).T
    candidates = [{name: values[i] for (name, values), i in zip(space.items(), row)} for row in places]
    return _search(df, label, model_type, problem, features, keys, folds, method, seed, parallelism, candidates, scoring)


def _search(df, label, model_type, problem, features, keys, folds, method, seed, parallelism, candidates, scoring):
    trials = _Trials(df, label, model_type, problem, features, keys, folds, method, seed, parallelism, scoring)
    scores = trials.run(candidates)
    trials.close()
    return trials.table(df.sparkSession, candidates, scores), trials.best(candidates, scores)


# -- Bayesian ---------------------------------------------------------------------------------------


class _Proposer:
    """Small Parzen-estimator sampler: new points are drawn near good trials and away from bad ones."""

    def __init__(self, space: dict[str, list], seed: int):
        self.space, self.rng = space, np.random.default_rng(seed)

    def numeric(self, name: str) -> bool:
        return all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in self.space[name])

    def draw(self, name: str, good: list, bad: list):
        values = self.space[name]
        if not self.numeric(name):
            weight = np.array([1.0 + good.count(v) for v in values]) / np.array([1.0 + bad.count(v) for v in values])
            return values[int(self.rng.choice(len(values), p=weight / weight.sum()))]
        low, high = min(values), max(values)
        whole = all(isinstance(v, int) for v in values)
        if not good:
            x = self.rng.uniform(low, high)
        else:
            width = max((high - low) / (1 + len(good)) ** 0.5, 1e-12)
            options = np.clip(self.rng.choice(good, size=24) + self.rng.normal(0, width, size=24), low, high)
            x = options[int(np.argmax(self._density(options, good, width) / (self._density(options, bad, width) + 1e-12)))]
        return int(round(x)) if whole else float(x)

    @staticmethod
    def _density(x, centres, width):
        if not centres:
            return np.ones_like(x)
        return np.exp(-0.5 * ((x[:, None] - np.array(centres)[None, :]) / width) ** 2).mean(axis=1)

    def propose(self, trials: list[tuple[dict, float]], count: int) -> list[dict]:
        ranked = sorted(trials, key=lambda t: -t[1])
        split = max(1, len(ranked) // 4) if len(ranked) >= 8 else 0
        good, bad = [t[0] for t in ranked[:split]], [t[0] for t in ranked[split:]] if split else []
        return [
            {n: self.draw(n, [g[n] for g in good], [b[n] for b in bad]) for n in self.space} for _ in range(count)
        ]


def bayesian_search(
    df: DataFrame, label: str, model_type: str, problem: str | None = None, features: list[str] | None = None,
    keys: list[str] = (), folds: int = 5, n_trials: int = 50, timeout: float | None = None, space: dict[str, list] | None = None,
    seed: int = 42, parallelism: int = 4, batch: int = 4, scoring: str | None = None,
) -> tuple[DataFrame, models.FittedModel]:
    """(trials, refitted best model). Runs n_trials, or fewer where a timeout in seconds is given and passes;
    classification folds are stratified and shrink to the smallest class."""
    space = space or SPACES.get(canonical(model_type)) or GRIDS[canonical(model_type)]
    space = {k: v for k, v in space.items() if k not in WITHOUT_EFFECT}
    problem = problem or models.guess_problem(df, label)
    method = "stratified" if problem == models.CLASSIFICATION else "kfold"
    trials = _Trials(df, label, model_type, problem, features, keys, folds, method, seed, parallelism, scoring)
    proposer, start = _Proposer(space, seed), time.time()
    candidates, scores = [], []
    while len(candidates) < n_trials and (not candidates or timeout is None or time.time() - start < timeout):
        wave = proposer.propose([(c, s[0]) for c, s in zip(candidates, scores)], min(batch, n_trials - len(candidates)))
        scores += trials.run(wave)
        candidates += wave
    trials.close()
    return trials.table(df.sparkSession, candidates, scores), trials.best(candidates, scores)
