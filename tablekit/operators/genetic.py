"""Genetic search for a feature subset.

Masks evolve on the driver (population x d bits). The data is read once: per-fold cross products give
the ridge coefficients of every mask. Regression fitness needs nothing else; classification fitness
takes one pass per generation that scores all masks together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import col, numeric_columns, numeric_or_zero
from tablekit.functions.grams import gram
from tablekit.functions.session import collect_bounded
from tablekit.operators.sample import kfold, kfold_stratified
from tablekit.operators.select import Selection, is_class_label

#: Search constants (fixed values).
TOURNAMENT = 3
ELITE = 2
MIN_POPULATION = 6
MIN_GENERATIONS = 6
DENSITY = (0.15, 0.45)
MUTATION_BOUNDS = (0.02, 0.25)
OVERSIZE_PENALTY = 0.15
EMPTY_FITNESS = -1e5
RIDGE = 1.0
MAX_CLASSES = 1_000


class _Folds:
    """Cross products of (1, features, targets) per fold, and what can be computed from them."""

    def __init__(self, df: DataFrame, keys, features, label, classes: bool, seed: int):
        self.features = features
        rows = df.filter(col(label).isNotNull())
        n = rows.count()
        k = 3 if n >= 15 else 2
        if classes:
            values = collect_bounded(
                rows.select(col(label).cast("string").alias("v")).distinct().orderBy("v"), MAX_CLASSES, "classes"
            )
            self.classes = [r["v"] for r in values]
            folded = kfold_stratified(rows, keys, label, k, seed)
            targets = {f"_t{i}": (col(label).cast("string") == v).cast("double") for i, v in enumerate(self.classes)}
        else:
            self.classes = None
            folded = kfold(rows, keys, k, seed)
            targets = {"_t0": numeric_or_zero(rows, label)}
        self.targets = list(targets)
        data = folded.withColumns({c: numeric_or_zero(rows, c) for c in features} | targets | {"_one": F.lit(1.0)})
        self.data = data.select("fold", "_one", *[col(c) for c in features], *self.targets).persist()
        self.grams = gram(self.data, ["_one", *features, *self.targets], "fold")
        self.total = sum(self.grams.values())

    def variances(self) -> np.ndarray:
        n = self.total[0, 0]
        d = len(self.features)
        mean = self.total[0, 1 : d + 1] / n
        return np.diag(self.total)[1 : d + 1] / n - mean**2

    def coefficients(self, mask: np.ndarray, fold: int) -> np.ndarray:
        """(1 + d) x targets ridge coefficients fitted outside the fold; zero where the mask is 0."""
        g = self.total - self.grams[fold]
        d = len(self.features)
        on = np.concatenate([[0], 1 + np.flatnonzero(mask)])
        a = g[np.ix_(on, on)] + np.diag([0.0] + [RIDGE] * (len(on) - 1))
        beta = np.zeros((1 + d, len(self.targets)))
        beta[on] = np.linalg.lstsq(a, g[np.ix_(on, range(1 + d, g.shape[0]))], rcond=None)[0]
        return beta

    def r2(self, mask: np.ndarray) -> float:
        scores = []
        d = len(self.features)
        for fold, g in self.grams.items():
            b = self.coefficients(mask, fold)[:, 0]
            xx, xy, yy, y1, n = g[: d + 1, : d + 1], g[: d + 1, d + 1], g[d + 1, d + 1], g[0, d + 1], g[0, 0]
            residual = yy - 2 * b @ xy + b @ xx @ b
            spread = yy - y1 * y1 / n
            scores.append(1 - residual / spread if spread > 0 else 0.0)
        return float(np.mean(scores))

    def accuracies(self, masks: list[np.ndarray]) -> list[float]:
        """Mean fold accuracy of every mask from one pass over the data."""
        folds = sorted(self.grams)
        betas = {f: np.stack([self.coefficients(m, f) for m in masks]) for f in folds}
        shared = self.data.sparkSession.sparkContext.broadcast(betas)
        d, count = len(self.features), len(masks)

        def hits(batches):
            totals = {}
            for batch in batches:
                fold = batch["fold"].to_numpy()
                values = batch.iloc[:, 1:].to_numpy(dtype=float)
                for f in np.unique(fold):
                    part = values[fold == f]
                    truth = part[:, d + 1 :].argmax(axis=1)
                    guess = np.einsum("nd,mdt->mnt", part[:, : d + 1], shared.value[f]).argmax(axis=2)
                    totals[f] = totals.get(f, 0) + (guess == truth).sum(axis=1)
            for f, t in totals.items():
                yield pd.DataFrame({"fold": np.full(count, f), "mask": np.arange(count), "hits": t})

        found = (
            self.data.mapInPandas(hits, "fold int, mask int, hits bigint").groupBy("fold", "mask").agg(F.sum("hits").alias("h"))
        ).collect()
        shares = np.zeros((len(folds), count))
        for r in found:
            shares[folds.index(r["fold"]), r["mask"]] = r["h"] / self.grams[r["fold"]][0, 0]
        shared.unpersist()
        return shares.mean(axis=0).tolist()

    def scores(self, masks):
        if self.classes is None:
            return [self.r2(m) for m in masks]
        return self.accuracies(masks)


def select_genetic(
    df: DataFrame,
    keys: list[str],
    label: str,
    features: list[str] | None = None,
    population: int = 30,
    generations: int = 20,
    crossover_rate: float = 0.8,
    mutation_rate: float | None = None,
    max_features: int | None = None,
    parsimony: float = 0.1,
    early_stopping: int = 5,
    seed: int = 42,
) -> Selection:
    """Best subset by (1 - w) * cv_score + w * (1 - k / d) - 0.15 * (k - max) / d when k is over max."""
    names = features or numeric_columns(df, exclude=(label, *keys))
    d = len(names)
    if d <= 1:
        return Selection("genetic", names, names, best_fitness=1.0)
    population, generations = max(MIN_POPULATION, population), max(1, generations)
    weight = float(np.clip(parsimony, 0.0, 0.5))
    mutate = float(np.clip(1.0 / d, *MUTATION_BOUNDS)) if mutation_rate is None else mutation_rate
    rng = np.random.default_rng(seed)
    folds = _Folds(df, keys, names, label, is_class_label(df, label), seed)
    known: dict[bytes, float] = {}

    def fitness(masks):
        new = {m.tobytes(): m for m in masks if m.any() and m.tobytes() not in known}
        if new:
            known.update(zip(new, folds.scores(list(new.values()))))
        result = []
        for m in masks:
            size = int(m.sum())
            if size == 0:
                result.append(EMPTY_FITNESS)
                continue
            over = max(0, size - max_features) if max_features else 0
            result.append((1 - weight) * known[m.tobytes()] + weight * (1 - size / d) - OVERSIZE_PENALTY * over / d)
        return np.array(result)

    pool = _first_population(rng, population, d, folds.variances(), max_features)
    best, best_fitness, flat, history = pool[0], -np.inf, 0, []
    for generation in range(1, generations + 1):
        scores = fitness(pool)
        leader = int(scores.argmax())
        if scores[leader] > best_fitness:
            best, best_fitness, flat = pool[leader].copy(), float(scores[leader]), 0
        else:
            flat += 1
        history.append(
            {
                "generation": generation,
                "best_fitness": round(best_fitness, 4),
                "generation_best": round(float(scores[leader]), 4),
                "n_features": int(best.sum()),
            }
        )
        if flat >= early_stopping and generation >= MIN_GENERATIONS:
            break
        pool = _next_population(rng, pool, scores, crossover_rate, mutate)
    folds.data.unpersist()
    kept = [c for c, on in zip(names, best) if on]
    return Selection("genetic", names, kept, {c: float(on) for c, on in zip(names, best)}, history, best_fitness)


def _repair(rng, masks: np.ndarray) -> np.ndarray:
    empty = masks.sum(axis=1) == 0
    masks[empty, rng.integers(masks.shape[1], size=int(empty.sum()))] = 1
    return masks


def _first_population(rng, size: int, d: int, variances: np.ndarray, max_features: int | None) -> np.ndarray:
    """70 % random densities, 20 % the widest features plus noise bits, the rest two-feature seeds."""
    random, guided = int(size * 0.7), int(size * 0.2)
    density = rng.uniform(*DENSITY, size=(random, 1))
    masks = [(rng.random((random, d)) < density).astype(np.int8)]
    widest = np.argsort(-variances)[: min(max_features or max(3, d // 3), d)]
    lead = (rng.random((guided, d)) < 0.1).astype(np.int8)
    lead[:, widest] = 1
    masks.append(lead)
    seeds = np.zeros((size - random - guided, d), dtype=np.int8)
    for m in seeds:
        m[rng.choice(d, size=min(2, d), replace=False)] = 1
    masks.append(seeds)
    return _repair(rng, np.concatenate(masks))


def _next_population(rng, pool: np.ndarray, scores: np.ndarray, crossover: float, mutate: float) -> np.ndarray:
    """Elite of two; children by tournament, uniform crossover and bit flips, drawn for all at once."""
    size, d = pool.shape
    children = size - ELITE
    entrants = rng.integers(size, size=(2, children, TOURNAMENT))
    winners = np.take_along_axis(entrants, scores[entrants].argmax(axis=2)[..., None], axis=2)[..., 0]
    first, second = pool[winners[0]], pool[winners[1]]
    swap = (rng.random((children, d)) < 0.5) & (rng.random((children, 1)) < crossover)
    young = np.where(swap, second, first)
    young ^= (rng.random((children, d)) < mutate).astype(np.int8)
    elite = pool[np.argsort(-scores)[:ELITE]]
    return np.concatenate([elite, _repair(rng, young)])
