"""The whole preparation: impute, split off the target, scale, encode, select, split, balance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import categorical_columns, col, normalise_missing, numeric_columns
from tablekit.operators import sample, select
from tablekit.operators.clean import FillModel, fit_fill
from tablekit.operators.encode import EncodeModel, bin_columns, bin_edges, fit_encoder, polynomial
from tablekit.operators.genetic import select_genetic
from tablekit.operators.resample import adasyn, smote
from tablekit.operators.scale import ScaleModel, fit_scaler


@dataclass
class PrepareConfig:
    """Names and defaults of a preparation request. keys identify rows and never become features."""

    keys: list[str]
    target: str | None = None
    problem: str | None = None
    numerical_features: list[str] | None = None
    categorical_features: list[str] | None = None
    imputation_strategy: str = "auto"
    scaling_method: str = "auto"
    apply_encoding: bool = True
    apply_polynomial: bool = False
    apply_binning: bool = False
    feature_selection: dict | None = None
    imbalance_handling: dict | None = None
    test_size: float = 0.2
    random_state: int = 42
    order_by: str | None = None
    fit_on: str = "all"


@dataclass
class Prepared:
    """Fitted steps; transform applies them to any table with the same columns."""

    config: PrepareConfig
    fill: FillModel
    scaler: ScaleModel
    encoder: EncodeModel
    features: list[str]
    selection: select.Selection | None = None
    edges: dict[str, list[float]] = field(default_factory=dict)
    squares: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)

    def shape(self, df: DataFrame) -> DataFrame:
        """Fill, scale, encode; keys, the target and the order column stay as they are."""
        df = self.scaler.transform(self.fill.transform(df))
        if self.squares:
            df = polynomial(df, self.squares)
        if self.edges:
            df = bin_columns(df, list(self.edges), edges=self.edges)
        return self.encoder.transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """keys, order column and target where present, then the selected features in training order."""
        kept = [c for c in [*self.config.keys, self.config.order_by, self.config.target] if c and c in df.columns]
        ready = self.shape(df)
        return ready.select(*[col(c) for c in dict.fromkeys(kept)], *[col(c) for c in self.features])


def prepare(df: DataFrame, config: PrepareConfig) -> tuple[Prepared, DataFrame]:
    """Fit all steps and return the model with the split (and balanced) table.

    Statistics come from all rows, as the workbench does it; fit_on='train' takes them from the training
    side only. Balancing touches training rows only.
    """
    df = normalise_missing(df)
    aside = [*config.keys, config.target, config.order_by]
    numeric = config.numerical_features or [c for c in numeric_columns(df) if c not in aside]
    categorical = config.categorical_features or [c for c in categorical_columns(df) if c not in aside]
    numeric = [c for c in numeric if c not in aside]
    categorical = [c for c in categorical if c not in aside]
    base = df
    if config.fit_on == "train":
        base = _split(df, config).filter("split = 'train'").drop("split")
    fill = fit_fill(base, numeric, categorical, config.imputation_strategy)
    base = fill.transform(base)
    scaler = fit_scaler(base, numeric, config.scaling_method)
    encoder = fit_encoder(base, categorical) if config.apply_encoding else EncodeModel()
    model = Prepared(config, fill, scaler, encoder, [])
    scaled = scaler.transform(base)
    model.squares = numeric if config.apply_polynomial else []
    model.edges = bin_edges(scaled, numeric, 5) if config.apply_binning else {}
    model.steps = [f"imputation={config.imputation_strategy}", f"scaling={scaler.method}"]
    if encoder.output_columns:
        model.steps.append(f"encoding={len(encoder.output_columns)} new cols")
    shaped = model.shape(df)
    features = [c for c in numeric_columns(shaped) if c not in aside]
    features += [c for c in categorical if c in shaped.columns]
    usable = [c for c in features if c in numeric_columns(shaped)]
    if config.feature_selection and config.feature_selection.get("method", "none") != "none":
        source = model.shape(_split(df, config).filter("split = 'train'").drop("split")) if config.fit_on == "train" else shaped
        model.selection = _select(source, usable, config)
        features = model.selection.kept
        model.steps.append(f"feature_selection={model.selection.method} ({len(features)} features)")
    model.features = features
    ready = model.transform(df)
    split = _split(ready, config)
    unsupervised = config.problem in ("Clustering", "Unsupervised")
    model.steps.append("clustering_preparation=full_dataset" if unsupervised else f"split={1 - config.test_size:.2f}/{config.test_size:.2f}")
    balance = (config.imbalance_handling or {}).get("method", "none")
    if balance != "none" and config.target and not unsupervised:
        split = _balance(split, config, balance, features)
        model.steps.append(f"imbalance_handling={balance}")
    return model, split


def _split(df: DataFrame, config: PrepareConfig) -> DataFrame:
    keys, seed, size = config.keys, config.random_state, config.test_size
    if config.problem in ("Clustering", "Unsupervised"):
        return sample.split_none(df)
    if config.target and config.problem == "Classification":
        return sample.split_stratified(df, keys, config.target, size, seed)
    if config.target and config.problem == "Regression":
        return sample.split_random(df, keys, size, seed)
    return sample.split_sequential(df, keys, config.order_by or keys[0], size, seed)


def _select(df: DataFrame, features: list[str], config: PrepareConfig) -> select.Selection:
    request = config.feature_selection
    method, k, t = request["method"], request.get("max_features", 10), request.get("threshold", 0.05)
    if method == "variance":
        return select.select_variance(df, features, t)
    if method == "correlation":
        return select.select_correlation(df, features, t)
    if config.target is None:
        return select.Selection(method, features, features)
    if method == "kbest":
        return select.select_kbest(df, config.target, k, features)
    if method == "rfe":
        return select.select_rfe(df, config.target, k, features)
    if method == "genetic":
        return select_genetic(
            df,
            config.keys,
            config.target,
            features,
            request.get("population_size", 30),
            request.get("generations", 20),
            request.get("crossover_rate", 0.8),
            request.get("mutation_rate"),
            k if k > 0 else min(15, len(features)),
            request.get("parsimony_weight", 0.1),
            request.get("early_stopping_rounds", 5),
        )
    raise ValueError(f"unknown selection method: {method}")


def _balance(split: DataFrame, config: PrepareConfig, method: str, features: list[str]) -> DataFrame:
    """Balanced training rows plus the untouched test rows: features..., target, split."""
    keys, target, seed = config.keys, config.target, config.random_state
    training, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    if method == "oversample":
        grown = sample.oversample(training, keys, target, seed)
    elif method == "undersample":
        grown = sample.undersample(training, keys, target, seed)
    elif method == "smote":
        grown = smote(training, keys, features, target, seed)
    elif method == "adasyn":
        grown = adasyn(training, keys, features, target, seed)
    else:
        raise ValueError(f"unknown balance method: {method}")
    columns = [*[col(c) for c in features], col(target)]
    return grown.select(*columns, F.lit("train").alias("split")).unionByName(test.select(*columns, F.lit("test").alias("split")))
