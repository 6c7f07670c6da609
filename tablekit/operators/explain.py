"""Model explanation: linear and sampled Shapley values, local linear surrogates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions.columns import col, local_table, numeric_or_zero
from tablekit.functions.trees import has_trees, tree_parts
from tablekit.functions.hashing import below, row_hash, unit_interval, with_hash_cutoffs
from tablekit.operators.models import CLASSIFICATION, FittedModel
from tablekit.operators.profile import numeric_stats


def linear_importance(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, mean_abs_shap), all rows: mean |b (x - mean x)| per feature, in two aggregates."""
    names = list(coefficients)
    x = df.select(*[numeric_or_zero(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    means = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(names))]).first()
    row = x.agg(
        *[F.avg(F.abs(F.lit(coefficients[c]) * (F.col(f"x{i}") - F.lit(means[f"m{i}"])))).alias(f"s{i}") for i, c in enumerate(names)]
    ).first()
    rows = sorted(((c, row[f"s{i}"]) for i, c in enumerate(names)), key=lambda r: (-(r[1] or 0.0), r[0]))
    return local_table(df.sparkSession, rows, "feature string, mean_abs_shap double")


def linear_shap(df: DataFrame, coefficients: dict[str, float], keys: list[str]) -> DataFrame:
    """keys..., feature, shap for every row."""
    stats = numeric_stats(df, list(coefficients))
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.lit(b) * (numeric_or_zero(df, c) - F.lit(stats[c].mean or 0.0))).alias("shap"))
            for c, b in coefficients.items()
        ]
    )
    return df.select(*[col(k) for k in keys], F.inline(parts))


def model_coefficients(model: FittedModel) -> dict[str, float]:
    return dict(zip(model.features, model.stage.model.coefficients.toArray().tolist()))


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int | str = 42) -> DataFrame:
    """The n rows that hash lowest (the sampling is the operator's own: Shapley runs cost rows x draws)."""
    cut = with_hash_cutoffs(df, row_hash(keys, seed), F.array(F.lit(n).cast("bigint")))
    return cut.filter(below(0)).drop("_h", "_n", "_cut")


def _outputs(model: FittedModel) -> list[str]:
    return list(model.classes) if model.problem == CLASSIFICATION else ["value"]


def _predicted(scored: DataFrame, model: FittedModel) -> Column:
    if model.problem == CLASSIFICATION:
        return F.col("probability")
    return F.array(F.col("prediction").cast("double"))


def sampled_shap(
    model: FittedModel, df: DataFrame, keys: list[str], rows: int | None = 200, draws: int = 10, seed: int = 42
) -> DataFrame:
    """(id, output, feature, shap) for a hash sample of `rows` rows, or for all with None, by permutation sampling.

    Each draw walks from a background row to the explained row, switching one feature at a time in a
    random order; a feature's value is the mean change of the output at its switch. All states go through
    one model.transform. Values of a row add up to its output minus the mean background output.
    """
    d = len(model.features)
    x = F.array(*[numeric_or_zero(df, c) for c in model.features])
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    chosen = (df if rows is None else hash_sample(df, keys, rows, seed)).select(ident.alias("id"), x.alias("x"))
    background = hash_sample(df, keys, draws, f"{seed}:background").select(x.alias("b"), row_hash(keys, seed).alias("h"))
    drawn = [r["b"] for r in background.orderBy("h").collect()]
    rng = np.random.default_rng(seed)
    plan = [(i, [int(v) for v in rng.permutation(d)], drawn[i % len(drawn)]) for i in range(draws)]
    walks = local_table(df.sparkSession, plan, "draw int, perm array<int>, b array<double>")
    # The walks are `draws` rows; a chosen row becomes draws * (features + 1) states in the tasks that hold it.
    states = chosen.select("id", "x", F.explode(F.array(*[F.lit(i) for i, _, _ in plan])).alias("draw")).join(F.broadcast(walks), "draw")
    states = states.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    mixed = [
        F.when(F.array_position("perm", i) <= F.col("step"), F.element_at("x", i + 1)).otherwise(F.element_at("b", i + 1)).alias(c)
        for i, c in enumerate(model.features)
    ]
    switched = F.when(F.col("step") > 0, F.element_at("perm", F.greatest("step", F.lit(1))))
    # The prediction join of a neighbour model needs a unique key per state.
    frame = states.select("id", "draw", "step", switched.alias("feature"), F.concat_ws("~", "id", "draw", "step").alias("state"), *mixed)
    scored = _with_keys(model, ["state"]).transform(frame)
    outputs = F.posexplode(_predicted(scored, model)).alias("o", "f")
    values = scored.select("id", "draw", "step", "feature", outputs)
    later = values.filter("step > 0")
    earlier = values.select("id", "draw", "o", (F.col("step") + 1).alias("step"), F.col("f").alias("f0"))
    gains = later.join(earlier, ["id", "draw", "o", "step"]).groupBy("id", "o", "feature").agg(F.avg(F.col("f") - F.col("f0")).alias("shap"))
    names = F.array(*[F.lit(c) for c in model.features])
    classes = F.array(*[F.lit(c) for c in _outputs(model)])
    return gains.select(
        "id", F.element_at(classes, F.col("o") + 1).alias("output"), F.element_at(names, F.col("feature") + 1).alias("feature"), "shap"
    )


def _with_keys(model: FittedModel, keys: list[str]) -> FittedModel:
    import dataclasses

    return dataclasses.replace(model, keys=keys)


def tree_shap(model: FittedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., output, feature, shap, base, value: exact Shapley values of every row for a tree, forest or boosted ensemble.

    An absent feature follows each split by the shares of training rows on either side. shap adds up over the features to
    value - base: value is the output for the row (a class probability, a predicted value, or the margin of a boosted
    classifier, for its second class or for each class against the rest) and base is its mean over the training rows. Missing
    values count as zero, as in prediction. An empty table gives an empty table; a model without trees raises.
    """
    if not has_trees(model):
        raise ValueError(f"{model.model_type} has no trees")
    parts = tree_parts(df.sparkSession, model)
    names = _outputs(model)
    if len(parts) == 1 and parts[0].value.shape[1] < len(names):
        names = names[1:]  # one margin
    kept = [f"k{i}" for i in range(len(keys))]
    table = df.select(*[col(k).alias(n) for k, n in zip(keys, kept)], F.array(*[numeric_or_zero(df, c) for c in model.features]).alias("x"))
    base = np.concatenate([p.base() for p in parts])

    def explained(batches):
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                part = batch.iloc[k : k + 2_000]
                x = np.stack(part["x"].to_numpy()).astype(float)
                shap = np.concatenate([p.shapley(x) for p in parts], axis=2).transpose(0, 2, 1)
                value = np.column_stack([p.outputs(x)[0] for p in parts])
                yield part[kept].assign(shap=list(shap.reshape(len(part), -1)), value=list(value))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in kept)
    rows = table.mapInPandas(explained, schema + ", shap array<double>, value array<double>")
    d = len(model.features)
    cells = [
        F.struct(F.lit(o).alias("output"), F.lit(f).alias("feature"), F.get("shap", F.lit(i * d + j)).alias("shap"), F.lit(float(base[i])).alias("base"), F.get("value", F.lit(i)).alias("value"))
        for i, o in enumerate(names)
        for j, f in enumerate(model.features)
    ]
    return rows.select(*[F.col(n).alias(k) for k, n in zip(keys, kept)], F.inline(F.array(*cells)))


def shap_summary(values: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap) over rows and outputs."""
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def local_surrogate(
    model: FittedModel,
    df: DataFrame,
    instances: DataFrame,
    keys: list[str],
    samples: int = 1_000,
    top: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(id, rank, feature, weight, intercept): a distance-weighted ridge fit around each instance.

    Every instance is perturbed `samples` times with the columns' spread, all perturbations are predicted
    in one transform (the probability of the instance's own predicted class for classifiers), and each
    instance's fit comes from summed cross products.
    """
    features = model.features
    d = len(features)
    stats = numeric_stats(df, features)
    spread = [(stats[c].std_pop or 1.0) for c in features]
    width2 = 0.75 * 0.75 * d
    ident = F.concat_ws("~", *[col(k).cast("string") for k in keys])
    base = instances.select(ident.alias("id"), *[numeric_or_zero(instances, c).alias(f"_b{i}") for i, c in enumerate(features)])
    drawn = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("draw"))

    def noise(i: int) -> Column:
        # Box-Muller from two digests of (instance, draw, feature); draw 0 is the instance itself.
        u = unit_interval(F.md5(F.concat_ws("~", "id", "draw", F.lit(f"{seed}:{i}:u"))))
        v = unit_interval(F.md5(F.concat_ws("~", "id", "draw", F.lit(f"{seed}:{i}:v"))))
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
        return F.when(F.col("draw") == 0, F.lit(0.0)).otherwise(normal)

    drawn = drawn.withColumns({f"_z{i}": noise(i) for i in range(d)})
    moved = drawn.withColumns({c: F.col(f"_b{i}") + F.col(f"_z{i}") * F.lit(spread[i]) for i, c in enumerate(features)})
    moved = moved.withColumn("state", F.concat_ws("~", "id", "draw"))
    scored = _with_keys(model, ["state"]).transform(moved)
    if model.problem == CLASSIFICATION:
        own = scored.filter("draw = 0").select("id", (F.array_position("probability", F.array_max("probability"))).alias("_c"))
        scored = scored.join(own, "id").withColumn("_f", F.element_at("probability", F.col("_c").cast("int")))
    else:
        scored = scored.withColumn("_f", F.col("prediction").cast("double"))
    away2 = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(d)), F.lit(0.0))
    weighted = scored.select("id", "draw", F.exp(-away2 / width2).alias("w"), F.array(*[F.col(f"_z{i}") for i in range(d)]).alias("z"), "_f")
    weighted = weighted.withColumn("part", F.pmod("draw", F.lit(16)))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["z"].to_numpy()), pdf["_f"].to_numpy()])
        g = (z * pdf["w"].to_numpy()[:, None]).T @ z
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "g": [g.ravel()]})

    parts = weighted.groupBy("id", "part").applyInPandas(products, "id string, g array<double>")
    # At most 16 partial matrices per instance, so a list per instance is bounded.
    sums = parts.groupBy("id").agg(F.collect_list("g").alias("g"))

    def solve(batches):
        for batch in batches:
            rows = []
            for name, list_of in batch.itertuples(index=False):
                g = np.sum([np.asarray(v, float) for v in list_of], axis=0).reshape(d + 2, d + 2)
                a = g[: d + 1, : d + 1] + np.diag([0.0] + [1e-3] * d)
                beta = np.linalg.lstsq(a, g[: d + 1, d + 1], rcond=None)[0]
                order = sorted(range(d), key=lambda i: -abs(beta[i + 1]))[:top]
                rows += [(name, r, features[i], float(beta[i + 1] / spread[i]), float(beta[0])) for r, i in enumerate(order, 1)]
            yield pd.DataFrame(rows, columns=["id", "rank", "feature", "weight", "intercept"])

    return sums.mapInPandas(solve, "id string, rank int, feature string, weight double, intercept double")
