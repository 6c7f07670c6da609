"""Evaluation of scored tables: a label, a prediction, and optionally a score for the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.functions.columns import col, local_table
from tablekit.functions.ordering import with_bucket
from tablekit.functions.quantiles import exact_quantiles

#: Guard in the denominator of the percentage error (fixed value: the spacing of doubles at 1).
EPSILON = 2.220446049250313e-16


def _counted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for the pairs that occur, nulls among them."""
    return df.groupBy(col(label).cast("string").alias("label"), col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for every pair of classes, zero cells included: for tables of few classes."""
    counted = _counted(df, label, prediction)
    seen = F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("prediction")))
    classes = counted.agg(seen.alias("classes"))
    cells = classes.select(F.explode("classes").alias("label"), "classes").select(
        "label", F.explode("classes").alias("prediction")
    )
    return cells.join(counted, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support per class, from the pairs that occur; undefined ratios are 0. Rows with a null
    on either side count for nothing, but name their other class."""
    known = F.col("label").isNotNull() & F.col("prediction").isNotNull()
    cells = _counted(df, label, prediction).withColumn("n", F.when(known, F.col("n")).otherwise(0).cast("bigint"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess"), F.lit(0).cast("bigint").alias("tp")),
    )
    per = cells.select(F.inline(sides)).filter(F.col("class").isNotNull()).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("truth", "guess", "tp")])
    return per.select(
        "class",
        _share(F.col("tp"), F.col("guess")).alias("precision"),
        _share(F.col("tp"), F.col("truth")).alias("recall"),
        _share(2 * F.col("tp"), F.col("truth") + F.col("guess")).alias("f1"),
        F.col("truth").alias("support"),
        F.col("guess").alias("predicted"),
        F.col("tp").alias("hits"),
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(metric, value): accuracy, balanced accuracy, macro and weighted precision / recall / f1, matthews
    correlation (multiclass form) and kappa."""
    per = class_report(df, label, prediction)
    true = F.col("support") > 0
    n, s = F.sum("support"), F.sum("hits")
    chance = F.sum(F.col("support") * F.col("predicted").cast("double"))
    row = per.agg(
        (s / n).alias("accuracy"),
        F.avg(F.when(true, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        _share(
            s * n - chance,
            F.sqrt(n * n.cast("double") - F.sum(F.col("predicted") * F.col("predicted").cast("double")))
            * F.sqrt(n * n.cast("double") - F.sum(F.col("support") * F.col("support").cast("double"))),
        ).alias("mcc"),
        _share(s / n - chance / (n * n.cast("double")), 1 - chance / (n * n.cast("double"))).alias("kappa"),
    )
    return _tall(row)


def _tall(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "metric", "value")


def score_table(df: DataFrame, positive, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp, n_pos, n_neg) per distinct score, cumulated from the highest score down.

    Distinct scores are counted first; the running sums go through equally deep score buckets, so no
    task sorts the whole table.
    """
    hit = (col(label).cast("string") == F.lit(str(positive))).cast("bigint")
    points = (
        df.filter(col(label).isNotNull() & col(score).isNotNull())
        .groupBy(col(score).cast("double").alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )
    points, _ = with_bucket(points, "score")
    blocks = points.groupBy("_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    everything = Window.partitionBy(F.lit(0))
    higher = everything.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "_bucket",
        F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_q").over(higher), F.lit(0)).alias("_q0"),
        F.sum("_p").over(everything).alias("n_pos"),
        F.sum("_q").over(everything).alias("n_neg"),
    )
    down = Window.partitionBy("_bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return points.join(carried, "_bucket").select(
        "score",
        "pos",
        "neg",
        (F.col("_p0") + F.sum("pos").over(down)).alias("tp"),
        (F.col("_q0") + F.sum("neg").over(down)).alias("fp"),
        "n_pos",
        "n_neg",
    )


def roc_auc(df: DataFrame, positive, label: str = "label", score: str = "score") -> DataFrame:
    """(metric, value) with the area under the ROC curve; ties count half."""
    t = score_table(df, positive, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    row = t.agg((area / (F.first("n_pos") * F.first("n_neg").cast("double"))).alias("roc_auc"))
    return _tall(row)


def roc_curve(df: DataFrame, positive, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the origin is threshold infinity."""
    t = score_table(df, positive, label, score)
    points = t.select(
        F.col("score").alias("threshold"),
        _share(F.col("fp"), F.col("n_neg")).alias("fpr"),
        _share(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )
    origin = local_table(df.sparkSession, [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def precision_recall_curve(df: DataFrame, positive, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) per distinct score; the end point (1, 0) has no threshold."""
    t = score_table(df, positive, label, score)
    points = t.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _share(F.col("tp"), F.col("n_pos")).alias("recall"),
    )
    end = local_table(df.sparkSession, [(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(metric, value): rmse, mae, r2, mape, medae, explained_variance."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    e = y - p
    errors = df.select(e.alias("e"), y.alias("y"), F.abs(e).alias("a"))
    sst = F.var_pop("y") * F.count("y")
    row = errors.agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg("a").alias("mae"),
        (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.avg(F.col("a") / F.greatest(F.abs("y"), F.lit(EPSILON))).alias("mape"),
        (1 - F.var_pop("e") / F.nullif(F.var_pop("y"), F.lit(0.0))).alias("explained_variance"),
    )
    medae = exact_quantiles(errors, ["a"], [0.5])["a"][0]
    return _tall(row.withColumn("medae", F.lit(medae).cast("double")))


def residuals(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """keys..., actual, predicted, residual for every row."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    return df.select(*[col(k) for k in keys], y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n) over equally wide residual bins."""
    e = col(label).cast("double") - col(prediction).cast("double")
    data = df.select(e.alias("e"))
    lo, hi = data.agg(F.min("e"), F.max("e")).first()
    if lo is None:
        return local_table(df.sparkSession, [], "bin bigint, lower double, upper double, n bigint")
    width = (hi - lo) / bins or 1.0
    number = F.least(F.floor((F.col("e") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counted = data.filter("e is not null").groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), "n"
    )
