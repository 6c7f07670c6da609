"""Splits, folds and class balance, all by hash order of the key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablekit.functions.columns import col, order_number
from tablekit.functions.hashing import below, row_hash, with_hash_cutoffs
from tablekit.functions.quantiles import order_statistics

_WORK = ("_h", "_n", "_cut")


def _ceil_share(share: float) -> Column:
    """ceil(n * share), with the rounding noise of n * share removed first."""
    return F.ceil(F.round(F.col("n") * F.lit(share), 9)).cast("bigint")


def split_random(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with split: the ceil(n * test_size) rows that hash lowest are 'test'."""
    cut = with_hash_cutoffs(df, row_hash(keys, seed), F.array(_ceil_share(test_size)))
    return cut.withColumn("split", F.when(below(0), F.lit("test")).otherwise(F.lit("train"))).drop(*_WORK)


def split_stratified(df: DataFrame, keys: list[str], label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """split_random inside each class; a single class gives the random split."""
    cut = with_hash_cutoffs(df, row_hash(keys, seed), F.array(_ceil_share(test_size)), col(label))
    return cut.withColumn("split", F.when(below(0), F.lit("test")).otherwise(F.lit("train"))).drop(*_WORK)


#: Stands for a null order value, so that those rows come first.
_BEFORE_ALL = -1.7976931348623157e308


def _place(df: DataFrame, order_by: str) -> Column:
    value = order_number(df, order_by)
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(_BEFORE_ALL))


def _ordered_cuts(df: DataFrame, keys: list[str], order_by: str, ranks: list[int], seed: int) -> list[tuple[float, str]]:
    """(order value, digest) of the rows at 0-based ranks by (order_by, digest)."""
    df = df.withColumns({"_ord": _place(df, order_by), "_dig": row_hash(keys, seed)})
    values = order_statistics(df, {"_ord": ranks})["_ord"]
    result = []
    for rank in ranks:
        v = values[rank]
        before = df.filter(F.col("_ord") < v).count()
        ties = df.filter(F.col("_ord") == v)
        at = with_hash_cutoffs(ties, F.col("_dig"), F.array(F.lit(rank - before + 1).cast("bigint")))
        result.append((v, at.select(F.element_at("_cut", 1)).first()[0]))
    return result


def _at_or_before(df: DataFrame, order_by: str, digest: Column, cut: tuple[float, str]) -> Column:
    value = _place(df, order_by)
    return (value < F.lit(cut[0])) | ((value == F.lit(cut[0])) & (digest <= F.lit(cut[1])))


def split_sequential(df: DataFrame, keys: list[str], order_by: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The first int(n * (1 - test_size)) rows by (order_by, key digest) are 'train'; null order values come first."""
    n = df.count()
    train = int(round(n * (1 - test_size), 9))
    if train <= 0:
        return df.withColumn("split", F.lit("test"))
    cut = _ordered_cuts(df, keys, order_by, [train - 1], seed)[0]
    first = _at_or_before(df, order_by, row_hash(keys, seed), cut)
    return df.withColumn("split", F.when(first, F.lit("train")).otherwise(F.lit("test")))


def split_none(df: DataFrame) -> DataFrame:
    """Unsupervised problems train on every row."""
    return df.withColumn("split", F.lit("train"))


# -- folds ------------------------------------------------------------------------------------------


def _block_ends(k: int) -> Column:
    """Last rank of each of the first k - 1 blocks; the first n % k blocks hold one row more."""
    size, extra = F.floor(F.col("n") / k), F.col("n") % k
    return F.array(*[((i + 1) * size + F.least(extra, F.lit(i + 1))).cast("bigint") for i in range(k - 1)])


def kfold(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1: contiguous blocks of the hash order, block sizes as for shuffled k-fold."""
    return _blocks(with_hash_cutoffs(df, row_hash(keys, seed), _block_ends(k)), k)


def _blocks(cut: DataFrame, k: int) -> DataFrame:
    fold = F.lit(0)
    for i in range(k - 1):
        fold = fold + F.when(below(i), F.lit(0)).otherwise(F.lit(1))
    return cut.withColumn("fold", fold.cast("int")).drop(*_WORK)


def stratified_folds(k: int, smallest: int) -> int | None:
    """Folds that the smallest class allows; None when it has fewer than two rows."""
    return None if smallest < 2 else max(2, min(k, smallest))


def kfold_stratified(df: DataFrame, keys: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """k-fold inside each class. k shrinks to the smallest class (at least 2); a class of one row falls
    back to plain k-fold."""
    smallest = class_counts(df, label).agg(F.min("n")).first()[0] or 0
    folds = stratified_folds(k, smallest)
    if folds is None:
        return kfold(df, keys, k, seed)
    return _blocks(with_hash_cutoffs(df, row_hash(keys, seed), _block_ends(folds), col(label)), folds)


def time_series_folds(df: DataFrame, keys: list[str], order_by: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Expanding windows: one row per (row, fold it takes part in) with fold and role train / test.

    Each fold tests on n // (k + 1) rows; a row is tested once at most and trains every later fold. Null order values
    come first.
    """
    n = df.count()
    size = n // (k + 1)
    if size < 1:
        raise ValueError("too few rows for the number of folds")
    starts = [n - (k - i) * size for i in range(k)] + [n]
    cuts = _ordered_cuts(df, keys, order_by, [s - 1 for s in starts], seed)
    digest = row_hash(keys, seed)
    before = [_at_or_before(df, order_by, digest, c) for c in cuts]
    roles = F.array(
        *[
            F.struct(
                F.lit(i).alias("fold"),
                F.when(before[i], F.lit("train")).when(before[i + 1], F.lit("test")).alias("role"),
            )
            for i in range(k)
        ]
    )
    return df.select("*", F.inline(roles)).filter("role is not null")


#: Copies of a row that are made together.
COPIES = 10_000

# -- balance ----------------------------------------------------------------------------------------


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))


def oversample(df: DataFrame, keys: list[str], label: str, seed: int = 42) -> DataFrame:
    """Every class grows to the majority count: each row n_max // n times, the rows that hash lowest once
    more. copy numbers the copies of a row from 0. A row of a very small class is first cut into blocks of COPIES copies,
    which spread over all tasks."""
    largest, smallest = class_counts(df, label).agg(F.max("n"), F.min("n")).first()
    largest = largest or 0
    cut = with_hash_cutoffs(df, row_hash(keys, seed), F.array(F.lit(largest).cast("bigint") % F.col("n")), col(label))
    copies = F.floor(F.lit(largest) / F.col("_n")) + below(0).cast("bigint")
    last = cut.withColumn("_last", copies - 1)
    blocks = last.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / COPIES))))
    if largest > COPIES * (smallest or 1):
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_block", *[col(k) for k in keys])
    inside = F.sequence(F.col("_block") * COPIES, F.least(F.col("_last"), F.col("_block") * COPIES + COPIES - 1))
    return blocks.withColumn("copy", F.explode(inside)).drop(*_WORK, "_last", "_block")


def undersample(df: DataFrame, keys: list[str], label: str, seed: int = 42) -> DataFrame:
    """Every class shrinks to the minority count, keeping the rows that hash lowest."""
    smallest = class_counts(df, label).agg(F.min("n")).first()[0] or 0
    cut = with_hash_cutoffs(df, row_hash(keys, seed), F.array(F.lit(smallest).cast("bigint")), col(label))
    return cut.filter(below(0)).drop(*_WORK)


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(stage, label, n) before and after rebalancing."""
    parts = [class_counts(d, label).withColumn("stage", F.lit(s)) for s, d in (("before", before), ("after", after))]
    return parts[0].unionByName(parts[1]).select("stage", "label", "n")
