"""Ordered work inside keys of any size.

A key may hold a third of all rows, so no window runs over a whole key. The order column is cut at
equally deep bounds shared by all keys; windows run inside (key, bucket) and a small per-bucket table
carries what crosses the bounds. Tables of at most ROWS rows use a single bucket, which is the plain
window.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.functions.columns import col, order_number
from tablekit.functions.session import cut_lineage, spread

ROWS = 1_000_000
BUCKETS = 20_000


def with_bucket(df: DataFrame, order_by: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """df with _ord (the order column as a double) and _bucket, plus the number of buckets."""
    df = df.withColumns(
        {"_ord": F.coalesce(order_number(df, order_by), F.lit(float("-inf"))), "_bucket": F.lit(0)}
    )
    wanted = min(-(-df.count() // (rows or ROWS)), BUCKETS)
    if wanted <= 1:
        return df, 1
    probs = [i / wanted for i in range(1, wanted)]
    knots = df.filter(F.col("_ord") > float("-inf")).agg(F.percentile_approx("_ord", probs, 10 * wanted)).first()[0]
    splits = [float("-inf"), *sorted(set(knots or [])), float("inf")]
    if len(splits) == 2:
        return df, 1
    cut = Bucketizer(splits=splits, inputCol="_ord", outputCol="_bucket").transform(df.drop("_bucket"))
    return cut.withColumn("_bucket", F.col("_bucket").cast("int")), len(splits) - 1


def _carry(df: DataFrame, keys: list[str], per_bucket: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """Join to each row the windows `carried` over its key's per-bucket summary."""
    names = [*keys, "_bucket"]
    summary = df.groupBy(*[col(c) for c in names]).agg(*[v.alias(k) for k, v in per_bucket.items()])
    table = summary.select(*[col(c).alias(f"_k_{c}") for c in names], *[v.alias(k) for k, v in carried.items()])
    condition = F.lit(True)
    for c in names:
        condition = condition & col(c).eqNullSafe(col(f"_k_{c}"))
    return df.join(table, condition, "left").drop(*[f"_k_{c}" for c in names])


def _over_buckets(keys: list[str], backward: bool = False):
    return Window.partitionBy(*([col(k) for k in keys] or [F.lit(0)])).orderBy(F.desc("_bucket") if backward else "_bucket")


def _over_rows(keys: list[str], ties: list[str], backward: bool = False):
    group = [*[col(k) for k in keys], F.col("_bucket")]
    order = [F.col("_ord"), *[col(t) for t in ties]]
    return Window.partitionBy(*group).orderBy(*[c.desc() for c in order] if backward else order)


def with_position(
    df: DataFrame, keys: list[str], order_by: str, ties: list[str] = (), name: str = "_pos", rows: int | None = None
) -> DataFrame:
    """df with the 0-based position of each row in its key, by (order_by, ties)."""
    df, buckets = with_bucket(df, order_by, rows)
    position = F.row_number().over(_over_rows(keys, ties)) - 1
    if buckets > 1:
        earlier = _over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
        df = _carry(df, keys, {"_rows": F.count("*")}, {"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))})
        position = F.col("_before") + position
    return df.withColumn(name, position.cast("bigint")).drop("_before", "_ord", "_bucket")


def fill_along(
    df: DataFrame,
    names: list[str],
    keys: list[str],
    order_by: str,
    ties: list[str] = (),
    backward: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Forward (or backward) fill of nulls along order_by inside each key.

    Backward runs forward over the reverse order: a frame that ends at the current row grows by a row at a time, one that
    starts there is read anew for every row.
    """
    df, buckets = with_bucket(df, order_by, rows)
    pick = F.min_by if backward else F.max_by
    inside = _over_rows(keys, ties, backward).rowsBetween(Window.unboundedPreceding, 0)
    beyond = _over_buckets(keys, backward).rowsBetween(Window.unboundedPreceding, -1)
    filled = {c: F.last(col(c), ignorenulls=True).over(inside) for c in names}
    if buckets > 1:
        place = F.struct(F.col("_ord"), *[col(t) for t in ties])
        df = _carry(
            df,
            keys,
            {f"_v{i}": pick(col(c), F.when(col(c).isNotNull(), place)) for i, c in enumerate(names)},
            {f"_c{i}": F.last(F.col(f"_v{i}"), ignorenulls=True).over(beyond) for i in range(len(names))},
        )
        filled = {c: F.coalesce(v, F.col(f"_c{i}")) for i, (c, v) in enumerate(filled.items())}
    return df.withColumns(filled).drop("_ord", "_bucket", *[f"_c{i}" for i in range(len(names))])


def sessions(
    df: DataFrame, keys: list[str], order_by: str, gap_micros: int, ties: list[str] = (), rows: int | None = None
) -> DataFrame:
    """df with _session, the 1-based number of the row's session in its key; a row opens a session when
    it comes at least gap_micros after the row before it."""
    df, buckets = with_bucket(df, order_by, rows)
    previous = F.lag("_ord").over(_over_rows(keys, ties))
    if buckets > 1:
        earlier = _over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1)
        df = _carry(df, keys, {"_end": F.max("_ord")}, {"_prev_end": F.max("_end").over(earlier)})
        previous = F.coalesce(previous, F.col("_prev_end"))
    opens = (previous.isNull() | (F.col("_ord") - previous >= gap_micros)).cast("bigint")
    df = df.withColumn("_opens", opens)
    number = F.sum("_opens").over(_over_rows(keys, ties).rowsBetween(Window.unboundedPreceding, 0))
    if buckets > 1:
        df = _carry(df, keys, {"_o": F.sum("_opens")}, {"_before": F.coalesce(F.sum("_o").over(earlier), F.lit(0))})
        number = number + F.col("_before")
    return df.withColumn("_session", number).drop("_ord", "_bucket", "_opens", "_before", "_prev_end")


def ordered_values(data: DataFrame, ties: list[str] = (), nulls_last: bool = False) -> DataFrame:
    """(series, values): the values of each series by (ts, ties); nulls come first, in ties last if nulls_last. For short series."""
    place = F.coalesce(order_number(data, "ts"), F.lit(float("-inf"))).alias("_ord")
    known = lambda t: col(t).isNull() if nulls_last else col(t).isNotNull()
    after = [c for i, t in enumerate(ties) for c in (known(t).alias(f"_null{i}"), col(t).alias(f"_tie{i}"))]
    rows = spread(data, "series").groupBy("series").agg(F.sort_array(F.collect_list(F.struct(place, *after, F.col("value").alias("value")))).alias("rows"))
    return rows.select("series", F.transform("rows", lambda r: r["value"]).alias("values"))


def number_rows(df: DataFrame, order_by: list[str], name: str) -> DataFrame:
    """df with 0-based row numbers in sorted order: a range sort, then one offset per sort partition."""
    placed = cut_lineage(df.sort(*[col(c) for c in order_by]).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*[col(c) for c in order_by])) - 1
    numbered = placed.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint")).drop("_part", "_inside", "_start")
