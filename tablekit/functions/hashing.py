"""Deterministic 'random' choices: order rows by a digest of their key columns.

Every choice is expressed as hash cutoffs. The rank of a row inside its group is never computed by
sorting the group in one task; instead the digests are counted by prefix, the prefix that holds the
wanted rank is found, and only that prefix is looked at row by row. Applying the cutoffs is a plain
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablekit.functions.columns import col
from tablekit.functions.session import small_table

#: Hex digits of the digest that form a counting prefix: at most 16**4 prefixes per group.
PREFIX = 4


def row_hash(keys: list[str] | str, seed: int | str = 42) -> Column:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return F.md5(F.concat_ws("~", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit_interval(digest: Column) -> Column:
    """The leading 48 bits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def group_name(by: Column | None) -> Column:
    if by is None:
        return F.lit("all")
    return F.coalesce(by.cast("string"), F.lit("~null~"))


def hash_cutoffs(df: DataFrame, digest: Column, ranks: Column, by: Column | None = None) -> DataFrame:
    """Digest values at given 1-based ranks, per group: (grp, n, cutoffs).

    ranks is an array<bigint> expression over the column n, the group's row count (and total, the row
    count over all groups). A rank below 1 gives an empty string, which no digest is below; a rank above
    n gives the largest digest. Equal digests (repeated keys) always fall on the same side.
    """
    hashed = df.select(group_name(by).alias("grp"), digest.alias("h")).withColumn("b", F.substring("h", 1, PREFIX))
    counts = hashed.groupBy("grp", "b").agg(F.count("*").alias("c"))
    group = Window.partitionBy("grp")
    running = counts.withColumns(
        {
            "upto": F.sum("c").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)),
            "n": F.sum("c").over(group),
        }
    )
    wanted = (
        running.select("grp", "b", "c", "upto", "n", F.posexplode(ranks).alias("slot", "rank"))
        .withColumn("rank", F.least("rank", "n"))
        .filter((F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto")))
        .select("grp", "b", "n", "slot", (F.col("rank") - F.col("upto") + F.col("c")).alias("need"))
    )
    buckets = wanted.groupBy("grp", "b").agg(F.collect_list(F.struct("slot", "need")).alias("needs"))
    inside = hashed.join(buckets, ["grp", "b"], "left_semi").groupBy("grp", "b", "h").agg(F.count("*").alias("c"))
    order = Window.partitionBy("grp", "b").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        inside.withColumn("upto", F.sum("c").over(order))
        .join(buckets, ["grp", "b"])
        .select("grp", "h", "c", "upto", F.inline("needs"))
        .filter((F.col("need") > F.col("upto") - F.col("c")) & (F.col("need") <= F.col("upto")))
        .groupBy("grp")
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "h"))).alias("hits"))
    )
    groups = counts.groupBy("grp").agg(F.sum("c").alias("n")).withColumn("slots", F.size(ranks))
    return groups.join(hits, "grp", "left").select(
        "grp",
        "n",
        F.transform(
            F.sequence(F.lit(0), F.col("slots") - 1),
            lambda i: F.coalesce(F.element_at("hits", i), F.lit("")),
        ).alias("cutoffs"),
    )


def with_hash_cutoffs(
    df: DataFrame, digest: Column, ranks: Column, by: Column | None = None
) -> DataFrame:
    """df with the columns _h (digest), _n (rows in the group) and _cut (cutoff digests of the group)."""
    table = small_table(hash_cutoffs(df, digest, ranks, by)).select(
        F.col("grp").alias("_grp"), F.col("n").alias("_n"), F.col("cutoffs").alias("_cut")
    )
    return (
        df.withColumns({"_h": digest, "_grp": group_name(by)})
        .join(table, "_grp", "left")
        .drop("_grp")
    )


def cutoff(slot: int) -> Column:
    return F.element_at("_cut", slot + 1)


def below(slot: int) -> Column:
    """True for the rows whose rank is at most the slot's rank."""
    return F.col("_h") <= cutoff(slot)
