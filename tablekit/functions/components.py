"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for nodes(id) and undirected edges(a, b); the component is its smallest id.

    Each round points the larger (then the smaller) neighbours of every node at the smallest of its
    neighbourhood. A neighbourhood is only ever reduced to its minimum, so a node with very many edges
    costs partial aggregates and a join, never a gathered list. Rounds end when no edge moves: one aggregate per round
    gives the count and two digests of the edges.
    """
    pairs = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(pairs)
    while before[0]:
        pairs = cut_lineage(_star(_star(pairs, larger=True), larger=False))
        now = _digest(pairs)
        if now == before:
            break
        before = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("component", "id").alias("component"))


def _digest(pairs: DataFrame) -> tuple:
    """Edges, and two order-free digests of them."""
    forth, back = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(pairs.agg(F.count("*"), F.bit_xor(forth), F.sum(back.cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Large star: (v, m) for neighbours v > u; small star: (v, m) for v <= u; m the smallest around u."""
    if larger:
        around = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()
