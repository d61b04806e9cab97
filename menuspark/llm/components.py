"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_counted, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Loops, repeated and reversed edges and an empty table are all right; an edge with a null end is ignored. Each round
    is two groupings with partial aggregation and is written to the shared folder; nothing is collected but a count and a
    checksum. Rounds end when the edges no longer change, as they do after some log-squared many. A node with over a thousandth of all
    edges meets its least neighbour by a broadcast of such nodes, fewer than a thousand, so no task gets its edges alone.
    """
    now = staged(_down(edges.select("u", "v")), "edges")
    before = _mark(now)
    while True:
        now = staged(_small_star(_large_star(now, before[0]), before[0]), "edges")
        after = _mark(now)
        if after == before:
            roots = now.select(F.col("u").alias("root")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("root").alias("node"), "root"))
        before = after


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the smaller end u to the larger end v."""
    return edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every node's larger neighbours go to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _down(join_counted(edges, least, "u", 2 * count).select(F.col("m").alias("u"), "v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of these. ``count``: no fewer than the edges."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "v", count).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return _down(moved.unionByName(least.select(F.col("m").alias("u"), "v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
