"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with v < u after one round; each node points its neighbours to the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    near = both.join(least, "u")
    moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest id of its component.

    Edges are written once per round to the shared folder, so a lost executor
    costs a re-read. A node's neighbours are never gathered: minima are
    aggregated map-side and joined back, where a large node can be split.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    old = mark(e)
    while old[0]:
        e = cut_lineage(_stars(_stars(e, True), False))
        new = mark(e)
        if new == old:
            break
        old = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
