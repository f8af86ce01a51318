"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``u > v``.

    Large: every larger neighbour of a node is tied to the node's least
    neighbour. Small: the node and its smaller neighbours are. The least
    neighbours are a table of their own, so that a node with most of the edges
    can be split in the join.
    """
    around = edges
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = written(least, "star").withColumnRenamed("u", "_u")
    joined = around.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("_u").alias("u"), F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``u, v``: the least node it is tied to.

    Ends when a round of both steps changes no edge; the rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = written(ordered, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = written(_star(written(_star(now, large=True), "edges"), large=False), "edges")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
