"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing but two numbers a round reaches the driver. Each round is written to the
shared folder, so lost executors cost one round at most. The minimum of a node's
neighbours is aggregated with map-side partials before it is joined back, so
that hot nodes are neither collected nor windowed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.storage import cut, discard


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (a, b) with a > b. Large: link larger neighbours to the least one; small: the node and its smaller neighbours."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.union(least.select("a", F.col("m").alias("b"))).distinct()
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long) in any order, self-loops allowed. Rows (node, root): root is the component's least node.

    The rounds end by themselves, after about the square of the logarithm of the nodes.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(spark, edges, "edges")
    seen = None
    while True:
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (row["n"], row["x"]) == seen or not row["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = (row["n"], row["x"])
        after = cut(spark, _star(_star(edges, small=False), small=True), "edges")
        discard(edges)
        edges = after
