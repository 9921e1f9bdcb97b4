"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from netloom.session import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most=60) -> DataFrame:
    """(node, root) for every node of the (u, v) edges, roots left out; root is the component's least node.

    Each round is written to the shared folder, so lineage stays short. Stars settle in a number of
    rounds that grows with the logarithm of the component size.
    """
    e = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most):
        e = cut(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components not settled after {most} rounds")
