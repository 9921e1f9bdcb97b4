"""Spread of correlations over groups and target co-regulation scores."""

from pyspark.sql import functions as F

from netloom.operators.edges import tf_centrality, top_k_per
from netloom.session import cut


def corr_spread(c, signed=False, n_groups=None):
    """Consistency of a pair over groups: 1 - 2 (max - min). ``c`` is (grp, a, b, r). The signed
    form returns the positive and negative spreads, to be weighed by the sign of the edge."""
    g = c.groupBy("a", "b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("_k"))
    if n_groups is not None:  # a gene without variance in some group correlates 0 there
        gap = F.col("_k") < n_groups
        g = g.withColumn("lo", F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")))
        g = g.withColumn("hi", F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")))
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(x)))
    if not signed:
        return g.select("a", "b", "lo", "hi", (1 - 2 * (F.col("hi") - F.col("lo"))).alias("consistency"))
    return g.select("a", "b", (clip("hi", 0, 1) - clip("lo", 0, 1)).alias("pos"), (clip("hi", -1, 0) - clip("lo", -1, 0)).alias("neg"))


def signed_consistency(edges, spread):
    """Edge consistency where wrong-sign spread counts three times."""
    both = spread.unionByName(spread.select(F.col("b").alias("a"), F.col("a").alias("b"), "pos", "neg"))
    e = edges.join(both, (edges.source == both.a) & (edges.target == both.b))
    bad = F.when(F.col("weight") > 0, F.col("pos") + 3 * F.col("neg")).when(F.col("weight") < 0, 3 * F.col("pos") + F.col("neg")).otherwise(0.0)
    return e.select("source", "target", "weight", (1 - 0.25 * bad).alias("consistency"))


def select_targets(edges, n_tfs=100, max_targets=100, keys=()):
    """Most connected sources and their strongest targets."""
    c = tf_centrality(edges, keys).where(F.col("rank") <= n_tfs).select(*keys, F.col("tf").alias("source"))
    return top_k_per(edges.join(c, [*keys, "source"], "left_semi"), "source", max_targets, keys)


def coregulation(edges, consistency, keys=()):
    """Weighted consistency of factor-target links and of target-target pairs, per source.
    ``consistency`` holds each unordered pair once (a < b)."""
    keys = list(keys)
    consistency, edges = cut(consistency, "consistency"), cut(edges, "edges")
    both = consistency.select("a", "b", "consistency").unionByName(
        consistency.select(F.col("b").alias("a"), F.col("a").alias("b"), "consistency"))
    tot = edges.groupBy(*keys, "source").agg(F.sum(F.abs("weight")).alias("_t"), F.count("*").alias("k"))
    e = edges.join(tot, [*keys, "source"]).select(*keys, "source", "target", (F.abs("weight") / F.col("_t")).alias("w"), "k")
    tf_tg = (e.join(both.select(F.col("a").alias("source"), F.col("b").alias("target"), "consistency"), ["source", "target"])
             .groupBy(*keys, "source").agg(F.sum(F.col("w") * F.col("consistency")).alias("tf_tg")))
    other = e.select(*keys, "source", F.col("target").alias("b"))
    tg_tg = (e.select(*keys, "source", F.col("target").alias("a"), "w", "k").join(both, "a")
             .join(other, [*keys, "source", "b"], "left_semi")
             .groupBy(*keys, "source").agg(F.sum(F.try_divide(F.col("w") * F.col("consistency"), F.col("k") - 1)).alias("tg_tg")))
    return tot.select(*keys, "source").join(tf_tg, [*keys, "source"], "left").join(tg_tg, [*keys, "source"], "left")
