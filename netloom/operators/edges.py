"""Edge-list operators: cleaning, ranking, degrees, consensus and set logic."""

from pyspark.sql import Window as W, functions as F

from netloom.functions.stats import top_k, weighted_percentile
from netloom.operators.filters import drop_self, tf_filter, to_weight



def by_weight(by="abs"):
    """Order of edges: strongest first, names as tie-breaker."""
    w = F.abs(F.col("weight")) if by == "abs" else F.col("weight")
    return [w.desc_nulls_last(), F.col("source").asc(), F.col("target").asc()]


def symmetric_links(edges):
    """Edges whose reverse is present with the same weight."""
    f = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    return edges.join(f, ["source", "target", "weight"], "left_semi")


def dedup_edges(edges, how="avg", extra=()):
    """Repeated (source, target) rows to their mean or sum."""
    agg = F.avg("weight") if how == "avg" else F.sum("weight")
    return edges.groupBy(*extra, "source", "target").agg(agg.alias("weight"))


def top_edges(edges, n=50_000, extra=()):
    """Strongest ``n`` edges by absolute weight, over all rows or per ``extra`` group."""
    return top_k(edges, list(extra), by_weight(), n, ["source", "target"], salts=16 if extra else 64)


def clean_edges(edges, n=50_000, tfs=None, group=None):
    """Cast, drop self-loops, average repeats, keep the strongest ``n``, then keep factor
    sources. With ``group`` every step runs per group in the same job."""
    extra = [group] if group else []
    e = edges.select(*extra, F.col("source").cast("string"), F.col("target").cast("string"),
                     to_weight().alias("weight"))
    e = top_edges(dedup_edges(drop_self(e), "avg", extra), n, extra)
    return e if tfs is None else tf_filter(e, tfs)


def top_k_per(edges, by, k, extra=()):
    """Strongest ``k`` edges per source or target; ``k`` may be a column."""
    other = "target" if by == "source" else "source"
    return top_k(edges, [*extra, by], by_weight(), k, [other])


def top_k_var(edges, k_table, by="source", order="abs", extra=()):
    """Strongest k edges per key, k read from a table (key, k)."""
    other = "target" if by == "source" else "source"
    e = edges.join(k_table.select(by, "k"), by)
    return top_k(e, [*extra, by], by_weight(order), F.col("k"), [other], out="rn")


def degrees(edges, extra=()):
    """In- and out-degree and absolute strength of every node."""
    e = edges.where("weight != 0")
    out = e.groupBy(*extra, F.col("source").alias("node")).agg(
        F.count("*").alias("out_degree"), F.sum(F.abs("weight")).alias("out_strength"))
    inn = e.groupBy(*extra, F.col("target").alias("node")).agg(
        F.count("*").alias("in_degree"), F.sum(F.abs("weight")).alias("in_strength"))
    return out.join(inn, [*extra, "node"], "full").fillna(
        0, ["out_degree", "out_strength", "in_degree", "in_strength"])


def tf_centrality(edges, extra=()):
    """Out-degree of each source and its place, ties by name."""
    d = edges.groupBy(*extra, F.col("source").alias("tf")).agg(F.count("*").alias("degree"))
    w = W.partitionBy(*extra).orderBy(F.col("degree").desc(), "tf")
    return d.withColumn("rank", F.row_number().over(w))


def top_connected(edges, n, how="max", extra=()):
    """Most connected genes by max(in, out) or in + out."""
    extra = list(extra)
    d = degrees(edges, extra)
    c = F.greatest("in_degree", "out_degree") if how == "max" else F.col("in_degree") + F.col("out_degree")
    d = d.select(*extra, F.col("node").alias("gene"), c.alias("connectivity"))
    order = [F.col("connectivity").desc(), F.col("gene")]
    return top_k(d, extra, order, n, ["gene"]) if extra else d.orderBy(*order).limit(n)


def linear_sizes(lo=10, hi=300, n=10):
    return [int(lo + (hi - lo) * i / (n - 1)) for i in range(n)]


def nested_selections(edges, sizes=None, limit_edges=False, extra=()):
    """Edges of the ``size`` most central sources for all sizes in one job. A source of rank r
    belongs to every size >= r, so its row is repeated once per matching size only."""
    sizes = sizes or linear_sizes()
    c = tf_centrality(edges, extra).select(*extra, F.col("tf").alias("source"), F.col("rank").alias("_r"))
    arr = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_r"))
    out = edges.join(c, [*extra, "source"]).withColumn("n_tfs", F.explode(arr)).drop("_r")
    return top_k(out, [*extra, "n_tfs", "source"], by_weight(), F.col("n_tfs"), ["target"]) if limit_edges else out


def consensus_regulators(edges, genes, thetas=(0.0, 0.25, 0.5, 0.75, 1.0)):
    """In-degree quantiles over models per gene; a model without the gene counts as 0."""
    e = edges.where("weight != 0")
    models = edges.select(F.count_distinct("model")).scalar()
    per = e.groupBy(F.col("target").alias("gene"), "model").agg(F.count("*").alias("d"))
    hist = per.groupBy("gene", "d").agg(F.count("*").alias("n"))
    seen = per.groupBy("gene").agg(F.count("*").alias("m"))
    rest = (genes.select("gene").distinct().join(seen, "gene", "left")
            .select("gene", F.lit(0).cast("bigint").alias("d"), (models - F.coalesce("m", F.lit(0))).alias("n")))
    hist = hist.join(genes.select("gene"), "gene", "left_semi").unionByName(rest.where("n > 0"))
    q = hist.groupBy("gene").agg(weighted_percentile("d", list(thetas)).alias("q"))
    z = F.arrays_zip(F.array(*[F.lit(float(t)) for t in thetas]).alias("theta"), F.col("q").alias("v"))
    return q.select("gene", F.explode(z).alias("z")).select(
        "gene", F.col("z.theta").alias("theta"), F.rint(F.col("z.v")).cast("bigint").alias("n"))


def consensus_edges(edges, tfs=None, thetas=(0.25, 0.75)):
    """Quantiles of the non-zero out-degree over models per source, cut to whole numbers."""
    e = edges if tfs is None else tf_filter(edges, tfs)
    hist = (e.groupBy("source", "model").agg(F.count("*").alias("d"))
            .groupBy("source", "d").agg(F.count("*").alias("n")))
    q = hist.groupBy("source").agg(weighted_percentile("d", list(thetas)).alias("q"))
    z = F.arrays_zip(F.array(*[F.lit(float(t)) for t in thetas]).alias("theta"), F.col("q").alias("v"))
    return q.select("source", F.explode(z).alias("z")).select(
        "source", F.col("z.theta").alias("theta"), F.floor(F.col("z.v")).cast("bigint").alias("value"))


def edges_in(edges, genes, extra=()):
    """Edges with both ends among the measured genes; ``genes`` may have columns of ``extra``."""
    on = [c for c in extra if c in genes.columns]
    return (edges.join(genes.select(*on, F.col("gene").alias("source")), [*on, "source"], "left_semi")
            .join(genes.select(*on, F.col("gene").alias("target")), [*on, "target"], "left_semi"))


def gt_overlap(a, b):
    """Shared edges of two ground truths with shared / union counts of ends and pairs."""
    def one(cols, what):
        x = a.select(*cols).distinct().withColumn("_a", F.lit(1))
        y = b.select(*cols).distinct().withColumn("_b", F.lit(1))
        return x.join(y, cols, "full").agg(
            F.lit(what).alias("what"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"),
            F.count("*").alias("total"))
    counts = one(["source"], "source").unionByName(one(["target"], "target")).unionByName(one(["source", "target"], "pair"))
    return a.select("source", "target").intersect(b.select("source", "target")), counts
