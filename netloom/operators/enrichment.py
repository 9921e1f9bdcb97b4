"""Gene-set overlap, enrichment, confusion counts and paired tests."""

from pyspark.sql import functions as F

from netloom.functions.stats import bh, fisher_greater, rank_table
from netloom.operators.edges import top_k_per


def common(a, b, col):
    """Values present on both sides."""
    return a.select(col).distinct().join(b.select(col).distinct(), col, "left_semi")


def overlap(edges, sets, keys=()):
    """Shared genes of every source with every gene set; only overlapping pairs are formed."""
    return (edges.select(*keys, "source", F.col("target").alias("gene")).distinct()
            .join(sets.select("library", "set_name", "gene"), "gene")
            .groupBy(*keys, "source", "library", "set_name").agg(F.count("*").alias("overlap")))


def enrich(edges, sets, universe_size, keys=(), genes=None):
    """One-sided Fisher test of every overlapping (source, set). ``universe_size`` is a column
    expression. With ``genes``, set members outside the universe still count as missed members,
    but not in the remainder of the table; a universe that carries key columns has its own size."""
    keys = list(keys)
    n_t = edges.groupBy(*keys, "source").agg(F.count_distinct("target").alias("n_targets"))
    n_s = sets.groupBy("library", "set_name").agg(F.count_distinct("gene").alias("set_size"))
    o = overlap(edges, sets, keys).join(n_t, [*keys, "source"]).join(n_s, ["library", "set_name"])
    if genes is None:
        o = o.withColumn("set_in", F.col("set_size")).withColumn("n", universe_size)
    else:  # a universe of its own for every key that it carries
        own = [k for k in keys if k in genes.columns]
        inside = sets.join(genes.select(*own, "gene"), "gene").groupBy(*own, "library", "set_name").agg(F.count_distinct("gene").alias("set_in"))
        o = o.join(inside, [*own, "library", "set_name"], "left").fillna(0, ["set_in"])
        o = o.join(genes.groupBy(*own).agg(F.count("*").alias("n")), own) if own else o.withColumn("n", universe_size)
    a = F.col("overlap")
    rest = F.col("n") - F.col("n_targets") - F.col("set_in") + a
    return o.withColumn("p", fisher_greater(a, F.col("n_targets") - a, F.col("set_size") - a, rest))


def tf_pathway_score(edges, sets, universe_size, min_targets=10, max_targets=100, alpha=0.05, keys=()):
    """Pathway score of each source from its strongest targets: best p among significant sets,
    its score against chance, and a specificity penalty."""
    by = [*keys, "source"]
    e = top_k_per(edges, "source", max_targets, list(keys))
    n_t = e.groupBy(*by).agg(F.count_distinct("target").alias("n_targets"))
    big = n_t.where(F.col("n_targets") >= min_targets)
    r = enrich(e.join(big.select(*by), by, "left_semi"), sets, universe_size, list(keys))
    r = bh(r, by, "p", "fdr")
    sig = F.col("fdr") < alpha
    s = r.groupBy(*by).agg(
        F.count("*").alias("tested"), F.count_if(sig).alias("n_enriched"), F.min("p").alias("min_p"),
        F.min_by(F.when(sig, F.col("set_name")), F.when(sig, F.struct("p", "set_name"))).alias("best_set"),
        F.min(F.when(sig, F.col("p"))).alias("best_p"))
    raw = F.when(F.col("n_enriched") > 0, F.when(F.col("best_p") > 0, -F.log10("best_p")).otherwise(50.0)).otherwise(0.0)
    expected = -F.log10(F.least(F.lit(1.0), F.col("tested") * alpha))
    out = n_t.join(s, by, "left").fillna(0, ["n_enriched"]).withColumn("score_raw", F.coalesce(raw, F.lit(0.0)))
    norm = F.greatest(F.lit(0.0), F.try_divide(F.col("score_raw") - expected, F.col("score_raw")))
    return out.select(
        *by, "n_targets", "n_enriched", "score_raw",
        F.when(F.col("score_raw") > 0, norm).otherwise(0.0).alias("score_norm"),
        F.when(F.col("n_enriched") > 0, 1 / (1 + F.log1p("n_enriched"))).otherwise(0.0).alias("specificity"),
        "best_set", F.coalesce("best_p", "min_p", F.lit(1.0)).alias("best_p"))


def prf(df, truth, pred, keys=()):
    """Confusion counts, precision, recall and F1 with 0 for an empty denominator."""
    t, p = F.col(truth), F.col(pred)
    c = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                              F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    z = F.lit(0.0)
    c = c.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), z))
    c = c.withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), z))
    return c.withColumn("f1", f1("precision", "recall"))


def f1(p, r):
    p, r = F.col(p) if isinstance(p, str) else p, F.col(r) if isinstance(r, str) else r
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def paired_t(df, a, b, keys=()):
    """Paired t statistic of |a| against |b|; pairs with a null are left out."""
    d = F.abs(F.col(a)) - F.abs(F.col(b))
    g = df.groupBy(*keys).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    return g.select(*keys, "n", F.when(F.col("n") > 1, F.col("m") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"))


def signed_rank(df, a, b, keys, zero="wilcox", alternative="two-sided"):
    """Wilcoxon signed-rank sums and the normal approximation z, ties corrected."""
    keys = list(keys)
    d = df.withColumn("_d", F.col(a) - F.col(b)).where(F.col("_d").isNotNull())
    zeros = d.groupBy(*keys).agg(F.count_if(F.col("_d") == 0).alias("n_zero"), F.count("*").alias("n_all"))
    if zero == "wilcox":
        d = d.where("_d != 0")
    h = d.groupBy(*keys, F.abs("_d").alias("_a")).agg(
        F.count("*").alias("n"), F.count_if(F.col("_d") > 0).alias("pos"), F.count_if(F.col("_d") < 0).alias("neg"))
    r = rank_table(h, keys, "_a")
    tie = F.when(F.col("_a") > 0, F.pow("n", 3) - F.col("n")).otherwise(0.0)
    s = r.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("w_plus"), F.sum(F.col("rank") * F.col("neg")).alias("w_minus"),
                             F.sum("n").alias("n"), F.sum(tie).alias("ties")).join(zeros, keys)
    n, nz = F.col("n"), F.col("n_zero") if zero == "pratt" else F.lit(0)
    mean = n * (n + 1) * 0.25 - nz * (nz + 1) * 0.25
    var = (n * (n + 1) * (2 * n + 1) - nz * (nz + 1) * (2 * nz + 1) - F.col("ties") / 2) / 24
    stat = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    return s.select(*keys, "n", "w_plus", "w_minus", ((stat - mean) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("z"))


def weighted_f1(df, precision, recall, weight, keys=()):
    """Weighted mean precision and recall, and their F1."""
    g = df.groupBy(*keys).agg((F.sum(F.col(precision) * F.col(weight)) / F.sum(weight)).alias("precision"),
                              (F.sum(F.col(recall) * F.col(weight)) / F.sum(weight)).alias("recall"))
    return g.withColumn("f1", f1("precision", "recall"))
