"""Aggregations over expression tables. Absent rows are zeros: counts of samples come from the
metadata table, and histograms get a zero bin of ``n - nnz``."""

import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions import det
from netloom.functions.quantiles import exact
from netloom.functions.stats import (
    bh, following, norm_p_two, rank_table, scan, t_p_greater, t_p_two, top_k, weighted_percentile, welch_t)
from netloom.functions.skew import spread_join
from netloom.operators.blocks import attach_all, pair_sums, sparse_product
from netloom.session import cut


def one_to_one(obs, key, cols):
    """Columns with a single value inside every group of ``key``."""
    per = obs.groupBy(key).agg(*[(F.min(c).eqNullSafe(F.max(c)) & (F.count_if(F.col(c).isNull()) % F.count("*") == 0)).alias(c) for c in cols])
    ok = per.agg(*[F.bool_and(c).alias(c) for c in cols]).first()
    return [c for c in cols if ok[c]]


def pseudobulk(expr, obs, key, min_cells=0):
    """Sum of the counts per group, and the group table with its one-to-one columns."""
    cols = one_to_one(obs, key, [c for c in obs.columns if c not in (key, "obs_id")])
    meta = (obs.groupBy(key).agg(*[F.min(c).alias(c) for c in cols], F.count("*").alias("cell_count"))
            .where(F.col("cell_count") >= min_cells))
    bulk = (expr.join(obs.select("obs_id", key), "obs_id").groupBy(key, "gene").agg(F.sum("value").alias("value"))
            .join(meta.select(key), key, "left_semi"))
    return bulk, meta


def lognorm(expr, target=1e4):
    """Scale each sample to ``target`` and take log1p."""
    tot = expr.groupBy("obs_id").agg(F.sum("value").alias("_t"))
    return expr.join(tot, "obs_id").withColumn("value", F.log1p(F.col("value") * target / F.col("_t"))).drop("_t")


def densify(expr, obs, genes):
    """Every (sample, gene) of the grid, zeros written out. Only for operators whose result is
    itself dense."""
    grid = attach_all(obs.select("obs_id"), genes.select("gene"))
    return (grid.join(expr.select("obs_id", "gene", "value"), ["obs_id", "gene"], "left")
            .fillna(0.0, ["value"]))


def pearson_residual(expr, obs, theta=100.0):
    """Analytic Pearson residuals of counts under a negative binomial, clipped to +-sqrt(n)."""
    rows = expr.groupBy("obs_id").agg(F.sum("value").alias("_r"))
    cols = expr.groupBy("gene").agg(F.sum("value").alias("_c"))
    total = expr.select(F.sum("value")).scalar()
    n = obs.select(F.count("*")).scalar()
    grid = attach_all(obs.select("obs_id").join(rows, "obs_id"), cols)
    x = F.coalesce("value", F.lit(0.0))
    mu = F.col("_r") * F.col("_c") / total
    z = (x - mu) / F.sqrt(mu + mu * mu / theta)
    lim = F.sqrt(n)
    return (grid.join(expr.select("obs_id", "gene", "value"), ["obs_id", "gene"], "left")
            .select("obs_id", "gene", F.greatest(-lim, F.least(lim, z)).alias("value")))


def group_sizes(obs, *cols):
    return obs.groupBy(*cols).agg(F.count("*").alias("n"))


def missing_ratio(expr, obs, group):
    """Share of zeros per group."""
    m = expr.select(F.count_distinct("gene")).scalar()
    n = obs.groupBy(group).agg(F.count("*").alias("n"))
    nnz = (expr.where("value != 0").join(obs.select("obs_id", group), "obs_id").groupBy(group).agg(F.count("*").alias("nnz")))
    return n.join(nnz, group, "left").select(group, "n", (1 - F.coalesce("nnz", F.lit(0)) / (F.col("n") * m)).alias("missing_ratio"))


def perturbation_effect(expr, obs, pert_gene, eps=1e-8):
    """Target gene of each perturbation, perturbed against all controls: means, log2 fold change,
    Welch t and its p-value. Too few samples or no variance give 0 and 1."""
    sizes = obs.where("not is_control").groupBy("perturbation").agg(F.count("*").alias("n1"))
    n0 = obs.select(F.count_if("is_control")).scalar()
    hit = expr.join(pert_gene.select("gene").distinct(), "gene", "left_semi").join(
        obs.select("obs_id", "perturbation", "is_control"), "obs_id")
    s = hit.groupBy("gene", F.when(F.col("is_control"), F.lit(None)).otherwise(F.col("perturbation")).alias("grp")).agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    ctrl = s.where("grp is null").select("gene", F.col("s").alias("s0"), F.col("q").alias("q0"))
    pert = s.where("grp is not null").select("gene", F.col("grp").alias("perturbation"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    d = (pert_gene.select("perturbation", "gene").join(sizes, "perturbation").join(ctrl, "gene", "left")
         .join(pert, ["perturbation", "gene"], "left").fillna(0.0, ["s0", "q0", "s1", "q1"]).withColumn("n0", n0))
    for i in "01":
        n, sm, q = F.col("n" + i), F.col("s" + i), F.col("q" + i)
        d = d.withColumn("m" + i, sm / n).withColumn(
            "v" + i, F.greatest(F.lit(0.0), F.try_divide(q - sm * sm / n, n - 1)))
    flat = (F.col("n1") < 3) | (F.col("n0") < 3) | ((F.sqrt("v1") < eps) & (F.sqrt("v0") < eps))
    t, df = welch_t(F.col("m1"), F.col("v1"), F.col("n1"), F.col("m0"), F.col("v0"), F.col("n0"))
    d = d.withColumn("flat", F.coalesce(flat, F.lit(True)))
    return d.select(
        "perturbation", "gene", "n1", "n0",
        F.when(F.col("flat"), 0.0).otherwise(F.col("m0")).alias("mean_control"),
        F.when(F.col("flat"), 0.0).otherwise(F.col("m1")).alias("mean_perturbed"),
        F.when(F.col("flat"), 0.0).otherwise(F.log2((F.col("m1") + eps) / (F.col("m0") + eps))).alias("lfc"),
        F.when(~F.col("flat"), t).alias("t"), F.when(~F.col("flat"), df).alias("df"))


def qc_effect(expr, obs, pert_gene, kind="knockout", max_lfc=-0.54, alpha=0.05):
    """Samples of perturbations that lower their own target significantly, plus controls.
    Cytokine data pass as they are; over-expression has no such test."""
    if kind == "cytokine":
        return obs
    if kind in ("overexpression", "activation"):
        raise ValueError(f"{kind} perturbation type is not supported")
    e = perturbation_effect(expr, obs, pert_gene).withColumn("p", F.coalesce(t_p_two("t", "df"), F.lit(1.0)))
    e = bh(e.withColumn("kind", F.substring("perturbation", 0, 0)), ["kind"], "p")
    good = e.where((F.col("lfc") < max_lfc) & (F.col("padj") < alpha)).select("perturbation")
    return obs.where("is_control").unionByName(obs.where("not is_control").join(good, "perturbation", "left_semi"))


def group_hist(expr, obs, group, genes=None):
    """Histogram (gene, group, value, n) with the zero bin of every (gene, group)."""
    sizes = obs.groupBy(group).agg(F.count("*").alias("size"))
    genes = expr.select("gene").distinct() if genes is None else genes
    stored = (expr.where("value != 0").join(obs.select("obs_id", group), "obs_id")
              .groupBy("gene", group, "value").agg(F.count("*").alias("n")))
    nnz = stored.groupBy("gene", group).agg(F.sum("n").alias("nnz"))
    zero = (attach_all(genes, sizes).join(nnz, ["gene", group], "left")
            .select("gene", group, F.lit(0.0).alias("value"), (F.col("size") - F.coalesce("nnz", F.lit(0))).alias("n")))
    return stored.unionByName(zero.where("n > 0")), sizes


def _contrast(expr, obs, group, control, genes=None):
    """Group histogram next to the running control counts on the same value axis."""
    o = obs.select("obs_id", F.when(F.col("is_control"), F.lit(control)).otherwise(F.col(group)).alias(group)) \
        if control is not None else obs.select("obs_id", group)
    hist, sizes = group_hist(expr, o, group, genes)
    hist = cut(hist, "hist")
    axis = hist.groupBy("gene", "value").agg(F.sum(F.when(F.col(group) == control, F.col("n")).otherwise(0)).alias("c"))
    return hist, sizes, axis


def rank_sum(expr, obs, group="perturbation", control="control", max_controls=None, seed=0):
    """Wilcoxon rank-sum z (no tie correction) of every group against the controls per gene.

    One histogram per (gene, group); the controls enter through their running counts, so they
    are never joined to each group. With ``max_controls`` the test takes that many of the controls,
    in hash order; genes are those of the whole table either way.
    """
    genes = expr.select("gene").distinct() if max_controls else None
    if max_controls:
        keep = top_k(obs.where("is_control"), [], [det.hash_key("obs_id", seed=seed), F.col("obs_id")], max_controls, ["obs_id"], salts=64)
        obs = obs.where("not is_control").unionByName(keep)
        expr = expr.join(obs.select("obs_id"), "obs_id", "left_semi")
    hist, sizes, axis = _contrast(expr, obs, group, control, genes)
    below = scan(axis, ["gene"], "value", "c", "less", inclusive=False)
    n0 = sizes.where(F.col(group) == control).select(F.sum("size")).scalar()
    u = (hist.where(F.col(group) != control).join(below, ["gene", "value"])
         .groupBy("gene", group).agg(F.sum(F.col("n") * (F.col("less") + F.col("c") / 2)).alias("u"), F.sum("n").alias("n1")))
    u = u.withColumn("n0", n0)
    # a product of three counts leaves the range of a long from some millions of samples on
    sd = F.sqrt(F.col("n0").cast("double") * F.col("n1") * (F.col("n0") + F.col("n1") + 1) / 12.0)
    return u.select(group, "gene", "n1", "n0", ((F.col("u") - F.col("n0") * F.col("n1") / 2) / sd).alias("score"))


def rank_sum_rest(expr, obs, group):
    """Rank-sum z of every group against all other samples, per gene, with mean log fold change."""
    hist, sizes = group_hist(expr, obs, group)
    hist = cut(hist, "hist")
    total = obs.select(F.count("*")).scalar()
    ranks = rank_table(hist.groupBy("gene", "value").agg(F.sum("n").alias("n")), ["gene"], "value").drop("n")
    r = (hist.join(ranks, ["gene", "value"]).groupBy("gene", group)
         .agg(F.sum(F.col("n") * F.col("rank")).alias("r1"), F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("value")).alias("s1")))
    tot = r.groupBy("gene").agg(F.sum("s1").alias("s"))
    r = r.join(tot, "gene").withColumn("n", total)
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    z = (F.col("r1") - n1 * (F.col("n") + 1) / 2.0) / F.sqrt(n1.cast("double") * n2 * (F.col("n") + 1) / 12.0)
    rest = F.greatest(F.lit(0.0), F.round(F.col("s") - F.col("s1"), 9))  # a difference of sums: no noise below 1e-9
    lfc = F.log2((F.round("s1", 9) / n1 + 1e-9) / (rest / n2 + 1e-9))
    return r.select(group, "gene", z.alias("score"), lfc.alias("lfc"))


def differential(expr, obs, group, min_fold=1.5, alpha=0.05):
    """Genes (or regions) that mark a group: rank-sum against all other samples, two-sided p of
    its z, Benjamini-Hochberg within the group, fold change of at least ``min_fold``.
    (group, gene, score, lfc, p, padj, is_marker)"""
    d = rank_sum_rest(expr, obs, group).withColumn("p", F.coalesce(norm_p_two("score"), F.lit(1.0)))
    d = bh(d, [group], "p")
    return d.withColumn("is_marker", (F.col("lfc") >= math.log2(min_fold)) & (F.col("padj") <= alpha))


def wasserstein(expr, obs, group="perturbation", control="control"):
    """1-D Wasserstein distance between each group and the controls, per gene.

    The control distribution F0 is kept once per gene as two running sums over its values, which
    give F0 and its integral at any point. Between neighbouring values of a group its own F1 is
    flat, so |F0 - F1| integrates from those sums; only where F0 crosses the level inside a gap
    is the crossing point looked up. Cost follows the group's values, not groups x controls.
    """
    hist, sizes, axis = _contrast(expr, obs, group, control)
    n0 = sizes.where(F.col(group) == control).select(F.sum("size")).scalar()
    ax = scan(axis.withColumn("cv", F.col("c") * F.col("value")), ["gene"], "value", ["c", "cv"], ["run_n", "run_s"])
    ax = cut(ax.select("gene", "value", "c", (F.col("run_n") / n0).alias("f"), ((F.col("run_n") - F.col("c")) / n0).alias("f_before"),
                   ((F.col("value") * F.col("run_n") - F.col("run_s")) / n0).alias("g")), "axis")
    ends = ax.groupBy("gene").agg(F.max_by(F.struct("value", "g"), "value").alias("end"))
    # running totals and neighbours are found bin by bin: one gene with most of the values is spread over tasks
    own = hist.where(F.col(group) != control)
    steps = scan(own, ["gene", group], "value", "n", "run").join(own.groupBy("gene", group).agg(F.sum("n").alias("n1")), ["gene", group])
    at = steps.select("gene", group, "value", (F.col("run") / F.col("n1")).alias("level")).join(ax.drop("c"), ["gene", "value"])
    at = cut(following(at, ["gene", group], "value", ["value", "f_before", "g"], "nxt", "first"), "steps")
    inside = at.where("nxt is not null")
    crossing = (F.col("f") < F.col("level")) & (F.col("nxt.f_before") > F.col("level"))
    asked = inside.where(crossing)
    marks = (ax.where("c > 0").select("gene", F.col("f").alias("level"), F.struct("value", "g").alias("mark"))
             .unionByName(asked.select("gene", "level", F.lit(None).cast("struct<value:double,g:double>").alias("mark")))
             .groupBy("gene", "level").agg(F.min("mark").alias("mark")))
    marks = scan(marks, ["gene"], "level", "mark", "x", how="min", reverse=True).select("gene", "level", "x")
    dx = F.col("nxt.value") - F.col("value")
    dg = F.col("nxt.g") - F.col("g")
    plain = inside.where(~crossing).select("gene", group, F.abs(dg - F.col("level") * dx).alias("part"))
    lvl = F.col("level")
    crossed = asked.join(marks, ["gene", "level"]).select(
        "gene", group, (lvl * (F.col("x.value") - F.col("value")) - (F.col("x.g") - F.col("g"))
                        + (F.col("nxt.g") - F.col("x.g")) - lvl * (F.col("nxt.value") - F.col("x.value"))).alias("part"))
    tails = at.join(ends, "gene").select("gene", group, (
        F.when(F.col("first"), F.col("g")).otherwise(0.0)
        + F.when(F.col("nxt").isNull(), (F.col("end.value") - F.col("value")) - (F.col("end.g") - F.col("g"))).otherwise(0.0)).alias("part"))
    return (plain.unionByName(crossed).unionByName(tails).groupBy(F.col(group).alias("source"), F.col("gene").alias("target"))
            .agg(F.sum("part").alias("ws_distance")))


def gene_moments(expr, obs, keys=()):
    """Count of samples, sum and sum of squares of each gene, per key."""
    keys = list(keys)
    m = expr.groupBy(*keys, "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    if keys:
        return m.join(obs.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return m.withColumn("n", obs.select(F.count("*")).scalar())


def rank_transform(expr, obs, keys=()):
    """Average ranks per gene shifted so that zeros stay zero: correlation is unchanged and the
    table stays sparse. All implicit zeros share one tie rank."""
    keys = list(keys)
    hist = expr.where("value != 0").groupBy(*keys, "gene", "value").agg(F.count("*").alias("n"))
    nnz = hist.groupBy(*keys, "gene").agg(F.sum("n").alias("nnz"))
    size = (nnz.join(obs.groupBy(*keys).agg(F.count("*").alias("size")), keys) if keys
            else nnz.withColumn("size", obs.select(F.count("*")).scalar()))
    zero = size.select(*keys, "gene", F.lit(0.0).alias("value"), (F.col("size") - F.col("nnz")).alias("n"))
    ranks = rank_table(hist.unionByName(zero), [*keys, "gene"], "value").drop("n")
    base = ranks.where("value = 0").select(*keys, "gene", F.col("rank").alias("_r0"))
    moved = ranks.join(base, [*keys, "gene"]).withColumn("_r", F.col("rank") - F.col("_r0"))
    return (expr.where("value != 0").join(moved.select(*keys, "gene", "value", "_r"), [*keys, "gene", "value"])
            .select("obs_id", *keys, "gene", F.col("_r").alias("value")))


def correlation(expr, obs, method="pearson", keys=(), left=None):
    """Correlation of gene pairs a < b (or of ``left`` genes with all others), per key.

    ``keys`` columns are in both tables. Genes without variance are left out.
    """
    keys = list(keys)
    e = expr.select("obs_id", *keys, "gene", "value")
    if method == "spearman":
        e = cut(rank_transform(e, obs, keys), "ranks")
    elif method != "pearson":
        raise ValueError(f"unknown correlation {method}")
    lhs = e if left is None else e.join(left.select("gene"), "gene", "left_semi")
    s = pair_sums(lhs, e, "obs_id", "gene", "value", "dot", keys, upper=left is None).where("a != b")
    m = gene_moments(e, obs, keys).withColumn("var", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    m = m.where(F.col("var") > 1e-12 * F.greatest(F.col("q"), F.lit(1.0)))
    # pairs without a shared sample have Σxy = 0 but still a correlation
    ma = m.select(*keys, F.col("gene").alias("a"), F.col("s").alias("sa"), F.col("var").alias("va"), "n")
    mb = m.select(*keys, F.col("gene").alias("b"), F.col("s").alias("sb"), F.col("var").alias("vb"))
    if left is not None:
        ma = ma.join(left.select(F.col("gene").alias("a")), "a", "left_semi")
    if keys:
        # every pair of a key is a result; slices of the right side keep a key's pairs in many tasks
        slices = 16
        grid = (ma.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
                .join(mb.withColumn("_z", F.pmod(F.xxhash64("b"), F.lit(slices)).cast("int")), [*keys, "_z"]).drop("_z"))
    else:
        grid = attach_all(ma, mb)
    grid = grid.where(F.col("a") < F.col("b") if left is None else F.col("a") != F.col("b"))
    sxy = F.coalesce("s", F.lit(0.0)) - F.col("sa") * F.col("sb") / F.col("n")
    return grid.join(s, [*keys, "a", "b"], "left").select(
        *keys, "a", "b", (sxy / F.sqrt(F.col("va") * F.col("vb"))).alias("r"), "n")


def robust_scale(expr, obs):
    """Divide by the interquartile range (zeros included); a zero range counts as 1."""
    n = obs.select(F.count("*")).scalar()
    hist = expr.where("value != 0").groupBy("gene", "value").agg(F.count("*").alias("n"))
    zero = hist.groupBy("gene").agg(F.sum("n").alias("nnz")).select("gene", F.lit(0.0).alias("value"), (n - F.col("nnz")).alias("n"))
    q = hist.unionByName(zero.where("n > 0")).groupBy("gene").agg(weighted_percentile("value", [0.25, 0.75]).alias("q"))
    iqr = q.select("gene", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    return expr.join(iqr, "gene").withColumn(
        "value", F.col("value") / F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr"))).drop("iqr")


def fit_scaler(expr, obs_fit):
    """Mean and population deviation of every gene over the fitted samples; zero counts as 1."""
    fit = expr.join(obs_fit.select("obs_id"), "obs_id", "left_semi")
    n = obs_fit.select(F.count("*")).scalar()
    g = expr.select("gene").distinct()
    m = fit.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    m = g.join(m, "gene", "left").fillna(0.0).withColumn("n", n)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
    return m.select("gene", (F.col("s") / F.col("n")).alias("mu"), F.when(sd < 1e-9, 1.0).otherwise(sd).alias("sd"))


def fold_scaler(expr, folds):
    """Population deviation of every gene over the samples outside each fold; zero counts as 1.
    Sums of all folds less the own one. ``folds`` is (obs_id, fold); (gene, fold, sd)."""
    v = F.col("value")
    own = expr.join(folds.select("obs_id", "fold"), "obs_id").groupBy("gene", "fold").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = own.groupBy("gene").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    size = folds.groupBy("fold").agg(F.count("*").alias("n"))
    size = size.withColumn("rest", size.select(F.sum("n")).scalar() - F.col("n")).select("fold", "rest")
    d = attach_all(total, size).join(own, ["gene", "fold"], "left").fillna(0.0, ["s", "q"])
    s, q = F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    sd = F.sqrt(F.greatest(F.lit(0.0), q / F.col("rest") - F.pow(s / F.col("rest"), 2)))
    return d.select("gene", "fold", F.when(F.coalesce(sd, F.lit(0.0)) < 1e-9, 1.0).otherwise(sd).alias("sd"))


def standardize(expr, obs, obs_fit):
    """Centre and scale with the statistics of a subset. The result is dense: a zero becomes
    -mean/deviation."""
    sc = fit_scaler(expr, obs_fit)
    return (densify(expr, obs, sc).join(sc, "gene")
            .select("obs_id", "gene", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value")))


def hvg(expr, obs, n_top=None, n_bins=20, logged=True):
    """Highly variable genes: dispersion z-score within bins of the mean."""
    n = obs.select(F.count("*")).scalar()
    v = F.expm1("value") if logged else F.col("value")
    g = (expr.withColumn("v", v).groupBy("gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
         .withColumn("n", n))
    mean = F.col("s") / F.col("n")
    g = g.withColumn("m", F.when(mean == 0, 1e-12).otherwise(mean)).withColumn(
        "var", (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    g = g.where("var > 0").select("gene", F.log1p("m").alias("mean"), F.log(F.col("var") / F.col("m")).alias("disp"))
    lim = g.agg(F.struct(F.min("mean").alias("lo"), F.max("mean").alias("hi"))).scalar()
    g = g.withColumn("_l", lim)
    width = (F.col("_l.hi") - F.col("_l.lo")) / n_bins
    g = g.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.ceil((F.col("mean") - F.col("_l.lo")) / width) - 1)).cast("int")).drop("_l")
    b = g.groupBy("bin").agg(F.avg("disp").alias("bm"), F.stddev_samp("disp").alias("bs"))
    z = (F.when(F.col("bs").isNull(), F.lit(1.0)).otherwise((F.col("disp") - F.col("bm")) / F.nullif("bs", F.lit(0.0))))
    out = g.join(b, "bin").select("gene", "mean", "disp", "bin", z.alias("z"))
    return out if n_top is None else out.orderBy(F.col("z").desc_nulls_last(), "gene").limit(n_top)


def hvg_counts(expr, obs, n_top=None):
    """Highly variable genes of raw counts: variance of values standardised by the variance that
    the mean predicts, large values clipped at sqrt(n). The mean-variance trend is a quadratic in
    log space, fitted from sums (a global fit in place of a local one)."""
    n = obs.select(F.count("*")).scalar()
    g = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n)
    g = g.select("gene", "n", (F.col("s") / F.col("n")).alias("m"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var"))
    g = cut(g.where("var > 0").withColumns({"x": F.log10("m"), "y": F.log10("var")}), "moments")
    row = g.agg(*[F.sum(F.pow("x", i)).alias(f"x{i}") for i in range(5)], *[F.sum(F.pow("x", i) * F.col("y")).alias(f"y{i}") for i in range(3)]).first()
    a = np.array([[row[f"x{i + j}"] for j in range(3)] for i in range(3)])
    c = np.linalg.lstsq(a, np.array([row[f"y{i}"] for i in range(3)]), rcond=None)[0]
    fit = F.lit(float(c[0])) + F.col("x") * float(c[1]) + F.col("x") * F.col("x") * float(c[2])
    g = g.withColumn("sd", F.sqrt(F.pow(F.lit(10.0), fit))).withColumn("top", F.col("sd") * F.sqrt("n") + F.col("m"))
    v = F.least("value", "top")
    d = (expr.join(g.select("gene", "top"), "gene").groupBy("gene").agg(F.sum(v).alias("cs"), F.sum(v * v).alias("cq")).join(g, "gene"))
    norm = (F.col("n") * F.col("m") * F.col("m") + F.col("cq") - 2 * F.col("cs") * F.col("m")) / ((F.col("n") - 1) * F.col("sd") * F.col("sd"))
    out = d.select("gene", F.col("m").alias("mean"), "var", norm.alias("norm_var"))
    return out if n_top is None else out.orderBy(F.col("norm_var").desc(), "gene").limit(n_top)


def ulm(expr, edges, tmin=5, obs=None, keys=(), genes=None):
    """Univariate linear model: slope t-value of expression on the weights of each source, genes
    outside the network having weight 0. ``keys`` are extra columns of the edges (selection,
    model). Closed form from sums, no regression is run. ``genes`` (gene) is the measured universe, by
    default every gene with a stored value."""
    keys = list(keys)
    genes = expr.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    m = genes.select(F.count("*")).scalar()
    net = edges.select(*keys, "source", F.col("target").alias("gene"), "weight").join(genes, "gene", "left_semi")
    src = (net.groupBy(*keys, "source").agg(F.sum("weight").alias("sw"), F.sum(F.col("weight") * F.col("weight")).alias("qw"), F.count("*").alias("k"))
           .where(F.col("k") >= tmin))
    # a network's source is one column of a matrix: samples meet all of them in blocks, not edge by edge
    src = src.withColumn("_id", F.to_json(F.struct(*keys, "source")))
    net = net.join(src.select(*keys, "source", "_id"), [*keys, "source"])
    smp = expr.groupBy("obs_id").agg(F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("qy"))
    if obs is not None:
        smp = obs.select("obs_id").join(smp, "obs_id", "left").fillna(0.0)
    cross = sparse_product(expr.select("obs_id", "gene", "value"), net.select("gene", "_id", "weight"), "gene", "obs_id", "_id", out="swy")
    full = attach_all(smp, src).join(cross, ["obs_id", "_id"], "left").withColumn("m", m)
    return full.select("obs_id", *keys, "source", ulm_t("m", "sw", "qw", "sy", "qy", F.coalesce("swy", F.lit(0.0))).alias("activity"))


def ulm_t(m, sw, qw, sy, qy, swy):
    """t-value of the slope from sums over ``m`` genes."""
    m, sw, qw, sy, qy, swy = (F.col(x) if isinstance(x, str) else x for x in (m, sw, qw, sy, qy, swy))
    vx, vy = m * qw - sw * sw, m * qy - sy * sy
    r = (m * swy - sw * sy) / F.nullif(F.sqrt(F.greatest(F.lit(0.0), vx) * F.greatest(F.lit(0.0), vy)), F.lit(0.0))
    return r * F.sqrt((m - 2) / ((1 - r + 1e-20) * (1 + r + 1e-20)))


def active_sets(act, alpha=0.01, min_mean=0.0, keys=()):
    """One-sample t of the activities of each set; active when significantly above zero."""
    a = act.groupBy(*keys, "source").agg(F.avg("activity").alias("mean"), F.stddev_samp("activity").alias("sd"),
                                         F.count("activity").alias("n"))
    t = F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    a = a.withColumn("t", t).withColumn("p", t_p_greater("t", (F.col("n") - 1).cast("double")))
    return a.withColumn("is_active", F.coalesce((F.col("p") < alpha) & (F.col("mean") > min_mean), F.lit(False)))


def dispersion(act, groups, keys=()):
    """Mean absolute deviation from the group median, averaged over groups of two or more, and
    consistency 1 - clip(mad / p95, 0, 1)."""
    keys = list(keys)
    a = cut(act.join(groups.select("obs_id", "grp"), "obs_id"), "activity")
    med = exact(a, [*keys, "source", "grp"], "activity", [0.5]).where("n >= 2").select(*keys, "source", "grp", F.col("value").alias("med"))
    mad = (a.join(med, [*keys, "source", "grp"]).groupBy(*keys, "source", "grp")
           .agg(F.avg(F.abs(F.col("activity") - F.col("med"))).alias("mad"))
           .groupBy(*keys, "source").agg(F.avg("mad").alias("mad")))
    if keys:
        top = mad.groupBy(*keys).agg(F.percentile("mad", F.lit(0.95)).alias("p95"))
        d = mad.join(top, keys)
    else:
        d = mad.withColumn("p95", mad.agg(F.percentile("mad", F.lit(0.95))).scalar())
    cons = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mad") / F.col("p95")))
    return d.select(*keys, F.col("source").alias("tf"), "mad", cons.alias("consistency"))


def padded_mean(scores, n, value="consistency", keys=()):
    """Mean of the best ``n`` values, missing places counting as 0. ``n`` may be a column among
    ``keys``."""
    keys = list(keys)
    order = [F.col(value).desc_nulls_last(), F.col("tf")]
    best = top_k(scores, keys, order, F.col(n) if isinstance(n, str) else n, ["tf"]) if keys else \
        scores.orderBy(*order).limit(n)
    size = F.col(n) if isinstance(n, str) else F.lit(n)
    return best.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("_s")).select(
        *keys, (F.col("_s") / size).alias("score"))


def profiles(expr, obs, group="perturbation", keys=()):
    """Mean profile of each group, zeros included."""
    n = obs.groupBy(group).agg(F.count("*").alias("_n"))
    return (expr.join(obs.select("obs_id", group), "obs_id").groupBy(*keys, group, "gene").agg(F.sum("value").alias("_s"))
            .join(n, group).select(*keys, group, "gene", (F.col("_s") / F.col("_n")).alias("value")))


def pds(pred, true, target_gene=None, keys=()):
    """Perturbation discrimination: rank of the right true profile by L1 distance to each
    predicted profile, own target gene left out; 1 - rank/(n-1).

    ``pred`` is (keys, perturbation, item, gene, value), one item being a mean profile or a cell;
    ``true`` is (keys, perturbation, gene, value); ``target_gene`` maps perturbation to gene. Keys are strings.
    """
    keys = list(keys)
    target_gene = target_gene if target_gene is not None else true.select("perturbation", F.col("perturbation").alias("gene")).distinct()
    tagged = pred.withColumn("item", F.to_json(F.struct("perturbation", "item")))
    t = true.select(*keys, "gene", F.col("perturbation").alias("item"), "value")
    s = pair_sums(tagged.select(*keys, "gene", "item", "value"), t, "gene", "item", "value", "l1", keys)
    ip = tagged.groupBy(*keys, "item", "perturbation").agg(F.sum(F.abs("value")).alias("sp"))
    tp = t.groupBy(*keys, F.col("item").alias("other")).agg(F.sum(F.abs("value")).alias("st"))
    # every item against every true profile of its key is a result
    grid = attach_all(ip, tp) if not keys else spread_join(ip, tp, keys, ["item"], per=2_000)
    d = grid.join(s.select(*keys, F.col("a").alias("item"), F.col("b").alias("other"), "s"), [*keys, "item", "other"], "left")
    d = d.withColumn("dist", F.col("sp") + F.col("st") + F.coalesce("s", F.lit(0.0)))
    # take the own target gene out of every distance
    own = tagged.join(target_gene, ["perturbation", "gene"]).select(*keys, "item", F.col("value").alias("x"))
    theirs = true.join(target_gene.select(F.col("gene"), F.col("perturbation").alias("p")), "gene").select(
        *keys, F.col("perturbation").alias("other"), F.col("p").alias("perturbation"), F.col("value").alias("y"))
    d = d.join(own, [*keys, "item"], "left").join(theirs, [*keys, "perturbation", "other"], "left")
    d = d.withColumn("dist", F.round(F.col("dist") - F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))), 9))
    # the own profile's place is the number of profiles before it; nothing is put in order
    right = d.where("perturbation = other").select(*keys, "item", "perturbation", F.struct("dist", "other").alias("_own"))
    hit = (d.join(right.select(*keys, "item", "_own"), [*keys, "item"]).groupBy(*keys, "item", "perturbation")
           .agg(F.count_if(F.struct("dist", "other") < F.col("_own")).alias("rank"), F.count("*").alias("_n")))
    return hit.select(*keys, "perturbation", F.get_json_object("item", "$.item").alias("item"), "rank",
                      (1 - F.col("rank") / F.nullif(F.col("_n") - 1, F.lit(0))).alias("pds"))


def pooled_r2(pred, keys=()):
    """Per gene 1 - sum of residual squares / total squares over all folds, clipped to [0, 1].
    ``pred`` is (fold, gene, y, y_hat); totals are taken around the mean of each fold."""
    f = pred.groupBy(*keys, "gene", "fold").agg(
        F.sum(F.pow(F.col("y") - F.col("y_hat"), 2)).alias("res"), (F.var_pop("y") * F.count("y")).alias("tot"))
    g = f.groupBy(*keys, "gene").agg(F.sum("res").alias("res"), F.sum("tot").alias("tot"))
    return g.select(*keys, "gene", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("res") / F.nullif("tot", F.lit(0.0)))).alias("r2"))


def gene_r2(pred, keys=()):
    """R2 per gene; constant genes null, negative values 0."""
    g = pred.groupBy(*keys, "gene").agg(
        F.sum(F.pow(F.col("y") - F.col("y_hat"), 2)).alias("res"), (F.var_pop("y") * F.count("y")).alias("tot"),
        (F.min("y") == F.max("y")).alias("flat"))
    return g.select(*keys, "gene", F.when(~F.col("flat"), F.greatest(F.lit(0.0), 1 - F.col("res") / F.col("tot"))).alias("r2"))


def perturbation_delta(expr, obs, strict, loose):
    """Sample minus its matched control: last control of the strict key, else of the loose key,
    else the first control. Genes absent on one side count as zero there."""
    ctrl = obs.where("is_control")
    s = ctrl.groupBy(*strict).agg(F.max_by("obs_id", "row_no").alias("_c1"))
    l = ctrl.groupBy(*loose).agg(F.max_by("obs_id", "row_no").alias("_c2"))
    first = ctrl.agg(F.min_by("obs_id", "row_no")).scalar()
    m = obs.join(s, strict, "left").join(l, loose, "left").select("obs_id", F.coalesce("_c1", "_c2", first).alias("control_id"))
    own = expr.join(m.select("obs_id"), "obs_id", "left_semi").select("obs_id", "gene", "value")
    profile = expr.select(F.col("obs_id").alias("control_id"), "gene", "value")
    ref = (spread_join(m, profile, ["control_id"], ["obs_id"], per=2_000)
           .select("obs_id", "gene", (-F.col("value")).alias("value")))
    # a union and one sum: same result as a full join, with map-side combine
    return own.unionByName(ref).groupBy("obs_id", "gene").agg(F.sum("value").alias("value")), m
