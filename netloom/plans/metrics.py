"""Network inference and the evaluation metrics, as plans over the operators."""

from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.stats import norm_p_greater, norm_p_two, top_k
from netloom.functions import det
from netloom.functions.skew import spread_join
from netloom.operators import coregulation as G, edges as E, enrichment as N, expression as X, filters as O, fits as J, nulls as Z
from netloom.operators.blocks import attach_all
from netloom.operators.ranking import null_percentile
from netloom.session import cut


def one(df, name, value="value", keys=()):
    """One row per key as (keys, metric, value)."""
    return df.select(*keys, F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"))


def wide_to_long(df, names, keys=()):
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(*keys, "x.*")


# --- inference -------------------------------------------------------------------------------

def correlation_network(expr, obs, tfs=None, method="pearson", n=None):
    """Correlation of gene pairs in name order, factor sources only, strongest ``n``."""
    # with factors known only their pairs are formed; a pair belongs to the source that comes first by name
    left = None if tfs is None else tfs.select(F.col("tf").alias("gene")).distinct()
    c = X.correlation(expr, obs, method, left=left).where("a < b").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("r").alias("weight"))
    return c if n is None else E.clean_edges(c, n, tfs)


def positive_control(train, test, obs, tfs, n=50_000):
    """Correlation network on the union of both splits."""
    return correlation_network(train.unionByName(test), obs, tfs, "pearson", n)


# --- regression (top regulators predict their targets) ---------------------------------------

def consensus_lookup(genes, consensus, theta):
    """Number of regulators each measured gene is given at one theta; unknown genes fall out."""
    at = consensus.where(F.abs(F.col("theta") - theta) < 1e-9).select("gene", "n")
    return genes.select("gene").distinct().join(at, "gene")


def regression_detail(edges, expr, samples, tfs, consensus, alpha=1.0, keys=(), group=None):
    """(keys, group, metric, target, n_regulators, r2) of every evaluated gene of every network.
    ``samples`` is (obs_id, fold[, group])."""
    by = [] if group is None else [group]
    keys = [*keys, *(c for c in by if c in edges.columns)]
    genes = consensus.select("gene").distinct()
    net = E.edges_in(edges, genes)
    factors = tfs.join(genes.withColumnRenamed("gene", "tf"), "tf", "left_semi")
    left = factors.withColumnRenamed("tf", "gene")
    if group is None:
        m = J.moments(expr, samples, left=left)
    else:  # all groups in one table of moments, told apart by the fold's name
        m = J.moments(expr, samples.select("obs_id", F.to_json(F.struct(F.col(group).cast("string").alias("g"), "fold")).alias("fold")), left=left)
        m = m.withColumn(group, F.get_json_object("fold", "$.g"))
    out = J.ridge_cv(cut(J.raw_regulators(net, factors, keys=keys), "regs"), m, alpha, keys, by).withColumn("metric", F.lit("r2_raw"))
    for theta, name in ((0.25, "r_precision"), (0.75, "r_recall")):
        regs = J.select_regulators(net, factors, consensus_lookup(genes, consensus, theta), keys=keys)
        out = out.unionByName(J.ridge_cv(cut(regs, "regs"), m, alpha, keys, by).withColumn("metric", F.lit(name)))
    return out


def regression(edges, expr, obs, tfs, consensus, cv_column=None, alpha=1.0, group=None, keys=()):
    """r_precision / r_recall: mean fold R2 with the consensus number of regulators at theta
    0.25 / 0.75; r2_raw: with all regulators of the network. Samples without a fold (small groups of
    ``cv_column``) are left out before anything is scaled. With ``group`` (a metadata column, e.g. cell type) every group of samples is scored
    on its own, against its own edges where the network carries that column. (keys, metric, value)"""
    genes = consensus.select("gene").distinct()
    samples = Z.folds(obs, cv_column)
    kept = obs.join(samples.select("obs_id"), "obs_id", "left_semi")
    e = X.robust_scale(expr.join(genes, "gene", "left_semi").join(kept.select("obs_id"), "obs_id", "left_semi"), kept)
    if group is not None:
        samples = samples.join(obs.select("obs_id", group), "obs_id")
    detail = regression_detail(edges, e, samples, tfs, consensus, alpha, keys, group)
    return detail.groupBy(*keys, "metric").agg(F.avg("r2").alias("value"))


# --- distance to the perturbed distribution --------------------------------------------------

def predicted_distances(edges, background, consensus, by="signed", seed=42, keys=()):
    """Background distances of the consensus number of edges per factor: predicted edges that the
    background knows, filled up by draws with replacement from the background (by hash).
    (keys, theta, source, percentile, filled); ``background`` carries its percentile."""
    keys = list(keys)
    need = consensus.join(background.select("source").distinct(), "source", "left_semi").select("source", "theta", F.col("value").alias("k"))
    if keys:
        need = attach_all(need, edges.select(*keys).distinct())
    e = edges.join(need, [*keys, "source"])
    pick = top_k(e, [*keys, "theta", "source"], E.by_weight(by), F.col("k"), ["target"]).select(*keys, "theta", "source", "target")
    hit = pick.join(background, ["source", "target"]).select(*keys, "theta", "source", "percentile")
    have = hit.groupBy(*keys, "theta", "source").agg(F.count("*").alias("h"))
    miss = need.join(have, [*keys, "theta", "source"], "left").withColumn("m", F.col("k") - F.coalesce("h", F.lit(0))).where("m > 0")
    order = W.partitionBy("source").orderBy(det.hash_key("source", "target", seed=seed), "target")
    pool = background.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy("source")))
    size = pool.groupBy("source").agg(F.max("_n").alias("_n"))
    draws = miss.join(size, "source").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    draws = draws.withColumn("_i", 1 + F.floor(det.uniform("source", "theta", "_j", seed=seed) * F.col("_n")))
    fill = draws.drop("_n").join(pool.select("source", "_i", "percentile"), ["source", "_i"]).select(*keys, "theta", "source", "percentile")
    return hit.withColumn("filled", F.lit(False)).unionByName(fill.withColumn("filled", F.lit(True)))


def ws_distance(edges, background, consensus, by="signed", seed=42, keys=()):
    """Mean percentile of the Wasserstein distance of predicted edges within the background of
    their factor, for the consensus edge counts. ``ws_raw`` is the plain mean distance of
    predicted edges."""
    keys = list(keys)
    pct = cut(null_percentile(background, background.select("source", F.col("ws_distance")), ["source"], "ws_distance"), "background")
    raw = edges.select(*keys, "source", "target").distinct().join(background, ["source", "target"])
    raw = raw.groupBy(*keys).agg(F.avg("ws_distance").alias("value")).select(*keys, F.lit("ws_raw").alias("metric"), "value")
    mean = predicted_distances(edges, pct, consensus, by, seed, keys).groupBy(*keys, "theta").agg(F.avg("percentile").alias("value"))
    name = F.when(F.abs(F.col("theta") - 0.25) < 1e-9, "ws_precision").when(F.abs(F.col("theta") - 0.75) < 1e-9, "ws_recall").otherwise(F.col("theta").cast("string"))
    return mean.select(*keys, name.alias("metric"), "value").unionByName(raw)


# --- recovery of the perturbed factor --------------------------------------------------------

def own_activity(de, edges, keys=()):
    """ULM activity of each perturbed factor on its own differential expression."""
    keys = list(keys)
    by = [*keys, "source"]
    m = de.select(F.count_distinct("gene")).scalar()
    y = de.groupBy(F.col("perturbation").alias("source")).agg(F.sum("score").alias("sy"), F.sum(F.col("score") * F.col("score")).alias("qy"))
    genes = de.select(F.col("gene").alias("target")).distinct()
    e = edges.join(genes, "target", "left_semi")
    w = e.groupBy(*by).agg(F.sum("weight").alias("sw"), F.sum(F.col("weight") * F.col("weight")).alias("qw"), F.count("*").alias("k"))
    xy = (e.join(de.select(F.col("perturbation").alias("source"), F.col("gene").alias("target"), "score"), ["source", "target"])
          .groupBy(*by).agg(F.sum(F.col("weight") * F.col("score")).alias("swy")))
    d = w.join(y, "source").join(xy, by, "left").withColumn("m", m)
    return d.where("k >= 3").select(*by, "k", X.ulm_t("m", "sw", "qw", "sy", "qy", F.coalesce("swy", F.lit(0.0))).alias("activity"))


def tf_recovery(edges, de, min_targets=5, seed=42, keys=()):
    """Paired t of |activity| against a random network of equal size: over factors in the
    network (precision) and over all perturbed factors (recall). (keys, metric, value)"""
    keys = list(keys)
    by = [*keys, "source"]
    net = O.min_targets(edges.select(*keys, "source", "target", "weight"), min_targets, keys)
    genes = de.select("gene").distinct()
    act = own_activity(de, net, keys)
    shared = net.join(genes.withColumnRenamed("gene", "target"), "target", "left_semi").join(act.select(*by), by, "left_semi")
    rnd = Z.random_partners(shared.withColumn("weight", F.lit(1.0)), genes, seed=seed, extra=keys, allow_self=True)
    pair = cut(act.select(*by, F.col("activity").alias("act")).join(
        own_activity(de, rnd, keys).select(*by, F.col("activity").alias("rnd")), by), "activity")
    # perturbed factors that a network lacks score the median of the random ones
    perturbed = de.select(F.col("perturbation").alias("source")).distinct()
    if keys:
        med = edges.select(*keys).distinct().join(pair.groupBy(*keys).agg(F.median("rnd").alias("_m")), keys, "left")
        perturbed = attach_all(perturbed, med)
    else:
        perturbed = perturbed.withColumn("_m", pair.select(F.median("rnd")).scalar())
    absent = perturbed.join(net.select(*by).distinct(), by, "left_anti").withColumn("act", F.coalesce("_m", F.lit(0.0))).withColumn("rnd", F.col("act")).drop("_m")
    p = one(N.paired_t(pair, "act", "rnd", keys), "t_rec_precision", "t", keys)
    return p.unionByName(one(N.paired_t(pair.unionByName(absent), "act", "rnd", keys), "t_rec_recall", "t", keys))


# --- binding evidence ------------------------------------------------------------------------

def target_overlap(edges, truths, genes, tfs, keys=()):
    """Top-k predicted targets of each factor against its k true targets:
    (keys, gt, source, n_targets, k, tp, got), the last two null for a factor not predicted."""
    keys = list(keys)
    gt = truths.join(tfs.select(F.col("tf").alias("source")), "source", "left_semi").select("gt", "source", "target").distinct()
    is_tf = tfs.select(F.col("tf").alias("target")).distinct()
    n_all = genes.select(F.count("*")).scalar()
    n_fac = genes.join(is_tf.withColumnRenamed("target", "gene"), "gene", "left_semi").select(F.count("*")).scalar()
    # when every predicted target is a factor, truths and background shrink to factors too
    flag = (edges.select(*keys, "target").distinct().join(is_tf.withColumn("_f", F.lit(1)), "target", "left")
            .groupBy(*keys).agg((F.count("*") == F.count("_f")).alias("only_tfs")).withColumn("n_all", n_all).withColumn("n_fac", n_fac)
            .withColumn("n_targets", F.when(F.col("only_tfs"), F.col("n_fac")).otherwise(F.col("n_all"))))
    true = gt.join(genes.select(F.col("gene").alias("target")), "target", "left_semi").join(is_tf.withColumn("_f", F.lit(1)), "target", "left")
    true = attach_all(true, flag.select(*keys, "only_tfs", "n_targets")).where(~F.col("only_tfs") | (F.col("_f") == 1))
    k = true.groupBy(*keys, "gt", "source", "n_targets").agg(F.count("*").alias("k"))
    pred = edges.select(*keys, "source", "target", "weight").join(k.select(*keys, "gt", "source", "k"), [*keys, "source"])
    top = top_k(pred, [*keys, "gt", "source"], E.by_weight(), F.col("k"), ["target"])
    hits = (top.join(true.select(*keys, "gt", "source", "target", F.lit(1).alias("_h")), [*keys, "gt", "source", "target"], "left")
            .groupBy(*keys, "gt", "source").agg(F.count("_h").alias("tp"), F.count("*").alias("got")))
    return k.join(hits, [*keys, "gt", "source"], "left")


def tf_binding(edges, truths, genes, tfs, keys=()):
    """Precision at k against ground truths (gt, source, target), k being the number of true
    targets, normalised for chance; F1 of predicted factors against all factors, weighted over
    the ground truths by their number of factors. Returns (keys, gt, ..., f1) with gt 'all'."""
    keys = list(keys)
    n_tfs = (truths.join(tfs.select(F.col("tf").alias("source")), "source", "left_semi")
             .groupBy("gt").agg(F.count_distinct("source").alias("n_tfs")))
    d = target_overlap(edges, truths, genes, tfs, keys)
    chance = F.col("k") / F.col("n_targets")
    d = d.withColumn("norm", F.when(F.col("got").isNull(), 0.0).otherwise(F.try_divide(F.col("tp") / F.col("got") - chance, 1 - chance)))
    g = d.groupBy(*keys, "gt").agg(F.coalesce(F.avg(F.when(F.col("got").isNotNull(), F.col("norm"))), F.lit(0.0)).alias("precision"),
                                   F.avg("norm").alias("recall")).join(n_tfs, "gt")
    each = g.withColumn("f1", N.f1("precision", "recall")).select(*keys, "gt", "precision", "recall", "f1")
    total = N.weighted_f1(g, "precision", "recall", "n_tfs", keys).select(*keys, F.lit("all").alias("gt"), "precision", "recall", "f1")
    return each.unionByName(total)


# --- gene-set evidence -----------------------------------------------------------------------

def gs_recovery(edges, sets, expr, obs, tfs, min_size=5, max_size=500, min_targets=10, alpha=0.05, active_p=0.01, keys=(), genes=None):
    """Are the gene sets active in the data the ones enriched among factor targets? Precision,
    recall and F1 per library (and key). ``sets`` is (library, set_name, gene); ``genes`` (gene) is the
    measured universe, by default every gene with a stored value."""
    keys = list(keys)
    genes = expr.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    size = sets.groupBy("library", "set_name").agg(F.count_distinct("gene").alias("n")).where(F.col("n").between(min_size, max_size))
    sets = sets.join(size.select("library", "set_name"), ["library", "set_name"], "left_semi")
    n_sets = size.groupBy("library").agg(F.count("*").alias("n_sets"))
    net = sets.select(F.concat_ws("|", "library", "set_name").alias("source"), F.col("gene").alias("target"), F.lit(1.0).alias("weight"))
    active = cut(X.active_sets(X.ulm(expr, net, min_targets, obs, genes=genes), active_p).select("source", "is_active"), "active")
    uni = cut(O.universe(edges, tfs, genes, keys), "universe")
    inside = O.min_targets(edges.select(*keys, "source", "target").distinct().join(uni.select(*keys, F.col("gene").alias("target")), [*keys, "target"], "left_semi"), min_targets, keys)
    if keys:
        p = N.enrich(inside, sets, None, keys, genes=uni)
        active = attach_all(active, edges.select(*keys).distinct())
    else:
        p = N.enrich(inside, sets, uni.select(F.count("*")).scalar(), genes=uni)
    hit = (p.join(n_sets, "library").where(F.col("p") < alpha / F.col("n_sets")).select(*keys, F.concat_ws("|", "library", "set_name").alias("source"))
           .distinct().withColumn("is_enriched", F.lit(True)))
    d = active.join(hit, [*keys, "source"], "left").fillna(False, ["is_enriched"]).withColumn("library", F.substring_index("source", "|", 1))
    return N.prf(d, "is_active", "is_enriched", [*keys, "library"])


# --- replicate consistency -------------------------------------------------------------------

def replicate_consistency(edges, expr, groups, sizes=None, min_targets=5, keys=()):
    """Agreement of factor activities between replicates, averaged over nested selections of the
    most central factors. An activity does not depend on the selection, so it is computed once.
    ``groups`` is (obs_id, grp)."""
    keys, sizes = list(keys), sizes or E.linear_sizes()
    e = edges.select(*keys, "source", "target", "weight")
    act = X.ulm(expr, O.min_targets(e, min_targets) if not keys else e, min_targets, groups, keys)
    mad = X.dispersion(act, groups, keys).select(*keys, "tf", "mad")
    arr = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("rank"))
    d = cut(mad.join(E.tf_centrality(e, keys), [*keys, "tf"]), "mad").withColumn("n_tfs", F.explode(arr))
    top = d.groupBy(*keys, "n_tfs").agg(F.percentile("mad", F.lit(0.95)).alias("p95"))
    d = d.join(top, [*keys, "n_tfs"]).withColumn("c", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("mad", "p95"))))
    s = d.groupBy(*keys, "n_tfs").agg((F.sum(F.coalesce("c", F.lit(0.0))) / F.first("n_tfs")).alias("s"))
    return s.groupBy(*keys).agg((F.sum("s") / len(sizes)).alias("value")).select(*keys, F.lit("replicate_consistency").alias("metric"), "value")


def robustness(edges, expr, groups, degrees=(0.0, 0.2, 0.5, 1.0), keys=()):
    """Replicate consistency under every kind and degree of noise, of all networks in one job."""
    keys = list(keys)
    sweep = cut(Z.noise_sweep(edges, degrees, keys=keys), "noise")
    s = cut(replicate_consistency(sweep, expr, groups, keys=("noise", "level", *keys)).select("noise", "level", *keys, "value"), "robustness")
    base = s.where("level = 0").select("noise", *keys, F.col("value").alias("base"))
    return s.join(base, ["noise", *keys]).select("noise", "level", *keys, "value", (F.col("base") - F.col("value")).alias("drop"))


# --- structural equations --------------------------------------------------------------------

def _sem_half(edges, genes, expr, obs, strict, loose, cv, early, penalise, keys=()):
    """Mean R2 of one half per key; ``genes`` is (gene) or (keys, gene)."""
    keys = list(keys)
    net = cut(E.edges_in(edges, genes, keys).where("source != target and weight != 0").select(*keys, "source", "target", "weight"), "net")
    if keys and keys[0] not in genes.columns:
        genes = attach_all(genes.select("gene"), edges.select(*keys).distinct())
    genes = genes.select(*keys, "gene")
    used = genes.select("gene").distinct()
    e = expr.join(used, "gene", "left_semi")
    ctrl = obs.where("is_control")
    sd = X.fit_scaler(e, ctrl)
    scaled = cut(e.join(sd, "gene").select("obs_id", "gene", (F.col("value") / F.col("sd")).alias("value")), "scaled")
    # centring: the mean of the controls is taken out inside the moments by the constant regressor
    m = J.moments(scaled.join(ctrl.select("obs_id"), "obs_id", "left_semi"), ctrl.select("obs_id", F.lit("control").alias("fold")),
                  left=net.select(F.col("source").alias("gene")))
    mu = m.where((F.col("a") == J.ONE) & (F.col("b") != J.ONE)).select("b", F.col("s").alias("mb"))
    n = m.where((F.col("a") == J.ONE) & (F.col("b") == J.ONE)).select(F.max("s")).scalar()
    c = m.where(F.col("a") != J.ONE).join(mu.withColumnsRenamed({"b": "a", "mb": "ma"}), "a").join(mu, "b").withColumn("_n", n)
    c = c.select("fold", "a", "b", (F.col("s") - F.col("ma") * F.col("mb") / F.col("_n")).alias("s"))
    c = c.unionByName(m.where((F.col("a") == J.ONE) & (F.col("b") == J.ONE)).select("fold", "a", "b", "s"))
    w = cut(J.refit_elastic(net, c, keys=keys), "weights")
    delta, _ = X.perturbation_delta(scaled, obs, strict, loose)
    pert = obs.where("not is_control")
    delta = cut(delta.join(pert.select("obs_id"), "obs_id", "left_semi"), "delta")
    rep = cut(net.select(*keys, F.col("source").alias("gene")).union(genes.join(early, "gene", "left_semi").select(*keys, "gene")).distinct(), "reporters")
    shocks = J.shock_estimate(delta, w, rep, keys=keys)
    hat = J.propagate(shocks, w, keys=keys)
    test = Z.group_shuffle(pert.withColumn("_g", F.concat_ws("_", *cv)), "_g").where("not is_train").select("obs_id")
    heads = net.select(*keys, F.col("target").alias("gene")).distinct()
    evaluated = genes.join(rep, [*keys, "gene"], "left_anti")
    have = cut(evaluated.join(heads, [*keys, "gene"], "left_semi"), "have")
    grid = X.densify(delta, test, have.select("gene").distinct()).withColumnRenamed("value", "y")
    grid = spread_join(grid, have, ["gene"], ["obs_id"]) if keys else grid
    pred = grid.join(hat.withColumnRenamed("value", "y_hat"), [*keys, "obs_id", "gene"], "left").fillna(0.0, ["y_hat"])
    r2 = X.gene_r2(pred, keys)
    if penalise:
        r2 = evaluated.join(r2, [*keys, "gene"], "left").fillna(0.0, ["r2"])
    value = r2.groupBy(*keys).agg(F.coalesce(F.avg("r2"), F.lit(0.0)).alias("value"))
    # a network none of whose genes are evaluated scores 0 too
    return edges.select(*keys).distinct().join(value, keys, "left").fillna(0.0, ["value"]) if keys else value


def sem(edges, expr, obs, strict, loose, cv, early, n_top=3000, keys=()):
    """Linear structural equations on the network: weights refitted on controls, shocks read from
    reporter genes, response of the other genes predicted on unseen groups. Mean of a half on the
    most connected genes and a half on highly variable genes. The gradient refinement of the
    weights is left out. (keys, metric, value)"""
    grn = E.top_connected(edges.where("weight != 0"), n_top, "max", keys).select(*keys, "gene").join(expr.select("gene").distinct(), "gene", "left_semi")
    hv = X.hvg(expr, obs, n_top).select("gene")
    a = _sem_half(edges, cut(grn, "genes"), expr, obs, strict, loose, cv, early, False, keys)
    b = _sem_half(edges, cut(hv, "genes"), expr, obs, strict, loose, cv, early, True, keys)
    return one(a.unionByName(b).groupBy(*keys).agg(F.avg("value").alias("value")), "sem", keys=keys)


# --- prediction of unseen perturbations ------------------------------------------------------

def _vc_half(edges, genes, expr, obs, strict, loose, cv, keys=(), cells=False):
    """(keys, value) and (keys, pds) of one half; ``genes`` is (gene) or (keys, gene)."""
    keys = list(keys)
    net = E.edges_in(edges, genes, keys).where("source != target and weight != 0")
    heads = cut(net.select(*keys, F.col("target").alias("gene")).distinct().withColumn("_h", F.lit(1)), "heads")
    if keys and keys[0] not in genes.columns:
        genes = attach_all(genes.select("gene"), edges.select(*keys).distinct())
    genes = cut(genes.select(*keys, "gene"), "keyed-genes")
    used = genes.select("gene").distinct()
    e = cut(expr.join(used, "gene", "left_semi").select("obs_id", "gene", "value"), "expr")
    o = obs.withColumn("_g", F.concat_ws("_", *cv))
    f = cut(o.join(Z.group_kfold(o, "_g"), "_g").select("obs_id", "perturbation", "is_control", "fold"), "folds")
    sd = cut(X.fold_scaler(e, f), "scale")  # each fold by its training samples alone
    delta, match = X.perturbation_delta(e, obs, strict, loose)
    delta = cut(delta.join(f.where("not is_control").select("obs_id", "fold"), "obs_id"), "delta")
    # mean response of the training folds: all folds minus the own one
    per = delta.groupBy("gene", "fold").agg(F.sum("value").alias("s"))
    size = f.where("not is_control").groupBy("fold").agg(F.count("*").alias("n"))
    tot, n_all = per.groupBy("gene").agg(F.sum("s").alias("ts")), size.select(F.sum("n")).scalar()
    folds = size.withColumn("rest", n_all - F.col("n"))
    mean = (attach_all(tot, folds.select("fold", "rest")).join(per, ["gene", "fold"], "left")
            .select("gene", "fold", ((F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.col("rest")).alias("mean")))
    test = f.where("not is_control")
    y = X.densify(e, test, used).withColumnRenamed("value", "y").join(test.select("obs_id", "fold"), "obs_id")
    ctrl = match.join(e.select(F.col("obs_id").alias("control_id"), "gene", F.col("value").alias("c")), "control_id").select("obs_id", "gene", "c")
    flat = (y.join(ctrl, ["obs_id", "gene"], "left").join(mean, ["gene", "fold"], "left")
            .join(sd, ["gene", "fold"], "left").withColumn("sd", F.coalesce("sd", F.lit(1.0)))
            .select("obs_id", "gene", "fold", (F.col("y") / F.col("sd")).alias("y"), (F.coalesce("c", F.lit(0.0)) / F.col("sd")).alias("c"),
                    (F.coalesce("mean", F.lit(0.0)) / F.col("sd")).alias("mean")))
    # only genes with a regulator respond; everything before this line is the same for all networks
    own = genes.join(heads, [*keys, "gene"], "left").select(*keys, "gene", F.coalesce("_h", F.lit(0)).alias("_h"))
    pred = cut(spread_join(cut(flat, "flat"), own, ["gene"], ["obs_id"]).select(
        *keys, "obs_id", "gene", "fold", "y", (F.col("c") + F.when(F.col("_h") == 1, F.col("mean")).otherwise(0.0)).alias("y_hat")), "pred")
    r2 = X.pooled_r2(pred, keys).groupBy(*keys).agg(F.avg("r2").alias("value"))
    hat = pred.select(*keys, "obs_id", "gene", F.col("y_hat").alias("value")).where("value != 0")
    if cells:  # every predicted sample is an item of its own
        item = hat.join(test.select("obs_id", "perturbation"), "obs_id").withColumnRenamed("obs_id", "item")
    else:
        item = X.profiles(hat, test, keys=keys).withColumn("item", F.lit("mean"))
    true = pred.select(*keys, "obs_id", "gene", F.col("y").alias("value")).where("value != 0")
    p = X.pds(cut(item, "item"), cut(X.profiles(true, test, keys=keys), "true"), keys=keys).groupBy(*keys).agg(F.avg("pds").alias("pds"))
    return r2, p


def vc(edges, expr, obs, strict, loose, cv, n_grn=1000, n_top=3000, keys=(), cells=False):
    """Prediction of held-out perturbed samples: matched control plus the mean training response
    of genes that the network gives a regulator. vc is the mean R2 of a half on connected and a
    half on variable genes; vc_pds the perturbation discrimination of the same predictions, of mean
    profiles or, with ``cells``, of every predicted sample. (keys, metric, value)"""
    grn = E.top_connected(edges.where("weight != 0"), n_grn, "sum", keys).select(*keys, "gene").join(expr.select("gene").distinct(), "gene", "left_semi")
    r1, p1 = _vc_half(edges, cut(grn, "genes"), expr, obs, strict, loose, cv, keys, cells)
    r2, p2 = _vc_half(edges, cut(X.hvg(expr, obs, n_top).select("gene"), "genes"), expr, obs, strict, loose, cv, keys, cells)
    r = r1.unionByName(r2).groupBy(*keys).agg(F.avg("value").alias("value"))
    p = p1.unionByName(p2).groupBy(*keys).agg(F.avg("pds").alias("value"))
    return one(r, "vc", keys=keys).unionByName(one(p, "vc_pds", keys=keys))


# --- stability and residual metrics ----------------------------------------------------------

def net_and_null(net, null, keys=()):
    """Both networks in one table, told apart by ``net``: the keys and 'net' or 'null' as JSON."""
    tag = lambda kind: F.to_json(F.struct(*keys, F.lit(kind).alias("_kind"))).alias("net")
    return net.select(tag("net"), "source", "target").unionByName(null.select(tag("null"), "source", "target"))


def untag(df, keys, kinds):
    """Keys and kind read back from ``net``."""
    cols = [F.get_json_object("net", f"$.{k}").cast(kinds[k]).alias(k) for k in keys]
    return df.select(*cols, F.get_json_object("net", "$._kind").alias("kind"), *[c for c in df.columns if c != "net"])


def side_by_side(df, by, value):
    """(by, a, b): the value of the network and of its null where both have one."""
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col(value)))
    return df.groupBy(*by).agg(of("net").alias("a"), of("null").alias("b")).where("a is not null and b is not null")


def anchor_regression(edges, expr, obs, anchor, n_top=1000, keys=()):
    """Stability of selected regulators against the degree-preserving null: -log10 of the
    signed-rank p when significant, and the mean difference. Candidates are the genes that any of
    the networks ranks among its ``n_top`` most connected; each network's edges lie among its own."""
    keys = list(keys)
    genes = cut(E.top_connected(edges, n_top, "max", keys).select(*keys, "gene").join(expr.select("gene").distinct(), "gene", "left_semi"), "genes")
    net = E.edges_in(edges, genes, keys).where("source != target and weight != 0")
    both = cut(net_and_null(net, Z.degree_null(net, extra=keys), keys), "nets")
    m = J.moments(expr.join(genes, "gene", "left_semi"), obs.select("obs_id", F.col(anchor).alias("fold")))
    s = untag(J.stability(both, m), keys, dict(edges.dtypes))
    p = cut(side_by_side(s, [*keys, "target"], "stability"), "pairs")
    z = N.signed_rank(p, "a", "b", keys).withColumn("p", F.greatest(norm_p_two("z"), F.lit(1e-300)))
    score = z.select(*keys, F.when(F.col("p") < 0.05, -F.log10("p")).otherwise(0.0).alias("value"))
    raw = p.groupBy(*keys).agg((F.avg("a") - F.avg("b")).alias("value"))
    return one(score, "anchor_regression", keys=keys).unionByName(one(raw, "anchor_regression_raw", keys=keys))


def correlation_consistency(edges, expr, obs, group, n_tfs=100, max_targets=100, keys=(), genes=None):
    """Do correlations along the network agree between groups better than for random targets?
    Lift of the mean and -log10 p, averaged over factor-target and target-target scores. Random
    targets come from the genes that the network uses; ``genes`` (gene) is the measured universe."""
    keys = list(keys)
    genes = expr.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    net = cut(E.edges_in(edges, genes).where("source != target and weight != 0").select(*keys, "source", "target", "weight"), "net")
    used = net.select(F.col("source").alias("gene")).union(net.select(F.col("target").alias("gene"))).distinct()
    o = O.valid_groups(obs.select("obs_id", F.col(group).alias("grp")), "grp", 3)
    c = X.correlation(expr.join(used, "gene", "left_semi").join(o, "obs_id"), o, "spearman", ["grp"])
    spread = G.corr_spread(c, n_groups=o.select(F.count_distinct("grp")).scalar())
    both = net.withColumn("kind", F.lit("net")).unionByName(Z.random_partners(net, used, extra=keys).withColumn("kind", F.lit("null")))
    both = G.select_targets(cut(both, "nets"), n_tfs, max_targets, [*keys, "kind"])
    s = cut(G.coregulation(both, spread, [*keys, "kind"]), "scores")
    s = s.select(*keys, "source", "kind", F.explode(F.array(F.struct(F.lit("tf_tg").alias("what"), F.col("tf_tg").alias("v")), F.struct(F.lit("tg_tg").alias("what"), F.col("tg_tg").alias("v")))).alias("x"))
    p = cut(side_by_side(s.select(*keys, "source", "kind", "x.*"), [*keys, "source", "what"], "v"), "pairs")
    z = N.signed_rank(p, "a", "b", [*keys, "what"], "pratt", "greater").select(*keys, "what", (-F.log10(F.greatest(norm_p_greater("z"), F.lit(1e-300)))).alias("score"))
    lift = p.groupBy(*keys, "what").agg((F.avg("a") / (F.avg("b") + 1e-10)).alias("lift"))
    out = lift.join(z, [*keys, "what"]).groupBy(*keys).agg(F.avg("lift").alias("rc_precision"), F.avg("score").alias("rc_balanced"))
    return wide_to_long(out, ["rc_precision", "rc_balanced"], keys)


def residual_metric(edges, expr, obs, group, n_top=2000, keys=()):
    """Is what the regulators leave unexplained unrelated to the other genes, compared with
    shuffled regulators? Ratio of mean correlations and -log10 p. The other genes are those that any
    of the networks ranks among its ``n_top`` most connected."""
    keys = list(keys)
    genes = cut(E.top_connected(edges, n_top, "max", keys).select(*keys, "gene").join(expr.select("gene").distinct(), "gene", "left_semi"), "genes")
    net = E.edges_in(edges, genes, keys).where("source != target and weight != 0").select(*keys, "source", "target", "weight")
    null = Z.random_partners(net, genes.select("gene").distinct(), by="target", extra=keys)
    m = J.moments(expr.join(genes, "gene", "left_semi"), obs.select("obs_id", F.col(group).alias("fold")))
    s = untag(J.residual_corr(cut(net_and_null(net, null, keys), "nets"), m), keys, dict(edges.dtypes))
    p = cut(side_by_side(s, [*keys, "fold", "target"], "score"), "pairs")
    z = N.signed_rank(p, "b", "a", keys, "wilcox", "greater")
    score = z.select(*keys, (-F.log10(F.greatest(norm_p_greater("z"), F.lit(1e-300)))).alias("value"))
    lift = p.groupBy(*keys).agg((F.avg("a") / (F.avg("b") + 1e-6)).alias("value"))
    return one(lift, "reg3_precision", keys=keys).unionByName(one(score, "reg3_balanced", keys=keys))
