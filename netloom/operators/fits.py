"""Per-target model fits from moments.

Every fit here needs only sums of products: X'X, X'y, y'y and column sums, per fold. Spark adds
these over all samples (blocked products, see operators.blocks); a fit then sees one small matrix
per target, whose size follows the number of regulators and never the number of samples.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.stats import t_tail, top_k
from netloom.functions import det
from netloom.functions.skew import spread_join
from netloom.operators.blocks import attach_all, pair_sums
from netloom.operators.dense import deal, inverse, square
from netloom.operators.nulls import draw
from netloom.session import cut

ONE = ""  # the constant regressor
WIDTH = 512  # genes of a matrix block


def moments(expr: DataFrame, samples: DataFrame, key="fold", left=None) -> DataFrame:
    """Moment table (key, a, b, s) with a <= b. The constant is a gene named '', so sums and
    counts are rows of the same table. ``samples`` is (obs_id, key). With ``left`` (gene) only
    pairs with one of these genes are formed, and the squares of all genes."""
    e = cut(expr.where("value != 0").select("obs_id", "gene", "value").join(samples.select("obs_id", key), "obs_id"), "samples")
    if left is None:
        prod = pair_sums(e, e, "obs_id", "gene", "value", "dot", [key], upper=True)
    else:
        one = left.select("gene").distinct()
        p = pair_sums(e.join(one, "gene", "left_semi"), e, "obs_id", "gene", "value", "dot", [key])
        p = p.join(one.select(F.col("gene").alias("b"), F.lit(True).alias("_both")), "b", "left")
        p = p.where((F.col("a") != F.col("b")) & (F.col("_both").isNull() | (F.col("a") < F.col("b"))))
        squares = e.groupBy(key, "gene").agg(F.sum(F.col("value") * F.col("value")).alias("s"))
        prod = p.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").unionByName(
            squares.select(key, F.col("gene").alias("a"), F.col("gene").alias("b"), "s"))
    sums = e.groupBy(key, F.col("gene").alias("b")).agg(F.sum("value").alias("s")).select(key, F.lit(ONE).alias("a"), "b", "s")
    n = samples.groupBy(key).agg(F.count("*").cast("double").alias("s")).select(key, F.lit(ONE).alias("a"), F.lit(ONE).alias("b"), "s")
    return cut(prod.unionByName(sums).unionByName(n), "moments")


def scale_moments(m: DataFrame, scale: DataFrame) -> DataFrame:
    """Moments of gene / scale, from a (gene, scale) table."""
    one = scale.select("gene", "scale")
    a = one.select(F.col("gene").alias("a"), F.col("scale").alias("_sa"))
    b = one.select(F.col("gene").alias("b"), F.col("scale").alias("_sb"))
    return (m.join(a, "a", "left").join(b, "b", "left")
            .withColumn("s", F.col("s") / (F.coalesce("_sa", F.lit(1.0)) * F.coalesce("_sb", F.lit(1.0)))).drop("_sa", "_sb"))


def design(regs: DataFrame, m: DataFrame, key="fold", keys=(), by=()) -> DataFrame:
    """Moments each target needs: all pairs among its regulators, itself and the constant.
    ``regs`` is (keys, target, source[, model columns]): many networks are one design. ``by`` are
    columns of ``m`` that part the samples; a network that carries one meets its own part only."""
    keys = list(keys)
    mem = regs.where("source is not null").select(*keys, "target", F.col("source").alias("g")).unionByName(
        regs.select(*keys, "target", F.col("target").alias("g"))).unionByName(
        regs.select(*keys, "target", F.lit(ONE).alias("g"))).distinct()
    # one normal matrix per target: list its cells, then look them up
    pairs = mem.withColumnRenamed("g", "a").join(mem.withColumnRenamed("g", "b"), [*keys, "target"]).where("a <= b")
    out = list(dict.fromkeys([*keys, *by]))
    return pairs.join(m, ["a", "b", *[c for c in by if c in keys]]).select(*out, "target", key, "a", "b", "s")


def per_target(d: DataFrame, fit, schema: str, keys=()) -> DataFrame:
    """``fit`` on each target's rows, its result led by the key columns."""
    keys, kinds = list(keys), dict(d.dtypes)

    def run(pdf):
        out = fit(pdf)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return d.groupBy(*keys, "target").applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def _matrices(pdf, key):
    """Regulator names and, per key, the symmetric moment matrix [const, regulators..., target]."""
    target = pdf["target"].iloc[0]
    names = sorted(set(pdf["a"]) | set(pdf["b"]) - {target})
    names = [ONE] + [x for x in names if x not in (ONE, target)] + [target]
    idx = {g: i for i, g in enumerate(names)}
    out = {}
    for k, g in pdf.groupby(key, sort=True):
        s = np.zeros((len(names), len(names)))
        i, j = g["a"].map(idx).to_numpy(), g["b"].map(idx).to_numpy()
        s[i, j] = g["s"].to_numpy()
        s[j, i] = g["s"].to_numpy()
        out[k] = s
    return target, names[1:-1], out


def _centered(s):
    n = s[0, 0]
    mu = s[0, 1:] / n
    return n, mu, s[1:, 1:] - n * np.outer(mu, mu)


def ridge_solve(s, alpha, intercept=True):
    """Coefficients and intercept of a ridge fit on one moment matrix."""
    if intercept:
        _, mu, c = _centered(s)
    else:
        mu, c = np.zeros(len(s) - 1), s[1:, 1:]
    k = len(c) - 1
    beta = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k]) if k else np.zeros(0)
    return beta, mu[k] - mu[:k] @ beta


def residual_ss(s, beta, b0):
    """Sum of squared residuals on the samples behind a moment matrix."""
    w = np.concatenate([[-b0], -beta, [1.0]])
    return float(w @ s @ w)


def fold_r2(mats, alpha=1.0):
    """Mean test R2 of leave-one-fold-out ridge, clipped to [0, 1]."""
    total = sum(mats.values())
    scores = []
    for s in mats.values():
        beta, b0 = ridge_solve(total - s, alpha)
        rss, tss = max(residual_ss(s, beta, b0), 0.0), s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
        scores.append(1 - rss / tss if tss > 1e-9 else (1.0 if rss < 1e-9 else 0.0))
    return float(np.clip(np.mean(scores), 0, 1)) if scores else 0.0


def ridge_cv(regs: DataFrame, m: DataFrame, alpha=1.0, keys=(), by=()) -> DataFrame:
    """(keys, target, n_regulators, r2) by leave-one-fold-out ridge on the given regulators; 0 without any."""
    def fit(pdf):
        target, names, mats = _matrices(pdf, "fold")
        return pd.DataFrame({"target": [target], "n_regulators": [len(names)], "r2": [fold_r2(mats, alpha) if names else 0.0]})

    return per_target(design(regs, m, "fold", keys, by), fit, "target string, n_regulators int, r2 double", list(dict.fromkeys([*keys, *by])))


def select_regulators(edges: DataFrame, tfs: DataFrame, consensus: DataFrame, seed=0xCAFE, keys=()) -> DataFrame:
    """Top-n regulators of each target, n from the consensus table (gene, n). Where a network
    names fewer, random factors fill up, in hash order. Returns (keys, target, source, rn); a target
    without any possible regulator is one row with null source, which the fit scores 0."""
    keys = list(keys)
    need = consensus.where("n > 0").select(F.col("gene").alias("target"), "n")
    if keys:
        need = attach_all(need, edges.select(*keys).distinct())
    on = [*keys, "target"]
    factors = tfs.select(F.col("tf").alias("source")).distinct()
    named = (edges.where("source != target and weight != 0").select(*keys, "source", "target", "weight").join(factors, "source", "left_semi").join(need, on))
    order = [F.abs("weight").desc(), det.hash_key("source", "target", seed=seed), F.col("source")]
    chosen = cut(top_k(named, on, order, F.col("n"), ["source"], out="rn").select(*on, "source", "rn"), "named")
    have = chosen.groupBy(*on).agg(F.count("*").alias("have"))
    short = need.join(have, on, "left").fillna(0, ["have"]).where("have < n")
    # as many draws as places, own gene and named factors: what is left after these is enough
    fill = draw(short, factors, "target", "source", F.col("n") + 1, seed).where("source != target").join(chosen, [*on, "source"], "left_anti")
    fill = fill.withColumn("rn", F.col("have") + F.row_number().over(W.partitionBy(*on).orderBy("_j"))).where("rn <= n")
    chosen = chosen.unionByName(fill.select(*on, "source", F.col("rn").cast("int").alias("rn")))
    return need.select(*on).join(chosen, on, "left")


def raw_regulators(edges: DataFrame, tfs: DataFrame, more_than=2, keys=()) -> DataFrame:
    """All factor regulators of targets that have more than two."""
    keys = list(keys)
    e = (edges.where("source != target and weight != 0").join(tfs.select(F.col("tf").alias("source")), "source", "left_semi")
         .select(*keys, "target", "source").distinct())
    keep = e.groupBy(*keys, "target").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select(*keys, "target")
    return e.join(keep, [*keys, "target"], "left_semi")


def elastic_net(s, alpha=0.001, l1=0.5, rounds=1000, tol=1e-8):
    """Elastic net without intercept by coordinate descent on a moment matrix."""
    n, x, left = s[0, 0], s[1:-1, 1:-1], s[1:-1, -1].astype(float)  # left: y - x @ beta, kept up to date
    own, cut_, beta = np.diag(x).tolist(), n * alpha * l1, [0.0] * len(x)
    for _ in range(rounds):
        step = 0.0
        for j, old in enumerate(beta):
            if own[j] <= 0:
                continue
            rho = left.item(j) + own[j] * old
            new = math.copysign(max(abs(rho) - cut_, 0.0), rho) / (own[j] + n * alpha * (1 - l1))
            beta[j] = new
            if new != old:
                left -= x[j] * (new - old)
                step = max(step, abs(new - old))
        if step < tol:
            break
    return np.array(beta)


def refit_elastic(edges: DataFrame, m: DataFrame, alpha=0.001, signed=False, keys=()) -> DataFrame:
    """New weights on a fixed topology; ``signed`` drops weights of the wrong sign."""
    keys = list(keys)

    def fit(pdf):
        target, names, mats = _matrices(pdf, "fold")
        beta = elastic_net(sum(mats.values()), alpha)
        return pd.DataFrame({"source": names, "target": target, "weight": beta})

    e = edges.where("source != target and weight != 0").select(*keys, "source", "target", F.col("weight").alias("_w"))
    out = per_target(design(e, m, "fold", keys), fit, "source string, target string, weight double", keys)
    out = out.join(e, [*keys, "source", "target"])
    if signed:
        out = out.withColumn("weight", F.when(F.col("weight") * F.col("_w") < 0, 0.0).otherwise(F.col("weight")))
    return out.select(*keys, "source", "target", "weight")


def propagate(shocks: DataFrame, edges: DataFrame, steps=2, keys=()) -> DataFrame:
    """Shocks pushed through the network: shock + shock A + shock A A (keys, obs_id, gene, value).
    Shocks without the key columns go through every network."""
    keys = list(keys)
    term = shocks.select(*[k for k in keys if k in shocks.columns], "obs_id", "gene", "value")
    if any(k not in shocks.columns for k in keys):
        term = attach_all(term, edges.select(*[k for k in keys if k not in shocks.columns]).distinct())
    total = term = term.select(*keys, "obs_id", "gene", "value")
    for _ in range(steps):
        term = (spread_join(term.withColumnRenamed("gene", "source"), edges.select(*keys, "source", "target", "weight"), [*keys, "source"], ["obs_id"])
                .groupBy(*keys, "obs_id", F.col("target").alias("gene")).agg(F.sum(F.col("value") * F.col("weight")).alias("value")))
        total = total.unionByName(term)
    return total.groupBy(*keys, "obs_id", "gene").agg(F.sum("value").alias("value"))


def shock_estimate(delta: DataFrame, edges: DataFrame, reporters: DataFrame, lam=0.001, chunk=512, keys=()) -> DataFrame:
    """Ridge estimate of the shocks behind reporter deltas, all regulators of a network at once.

    The response of every reporter to a unit shock on every regulator is a small table of the
    network; samples are cut in chunks, each chunk gets a copy of that table and solves the same
    normal equations for its samples only. ``reporters`` is (keys, gene).
    """
    keys = list(keys)
    unit = edges.where("weight != 0").select(*keys, "source").distinct().select(*keys, F.col("source").alias("obs_id"), F.col("source").alias("gene"), F.lit(1.0).alias("value"))
    rep = cut(reporters.select(*keys, "gene").distinct(), "reporters")
    resp = cut(propagate(unit, edges, keys=keys).join(rep, [*keys, "gene"], "left_semi").select(
        *keys, F.col("obs_id").alias("regulator"), "gene", "value"), "response")
    n = delta.agg(F.approx_count_distinct("obs_id")).first()[0]
    chunks = max(1, -(-n // chunk))
    y = spread_join(delta.select("obs_id", "gene", "value"), rep, ["gene"], ["obs_id"]).withColumn("_c", F.pmod(F.xxhash64("obs_id"), F.lit(chunks)))
    copies = resp.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "obs_id string, gene string, value double"])

    def solve(a, b):
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in [*keys, "obs_id", "gene", "value"]}).astype({"value": float})
        obs, oi = np.unique(a["obs_id"], return_inverse=True)
        reg, ri = np.unique(b["regulator"], return_inverse=True)
        genes = pd.Index(np.unique(np.concatenate([a["gene"], b["gene"]])))
        ym, fm = np.zeros((len(obs), len(genes))), np.zeros((len(reg), len(genes)))
        ym[oi, genes.get_indexer(a["gene"])] = a["value"]
        fm[ri, genes.get_indexer(b["gene"])] = b["value"]
        d = np.linalg.solve(fm @ fm.T + lam * np.eye(len(reg)), fm @ ym.T).T
        return pd.DataFrame({**{k: a[k].iloc[0] for k in keys}, "obs_id": np.repeat(obs, len(reg)), "gene": np.tile(reg, len(obs)), "value": d.ravel()})

    return y.groupBy(*keys, "_c").cogroup(copies.groupBy(*keys, "_c")).applyInPandas(solve, schema)


def anchor_shift(expr: DataFrame, obs: DataFrame, anchor: str, gamma: float) -> DataFrame:
    """x + (sqrt(gamma) - 1) * mean(x | anchor group). ``expr`` is dense."""
    e = expr.join(obs.select("obs_id", anchor), "obs_id")
    mean = e.groupBy("gene", anchor).agg(F.avg("value").alias("_m"))
    return e.join(mean, ["gene", anchor]).select(
        "obs_id", "gene", (F.col("value") + (float(gamma) ** 0.5 - 1) * F.col("_m")).alias("value"))


def stability(edges_by_net: DataFrame, m: DataFrame, gammas=(1.0, 1.2), l2=1e-6, width=WIDTH) -> DataFrame:
    """Per target: do selected regulators keep large coefficients under both anchor strengths?

    ``m`` are moments per anchor group. Standardising, the anchor shift and both covariance
    matrices follow from them: the shift adds (gamma - 1) times the between-group part. All
    coefficients of one target against all other genes are a column of the inverse covariance, which
    is found in blocks of ``width`` genes (operators.dense), so no task holds the whole matrix.
    ``edges_by_net`` is (net, source, target); every gene of ``m`` is a candidate.
    """
    cells, place = anchored_covariance(m, gammas, l2, width)
    inv = inverse(cells, ["gamma"])
    both = cut(inv.where(F.col("gamma") == 0).select("i", "j", F.col("data").alias("x")).join(
        inv.where(F.col("gamma") == 1).select("i", "j", F.col("data").alias("y")), ["i", "j"]), "inverse")
    places = [place.select(F.col("gene").alias(g), F.col("block").alias(b), F.col("pos").alias(p)) for g, b, p in (("source", "i", "r"), ("target", "j", "c"))]
    sel = edges_by_net.where("source != target").select("net", "source", "target").distinct().join(places[0], "source").join(places[1], "target")

    def columns(batches):
        """Per block and column: sums of |x|, |y| and |xy| off the diagonal, and the diagonal."""
        for pdf in batches:
            for i, j, x, y in zip(pdf["i"], pdf["j"], pdf["x"], pdf["y"]):
                x, y = (square(v, width) for v in (x, y))
                dx, dy = (np.diag(v).copy() if i == j else np.zeros(width) for v in (x, y))
                x, y = np.abs(x), np.abs(y)
                if i == j:
                    np.fill_diagonal(x, 0), np.fill_diagonal(y, 0)
                yield pd.DataFrame({"j": j, "c": np.arange(width), "sx": x.sum(0), "sy": y.sum(0), "sxy": (x * y).sum(0), "dx": dx, "dy": dy})

    def pick(edges, cells_):
        if edges.empty or cells_.empty:
            return pd.DataFrame(columns=["net", "target", "j", "c", "xy"])
        x, y = (square(cells_[k].iloc[0], width) for k in ("x", "y"))
        r, c = edges["r"].to_numpy(), edges["c"].to_numpy()
        return pd.DataFrame({"net": edges["net"], "target": edges["target"], "j": edges["j"], "c": c, "xy": np.abs(x[r, c] * y[r, c])})

    total = both.mapInPandas(columns, "j int, c int, sx double, sy double, sxy double, dx double, dy double").groupBy("j", "c").agg(
        *[F.sum(k).alias(k) for k in ("sx", "sy", "sxy", "dx", "dy")])
    hit = sel.groupBy("i", "j").cogroup(both.groupBy("i", "j")).applyInPandas(pick, "net string, target string, j int, c int, xy double")
    hit = hit.groupBy("net", "target", "j", "c").agg(F.sum("xy").alias("s1"), F.count("*").alias("k1"))
    # coefficients are entries over the diagonal, normalised by the column's sum of them
    dx, dy = F.abs("dx"), F.abs("dy")
    unit = dx * dy * (F.col("sx") / dx + 1e-50) * (F.col("sy") / dy + 1e-50)
    kt = place.count() - 1
    d = hit.join(total, ["j", "c"]).where(F.col("k1") < kt)
    s1, s2 = F.col("s1") / unit / F.col("k1"), (F.col("sxy") - F.col("s1")) / unit / (F.lit(kt) - F.col("k1"))
    return d.select("net", "target", ((s1 - s2) / (s1 + s2 + 1e-50)).alias("stability"))


def anchored_covariance(m: DataFrame, gammas, l2, width) -> tuple[DataFrame, DataFrame]:
    """Blocks (gamma, i, j, data) of the standardised covariance under each anchor strength, plus
    ``l2`` on the diagonal, and the genes' places (gene, block, pos). Unused places are identity rows."""
    sums = m.where((F.col("a") == ONE) & (F.col("b") != ONE)).select("fold", F.col("b").alias("gene"), "s")
    n = m.where((F.col("a") == ONE) & (F.col("b") == ONE)).select("fold", F.col("s").alias("n"))
    square_ = m.where((F.col("a") == F.col("b")) & (F.col("a") != ONE)).groupBy(F.col("a").alias("gene")).agg(F.sum("s").alias("q"))
    pairs = m.where(F.col("a") != ONE)
    genes = cut(sums.select("gene").union(pairs.select("a")).union(pairs.select("b")).distinct(), "genes")
    blocks = -(-genes.count() // width) or 1
    # places are dealt in blocks of hash order, so no window sees all genes; a block that got too many passes them on
    place = deal(genes, blocks, width)
    folds = {r.fold: r.n for r in n.collect()}  # one number per anchor group
    order, size = sorted(folds), float(sum(folds.values()))
    stats = (place.join(square_, "gene", "left").join(sums.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("fold", "s"))).alias("v")), "gene", "left")
             .groupBy("block").agg(F.collect_list(F.struct("pos", "q", "v")).alias("st")))
    at = [place.select(F.col("gene").alias(g), F.col("block").alias(b), F.col("pos").alias(p)) for g, b, p in (("a", "i", "r"), ("b", "j", "c"))]
    full = pairs.groupBy("a", "b").agg(F.sum("s").alias("s"))
    full = full.unionByName(full.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    entries = full.join(at[0], "a").join(at[1], "b").select("i", "j", "r", "c", "s")
    left = stats.select(F.col("block").alias("i"), F.col("st").alias("st_i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    frames = left.join(stats.select(F.col("block").alias("j"), F.col("st").alias("st_j")), "j")

    def vectors(st):
        q, v, used = np.zeros(width), np.zeros((width, len(order))), np.zeros(width, bool)
        for x in st:
            used[x["pos"]], q[x["pos"]] = True, x["q"] or 0.0
            of = dict(x["v"] or ())
            v[x["pos"]] = [of.get(f, 0.0) for f in order]
        mu = v.sum(1) / size
        sd = np.sqrt(np.maximum(q / size - mu ** 2, 0))
        sd[sd < 1e-12] = 1.0
        return mu, sd, v, used

    def build(e, f):
        if f.empty:
            return pd.DataFrame(columns=["gamma", "i", "j", "data"])
        i, j = int(f["i"].iloc[0]), int(f["j"].iloc[0])
        (mi, si, vi, ui), (mj, sj, vj, uj) = vectors(f["st_i"].iloc[0]), vectors(f["st_j"].iloc[0])
        s = np.zeros((width, width))
        s[e["r"].astype(int), e["c"].astype(int)] = e["s"]
        outer = size * np.outer(mi, mj)
        between = (vi / np.array([folds[k] for k in order])) @ vj.T - outer
        out = []
        for g, gamma in enumerate(gammas):
            cov = (s - outer + (gamma - 1) * between) / np.outer(si, sj) / size
            if i == j:
                cov += np.diag(np.where(ui, l2, 1.0))
            out.append((g, i, j, cov.tobytes()))
        return pd.DataFrame(out, columns=["gamma", "i", "j", "data"])

    cells = entries.groupBy("i", "j").cogroup(frames.groupBy("i", "j")).applyInPandas(build, "gamma int, i int, j int, data binary")
    return cells, place


def residual_corr(edges_by_net: DataFrame, m: DataFrame, alpha=10.0) -> DataFrame:
    """Left-out groups: residual of each target given its regulators, against every gene that is
    not a regulator; mean absolute correlation. (net, fold, target, score)

    Ridge fits on the other groups give coefficients; the covariances with all other genes are a
    join of coefficients with the left-out group's moments.
    """
    genes = m.where(F.col("a") == ONE).where(F.col("b") != ONE).select(F.col("b").alias("gene")).distinct()
    n_genes = genes.select(F.count("*")).scalar()
    e = edges_by_net.where("source != target").select(F.to_json(F.struct("net", "target")).alias("nt"), "net", "source", "target").distinct()
    mem = e.select("nt", F.col("source").alias("g"), "target").unionByName(
        e.select("nt", F.col("target").alias("g"), "target")).unionByName(e.select("nt", F.lit(ONE).alias("g"), "target")).distinct()
    pairs = mem.withColumnRenamed("g", "a").join(mem.select("nt", F.col("g").alias("b")), "nt").where("a <= b")
    d = pairs.join(m, ["a", "b"])

    def fit(pdf):
        nt = pdf["nt"].iloc[0]
        _, names, mats = _matrices(pdf, "fold")
        total, rows = sum(mats.values()), []
        target = pdf["target"].iloc[0]
        for k, s in mats.items():
            tr = total - s
            n, mu, c = _centered(tr)
            sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
            sd[sd < 1e-12] = 1.0
            z = tr / np.outer(np.r_[1, sd], np.r_[1, sd])
            beta, b0 = ridge_solve(z, alpha)
            w = np.r_[-b0 * sd[-1], -beta / sd[:-1] * sd[-1], 1.0]  # residual weights on raw genes
            rss, rsum, nk = w @ s @ w, w @ s[0], s[0, 0]
            rows += [(nt, k, target, g, x, rss - rsum ** 2 / nk, rsum / nk, nk) for g, x in zip([ONE, *names, target], w)]
        return pd.DataFrame(rows, columns=["nt", "fold", "target", "g", "w", "rvar", "rmean", "n"])

    coef = cut(d.groupBy("nt").applyInPandas(
        fit, "nt string, fold string, target string, g string, w double, rvar double, rmean double, n double"), "residuals")
    both = m.select("fold", F.col("a").alias("g"), F.col("b").alias("z"), "s").unionByName(
        m.where("a != b").select("fold", F.col("b").alias("g"), F.col("a").alias("z"), "s")).where(F.col("z") != ONE)
    # the constant is a regressor of every target: hot (fold, g) keys are cut in slices
    cov = spread_join(coef, both, ["fold", "g"], ["nt"], per=2_000).groupBy("nt", "fold", "target", "z").agg(
        F.sum(F.col("w") * F.col("s")).alias("c"), F.max("rvar").alias("rvar"), F.max("rmean").alias("rmean"), F.max("n").alias("n"))
    zsum = m.where((F.col("a") == ONE) & (F.col("b") != ONE)).select("fold", F.col("b").alias("z"), F.col("s").alias("zs"))
    zvar = m.where((F.col("a") == F.col("b")) & (F.col("a") != ONE)).select("fold", F.col("a").alias("z"), F.col("s").alias("zq"))
    cov = cov.join(zsum, ["fold", "z"]).join(zvar, ["fold", "z"]).join(
        e.select("nt", F.col("source").alias("z")), ["nt", "z"], "left_anti")
    var = F.col("rvar") * (F.col("zq") - F.col("zs") * F.col("zs") / F.col("n"))
    r = F.when(var > 1e-12, F.abs((F.col("c") - F.col("zs") * F.col("rmean")) / F.sqrt(var))).otherwise(0.0)
    k = e.groupBy("nt").agg(F.count("*").alias("k"))
    # genes without any product row correlate 0 and still count in the mean
    return (cov.groupBy("nt", "fold", "target").agg(F.sum(r).alias("sr")).join(k, "nt").withColumn("g", n_genes).where("k < g - 1")
            .select(F.get_json_object("nt", "$.net").alias("net"), "fold", "target", (F.col("sr") / (F.col("g") - F.col("k"))).alias("score")))


def prior_ridge(regs: DataFrame, m: DataFrame, alpha=10.0, keys=()) -> DataFrame:
    """Ridge of each target on its prior regulators within each cluster, with the p-value of
    every coefficient. ``m`` has the cluster as its fold column."""
    def fit(pdf):
        target, names, mats = _matrices(pdf, "fold")
        out = []
        for k, s in mats.items():
            n, mu, c = _centered(s)
            p = len(names)
            if n <= p + 2 or not p:
                continue
            inv = np.linalg.inv(c[:p, :p] + alpha * np.eye(p))
            beta = inv @ c[:p, p]
            rss = max(c[p, p] - 2 * beta @ c[:p, p] + beta @ c[:p, :p] @ beta, 1e-300)
            dof = n - np.trace(inv @ c[:p, :p]) - 1
            se = np.sqrt(np.maximum(rss / dof * np.diag(inv @ c[:p, :p] @ inv), 1e-300))
            pv = 2 * t_tail(np.abs(beta / se), np.full(p, dof))
            out.append(pd.DataFrame({"cell_type": k, "source": names, "target": target, "weight": beta, "p": pv}))
        return pd.concat(out) if out else pd.DataFrame(columns=["cell_type", "source", "target", "weight", "p"])

    return per_target(design(regs, m, "fold", keys), fit, "cell_type string, source string, target string, weight double, p double", keys)


def partial_corr(corr: DataFrame, m: DataFrame, k=10, l2=1e-6) -> DataFrame:
    """Partial correlations by neighbourhood regression: each gene on its ``k`` most correlated
    genes; the coefficient's t gives the partial correlation. ``corr`` is (a, b, r)."""
    both = corr.select(F.col("a").alias("target"), F.col("b").alias("source"), "r").unionByName(
        corr.select(F.col("b").alias("target"), F.col("a").alias("source"), "r"))
    regs = top_k(both, ["target"], [F.abs(F.round("r", 9)).desc(), F.col("source")], k, ["source"]).select("target", "source")

    def fit(pdf):
        target, names, mats = _matrices(pdf, "fold")
        n, mu, c = _centered(sum(mats.values()))
        sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
        c = c / np.outer(sd, sd)
        p = len(names)
        inv = np.linalg.inv(c[:p, :p] + l2 * np.eye(p))
        beta = inv @ c[:p, p]
        dof = n - p - 1
        rss = max(1 - beta @ c[:p, p], 1e-12)
        t = beta / np.sqrt(rss / dof * np.diag(inv))
        return pd.DataFrame({"source": names, "target": target, "weight": t / np.sqrt(t * t + dof)})

    return per_target(design(regs, m), fit, "source string, target string, weight double")
