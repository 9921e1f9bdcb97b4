"""Gradient boosting of stumps from binned moments.

Every factor's values are cut at their quantiles. A split's gain needs the residual summed over each
(factor, bin); after a round these sums change by known multiples of the bins' common sample counts.
So two tables serve all rounds: how many samples two bins share, and each target's sum in each bin.
Spark adds both over all samples once (operators.blocks); boosting then runs on sums, with one model
whatever the number of samples, and no round reads the samples again.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.stats import scan
from netloom.operators.blocks import pair_sums
from netloom.session import cut

TARGETS = 64  # targets a task boosts side by side
TIE = 1e-9  # gains this close are equal: they differ by the order of sums only
AHEAD = 4  # best factors a target asks for before a pass


def feature_cuts(expr: DataFrame, tfs: DataFrame, bins=8) -> DataFrame:
    """(gene, cuts): distinct quantiles 0, 1/(bins-1), ..., 1 of the factor's nonzero values.

    Quantile k is the smallest value at or below which at least k/(bins-1) of the values lie.
    """
    x = expr.where("value != 0").join(tfs.select(F.col("tf").alias("gene")).distinct(), "gene", "left_semi")
    hist = x.groupBy("gene", "value").agg(F.count("*").alias("n"))
    run = scan(hist, ["gene"], "value", "n", "upto").join(hist.groupBy("gene").agg(F.sum("n").alias("all")), "gene")
    # the steps this value is the first to reach, -1 where it reaches none
    first = F.floor((F.col("upto") - F.col("n")) * (bins - 1) / F.col("all"))
    reaches = F.floor(F.col("upto") * (bins - 1) / F.col("all"))
    before = F.when(F.col("upto") == F.col("n"), F.lit(-1)).otherwise(first)
    return run.where(reaches > before).groupBy("gene").agg(F.array_sort(F.collect_list("value")).alias("cuts"))


def _bin(value, cuts):
    return F.size(F.filter(cuts, lambda c: c <= value))


class Layout:
    """Where each (factor, bin) lies in a target's vector, and its sample count."""

    def __init__(self, names, cuts, counts, n):
        self.names, self.n = np.array(names, object), float(n)
        self.size = max((len(c) for c in cuts), default=0) + 1
        shape = (len(names), self.size)
        self.zero = np.array([sum(x <= 0 for x in c) for c in cuts], int)
        self.count = np.zeros(shape)
        for (f, b), c in counts.items():
            self.count[f, b] = c
        self.full = self.fill(self.count, self.n)
        self.left = np.cumsum(self.full, axis=1)
        splits = np.arange(self.size)[None, :] < np.array([len(c) for c in cuts], int).reshape(-1, 1)
        self.ok = splits & (self.left > 0) & (self.left < self.n)
        self.where = {g: i for i, g in enumerate(names)}

    def fill(self, sums, total):
        """Bin sums with what the stored values leave of ``total`` in the bin of zero."""
        out = sums.copy()
        rest = total - sums.sum(-1)
        np.add.at(out, (np.arange(len(out)), self.zero), rest)
        return out

    def scores(self, h, own):
        """Gain of every split for residual bin sums ``h`` of total 0."""
        left = np.cumsum(self.fill(h, 0.0), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(self.ok, left ** 2 / self.left + left ** 2 / (self.n - self.left), -1.0)
        if own is not None:
            s[own] = -1.0
        return s, left


def boosted_importance(expr: DataFrame, obs: DataFrame, tfs: DataFrame, rounds=50, rate=0.1, bins=8) -> DataFrame:
    """Importance of every factor for every gene by boosted stumps: (source, target, weight).

    Each round takes the split with the largest gain (ties: first factor by name, lowest cut) and
    shrinks its step by ``rate``; a factor's weight is the sum of its gains. Rounds run in passes: a
    target asks for the shared counts of its best ``AHEAD`` factors and goes on until it picks one it
    did not get, at least one round a pass. The layout that reaches every task holds one number per
    (factor, bin).
    """
    n = obs.select("obs_id").distinct().count()
    expr = expr.join(obs.select("obs_id").distinct(), "obs_id", "left_semi").where("value != 0").select("obs_id", "gene", "value")
    # factors are numbered in order of name: as many rows as there are factors
    cuts = cut(feature_cuts(expr, tfs, bins).withColumn("f", F.row_number().over(W.orderBy("gene")) - 1), "cuts")
    x = expr.join(cuts, "gene").select("obs_id", F.concat_ws(":", "f", _bin(F.col("value"), F.col("cuts"))).alias("gene"), F.lit(1.0).alias("value"))
    x = cut(x, "binned")
    shared = pair_sums(x, x, "obs_id", "gene", "value", "dot", upper=True)
    both = shared.select("a", "b", "s").unionByName(shared.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    both = both.select(*[F.split(c, ":")[i].cast("int").alias(f"{c}{k}") for c in ("a", "b") for i, k in ((0, "f"), (1, "b"))], "s")
    facts = [(r.gene, list(r.cuts)) for r in cuts.orderBy("f").collect()]
    both = cut(both, "shared")
    counts = {(r.af, r.ab): r.s for r in both.where("af = bf and ab = bb").collect()}
    lay = Layout([g for g, _ in facts], [c for _, c in facts], counts, n)
    shape = lay.count.shape
    if not facts or not n:
        return expr.select(F.col("gene").alias("source"), F.col("gene").alias("target"), F.col("value").alias("weight")).where("false")

    def grid(pdf):
        m = np.zeros((lay.size, *shape))
        m[pdf["ab"], pdf["bf"], pdf["bb"]] = pdf["s"]
        rest = lay.count - m.sum(0)  # samples where the factor is 0
        f = int(pdf["af"].iloc[0])
        m[lay.zero[f]] += rest
        return pd.DataFrame({"f": [f], "shared": [np.cumsum(m, axis=0).tobytes()]})

    rows = cut(both.groupBy("af").applyInPandas(grid, "f int, shared binary"), "grids")

    n_targets = expr.agg(F.approx_count_distinct("gene")).first()[0]
    blocks = max(1, -(-n_targets // TARGETS))
    block = F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int").alias("block")
    sums = pair_sums(x, expr, "obs_id", "gene", "value", "dot").select(F.col("b").alias("target"), F.col("a").alias("of"), "s")
    sums = sums.unionByName(expr.groupBy(F.col("gene").alias("target")).agg(F.sum("value").alias("s")).select("target", F.lit("").alias("of"), "s"))

    def start(pdf):
        for name, g in pdf.groupby("target"):
            h, mean = np.zeros(shape), g.loc[g["of"] == "", "s"].iloc[0] / lay.n
            of = g[g["of"] != ""]
            at = of["of"].str.split(":", expand=True)
            if len(of):
                h[at[0].astype(int), at[1].astype(int)] = of["s"]
            yield name, h - mean * lay.count

    def state(block_no, name, h, gain, done):
        s, _ = lay.scores(h, lay.where.get(name))
        best = s.max(1)
        pick = int(np.argmax(best >= best.max() * (1 - TIE))) if len(best) else 0
        want = [f for f in dict.fromkeys([pick, *np.argsort(-best, kind="stable").tolist()]) if len(best) and best[f] > 0][:AHEAD]
        return block_no, name, h.tobytes(), gain.tobytes(), done if want else rounds, want

    names = ["block", "target", "h", "gain", "done", "want"]
    schema = "block int, target string, h binary, gain binary, done int, want array<int>"

    def first(pdf):
        b = int(pdf["block"].iloc[0])
        return pd.DataFrame([state(b, name, h, np.zeros(shape[0]), 0) for name, h in start(pdf)], columns=names)

    def go(pdf, grids):
        have = {int(f): np.frombuffer(m).reshape(lay.size, *shape) for f, m in zip(grids["f"], grids["shared"])}
        out = []
        for b, name, h, gain, done in zip(pdf["block"], pdf["target"], pdf["h"], pdf["gain"], pdf["done"]):
            h, gain, own = np.frombuffer(h).reshape(shape).copy(), np.frombuffer(gain).copy(), lay.where.get(name)
            while done < rounds:
                s, left = lay.scores(h, own)
                f, c = divmod(int(np.argmax(s >= s.max() * (1 - TIE))), lay.size)
                if s[f, c] <= 0:
                    done = rounds
                elif f in have:
                    lo, hi = left[f, c] / lay.left[f, c], -left[f, c] / (lay.n - lay.left[f, c])
                    gain[f] += s[f, c]
                    h -= rate * (lo * have[f][c] + hi * (lay.count - have[f][c]))
                    done += 1
                else:
                    break
            out.append(state(b, name, h, gain, done))
        return pd.DataFrame(out, columns=names)

    now = cut(sums.withColumn("block", block).groupBy("block").applyInPandas(first, schema), "boost")
    for _ in range(rounds):
        if now.where(F.col("done") < rounds).isEmpty():
            break
        want = now.where(F.col("done") < rounds).select(F.col("block").alias("by"), F.explode("want").alias("f")).distinct()
        now = cut(now.groupBy("block").cogroup(want.join(rows, "f").groupBy("by")).applyInPandas(go, schema), "boost")

    def gains(batches):
        for pdf in batches:
            for name, g in zip(pdf["target"], pdf["gain"]):
                g = np.frombuffer(g)
                k = np.flatnonzero(g)
                yield pd.DataFrame({"source": lay.names[k], "target": name, "weight": g[k]})

    return now.select("target", "gain").mapInPandas(gains, "source string, target string, weight double")
