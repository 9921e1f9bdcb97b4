"""Cases that once gave another result: caps, order of scaling, draws, duplicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import expression as X, filters as O, fits as J, nulls as Z
from netloom.plans import metrics as M
from netloom.sources import tables as T, text as S


def test_rank_sum_takes_all_controls_and_keeps_every_gene(table):
    e = table([(f"c{i}", f"g{i}", 1.0) for i in range(5)] + [("p", "g9", 2.0)], "obs_id string, gene string, value double")
    o = table([(f"c{i}", "control", True) for i in range(5)] + [("p", "x", False)], "obs_id string, perturbation string, is_control boolean")
    full, cut = X.rank_sum(e, o), X.rank_sum(e, o, max_controls=2)
    assert full.count() == cut.count() == 6
    assert full.select("n0").first()[0] == 5 and cut.select("n0").first()[0] == 2


def test_layers_past_the_hundredth(table):
    e = table([(f"l{i:03d}", "g", 1.0) for i in range(150)] + [("lognorm", "g", 2.0)], "layer string, gene string, value double")
    assert O.pick_layer(e, "l149").count() == 1 and O.pick_layer(e).first().value == 2.0
    with pytest.raises(ValueError):
        O.pick_layer(e, "none")
    assert O.pick_layer(table([("X_norm", "g", 3.0)], "layer string, gene string, value double"), "lognorm", "norman").count() == 1


def test_gene_sets_keep_their_first_and_last_gene(spark, tmp_path):
    p = tmp_path / "a.gmt"
    p.write_text("s\td\t" + "\t".join(f"g{i}" for i in range(3000)) + "\n")
    genes = S.read_gmt(spark, str(p)).first().genes
    assert len(genes) == 3000 and genes[0] == "g0" and genes[-1] == "g2999"


def test_negative_control_uses_every_factor(table):
    genes, tfs = table([(f"g{i}",) for i in range(40)], "gene string"), table([(f"t{i:04d}",) for i in range(600)], "tf string")
    assert Z.negative_control(genes, tfs, share=0.5).select("source").distinct().count() == 600


def test_scaling_sees_only_samples_with_a_fold(table, monkeypatch):
    seen = {}
    monkeypatch.setattr(M, "regression_detail", lambda net, e, *a: seen.setdefault("e", e).select(F.lit("m").alias("metric"), F.col("value").alias("r2")))
    n = 200
    rows = [(f"a{i}", "g", float(i % 5)) for i in range(n)] + [(f"b{i}", "g", 1e6 + i) for i in range(100)]
    e = table(rows, "obs_id string, gene string, value double")
    o = table([(r[0], "big" if r[0][0] == "a" else f"small{int(r[0][1:]) % 10}") for r in rows], "obs_id string, cell string")
    M.regression(None, e, o, None, table([("g", 0.25, 1)], "gene string, theta double, n long"), cv_column="cell")
    got = {r.obs_id: r.value for r in seen["e"].collect()}
    iqr = np.subtract(*np.percentile([i % 5 for i in range(n)], [75, 25]))
    assert len(got) == n and got["a4"] == pytest.approx(4 / iqr)


def test_fill_draws_with_replacement(table):
    bg = table([("t", "x", 0.1), ("t", "y", 0.9)], "source string, target string, percentile double")
    cons = table([("t", 0.25, 5)], "source string, theta double, value long")
    d = M.predicted_distances(table([("t", "x", 1.0)], "source string, target string, weight double"), bg, cons)
    assert d.count() == 5 and d.where("filled").count() == 4


def test_random_partners_may_be_the_own_gene(table):
    e = table([("a", "b", 1.0), ("a", "c", 1.0)], "source string, target string, weight double")
    g = table([("a",), ("b",)], "gene string")
    assert Z.random_partners(e, g, allow_self=True).count() == 2 and Z.random_partners(e, g).count() == 1


def test_disagreeing_folders_are_averaged(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("d", "m", "x", 1.0), ("d", "m", "x", 3.0)], "dataset string, model string, metric string, value double")
    monkeypatch.setattr(T, "read_scores", lambda *a: rows)
    assert [r.value for r in T.combine_results(spark, ["p"]).collect()] == [2.0]


def test_target_without_a_possible_regulator_scores_zero(table):
    rng = np.random.default_rng(1)
    e = table([(f"o{i}", g, float(rng.random())) for i in range(12) for g in ("t", "u")], "obs_id string, gene string, value double")
    folds = table([(f"o{i}", str(i % 3)) for i in range(12)], "obs_id string, fold string")
    regs = J.select_regulators(table([("t", "u", 1.0)], "source string, target string, weight double"), table([("t",)], "tf string"),
                               table([("t", 1), ("u", 1)], "gene string, n long"))
    got = {r.target: (r.n_regulators, r.r2) for r in J.ridge_cv(regs, J.moments(e, folds)).collect()}
    assert got["t"] == (0, 0.0) and got["u"][0] == 1


@pytest.mark.parametrize("n,k", [(1, 1), (2, 2), (10, 10), (97, 30), (100, 99)])
def test_draws_never_repeat_and_suffice(table, n, k):
    items = table([(f"i{j}",) for j in range(n)], "gene string")
    got = Z.draw(table([(f"s{j}", k) for j in range(20)], "source string, k int"), items, "source", "gene", F.col("k"), 3)
    per = got.groupBy("source").agg(F.count("*").alias("c"), F.count_distinct("gene").alias("d")).collect()
    assert len(per) == 20 and all(r.c == r.d >= min(k, n) for r in per)


def test_draws_are_spread_evenly(table):
    items = table([(f"i{j}",) for j in range(50)], "gene string")
    got = Z.draw(table([(f"s{j}", 10) for j in range(2000)], "source string, k int"), items, "source", "gene", F.col("k"), 1).where("_j < 10")
    c = [r["count"] for r in got.groupBy("gene").count().collect()]
    assert len(c) == 50 and min(c) > 300 and max(c) < 500  # 53 steps, 377 expected


def test_markers_against_numpy(table):
    import math
    rng = np.random.default_rng(2)
    x = rng.poisson(1.0, (40, 12)).astype(float)
    x[:20, 0] += 6
    x[20:, 1] = 0
    e = table([(f"o{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "obs_id string, gene string, value double")
    o = table([(f"o{i}", "a" if i < 20 else "b") for i in range(40)], "obs_id string, grp string")
    got = {(r.grp, r.gene): r for r in X.differential(e, o, "grp").collect()}
    for g, side in (("a", slice(0, 20)), ("b", slice(20, 40))):
        p = []
        for j in range(12):
            v = np.sort(x[:, j])
            rank = {u: (np.searchsorted(v, u) + np.searchsorted(v, u, "right") + 1) / 2 for u in v}
            z = (sum(rank[u] for u in x[side, j]) - 20 * 41 / 2) / math.sqrt(20 * 20 * 41 / 12)
            p.append(math.erfc(abs(z) / math.sqrt(2)))
        order = np.argsort(p)
        adj, low = [0.0] * 12, 1.0
        for k in range(11, -1, -1):
            low = min(low, p[order[k]] * 12 / (k + 1))
            adj[order[k]] = low
        for j in range(12):
            r = got[g, f"g{j}"]
            assert r.p == pytest.approx(p[j]) and r.padj == pytest.approx(adj[j])
            assert r.is_marker == (r.lfc >= math.log2(1.5) and adj[j] <= 0.05)
    assert got["a", "g0"].is_marker and got["a", "g1"].is_marker and not got["b", "g1"].is_marker


def test_each_fold_is_scaled_by_the_other_folds(table):
    rng = np.random.default_rng(6)
    x = rng.poisson(2.0, (15, 4)).astype(float)
    x[:, 3] = 0
    x[:5, 3] = 4.0  # varies in fold 0 against the rest, flat outside it
    e = table([(f"o{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "obs_id string, gene string, value double")
    f = table([(f"o{i}", i // 5) for i in range(15)], "obs_id string, fold int")
    got = {(r.gene, r.fold): r.sd for r in X.fold_scaler(e, f).collect()}
    for j in range(4):
        for k in range(3):
            sd = np.delete(x[:, j], slice(5 * k, 5 * k + 5)).std()
            assert got[f"g{j}", k] == pytest.approx(sd if sd > 1e-9 else 1.0)
