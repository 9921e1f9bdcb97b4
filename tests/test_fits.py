"""Moment-based fits against direct numpy fits on the samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import boosting, fits as J
from netloom.operators.boosting import boosted_importance

N, P = 60, 6


@pytest.fixture(scope="module")
def data(table):
    rng = np.random.default_rng(11)
    x = rng.normal(1.0, 1.0, (N, P)) * (rng.random((N, P)) < .8)
    x[:, 5] = x[:, 0] * 1.5 - x[:, 1] + rng.normal(0, .2, N)
    fold = np.arange(N) % 4
    e = table([(f"o{i}", f"g{j}", float(x[i, j])) for i in range(N) for j in range(P) if x[i, j] != 0], "obs_id string, gene string, value double")
    o = table([(f"o{i}", str(fold[i])) for i in range(N)], "obs_id string, fold string")
    return x, fold, J.moments(e, o), e, o


def ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return b, my - mx @ b


def test_ridge_cv(data, table):
    x, fold, m, *_ = data
    regs = table([("g5", "g0"), ("g5", "g1"), ("g5", "g2"), ("g4", "g3")], "target string, source string")
    got = {r.target: r.r2 for r in J.ridge_cv(regs, m).collect()}
    for t, cols in ((5, [0, 1, 2]), (4, [3])):
        sc = []
        for k in range(4):
            tr, te = fold != k, fold == k
            b, b0 = ridge(x[tr][:, cols], x[tr, t], 1.0)
            y = x[te, t]
            sc.append(1 - ((y - x[te][:, cols] @ b - b0) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert got[f"g{t}"] == pytest.approx(float(np.clip(np.mean(sc), 0, 1)), abs=1e-9)


def test_elastic_net_meets_its_optimality_conditions(data, table):
    x, _, m, *_ = data
    e = table([(f"g{j}", "g5", 1.0) for j in range(5)], "source string, target string, weight double")
    b = np.array([r.weight for r in J.refit_elastic(e, m, alpha=.1).orderBy("source").collect()])
    g = x[:, :5].T @ (x[:, 5] - x[:, :5] @ b) / N - .05 * b
    assert np.all(np.abs(g[b == 0]) <= .05 + 1e-6)
    assert g[b != 0] == pytest.approx(.05 * np.sign(b[b != 0]), abs=1e-6)


def test_propagate(table):
    s = table([("o", "A", 1.0)], "obs_id string, gene string, value double")
    e = table([("A", "B", .5), ("B", "C", .5)], "source string, target string, weight double")
    assert {r.gene: r.value for r in J.propagate(s, e).collect()} == {"A": 1.0, "B": .5, "C": .25}


@pytest.mark.parametrize("chunk", [512, 3])
def test_shock_estimate(table, chunk):
    rng = np.random.default_rng(0)
    a = np.array([[0, .5, .2, 0], [0, 0, .4, .1], [0, 0, 0, 0], [0, 0, 0, 0]])
    f = np.eye(4) + a + a @ a
    y = rng.normal(size=(20, 4))
    d = table([(f"o{i}", f"g{j}", float(y[i, j])) for i in range(20) for j in range(4)], "obs_id string, gene string, value double")
    e = table([(f"g{i}", f"g{j}", float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "source string, target string, weight double")
    rep = table([("g0",), ("g1",), ("g2",)], "gene string")
    got = {(r.obs_id, r.gene): r.value for r in J.shock_estimate(d, e, rep, .001, chunk).collect()}
    fc = f[np.ix_([0, 1], [0, 1, 2])]
    want = y[:, :3] @ fc.T @ np.linalg.inv(fc @ fc.T + .001 * np.eye(2))
    for i in range(20):
        for k in range(2):
            assert got[f"o{i}", f"g{k}"] == pytest.approx(want[i, k], abs=1e-9)


def test_stability(data, table):
    x, fold, m, *_ = data
    sel = [(0, 5), (1, 5), (2, 4)]
    nets = table([("net", f"g{a}", f"g{b}") for a, b in sel], "net string, source string, target string")
    got = {r.target: r.stability for r in J.stability(nets, m).collect()}
    z = (x - x.mean(0)) / x.std(0)
    mean = np.stack([z[fold == k].mean(0) for k in fold])
    theta = {}
    for gamma in (1.0, 1.2):
        w = z + (np.sqrt(gamma) - 1) * mean
        for t in (4, 5):
            o = [j for j in range(P) if j != t]
            th = np.abs(np.linalg.solve(w[:, o].T @ w[:, o] / N + 1e-6 * np.eye(P - 1), w[:, o].T @ w[:, t] / N))
            theta[gamma, t] = dict(zip(o, th / th.sum()))
    for t in (4, 5):
        s = {a for a, b in sel if b == t}
        p = {j: theta[1.0, t][j] * theta[1.2, t][j] for j in theta[1.0, t]}
        s1, s2 = np.mean([p[j] for j in s]), np.mean([p[j] for j in p if j not in s])
        assert got[f"g{t}"] == pytest.approx((s1 - s2) / (s1 + s2), abs=1e-7)


def direct_stability(x, fold, sel, gammas=(1.0, 1.2), l2=1e-6):
    """(s1 - s2) / (s1 + s2) per target by one inverse of the whole matrix."""
    n, p = x.shape
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd < 1e-12, 1, sd)
    mean = np.zeros_like(z)
    for k in set(fold):
        mean[fold == k] = z[fold == k].mean(0)
    w = 1.0
    for g in gammas:
        y = z + (np.sqrt(g) - 1) * mean
        inv = np.linalg.inv(y.T @ y / n + l2 * np.eye(p))
        th = np.abs(inv / np.diag(inv)[None, :])
        np.fill_diagonal(th, 0)
        w = w * th / th.sum(0, keepdims=True)
    out = {}
    for t in {b for _, b in sel}:
        own = sorted({a for a, b in sel if b == t})
        rest = [j for j in range(p) if j not in own and j != t]
        s1, s2 = w[own, t].mean(), w[rest, t].mean()
        out[f"g{t}"] = (s1 - s2) / (s1 + s2)
    return out


@pytest.mark.parametrize("genes,width", [(7, 2), (300, 128)])
def test_stability_by_blocks_equals_one_inverse(table, genes, width):
    rng = np.random.default_rng(genes)
    n = 40 * 12
    fold = np.arange(n) % 5
    x = np.round(rng.normal(1, 1, (n, genes)) * (rng.random((n, genes)) < .5) + .3 * fold[:, None] * rng.random(genes), 3)
    x[:, 3] = 0
    x[0, 3] = 1.0
    sel = [(int(a), int(b)) for a, b in rng.integers(0, genes, (3 * genes, 2)) if a != b]
    e = table([(f"o{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "obs_id string, gene string, value double")
    o = table([(f"o{i}", str(k)) for i, k in enumerate(fold)], "obs_id string, fold string")
    nets = table([("net", f"g{a}", f"g{b}") for a, b in sel] + [("net", "unknown", "g0")], "net string, source string, target string")
    got = {r.target: r.stability for r in J.stability(nets, J.moments(e, o), width=width).collect()}
    want = direct_stability(x, fold, sel)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_residual_correlation(data, table):
    x, fold, m, *_ = data
    nets = table([("net", "g0", "g5"), ("net", "g1", "g5")], "net string, source string, target string")
    got = {r.fold: r.score for r in J.residual_corr(nets, m).collect()}
    for k in range(4):
        tr, te = fold != k, fold == k
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mu) / sd
        b, b0 = ridge(z[tr][:, [0, 1]], z[tr, 5], 10.0)
        res = z[te, 5] - z[te][:, [0, 1]] @ b - b0
        want = np.mean([abs(np.corrcoef(res, z[te, j])[0, 1]) for j in (2, 3, 4, 5)])
        assert got[str(k)] == pytest.approx(want, abs=1e-8)


def test_partial_correlation(data, table):
    from netloom.operators.expression import correlation
    x, _, m, e, o = data
    got = {(r.source, r.target): r.weight for r in J.partial_corr(correlation(e, o), m, k=5, l2=0.0).collect()}
    p = np.linalg.inv(np.cov(x.T))
    for i in range(P):
        for j in range(P):
            if i != j:
                assert got[f"g{i}", f"g{j}"] == pytest.approx(-p[i, j] / np.sqrt(p[i, i] * p[j, j]), abs=1e-8)


def test_boosting_finds_the_drivers(data, table):
    *_, e, o = data
    tfs = table([(f"g{j}",) for j in range(4)], "tf string")
    w = {r.source: r.weight for r in boosted_importance(e, o, tfs).where(F.col("target") == "g5").collect()}
    assert sorted(w, key=w.get)[-2:] in (["g0", "g1"], ["g1", "g0"])


def boost_by_hand(x, factors, rounds=50, rate=.1, bins=8):
    """Boosted stumps on the samples themselves: gains per (factor, target)."""
    n, out = len(x), {}
    cuts = {}
    for f in factors:
        v = np.sort(x[x[:, f] != 0, f])
        cuts[f] = np.unique([v[max(-(-k * len(v) // (bins - 1)), 1) - 1] for k in range(bins)]) if len(v) else []
    splits = [(f, x[:, f] < c) for f in factors for c in cuts[f] if 0 < (x[:, f] < c).sum() < n]
    for t in range(x.shape[1]):
        r = x[:, t] - x[:, t].mean()
        for _ in range(rounds):
            score = [(r[z].sum() ** 2 / z.sum() + r[~z].sum() ** 2 / (~z).sum()) if f != t else -1 for f, z in splits]
            k = int(np.argmax(np.array(score) >= max(score) * (1 - 1e-9)))
            f, z = splits[k]
            out[f, t] = out.get((f, t), 0) + score[k]
            r = r - rate * np.where(z, r[z].mean(), r[~z].mean())
    return out


def long(table, x):
    e = table([(f"o{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "obs_id string, gene string, value double")
    return e, table([(f"o{i}",) for i in range(len(x))], "obs_id string")


@pytest.mark.parametrize("ahead", [4, 1])
def test_boosting_equals_boosting_on_the_samples(table, monkeypatch, ahead):
    monkeypatch.setattr(boosting, "AHEAD", ahead)
    monkeypatch.setattr(boosting, "TARGETS", 3)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(.4, 1, (300, 7)), 3) * (rng.random((300, 7)) < .6)
    x[:, 6] = 0
    x[3, 6] = 2.0
    x[:, 5] = np.round(2 * (x[:, 0] > .5) - x[:, 1] + rng.normal(0, .1, 300), 3)
    e, o = long(table, x)
    tfs = table([(f"g{j}",) for j in (0, 1, 2, 6)] + [("absent",)], "tf string")
    want = boost_by_hand(x, (0, 1, 2, 6))
    got = {(int(r.source[1:]), int(r.target[1:])): r.weight for r in boosted_importance(e, o, tfs).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_boosting_is_one_model_at_every_size(table):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (2000, 4)), 2)
    x[:, 3] = np.round(x[:, 0] * x[:, 1] + x[:, 2], 2)
    tfs = table([("g0",), ("g1",), ("g2",)], "tf string")
    one, ten = ({(r.source, r.target): r.weight for r in boosted_importance(*long(table, y), tfs).collect()} for y in (x, np.tile(x, (10, 1))))
    assert {k: 10 * v for k, v in one.items()} == pytest.approx(ten, rel=1e-9)


def test_boosting_without_factors_or_samples(table):
    e, o = long(table, np.eye(3))
    assert boosted_importance(e, o, table([("none",)], "tf string")).count() == 0
    assert boosted_importance(e.where("false"), o.where("false"), table([("g0",)], "tf string")).count() == 0


def test_true_regulators_beat_unrelated_ones(data, table):
    _, _, m, *_ = data
    true = table([("g5", "g0"), ("g5", "g1")], "target string, source string")
    other = table([("g5", "g2"), ("g5", "g3")], "target string, source string")
    assert J.ridge_cv(true, m).first().r2 > .9 > J.ridge_cv(other, m).first().r2


def test_moments_limited_to_regulators_agree(data, table):
    *_, m, e, o = data
    part = J.moments(e, o, left=table([("g1",), ("g3",)], "gene string"))
    want = {(r.fold, r.a, r.b): r.s for r in m.collect()}
    got = {(r.fold, r.a, r.b): r.s for r in part.collect()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert {k for k in want if "g1" in k[1:] or "g3" in k[1:] or k[1] == k[2] or k[1] == ""} == set(got)
