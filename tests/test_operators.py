"""Hand-worked rows and brute force for the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import blocks, edges as E, expression as X, filters as O, intervals as I, nulls as Z, ranking as R
from netloom.plans import leaderboard as L, metrics as M


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_clean_edges(table):
    raw = table([("A", "x", "1"), ("A", "x", "3"), ("B", "B", "9"), ("B", "y", "-5"), ("C", "z", "4"), ("A", "w", "bad")],
                "source string, target string, weight string")
    tfs = table([("A",), ("B",)], "tf string")
    assert rows(E.clean_edges(raw, 2, tfs), "source", "target", "weight") == [("B", "y", -5.0)]


def sparse(x, prefix="o"):
    return [(f"{prefix}{i}", f"g{j}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] != 0]


def cells(table, groups):
    return table([(f"o{i}", g, g == "c") for i, g in enumerate(groups)], "obs_id string, perturbation string, is_control boolean")


def brute_ws(a, b):
    pts = np.unique(np.concatenate([a, b]))
    f = lambda s: np.searchsorted(np.sort(s), pts[:-1], side="right") / len(s)
    return float(np.sum(np.abs(f(a) - f(b)) * np.diff(pts)))


def test_wasserstein_hand_values(table):
    e = table([(f"o{i}", "g0", v) for i, v in enumerate([0., 1., 3., 5., 6., 8.]) if v], "obs_id string, gene string, value double")
    o = cells(table, "ccctt" + "t")
    assert rows(X.wasserstein(e, o), "ws_distance") == [(pytest.approx(5.0),)]
    e = table([("o2", "g0", 2.0), ("o4", "g0", 2.0), ("o5", "g0", 2.0)], "obs_id string, gene string, value double")
    assert rows(X.wasserstein(e, o), "ws_distance") == [(pytest.approx(2 / 3),)]


def test_wasserstein_and_rank_sum_brute(table):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(1.0, 2.0, (60, 4)) * (rng.random((60, 4)) < .6), 1)
    g = np.array(list("c" * 25 + "t" * 20 + "u" * 15))
    e = table(sparse(x), "obs_id string, gene string, value double")
    o = cells(table, g)
    ws = {(r.source, r.target): r.ws_distance for r in X.wasserstein(e, o).collect()}
    rs = {(r.perturbation, r.gene): r.score for r in X.rank_sum(e, o).collect()}
    for t in "tu":
        for j in range(4):
            a, b = x[g == "c", j], x[g == t, j]
            assert ws[t, f"g{j}"] == pytest.approx(brute_ws(a, b), abs=1e-9)
            both = np.concatenate([b, a])
            rank = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
            n1, n0 = len(b), len(a)
            z = (rank[:n1].sum() - n1 * (n0 + n1 + 1) / 2) / np.sqrt(n0 * n1 * (n0 + n1 + 1) / 12)
            assert rs[t, f"g{j}"] == pytest.approx(z, abs=1e-9)


@pytest.mark.parametrize("block,chunk", [(256, 4096), (3, 7)])
def test_pair_sums_do_not_depend_on_blocking(table, block, chunk):
    rng = np.random.default_rng(2)
    x = rng.poisson(.7, (40, 11)).astype(float)
    e = table(sparse(x), "obs_id string, gene string, value double")
    got = {(r.a, r.b): r.s for r in blocks.pair_sums(e, e, "obs_id", "gene", "value", upper=True, block=block, chunk=chunk).collect()}
    for i in range(11):
        for j in range(11):
            a, b = sorted((f"g{i}", f"g{j}"))
            assert got.get((a, b), 0.0) == pytest.approx(float(x[:, i] @ x[:, j]))


def test_knn_blocks(table):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3))
    d = table([(f"c{i:02d}", [float(v) for v in x[i]]) for i in range(50)], "obs_id string, vec array<double>")
    got = rows(blocks.knn(d, 4, block=9), "obs_id", "neighbor", "rn")
    want = []
    for i in range(50):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        dist[i] = np.inf
        want += [(f"c{i:02d}", f"c{j:02d}", k + 1) for k, j in enumerate(np.argsort(dist)[:4])]
    assert got == sorted(want)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_counts_absent_rows_as_zeros(table, method):
    rng = np.random.default_rng(8)
    x = rng.poisson(.8, (30, 5)).astype(float)
    x[:, 4] = 2.0  # constant gene drops out
    e = table(sparse(x), "obs_id string, gene string, value double")
    o = cells(table, "c" * 30)
    y = x.copy()
    if method == "spearman":
        for j in range(5):
            y[:, j] = [(x[:, j] < v).sum() + ((x[:, j] == v).sum() + 1) / 2 for v in x[:, j]]
    got = {(r.a, r.b): r.r for r in X.correlation(e, o, method).collect()}
    assert set(got) == {(f"g{i}", f"g{j}") for i in range(4) for j in range(i + 1, 4)}
    for (a, b), r in got.items():
        assert r == pytest.approx(np.corrcoef(y[:, int(a[1])], y[:, int(b[1])])[0, 1], abs=1e-9)


def test_interval_closed_ends(table):
    tss = table([("chr1", 5000, "+", "P"), ("chr1", 5000, "-", "M")], "chrom string, tss bigint, strand string, gene string")
    win = {r.gene: (r.a_start, r.a_end) for r in I.tss_window(tss).collect()}
    assert win == {"P": (4000, 5100), "M": (4900, 6000)}
    peaks = table([("chr1", 5100, 5200, "T"), ("chr1", 0, 3999, "U"), ("chr1", 1000, 90000, "L")], "chrom string, start bigint, stop bigint, tf string")
    assert rows(I.peaks_near_tss(peaks, tss), "source", "target") == [("L", "M"), ("L", "P"), ("T", "M"), ("T", "P")]


def test_overlap_join_brute(table):
    rng = np.random.default_rng(0)
    a = [("chr1", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 5000, 60), rng.integers(0, 2500, 60)))]
    b = [("chr1", int(s), int(s + w), i) for i, (s, w) in enumerate(zip(rng.integers(0, 5000, 60), rng.integers(0, 200, 60)))]
    x = table(a, "chrom string, a_start bigint, a_end bigint, i int")
    y = table(b, "chrom string, b_start bigint, b_end bigint, j int")
    got = rows(I.overlap_join(x, y), "i", "j")
    assert got == sorted((p[3], q[3]) for p in a for q in b if q[2] >= p[1] and q[1] <= p[2])


def test_matched_control(table):
    o = table([("o1", 1, "d1", "p1", False), ("o2", 2, "d1", "p1", True), ("o5", 5, "d1", "p1", True), ("o6", 6, "d1", "p9", False),
               ("o7", 7, "d7", "p1", False)], "obs_id string, row_no int, donor string, plate string, is_control boolean")
    e = table([("o1", "g", 1.0)], "obs_id string, gene string, value double")
    _, m = X.perturbation_delta(e, o, ["donor", "plate"], ["donor"])
    assert {r.obs_id: r.control_id for r in m.collect()} == {"o1": "o5", "o2": "o5", "o5": "o5", "o6": "o5", "o7": "o2"}


def test_minmax(table):
    s = table([("d", "m", "a", -1.0), ("d", "m", "b", 0.0), ("d", "m", "c", 2.0), ("d", "m", "e", None), ("d", "k", "a", 3.0), ("d", "k", "b", 3.0)],
              "dataset string, metric string, model string, value double")
    got = {(r.metric, r.model): r.value for r in L.minmax(s, "value", ["dataset", "metric"]).collect()}
    assert got == {("m", "a"): 0, ("m", "b"): 0, ("m", "c"): 1, ("m", "e"): None, ("k", "a"): 0, ("k", "b"): 0}


@pytest.mark.parametrize("required,want", [(10, {"R", "a", "b"}), (20, {"R", "a"})])
def test_greedy_fill(table, required, want):
    sizes = {"R": required, "a": 3, "b": 5, "c": 9}
    o = table([(f"{d}{i}", d) for d, n in sizes.items() for i in range(n)], "obs_id string, donor_id string")
    got = R.fill_to(o, 15, table([("R",)], "donor_id string"))
    assert {r.donor_id for r in got.collect()} == want


def test_tf_binding_hand_value(table):
    genes = table([(f"g{i}",) for i in range(10)], "gene string")
    tfs = table([("T",), ("V",)], "tf string")
    gt = table([("x", "T", "g0"), ("x", "T", "g1"), ("x", "V", "g3")], "gt string, source string, target string")
    net = table([("T", "g0", 3.0), ("T", "g5", -2.0), ("T", "g1", 1.0)], "source string, target string, weight double")
    r = {x.gt: x for x in M.tf_binding(net, gt, genes, tfs).collect()}["all"]
    assert (r.precision, r.recall) == (pytest.approx(.375), pytest.approx(.1875))


def test_null_network_keeps_degrees(table):
    rng = np.random.default_rng(1)
    pairs = {(f"s{a}", f"t{b}") for a, b in zip(rng.integers(0, 12, 150), rng.integers(0, 30, 150))}
    e = table([(s, t, float(i + 1)) for i, (s, t) in enumerate(sorted(pairs))], "source string, target string, weight double")
    n = Z.degree_null(e)
    assert n.count() > .7 * len(pairs) and n.select("source", "target").distinct().count() == n.count()
    r = Z.random_partners(e, table([(f"t{i}",) for i in range(30)], "gene string"))
    deg = lambda d: {x.source: x["count"] for x in d.groupBy("source").count().collect()}
    assert deg(r) == deg(e)


def test_draws_do_not_depend_on_partitions(spark):
    o = spark.range(500).select(F.col("id").cast("string").alias("obs_id"))
    a = rows(R.cap(o.repartition(7), 50, 3), "obs_id")
    assert a == rows(R.cap(o.coalesce(1), 50, 3), "obs_id")


def test_pseudobulk_keeps_one_to_one_columns(table):
    o = table([("o1", "k1", "x", "u"), ("o2", "k1", "x", "v"), ("o3", "k2", "y", "u")], "obs_id string, grp string, one string, many string")
    e = table([("o1", "g", 1.0), ("o2", "g", 2.0), ("o3", "h", 4.0)], "obs_id string, gene string, value double")
    b, m = X.pseudobulk(e, o, "grp")
    assert rows(b, "grp", "gene", "value") == [("k1", "g", 3.0), ("k2", "h", 4.0)]
    assert set(m.columns) == {"grp", "one", "cell_count"}


def test_universe_and_basic_qc(table):
    genes, tfs = table([("a",), ("b",), ("c",)], "gene string"), table([("a",), ("b",)], "tf string")
    e = table([("a", "b", 1.0)], "source string, target string, weight double")
    assert rows(O.universe(e, tfs, genes), "gene") == [("a",), ("b",)]
    e = table([("a", "c", 1.0)], "source string, target string, weight double")
    assert rows(O.universe(e, tfs, genes), "gene") == [("a",), ("b",), ("c",)]


def test_variable_genes_of_counts(table):
    rng = np.random.default_rng(6)
    x = rng.negative_binomial(2, 1 / (1 + np.linspace(.2, 6, 12)), (80, 12)).astype(float)
    e = table(sparse(x), "obs_id string, gene string, value double")
    got = {r.gene: r.norm_var for r in X.hvg_counts(e, cells(table, "c" * 80)).collect()}
    m, v = x.mean(0), x.var(0, ddof=1)
    sd = np.sqrt(10 ** np.polyval(np.polyfit(np.log10(m), np.log10(v), 2), np.log10(m)))
    z = np.minimum(x, m + sd * np.sqrt(80))
    want = (80 * m ** 2 + (z ** 2).sum(0) - 2 * z.sum(0) * m) / (79 * sd ** 2)
    for j in range(12):
        assert got[f"g{j}"] == pytest.approx(want[j], rel=1e-6)


def test_spread_join_with_a_hot_key(table):
    from netloom.functions.skew import spread_join
    big = table([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, i int")
    small = table([("hot", j) for j in range(5)] + [("k0", 9), ("k3", 8)], "k string, j int")
    want = rows(big.join(small, "k"), "k", "i", "j")
    assert rows(spread_join(big, small, ["k"], ["i"], per=50), "k", "i", "j") == want
