"""Ranks, scans, tails and text parsers against hand values and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import stats, text


def col(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_average_rank_and_percentile(table):
    d = table([("k", x) for x in (1.0, 2.0, 2.0, 4.0)], "k string, v double")
    assert [r.rank for r in stats.avg_rank(d, ["k"], "v").orderBy("v").collect()] == [1, 2.5, 2.5, 4]
    assert [r.pct for r in stats.pct_rank(d, ["k"], "v").orderBy("v").collect()] == [.25, .625, .625, 1]


def test_benjamini_hochberg(table):
    d = table([("k", x) for x in (.01, .02, .03, .5)], "k string, p double")
    got = [r.padj for r in stats.bh(d, ["k"], "p").orderBy("p").collect()]
    assert got == pytest.approx([.04, .04, .04, .5])


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_matches_a_sorted_loop(table, reverse):
    rng = random.Random(3)
    vals = sorted({round(rng.gauss(0, 50), 3) for _ in range(400)} | {0.0, -1e-7, 1e9})
    w = {v: rng.randint(1, 5) for v in vals}
    d = table([("a", v, w[v]) for v in vals], "k string, v double, n int")
    got = {r.v: r.o for r in stats.scan(d, ["k"], "v", "n", "o", reverse=reverse).collect()}
    run, want = 0, {}
    for v in (reversed(vals) if reverse else vals):
        run += w[v]
        want[v] = run
    assert got == want


def test_top_k_with_a_hot_group(table):
    rows = [("hot", f"x{i}", float(i % 97)) for i in range(3000)] + [("cold", "y", 1.0)]
    d = table(rows, "g string, x string, v double")
    order = [F.col("v").desc(), F.col("x")]
    got = col(stats.top_k(d, ["g"], order, 40, ["x"]), "g", "x")
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:40]
    assert got == sorted([(r[0], r[1]) for r in hot] + [("cold", "y")])


def test_fisher(table):
    d = table([(3, 1, 1, 3), (0, 5, 5, 5), (5, 0, 0, 5)], "a bigint, b bigint, c bigint, d bigint")
    got = [r.p for r in d.select(stats.fisher_greater("a", "b", "c", "d").alias("p")).collect()]
    assert got == pytest.approx([17 / 70, 1.0, 1 / math.comb(10, 5)], rel=1e-9)


def test_fisher_brute(table):
    rng = random.Random(1)
    rows = [tuple(rng.randint(0, 30) for _ in range(4)) for _ in range(40)]
    d = table([(i, *r) for i, r in enumerate(rows)], "i int, a bigint, b bigint, c bigint, d bigint")
    got = {r.i: r.p for r in d.select("i", stats.fisher_greater("a", "b", "c", "d").alias("p")).collect()}
    for i, (a, b, c, e) in enumerate(rows):
        n, r, k = a + b + c + e, a + b, a + c
        want = sum(math.comb(r, x) * math.comb(n - r, k - x) for x in range(a, min(r, k) + 1) if k - x <= n - r) / math.comb(n, k)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_tails_against_tables():
    assert stats.t_tail([2.228138852, 1.812461123, 0.0, -1.0], [10, 10, 5, 1]) == pytest.approx([.025, .05, .5, .75], abs=1e-8)
    assert stats.normal_tail([1.959963985, 0, -1.644853627]) == pytest.approx([.025, .5, .95], abs=1e-9)
    x = np.linspace(0.01, .99, 23)
    assert stats.beta_inc(1.0, 1.0, x) == pytest.approx(x)


def test_log_gamma(table):
    d = table([(x,) for x in (1.0, 2.0, 5.5, 40.0, 1e5)], "x double")
    for r in d.select("x", stats.ln_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)


def test_text(table):
    d = table([("1h 30m", "512 MB", "97%"), ("500ms", "1,024", None), (None, "3.2 GB", "x")], "d string, m string, c string")
    got = [tuple(r) for r in d.select(text.hours("d"), text.gigabytes("m"), text.percent("c")).collect()]
    assert got == [(1.5, .5, 97.0), (pytest.approx(.5 / 3600), 0.0, 0.0), (0.0, 3.2, 0.0)]
