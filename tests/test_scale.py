"""Hot keys, long lookups and draws: what the operators do when one key holds much of the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import det, quantiles as Q
from netloom.functions.skew import grid_join
from netloom.functions.stats import following
from netloom.catalog import standins
from netloom.catalog.standins import SPARK_VIEWS, TABLES, VIEWS, Views, _inline
from netloom.operators import blocks, chromatin as H, expression as X, fits as J, intervals as I, nulls as Z
from netloom.session import bucketed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grid_join_spreads_a_hot_key_and_keeps_every_pair(spark):
    a = spark.range(300).selectExpr("if(id < 250, 0, id) as k", "id as x")
    b = spark.range(400).selectExpr("if(id < 380, 0, id - 100) as k", "id as y")
    want = rows(a.join(b, "k").select("k", "x", "y"))
    got = grid_join(a, b, ["k"], ["x"], ["y"], side=50)
    assert rows(got.select("k", "x", "y")) == want and len(want) == 250 * 380 + 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_sa" in plan and "_sb" in plan


def brute(a, b, closed):
    return sorted((i, j) for c, s, e, i in a for d, u, v, j in b if c == d and (v >= s and u <= e if closed else v > s and u < e))


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("side", [None, 20])
def test_intervals_of_every_length_and_one_hot_place(spark, closed, side):
    rng = np.random.default_rng(4)

    def some(n, hot):
        out = []
        for k in range(n):
            if k < hot:  # half of all rows within one small bin
                s, length = 1_000_000 + int(rng.integers(0, 60)), int(rng.integers(0, 6))
            else:
                s, length = int(rng.integers(0, 2_000_000)), int(10 ** rng.uniform(0, 6)) - 1
            out.append((f"c{k % 2 if k >= hot else 0}", s, s + length, k))
        return out

    a, b = some(160, 80), some(200, 100)
    x = spark.createDataFrame(a, "chrom string, a_start long, a_end long, i long")
    y = spark.createDataFrame(b, "chrom string, b_start long, b_end long, j long")
    got = sorted((r.i, r.j) for r in I.overlap_join(x, y, closed, side).collect())
    assert got == brute(a, b, closed)


def test_candidates_of_an_interval_join_follow_its_result(spark):
    # far more short intervals than overlaps: fixed bins of 20,000 would pair a thousand rows with each other
    x = spark.range(1000).selectExpr("'c' as chrom", "id * 20 as a_start", "id * 20 + 5 as a_end")
    y = spark.range(1000).selectExpr("'c' as chrom", "id * 20 + 10 as b_start", "id * 20 + 12 as b_end")
    left, right = I._binned(x, "a_start", "a_end", I._levels(y, "b_start", "b_end"), "a"), I._binned(y, "b_start", "b_end", I._levels(x, "a_start", "a_end"), "b")
    assert left.join(right, ["chrom", "_level", "_side", "_bin"]).count() < 10_000 and I.overlap_join(x, y).count() == 0


@pytest.mark.parametrize("most", [1000, 3])
def test_lookups_without_a_limit(spark, most):
    a, b = spark.range(20).selectExpr("id as x"), spark.range(11).selectExpr("id as y", "cast(id as string) as z")
    assert rows(blocks.attach_all(a, b, most)) == sorted((x, y, str(y)) for x in range(20) for y in range(11))
    assert blocks.attach_all(a, b.where("false"), most).count() == 0


def test_group_folds_of_many_groups_are_balanced(spark):
    o = spark.range(200_000).selectExpr("cast(pow(id, 0.8) as int) as g", "id as obs_id")
    at = Z.group_kfold(o, "g")
    load = [r.n for r in o.join(at, "g").groupBy("fold").agg(F.count("*").alias("n")).collect()]
    most = o.groupBy("g").count().agg(F.max("count")).first()[0]
    assert len(load) == 5 and max(load) - min(load) <= most and at.count() == at.select("g").distinct().count() == o.select("g").distinct().count()


def test_negative_control_draws_like_a_coin_for_every_pair(spark):
    genes = spark.range(4000).selectExpr("concat('G', id) as gene")
    tfs = spark.range(60).selectExpr("concat('T', id) as tf")
    e = Z.negative_control(genes, tfs, 0.05).cache()
    n = e.count()
    assert n == e.select("source", "target").distinct().count() and abs(n - 24_000) < 5 * (24_000 * .9) ** .5
    assert abs(e.where("weight > 0").count() - n / 2) < 5 * (n / 4) ** .5
    per = [r["count"] for r in e.groupBy("target").count().collect()]
    assert max(per) < 25 and len(per) > 3900


@pytest.mark.parametrize("degree", [0.3, 1.0])
def test_network_noise_moves_a_share_of_the_grid_without_listing_it(spark, degree):
    rng = np.random.default_rng(2)
    cells = [(m, f"s{i}", f"t{j}", float(i + j + 1)) for m in "ab" for i in range(40) for j in range(50) if rng.random() < .4]
    e = spark.createDataFrame(cells, "model string, source string, target string, weight double")
    got = Z.add_noise(e, "net", degree, keys=["model"]).collect()
    for m in "ab":
        old = {(r[1], r[2]): r[3] for r in cells if r[0] == m}
        new = {(r.source, r.target): r.weight for r in got if r.model == m}
        assert len(new) == len(old) and sorted(new.values()) == sorted(old.values())
        same = sum(new.get(k) == w for k, w in old.items()) / len(old)
        assert abs(same - (1 - degree)) < .1
        sources = {s for s, _ in new}
        assert len(sources) == 40 and {t for _, t in new} == {t for _, t in old}


def test_grid_permutation_is_one_and_has_an_inverse(spark):
    d = spark.range(13 * 7).selectExpr("id div 7 as s", "id % 7 as t")
    s, t = Z._mix(F.col("s"), F.col("t"), F.lit(13), F.lit(7), "x")
    d = d.withColumn("u", s).withColumn("v", t)
    s, t = Z._mix(F.col("u"), F.col("v"), F.lit(13), F.lit(7), "x", back=True)
    got = d.withColumn("s2", s).withColumn("t2", t).collect()
    assert len({(r.u, r.v) for r in got}) == 91 and all((r.s, r.t) == (r.s2, r.t2) for r in got) and any((r.s, r.t) != (r.u, r.v) for r in got)


def test_quantiles_from_sketches(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(0, 3, 501), "b": np.r_[np.zeros(40), rng.exponential(5, 60)], "c": np.array([2.0]), "d": np.r_[1.0, 1.0, 1.0, -4.0]}
    x = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("c", float("nan"))]
    df = spark.createDataFrame(x, "k string, v double")
    qs = [0.0, .25, .5, .9, 1.0]
    got = {(r.k, r.q): r.value for r in Q.exact(df, ["k"], "v", qs).collect()}
    assert got == {(k, q): pytest.approx(np.quantile(v, q), abs=1e-12) for k, v in data.items() for q in qs}
    sk = Q.merge(Q.sketch(df.where("v < 1"), ["k"], "v"), Q.sketch(df.where("v >= 1 and not isnan(v)"), ["k"], "v"), ["k"])
    assert rows(sk) == rows(Q.sketch(df, ["k"], "v"))
    for r in Q.approximate(sk, ["k"], [.25, .5, .9]).collect():
        want = np.quantile(data[r.k], r.q)
        below, upto = (data[r.k] < r.value - 1e-9).mean(), (data[r.k] <= r.value + 1e-9).mean()
        assert abs(r.value - want) <= abs(want) * .05 + 1e-9 or below - .05 <= r.q <= upto + .05


def test_following_rows_across_bins(spark):
    v = sorted({round(float(x), 3) for x in np.random.default_rng(9).normal(0, 100, 80)} | {0.0})
    df = spark.createDataFrame([(k, x) for k in "pq" for x in v], "k string, v double")
    got = {(r.k, r.v): (r.n.v if r.n else None, r.first) for r in following(df, ["k"], "v", ["v"], "n", "first").collect()}
    assert got == {(k, x): (v[i + 1] if i + 1 < len(v) else None, i == 0) for k in "pq" for i, x in enumerate(v)}


def test_approximate_neighbours_reach_their_recall_with_a_third_of_copies(spark):
    from netloom.operators.neighbours import knn_approx, recall
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24))
    x[::3] = x[0]  # one vector owns a third of the rows
    e = spark.createDataFrame([(f"c{k}", [float(v) for v in r]) for k, r in enumerate(x)], "obs_id string, vec array<double>")
    truth = blocks.knn(e, 8)
    unlike = truth.where("cast(substring(obs_id, 2) as int) % 3 <> 0")  # copies have a thousand equally near neighbours
    got = knn_approx(e, 8, piece=64).cache()
    assert got.count() == 900 * 8 and recall(got, unlike) >= 0.9
    near = {(r.obs_id, r.rn): r.dist for r in got.collect()}
    assert all(near[f"c{k}", 1] < 1e-9 for k in range(0, 900, 3)) and all(near[f"c{k}", r] <= near[f"c{k}", r + 1] for k in range(900) for r in range(1, 8))


def test_topics_predict_held_out_regions_as_well_as_the_library_model(spark):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from netloom.operators.chromatin import topics
    rng = np.random.default_rng(3)
    phi = rng.dirichlet(np.full(80, .08), 3)
    theta = rng.dirichlet(np.full(3, .3), 150)
    pairs = sorted({(c, int(p)) for c in range(150) for p in rng.choice(80, 30, p=theta[c] @ phi)})
    test = {x for x in pairs if rng.random() < .2 and any(y[1] == x[1] and y != x for y in pairs)}
    train = spark.createDataFrame([(f"c{c}", f"p{p}", 1.0) for c, p in pairs if (c, p) not in test], "obs_id string, peak string, value double")
    cell, region = topics(train, 3, max_iter=30)
    p, q = ({(r[0], r[1]): r[2] for r in d.collect()} for d in (cell, region))
    assert all(abs(sum(p[f"c{c}", t] for t in range(3)) - 1) < 1e-9 for c in range(150)) and abs(sum(v for (t, _), v in q.items() if t == 0) - 1) < 1e-9
    score = lambda p, q: np.mean([np.log(sum(p[f"c{c}", t] * q.get((t, f"p{r}"), 1e-9) for t in range(3))) for c, r in sorted(test)])
    docs = train.groupBy("obs_id").agg(F.collect_set("peak").alias("tokens"))
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=1.0).fit(docs)
    lda = LDA(k=3, seed=1, maxIter=30, featuresCol="features").fit(cv.transform(docs))
    lib_p = {(r.obs_id, t): float(v) for r in lda.transform(cv.transform(docs)).select("obs_id", "topicDistribution").collect() for t, v in enumerate(r.topicDistribution)}
    m = lda.topicsMatrix().toArray()
    lib_q = {(t, w): m[i, t] / m[:, t].sum() for i, w in enumerate(cv.vocabulary) for t in range(3)}
    assert score(p, q) >= score(lib_p, lib_q) - 0.05


def test_rank_sum_of_millions_of_samples_does_not_overflow(spark):
    from netloom.operators import expression as X
    obs = spark.range(5_000_000).select(F.concat(F.lit("o"), "id").alias("obs_id"), F.lit("p").alias("perturbation"), (F.col("id") % 2 == 0).alias("is_control"))
    e = spark.createDataFrame([("o1", "g", 1.0), ("o2", "g", 2.0)], "obs_id string, gene string, value double")
    n = 2_500_000
    u = (n - 1) * (n - 1) / 2 + (n - 1) - n * n / 2  # zeros against half of the zeros, the 1 above them all
    [r] = X.rank_sum(e, obs).collect()
    assert (r.n1, r.n0) == (n, n) and r.score == pytest.approx(u / (float(n) * n * (2 * n + 1) / 12) ** 0.5, abs=1e-9)
    [a, b] = X.rank_sum_rest(e, obs.withColumn("perturbation", F.col("is_control").cast("string")), "perturbation").collect()
    assert a.score == pytest.approx(-b.score, abs=1e-9)


def test_the_walk_of_the_negative_control_is_not_collected(spark):
    genes = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("gene"))
    tfs = spark.createDataFrame([(f"t{k}",) for k in range(5)], "tf string")
    e = Z.negative_control(genes, tfs)
    groups = tfs.withColumn("k", F.lit(20))
    for d, n in ((e, None), (Z.draw(groups, genes, "tf", "gene", F.col("k"), 3), 20)):
        plan = d._jdf.queryExecution().optimizedPlan().toString() + d._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin [_i" in x] and "SortMergeJoin [_i" in plan
        per = d.groupBy(d.columns[0]).agg(F.count("*"), F.count_distinct("target" if n is None else "gene")).collect()
        assert len(per) == 5 and all(r[1] == r[2] and r[1] >= (n or 20) for r in per)


def test_digests_of_many_numbers_at_once_are_md5():
    import hashlib
    for prefix, lo, hi in ((b"S12:", 1, 12_000), (b"", 95, 1_100), ("F\u00e9".encode() * 30 + b":", 7, 3_000), (b"x" * 52, 1, 400)):
        want = [int(hashlib.md5(prefix + str(j).encode() + b":0a").hexdigest()[:8], 16) for j in range(lo, hi)]
        assert det.heads(prefix, lo, hi, b":0a").tolist() == want


@pytest.mark.parametrize("box, share", [(1 << 21, 0.01), (256, 0.01), (256, 0.3), (256, 0.5)])
def test_a_long_negative_control_is_walked_in_tasks(spark, monkeypatch, box, share):
    genes = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("gene")).unionByName(spark.createDataFrame([(None,), ("g1",)], "gene string"))
    tfs = spark.createDataFrame([(f"t{k}",) for k in range(40)] + [(None,), ("t1",), ("",), ("\u00e9" * 40,)], "tf string")
    want = rows(Z.negative_control(genes, tfs, share).select(*(F.coalesce(c, F.lit("-")).alias(c) for c in ("source", "target")), "weight"))
    for name, value in (("FEW", 0), ("BOX", box), ("PIECE", 64), ("DRAWS", 500)):
        monkeypatch.setattr(Z, name, value)
    e = Z.negative_control(genes, tfs, share)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Window" not in plan.split("CartesianProduct")[0]
    assert rows(e.select(*(F.coalesce(c, F.lit("-")).alias(c) for c in ("source", "target")), "weight")) == want and len(want) > 1000


@pytest.mark.parametrize("dims, items", [(4096, 1024), (3, 4)])
def test_sparse_product_equals_the_joined_sum(spark, monkeypatch, dims, items):
    monkeypatch.setattr(blocks, "DIMS", dims)
    monkeypatch.setattr(blocks, "ITEMS", items)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    a = [(f"d{d}", f"a{i}", float(rng.integers(-2, 3))) for i in range(9) for d in rng.choice(12, 5, replace=False)]
    b = [(f"d{d}", f"b{i}", float(rng.integers(-2, 3))) for i in range(10) for d in rng.choice(12, 4, replace=False)]
    a += [("d1", "a1", 2.0), (None, "a1", 1.0), ("d1", None, 3.0), ("d2", "an", None), ("d3", "ax", nan), ("d4", "ax", 1.0), ("d5", "ai", inf), ("e", "az", 1.0)]
    b += [(None, "b1", 1.0), ("d3", None, 2.0), ("d2", "bn", None), ("d4", "bx", inf), ("d5", "bz", 0.0), ("d5", "by", 1.0)]
    left = spark.createDataFrame(a, "d string, i string, value double")
    right = spark.createDataFrame(b, "d string, j string, weight double")
    got = blocks.sparse_product(left, right, "d", "i", "j")
    key = lambda r: repr((r.i, r.j, None if r.value is None else round(r.value, 9) + 0.0))
    want = left.join(right, "d").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    both = lambda x: x.withColumn("k", F.explode(F.array(F.lit("p"), F.lit("q"))))
    keyed = blocks.sparse_product(both(left), both(right), "d", "i", "j", keys=["k"])
    twice = want.withColumn("value", F.col("value") * 2)
    assert sorted(map(key, keyed.collect())) == sorted(map(key, twice.collect()))


def test_sparse_product_stores_no_copies_of_its_blocks(spark, monkeypatch):
    # 7 x 9 pairs of blocks: every block is dealt once, and a pair's chunks are added up where they meet
    monkeypatch.setattr(blocks, "ITEMS", 8)
    left = spark.range(600).selectExpr("id % 13 as d", "concat('a', id % 50) as i", "cast(id as double) as value").distinct()
    right = spark.range(900).selectExpr("id % 13 as d", "concat('b', id % 70) as j", "1.0D as weight").distinct()
    want = rows(left.join(right, "d").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("weight")).alias("value")))
    for dims in (4096, 4):
        monkeypatch.setattr(blocks, "DIMS", dims)
        got = blocks.sparse_product(left, right, "d", "i", "j")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "sequence" not in plan.lower()
        assert rows(got) == want


def test_rounding_of_long_results_is_that_of_round(spark):
    from netloom.catalog.filters import r6, r6_double
    rng = np.random.default_rng(5)
    ties = np.arange(-500, 500) / 1e6 + 5e-7
    x = np.concatenate([rng.normal(size=4000), rng.normal(size=4000) * 10.0 ** rng.integers(-12, 20, 4000), ties, np.nextafter(ties, 1), np.nextafter(ties, -1),
                        ties + 123456.0, [0.0, -0.0, -1e-9, 1e11, 1e-7, np.nan, np.inf, -np.inf, 1e300, 1e-300]])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").select(r6("x").alias("a"), r6_double("x").alias("b"))
    assert [repr(r.a) for r in d.collect()] == [repr(r.b) for r in d.collect()]


def test_linked_sums_form_no_joined_rows(spark):
    from netloom.operators import chromatin as H
    access = spark.createDataFrame([(f"o{k % 7}", f"chr1:{k * 100}-{k * 100 + 50}", float(k)) for k in range(30)], "obs_id string, peak string, value double")
    links = access.select("peak", F.concat(F.lit("g"), F.col("value").cast("int") % 3).alias("gene")).distinct()
    tss = spark.createDataFrame([("chr1", 500, "g1"), ("chr1", 900, "g2")], "chrom string, tss long, gene string")
    ct = spark.createDataFrame([("o1", "0", 0.5), ("o2", "1", 0.25)], "obs_id string, topic string, p double")
    tr = spark.createDataFrame([("0", "p1", 0.5), ("1", "p1", 0.0)], "topic string, peak string, q double")
    obs = access.select("obs_id").distinct()
    expr = access.select("obs_id", F.lit("g1").alias("gene"), "value").groupBy("obs_id", "gene").agg(F.sum("value").alias("value"))
    for d in (H.dorc(access, links), I.gene_activity(access, tss), H.impute(ct, tr), I.peak_gene_corr(access, expr, obs, links)):
        assert "MapInArrow" in d._jdf.queryExecution().executedPlan().toString()
    assert rows(H.impute(ct, tr)) == [("o1", "p1", 250000)]
    depth = {r.obs_id: r.d for r in access.groupBy("obs_id").agg(F.avg("value").alias("d")).collect()}
    want = {}
    for r in access.collect():
        g = f"g{int(r.value) % 3}"
        want[r.obs_id, g] = want.get((r.obs_id, g), 0) + r.value / depth[r.obs_id]
    assert {(r.obs_id, r.gene): r.value for r in H.dorc(access, links).collect()} == pytest.approx(want)


def test_neighbours_are_found_without_copies_of_vectors_or_hopeless_pairs(spark, monkeypatch):
    from netloom.operators.neighbours import _best
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    e = spark.createDataFrame([(f"c{k:03}", [float(v) for v in r]) for k, r in enumerate(x)], "obs_id string, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = sorted((f"c{k:03}", f"c{j:03}", n + 1) for k in range(400) for n, j in enumerate(np.argsort(d[k])[:5]))
    for group in (1, 3):
        monkeypatch.setattr(blocks, "GROUP", group)
        got = blocks.knn(e, 5, block=60, part=50)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "sequence" not in plan.lower()
        assert sorted((r.obs_id, r.neighbor, r.rn) for r in got.collect()) == want
    ids, most = np.array([f"c{k}" for k in range(400)], object), np.sort(d, axis=1)[:, 3]
    all_, near = _best(ids[:50], x[:50], ids, x, 30), _best(ids[:50], x[:50], ids, x, 30, most[:50])
    assert len(all_) == 1500 and near.groupby("obs_id").size().tolist() == [4] * 50
    merged = all_.merge(near, on=["obs_id", "neighbor", "dist"])
    assert len(merged) == 200 and (merged["dist"].to_numpy() <= merged["obs_id"].map(dict(zip(ids, most))).to_numpy()).all()


def test_knn_in_parts_and_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5)).astype(np.float32).astype(float)
    x[::7] = x[0]
    x[5, 2] = float("nan")
    x[400:420] += 1000.0  # a cluster far out, whose distances lose digits in a product
    e = spark.createDataFrame([(f"c{k:03}", [float(v) for v in r]) for k, r in enumerate(x)], "obs_id string, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {k: sorted((d[k, j], f"c{j:03}") for j in range(700) if j != k and np.isfinite(d[k, j]))[:6] for k in range(700)}
    for vec in ("array<double>", "array<float>"):
        got = {}
        for r in blocks.knn(e.withColumn("vec", F.col("vec").cast(vec)), 6, block=300, part=90).collect():
            got.setdefault(int(r.obs_id[1:]), []).append((r.rn, r.dist, r.neighbor))
        assert len(got) == 699
        for k, found in got.items():
            assert [b for _, _, b in sorted(found)] == [b for _, b in want[k]] or vec == "array<float>"
            assert [a for _, a, _ in sorted(found)] == pytest.approx([a for a, _ in want[k]], abs=1e-4)


def test_activities_come_from_blocks_not_from_joined_edges(spark):
    rng = np.random.default_rng(8)
    y, w = rng.random((6, 12)), rng.standard_normal((2, 3, 12))
    expr = spark.createDataFrame([(f"o{i}", f"g{j}", float(y[i, j])) for i in range(6) for j in range(12)], "obs_id string, gene string, value double")
    net = spark.createDataFrame([(m + 0.5, f"s{s}", f"g{j}", float(w[m, s, j])) for m in range(2) for s in range(3) for j in range(12)],
                                "level double, source string, target string, weight double")
    got = X.ulm(expr, net, 5, keys=["level"])
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    r = {(r.obs_id, r.level, r.source): r.activity for r in got.collect()}
    assert len(r) == 6 * 2 * 3
    for (o, level, s), t in r.items():
        c = np.corrcoef(y[int(o[1:])], w[int(level), int(s[1:])])[0, 1]
        assert t == pytest.approx(c * np.sqrt(10 / (1 - c * c)), abs=1e-6)


def test_crowded_motifs_are_united_before_they_meet_genes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    tss = [("chr1", int(x), "+-"[k % 2], f"g{k}") for k, x in enumerate(rng.integers(0, 40_000, 60))]
    hits = [("chr1", int(x), int(x + n), f"t{k % 3}") for k, (x, n) in enumerate(zip(rng.integers(0, 40_000, 90), rng.integers(0, 40, 90)))]
    hits += [("chr1", 9_000 + k % 50, 9_030 + k % 50, "hot") for k in range(3000)] + [("chr1", t + d, t + d, f"edge{d}") for _, t, _, _ in tss[:5] for d in (-1000, 1001, -999, 1000)]
    hits += [("chr1", 8_000, 7_000, "backwards"), ("chr2", 1, 9, "elsewhere"), ("chr1", 20_000, 20_400, None)]
    genes = spark.createDataFrame(tss, "chrom string, tss long, strand string, gene string")
    motifs = spark.createDataFrame(hits, "chrom string, start long, stop long, tf string")
    seen = []
    monkeypatch.setattr(I, "grid_join", lambda a, b, *x: seen.append(b.count()) or grid_join(a, b, *x))
    order = lambda s: sorted(s, key=str)
    got = I.promoter_skeleton(genes, motifs).collect()
    want = {(f, g) for c, t, _, g in tss for d, s, e, f in hits if c == d and e >= s and e > t - 1000 and s < t + 1001}
    assert order(map(tuple, got)) == order(want)
    near = I.peaks_near_tss(motifs, genes).collect()
    lo, hi = (lambda t, s: max(0, t - (1000 if s == "+" else 100))), (lambda t, s: t + (100 if s == "+" else 1000))
    assert order(map(tuple, near)) == order({(f, g) for c, t, w, g in tss for d, s, e, f in hits if c == d and e >= s and e >= lo(t, w) and s <= hi(t, w)})
    assert len(seen) == 2 and max(seen) < 600


def test_elastic_net_keeps_the_residual_and_multiplies_no_matrix():
    class Counted(np.ndarray):
        products = 0

        def __matmul__(self, other):
            Counted.products += 1
            return np.asarray(self) @ np.asarray(other)

    rng = np.random.default_rng(10)
    x = rng.standard_normal((80, 6))
    z = np.column_stack([np.ones(80), x, x[:, 0] * 2 - x[:, 3] + 0.1 * rng.standard_normal(80)])
    s = z.T @ z
    beta = J.elastic_net(s.view(Counted), alpha=0.05)
    assert Counted.products == 0
    c, y = s[1:-1, 1:-1], s[1:-1, -1]
    slope = y - c @ beta - 80 * 0.05 * 0.5 * beta  # optimality: equal to the bound where a weight is, below it elsewhere
    assert np.allclose(slope[beta != 0], 80 * 0.05 * 0.5 * np.sign(beta[beta != 0]), atol=1e-5) and (abs(slope[beta == 0]) <= 2 + 1e-9).all()
    assert abs(beta[0] - 2) < 0.2 and abs(beta[3] + 1) < 0.2


def test_topic_rounds_shuffle_no_pairs(spark):
    e = bucketed(spark.range(400).selectExpr("concat('c', id % 40) as obs_id", "concat('p', id % 9) as peak", "array(1D, 2D) as r"), "obs_id")
    cell = e.groupBy("obs_id").agg(F.array(F.sum(F.col("r")[0])).alias("nc"))
    met = e.hint("merge").join(cell, "obs_id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and met.count() == 400
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(H, "bucketed", lambda df, by, name: seen.append(by) or bucketed(df, by, name))
        _, region = H.topics(e.select("obs_id", "peak", F.lit(1.0).alias("value")).distinct(), 2, max_iter=2)
        q = region.groupBy("topic").agg(F.sum("q").alias("q")).collect()
    assert seen == ["obs_id"] * 3 and [round(r.q, 9) for r in q] == [1.0, 1.0]


def test_the_normalised_view_shuffles_counts_once(spark, tmp_path):
    part = spark.createDataFrame([(1, "A", "x"), (2, "B", None), (3, None, "y")], "p_partkey long, p_brand string, p_type string")
    line = spark.createDataFrame([(o, p, q) for o in (1, 1, 2, None) for p in (1, 2, 3, 3) for q in (1.0, 3.0, None)], "l_orderkey long, l_partkey long, l_quantity double")
    for name, df in (("part", part), ("lineitem", line)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, str(tmp_path))
    plain, got = v.sql(VIEWS["v_norm"]), v.norm
    key = lambda d: sorted(map(str, d.select("obs_id", "gene", F.round("value", 9)).collect()))
    assert key(got) == key(plain) and got.count() > 0
    assert "Join" not in v.sql(SPARK_VIEWS["v_norm"])._jdf.queryExecution().optimizedPlan().toString()


def test_bulk_views_shuffle_neither_counts_nor_samples(spark, tmp_path):
    part = spark.createDataFrame([(1, "A", "x"), (2, "B", None), (3, "A/x", "y"), (3, "A", "x/y"), (4, None, "y")], "p_partkey long, p_brand string, p_type string")
    line = spark.createDataFrame([(o, p, q) for o in (1, 1, 2, 3, 4, None) for p in (1, 2, 3, 3, 4) for q in (1.0, 3.0, None)], "l_orderkey long, l_partkey long, l_quantity double")
    orders = spark.createDataFrame([(1, 1, "5-LOW"), (2, 2, "1-URGENT"), (2, 1, "5-LOW"), (2, 1, "5-LOW"), (3, 2, None), (5, 1, "5-LOW"), (None, 1, "5-LOW")],
                                   "o_orderkey long, o_custkey long, o_orderpriority string").withColumn("o_orderdate", F.lit("1995-01-02").cast("date"))
    customer = spark.createDataFrame([(1, 1, "M"), (2, 2, None), (2, 3, "N")], "c_custkey long, c_nationkey int, c_mktsegment string")
    for name, df in (("part", part), ("lineitem", line), ("orders", orders), ("customer", customer)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, str(tmp_path))
    key = lambda d: sorted(map(str, d.collect()))
    for name in ("counts", "bsum", "bulk", "bobs"):
        got, plain = getattr(v, name), spark.sql(_base(VIEWS[f"v_{name}"], tmp_path))
        assert got.dtypes == plain.dtypes and key(got) == key(plain) and got.count() > 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("bsum", "bobs"):
            plan = v.sql(SPARK_VIEWS.get(f"v_{name}", VIEWS[f"v_{name}"]))._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and plan.count("Exchange") == 1  # the sums over bulk samples alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _base(sql, folder):
    """The view's text on the base tables alone, nothing of it stored."""
    sql = _inline(sql)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", f"parquet.`{folder}/{t}.parquet`")
    return sql


def test_buckets_of_stored_views_stay_bounded(spark, tmp_path, monkeypatch):
    spark.range(41).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for most, want in ((1000, parts), (41, parts), (5, parts * -(-41 // (5 * parts)))):
        monkeypatch.setattr(standins, "LINES", most)
        n = Views(spark, str(tmp_path)).buckets()
        assert n == want and (41 <= most * n)
