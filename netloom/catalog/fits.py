"""J and E4, D14: per-target fits."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import rr
from netloom.operators.boosting import boosted_importance
from netloom.operators import edges as E, expression as X, fits as J, nulls as Z
from netloom.session import cut


KEYS = ("model",)  # the three networks are scored at once


def net_all(v):
    return v.net.select("model", "source", "target", "weight")


def tf_net(v):
    return net_all(v).where("source != target").join(v.gtfs.withColumnRenamed("tf", "source"), "source", "left_semi").select("model", "source", "target", "weight")


def consensus(v):
    """Regulator counts per gene from the three networks, as (gene, theta, n)."""
    c = E.consensus_regulators(v.net, v.counts.select("gene").distinct())
    return cut(c, "consensus")


def fold_moments(v):
    return J.moments(X.robust_scale(v.bulk, v.bobs), Z.folds(v.bobs))


E4 = """WITH md AS (SELECT DISTINCT model FROM v_net), need AS (SELECT target, quantile_cont(coalesce(d, 0), 0.25) AS q FROM (SELECT DISTINCT gene AS target FROM v_counts) g CROSS JOIN md
LEFT JOIN (SELECT target, model, count(*) AS d FROM v_net WHERE weight <> 0 GROUP BY ALL) x USING (target, model) GROUP BY target),
nd AS (SELECT target, CAST(round_even(q, 0) AS BIGINT) AS n FROM need WHERE CAST(round_even(q, 0) AS BIGINT) > 0),
nm AS (SELECT * FROM (SELECT e.model, e.target, e.source, n, row_number() OVER (PARTITION BY e.model, e.target ORDER BY abs(weight) DESC, $HASH(e.source, e.target, '51966'), e.source) AS rn
FROM v_net e JOIN nd USING (target) WHERE weight <> 0 AND e.source <> e.target AND e.source IN (SELECT tf FROM v_gtfs)) z WHERE rn <= n),
sh AS (SELECT md.model, nd.target, nd.n, coalesce(h, 0) AS have FROM nd CROSS JOIN md LEFT JOIN (SELECT model, target, count(*) AS h FROM nm GROUP BY 1, 2) c ON c.model = md.model AND c.target = nd.target WHERE coalesce(h, 0) < nd.n),
g AS (SELECT tf, row_number() OVER (ORDER BY $HASH(tf, '51966g'), tf) - 1 AS i FROM (SELECT DISTINCT tf FROM v_gtfs) x), gn AS (SELECT count(*) AS c FROM g),
pr AS (SELECT c, x AS p FROM gn, range(2, 20000) t(x) WHERE x >= c AND NOT EXISTS (SELECT 1 FROM range(2, 200) d(y) WHERE y * y <= x AND x % y = 0) ORDER BY x LIMIT 1),
dj AS (SELECT model, target, n, have, j, CAST(floor($U(target, '51966a') * p) + j * (1 + floor($U(target, '51966s') * (p - 1))) AS BIGINT) % p AS i
FROM (SELECT model, target, n, have, unnest(range(0, least(n + 1 + p - c, p))) AS j, p FROM sh, pr) x),
fl AS (SELECT model, target, tf AS source, n, have + row_number() OVER (PARTITION BY model, target ORDER BY j) AS rn FROM dj JOIN g USING (i)
WHERE tf <> target AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.model = dj.model AND nm.target = dj.target AND nm.source = g.tf))"""


@query("e4_regulators", E4 + " SELECT model, target, source, rn FROM nm UNION ALL SELECT model, target, source, rn FROM fl WHERE rn <= n")
def _(v):
    return J.select_regulators(net_all(v), v.gtfs, consensus(v).where("theta = 0.25"), keys=KEYS)


@query("d14_partial_corr")
def _(v):
    m = J.moments(v.bulk, v.bobs.select("obs_id", F.lit("all").alias("fold")))
    return J.partial_corr(cut(X.correlation(v.bulk, v.bobs), "corr"), m)


@query("j1_ridge_cv")
def _(v):
    regs = J.select_regulators(net_all(v), v.gtfs, consensus(v).where("theta = 0.25"), keys=KEYS)
    return J.ridge_cv(cut(regs, "regs"), fold_moments(v), keys=KEYS)


@query("j2_ridge_cv_raw")
def _(v):
    return J.ridge_cv(cut(J.raw_regulators(net_all(v), v.gtfs, keys=KEYS), "regs"), fold_moments(v), keys=KEYS)


@query("j3_elastic_refit")
def _(v):
    m = J.moments(v.bulk, v.bobs.where("is_control").select("obs_id", F.lit("control").alias("fold")))
    return J.refit_elastic(net_all(v), m, signed=True, keys=KEYS)


J4 = """WITH s AS (SELECT model, obs_id, gene, value FROM v_bulk CROSS JOIN (SELECT DISTINCT model FROM v_net) m WHERE gene IN (SELECT tf FROM v_gtfs)), a AS (SELECT model, source, target, weight * 0.1 AS w FROM v_net WHERE source <> target),
t1 AS (SELECT s.model, obs_id, target AS gene, sum(value * w) AS value FROM s JOIN a ON s.gene = a.source AND s.model = a.model GROUP BY ALL),
t2 AS (SELECT t1.model, obs_id, target AS gene, sum(value * w) AS value FROM t1 JOIN a ON t1.gene = a.source AND t1.model = a.model GROUP BY ALL)
SELECT model, obs_id, gene, r(sum(value)) AS value FROM (SELECT * FROM s UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2) u GROUP BY ALL"""


@query("j4_propagate", J4)
def _(v):
    shocks = v.bulk.join(v.gtfs.withColumnRenamed("tf", "gene"), "gene", "left_semi")
    a = net_all(v).where("source != target").withColumn("weight", F.col("weight") * 0.1)
    return rr(J.propagate(shocks, a, keys=KEYS), "value")


@query("j5_anchor_shift", """WITH b AS (SELECT o.obs_id, o.donor_id, g.gene, coalesce(n.value, 0) AS v FROM v_bobs o CROSS JOIN (SELECT DISTINCT gene FROM v_bulk) g LEFT JOIN v_bulk n ON n.obs_id = o.obs_id AND n.gene = g.gene)
SELECT obs_id, gene, r(v + (sqrt(1.2) - 1) * avg(v) OVER (PARTITION BY gene, donor_id)) AS value FROM b""")
def _(v):
    dense = X.densify(v.bulk, v.bobs, v.bulk.select("gene").distinct())
    return rr(J.anchor_shift(dense, v.bobs, "donor_id", 1.2), "value")


@query("j6_anchor_stability")
def _(v):
    net = net_all(v)
    both = net.select(F.concat_ws(" ", F.lit("net"), "model").alias("net"), "source", "target").unionByName(
        Z.degree_null(net, extra=KEYS).select(F.concat_ws(" ", F.lit("null"), "model").alias("net"), "source", "target"))
    return J.stability(cut(both, "nets"), J.moments(v.bulk, v.bobs.select("obs_id", F.col("donor_id").alias("fold"))))


@query("j7_residual_corr")
def _(v):
    m = J.moments(v.bulk, v.bobs.select("obs_id", F.col("cell_type").alias("fold")))
    return J.residual_corr(net_all(v).select(F.col("model").alias("net"), "source", "target"), m)


@query("j8_boosted_importance")
def _(v):
    return boosted_importance(v.bulk, v.bobs, v.gtfs)


J8 = """WITH x AS (SELECT obs_id, gene, value FROM v_bulk WHERE value <> 0 AND gene IN (SELECT tf FROM v_gtfs)), nn AS (SELECT count(*) AS n FROM v_bobs),
cu AS (SELECT gene, value, n, sum(n) OVER (PARTITION BY gene ORDER BY value) AS upto, sum(n) OVER (PARTITION BY gene) AS total FROM (SELECT gene, value, count(*) AS n FROM x GROUP BY ALL) h),
ct AS (SELECT gene, value AS c FROM cu WHERE (upto * 7) // total > CASE WHEN upto = n THEN -1 ELSE ((upto - n) * 7) // total END),
ln AS (SELECT ct.gene, c, count(*) FILTER (WHERE x.value < c) + CASE WHEN c > 0 THEN max(nn.n) - count(*) ELSE 0 END AS nl FROM ct JOIN x USING (gene) CROSS JOIN nn GROUP BY ct.gene, c),
ty AS (SELECT gene AS target, sum(value) AS total FROM v_bulk GROUP BY gene),
sb AS (SELECT x.gene, c, y.gene AS target, sum(CASE WHEN x.value < c THEN y.value ELSE 0 END) AS below, sum(y.value) AS stored FROM ct JOIN x USING (gene) JOIN v_bulk y USING (obs_id) GROUP BY ALL),
s AS (SELECT ln.gene, ln.c, ty.target, nl, n, coalesce(below, 0) + CASE WHEN ln.c > 0 THEN total - coalesce(stored, 0) ELSE 0 END - total / n * nl AS l
FROM ln CROSS JOIN ty CROSS JOIN nn LEFT JOIN sb ON sb.gene = ln.gene AND sb.c = ln.c AND sb.target = ty.target WHERE nl > 0 AND nl < n AND ln.gene <> ty.target),
z AS (SELECT *, l * l / nl + l * l / (n - nl) AS gain FROM s), b AS (SELECT *, max(gain) OVER (PARTITION BY target) AS best FROM z)
SELECT gene AS source, target, r(gain) AS weight FROM b WHERE gain >= best * (1 - 1e-9) QUALIFY row_number() OVER (PARTITION BY target ORDER BY gene, c) = 1"""


@query("j8_first_split", J8)
def _(v):
    return rr(boosted_importance(v.bulk, v.bobs, v.gtfs, rounds=1), "weight")


@query("j9_prior_ridge")
def _(v):
    m = J.moments(v.bulk, v.bobs.select("obs_id", F.col("cell_type").alias("fold")))
    return J.prior_ridge(net_all(v).where("source != target"), m, keys=KEYS)


@query("j10_shock_estimate")
def _(v):
    delta, _ = X.perturbation_delta(v.bulk, v.bobs.withColumn("row_no", F.xxhash64("obs_id")), ["donor_id", "cell_type"], ["donor_id"])
    w = net_all(v).where("source != target").withColumn("weight", F.col("weight") * 0.05)
    return J.shock_estimate(cut(delta, "delta"), w, w.select("model", F.col("source").alias("gene")).distinct(), keys=KEYS)
