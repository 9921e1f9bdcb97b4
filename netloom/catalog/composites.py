"""K: composite plans."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import FISHER, NET_ALL, ULM, rr
from netloom.catalog.fits import KEYS, consensus, net_all, tf_net
from netloom.catalog.joins import P2G, P2T, WINDOW
from netloom.catalog.nulls import POBS, SPLIT, pobs
from netloom.catalog.ranking import LATEST, MM
from netloom.operators import edges as E, intervals as I, ranking as R
from netloom.plans import leaderboard as L, metrics as M, preparation as P, registry as U
from netloom.session import cut


@query("k1_clean_edges", """WITH e AS (SELECT model, source, target, avg(try_cast(w AS DOUBLE)) AS weight FROM (SELECT model, source, CASE WHEN target LIKE 'P1%' THEN source ELSE target END AS target,
CASE WHEN target LIKE '%77' THEN 'bad' ELSE CAST(CAST(round(weight * 100) AS BIGINT) AS VARCHAR) END AS w FROM v_edges) x WHERE source <> target GROUP BY ALL)
SELECT model, source, target, r(weight) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(weight) DESC NULLS LAST, source, target) AS rn FROM e) y WHERE rn <= 6000 AND source IN (SELECT tf FROM v_tfs)""")
def _(v):
    raw = v.edges.select("model", "source", F.when(F.col("target").startswith("P1"), F.col("source")).otherwise(F.col("target")).alias("target"),
                         F.when(F.col("target").endswith("77"), "bad").otherwise(F.round(F.col("weight") * 100).cast("bigint").cast("string")).alias("weight"))
    return rr(E.clean_edges(raw, 6000, v.tfs, "model"), "weight")


@query("k2_regression_metric")
def _(v):
    return rr(M.regression(net_all(v), v.bulk, v.bobs, v.gtfs, consensus(v), keys=KEYS), "value")


@query("k2_regression_by_group")
def _(v):
    two = v.bobs.withColumn("half", F.when(F.col("cell_type") < "F", "a").otherwise("b"))
    return rr(M.regression(net_all(v), v.bulk, two, v.gtfs, consensus(v), group="half", keys=KEYS), "value")


WSN = """p AS (SELECT model, source, target, weight FROM v_net WHERE model <> 'A'), bg AS (SELECT source, target, abs(weight) AS d FROM v_net WHERE model = 'A'),
cq AS (SELECT source, quantile_cont(n, [0.25, 0.75]) AS q FROM (SELECT source, model, count(*) AS n FROM v_net GROUP BY ALL) x WHERE source IN (SELECT tf FROM v_gtfs) GROUP BY 1),
cs AS (SELECT source, unnest([0.25::DOUBLE, 0.75]) AS theta, CAST(unnest(list_transform(q, lambda x: floor(x))) AS BIGINT) AS k FROM cq),
need AS (SELECT m.model, cs.* FROM cs CROSS JOIN (SELECT DISTINCT model FROM p) m WHERE source IN (SELECT source FROM bg)),
pc AS (SELECT source, target, d, (rank() OVER (PARTITION BY source ORDER BY d) - 1) / count(*) OVER (PARTITION BY source)::DOUBLE AS pct, row_number() OVER (PARTITION BY source ORDER BY $HASH(source, target, '42'), target) AS i FROM bg),
tp AS (SELECT * FROM (SELECT p.*, theta, k, row_number() OVER (PARTITION BY p.model, theta, p.source ORDER BY weight DESC, target) AS rn FROM p JOIN need USING (model, source)) x WHERE rn <= k),
ht AS (SELECT model, theta, source, pct FROM tp JOIN pc USING (source, target)), hv AS (SELECT model, theta, source, count(*) AS h FROM ht GROUP BY ALL),
ms AS (SELECT n.model, n.theta, n.source, unnest(range(1, n.k - coalesce(h, 0) + 1)) AS j FROM need n LEFT JOIN hv USING (model, theta, source)),
fl AS (SELECT ms.model, ms.theta, ms.source, pc.pct FROM ms JOIN (SELECT source, count(*) AS c FROM pc GROUP BY 1) z USING (source)
JOIN pc ON pc.source = ms.source AND pc.i = 1 + CAST(floor($U(ms.source, ms.theta, ms.j, '42') * z.c) AS BIGINT))"""


@query("k3_ws_metric", f"""WITH {WSN} SELECT model, CASE theta WHEN 0.25 THEN 'ws_precision' ELSE 'ws_recall' END AS metric, r(avg(pct)) AS value FROM (SELECT * FROM ht UNION ALL SELECT * FROM fl) u GROUP BY model, theta
UNION ALL SELECT model, 'ws_raw', r(avg(d)) FROM p JOIN bg USING (source, target) GROUP BY model""")
def _(v):
    e = v.net
    bg = v.net.where("model = 'A'").select("source", "target", F.abs("weight").alias("ws_distance"))
    cons = E.consensus_edges(e, v.gtfs)
    return rr(M.ws_distance(e.where("model <> 'A'"), bg, cut(cons, "consensus"), keys=("model",)), "value")


@query("c12_background_fill", f"WITH {WSN} SELECT model, theta, source, count(*) AS n, count(*) FILTER (f) AS n_filled, r(avg(pct)) AS mean FROM (SELECT *, false AS f FROM ht UNION ALL SELECT *, true FROM fl) u GROUP BY ALL")
def _(v):
    e = v.net
    bg = v.net.where("model = 'A'").select("source", "target", F.abs("weight").alias("ws_distance"))
    bg = R.null_percentile(bg, bg.select("source", "ws_distance"), ["source"], "ws_distance")
    d = M.predicted_distances(e.where("model <> 'A'"), cut(bg, "background"), cut(E.consensus_edges(e, v.gtfs), "consensus"), keys=("model",))
    g = d.groupBy("model", "theta", "source").agg(F.count("*").alias("n"), F.count_if("filled").alias("n_filled"), F.avg("percentile").alias("mean"))
    return rr(g, "mean")


@query("c17_consensus_lookup", """SELECT g.gene, CAST(round_even(quantile_cont(coalesce(d, 0), 0.75), 0) AS BIGINT) AS n FROM (SELECT DISTINCT gene FROM v_bulk) g CROSS JOIN (SELECT DISTINCT model FROM v_net) m
LEFT JOIN (SELECT target, model, count(*) AS d FROM v_net WHERE weight <> 0 GROUP BY ALL) x ON x.target = g.gene AND x.model = m.model GROUP BY g.gene""")
def _(v):
    return M.consensus_lookup(v.bulk, consensus(v), 0.75)


K4 = f"""WITH de AS (SELECT source AS pert, target AS gene, weight * 10 AS score FROM v_net WHERE model = 'A'), g AS (SELECT DISTINCT gene FROM de), m AS (SELECT count(*)::DOUBLE AS m FROM g),
n0 AS (SELECT model, source, target, weight FROM v_net WHERE source <> target AND source IN (SELECT tf FROM v_gtfs)), net AS (SELECT * FROM n0 WHERE (model, source) IN (SELECT model, source FROM n0 GROUP BY 1, 2 HAVING count(*) >= 5)),
y AS (SELECT pert AS source, sum(score) AS sy, sum(score * score) AS qy FROM de GROUP BY 1),
w1 AS (SELECT model, source, count(*) AS k, sum(weight) AS sw, sum(weight * weight) AS qw FROM net JOIN g ON target = gene GROUP BY 1, 2 HAVING count(*) >= 3),
x1 AS (SELECT model, net.source, sum(weight * score) AS xy FROM net JOIN de ON pert = net.source AND gene = target GROUP BY 1, 2),
r1 AS (SELECT model, source, (m * coalesce(xy, 0) - sw * sy) / sqrt((m * qw - sw * sw) * (m * qy - sy * sy)) AS r, m, k FROM w1 JOIN y USING (source) LEFT JOIN x1 USING (model, source) CROSS JOIN m),
a1 AS (SELECT model, source, k, r * sqrt((m - 2) / ((1 - r) * (1 + r))) AS act FROM r1),
gi AS (SELECT gene, row_number() OVER (ORDER BY $HASH(gene, '42g'), gene) - 1 AS i FROM g),
pm AS (SELECT m AS n, x AS p FROM m, range(2, 20000) t(x) WHERE x >= m AND NOT EXISTS (SELECT 1 FROM range(2, 200) d(y) WHERE y * y <= x AND x % y = 0) ORDER BY x LIMIT 1),
dj AS (SELECT model, source, k, j, CAST(floor($U(source, '42a') * p) + j * (1 + floor($U(source, '42s') * (p - 1))) AS BIGINT) % p AS i
FROM (SELECT model, source, k, unnest(range(0, CAST(least(k + p - n, p) AS BIGINT))) AS j, p FROM a1, pm) x),
dr AS (SELECT model, source, gene AS target FROM (SELECT model, source, k, gene, row_number() OVER (PARTITION BY model, source ORDER BY j) AS rn FROM dj JOIN gi USING (i)) z WHERE rn <= k),
x2 AS (SELECT model, dr.source, sum(coalesce(score, 0)) AS xy, count(*)::DOUBLE AS k FROM dr LEFT JOIN de ON pert = dr.source AND gene = target GROUP BY 1, 2),
r2 AS (SELECT model, source, (m * xy - k * sy) / sqrt((m * k - k * k) * (m * qy - sy * sy)) AS r, m FROM x2 JOIN y USING (source) CROSS JOIN m WHERE k >= 3),
t2 AS (SELECT model, source, r * sqrt((m - 2) / ((1 - r) * (1 + r))) AS rnd FROM r2), pr AS (SELECT model, source, abs(act) - abs(rnd) AS d, rnd FROM a1 JOIN t2 USING (model, source)),
al AS (SELECT model, d FROM pr UNION ALL SELECT q.model, 0 FROM (SELECT DISTINCT n0.model, pert FROM de CROSS JOIN (SELECT DISTINCT model FROM n0) n0) q WHERE (q.model, pert) NOT IN (SELECT model, source FROM net))
SELECT model, 't_rec_precision' AS metric, r(avg(d) / (stddev_samp(d) / sqrt(count(*)))) AS value FROM pr GROUP BY model UNION ALL SELECT model, 't_rec_recall', r(avg(d) / (stddev_samp(d) / sqrt(count(*)))) FROM al GROUP BY model"""


def de_table(v):
    return v.net.where("model = 'A'").select(F.col("source").alias("perturbation"), F.col("target").alias("gene"), (F.col("weight") * 10).alias("score"))


@query("k4_tf_recovery", K4)
def _(v):
    return rr(M.tf_recovery(tf_net(v), de_table(v), keys=KEYS), "value")


K5 = """WITH p AS (SELECT model, source, target, weight FROM v_net WHERE model <> 'A'), g AS (SELECT DISTINCT gene FROM v_counts),
gt AS (SELECT DISTINCT CASE WHEN weight > 0.4 THEN 'high' ELSE 'mid' END AS gt, source, target FROM v_net WHERE model = 'A' AND weight > 0.2 AND source IN (SELECT tf FROM v_gtfs)),
nt AS (SELECT gt, count(DISTINCT source) AS n_tfs FROM gt GROUP BY 1), k AS (SELECT gt, source, count(*) AS k FROM gt WHERE target IN (SELECT gene FROM g) GROUP BY ALL),
t AS (SELECT * FROM (SELECT p.model, k.gt, p.source, p.target, k.k, row_number() OVER (PARTITION BY p.model, k.gt, p.source ORDER BY abs(weight) DESC, p.target) AS rn FROM p JOIN k USING (source)) x WHERE rn <= k),
h AS (SELECT t.model, t.gt, t.source, count(gt.target) AS tp, count(*) AS got FROM t LEFT JOIN gt ON gt.gt = t.gt AND gt.source = t.source AND gt.target = t.target GROUP BY ALL),
d AS (SELECT m.model, k.gt, k.source, got, CASE WHEN got IS NULL THEN 0 ELSE (tp / got - k / (SELECT count(*) FROM g)) / (1 - k / (SELECT count(*) FROM g)) END AS norm FROM k CROSS JOIN (SELECT DISTINCT model FROM p) m LEFT JOIN h ON h.model = m.model AND h.gt = k.gt AND h.source = k.source),
s AS (SELECT model, gt, coalesce(avg(norm) FILTER (got IS NOT NULL), 0) AS precision, avg(norm) AS recall, max(n_tfs) AS w FROM d JOIN nt USING (gt) GROUP BY ALL),
u AS (SELECT model, gt, precision, recall FROM s UNION ALL SELECT model, 'all', sum(precision * w) / sum(w), sum(recall * w) / sum(w) FROM s GROUP BY model)
SELECT model, gt, r(precision) AS precision, r(recall) AS recall, r(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) AS f1 FROM u"""


def truths(v):
    return v.net.where("model = 'A' and weight > 0.2").select(F.when(F.col("weight") > 0.4, "high").otherwise("mid").alias("gt"), "source", "target")


@query("c11_target_overlap", K5[:K5.index("d AS (SELECT m.model")].rstrip().rstrip(",") + " SELECT m.model, k.gt, k.source, k.k, tp, got FROM k CROSS JOIN (SELECT DISTINCT model FROM p) m LEFT JOIN h ON h.model = m.model AND h.gt = k.gt AND h.source = k.source")
def _(v):
    genes = v.counts.select("gene").distinct()
    return M.target_overlap(v.net.where("model <> 'A'"), truths(v), genes, v.gtfs, ("model",)).drop("n_targets")


@query("k5_tf_binding", K5)
def _(v):
    genes = v.counts.select("gene").distinct()
    return rr(M.tf_binding(v.net.where("model <> 'A'"), truths(v), genes, v.gtfs, ("model",)), "precision", "recall", "f1")


TCRIT = "(2.3263478740408408 + (2.3263478740408408 ^ 3 + 2.3263478740408408) / (4 * (n - 1)) + (5 * 2.3263478740408408 ^ 5 + 16 * 2.3263478740408408 ^ 3 + 3 * 2.3263478740408408) / (96 * (n - 1) ^ 2))"
K6 = f"""WITH net AS (SELECT concat(library, '|', set_name) AS source, gene AS target, 1.0::DOUBLE AS weight FROM v_genesets), {ULM.replace('>= 5', '>= 10')},
ac AS (SELECT source, count(*) AS n, avg(activity) AS mean, avg(activity) / (stddev_samp(activity) / sqrt(count(*))) AS t FROM ulm GROUP BY source),
md AS (SELECT DISTINCT model FROM v_net), e0 AS (SELECT DISTINCT model, source, target FROM v_net WHERE source <> target), e AS (SELECT * FROM e0 WHERE (model, source) IN (SELECT model, source FROM e0 GROUP BY 1, 2 HAVING count(*) >= 10)),
o AS (SELECT model, source, library, set_name, count(*) AS ov FROM e JOIN v_genesets g ON e.target = g.gene GROUP BY ALL), t AS (SELECT model, source, count(*) AS nt FROM e GROUP BY 1, 2), z AS (SELECT library, set_name, count(*) AS ns FROM v_genesets GROUP BY ALL),
ln AS (SELECT library, count(DISTINCT set_name) AS sets FROM v_genesets GROUP BY 1),
f AS (SELECT model, library, set_name, sets, CASE WHEN ov <= greatest(0, nt + ns - nn) THEN 1.0 ELSE {FISHER} END AS p FROM o JOIN t USING (model, source) JOIN z USING (library, set_name) JOIN ln USING (library) CROSS JOIN (SELECT count(DISTINCT gene) AS nn FROM v_counts) u),
en AS (SELECT DISTINCT model, concat(library, '|', set_name) AS source FROM f WHERE p < 0.05 / sets),
x AS (SELECT md.model, split_part(ac.source, '|', 1) AS library, t > {TCRIT} AND mean > 0 AS act, en.source IS NOT NULL AS enr FROM ac CROSS JOIN md LEFT JOIN en ON en.model = md.model AND en.source = ac.source)
SELECT model, library, count(*) FILTER (act AND enr) AS tp, count(*) FILTER (NOT act AND enr) AS fp, count(*) FILTER (act AND NOT enr) AS fn, count(*) FILTER (NOT act AND NOT enr) AS tn,
r(coalesce(count(*) FILTER (act AND enr) / nullif(count(*) FILTER (enr), 0), 0)) AS precision, r(coalesce(count(*) FILTER (act AND enr) / nullif(count(*) FILTER (act), 0), 0)) AS recall,
r(coalesce(2 * count(*) FILTER (act AND enr) / nullif(count(*) FILTER (enr) + count(*) FILTER (act), 0), 0)) AS f1 FROM x GROUP BY model, library"""


@query("k6_gs_recovery", K6)
def _(v):
    return rr(M.gs_recovery(net_all(v).where("source != target"), v.genesets, v.bulk, v.bobs, v.gtfs, keys=KEYS, genes=v.counts.select("gene")), "precision", "recall", "f1")


K7 = f"""WITH {NET_ALL}, {ULM}, am AS (SELECT u.source, o.cell_type AS grp, u.activity, median(u.activity) OVER (PARTITION BY u.source, o.cell_type) AS med FROM ulm u JOIN v_bobs o USING (obs_id)),
md AS (SELECT source, avg(mad) AS mad FROM (SELECT source, grp, avg(abs(activity - med)) AS mad FROM am GROUP BY ALL HAVING count(*) >= 2) x GROUP BY 1),
c AS (SELECT source, split_part(source, '|', 1) AS model, row_number() OVER (PARTITION BY split_part(source, '|', 1) ORDER BY count(*) DESC, source) AS rank FROM net GROUP BY source), sz AS (SELECT unnest([10, 42, 74, 106, 138, 171, 203, 235, 267, 300]) AS n),
d AS (SELECT model, n, mad FROM md JOIN c USING (source) JOIN sz ON n >= rank), q AS (SELECT model, n, quantile_cont(mad, 0.95) AS p95 FROM d GROUP BY 1, 2)
SELECT model, 'replicate_consistency' AS metric, r(sum(s) / 10) AS value FROM (SELECT model, n, sum(1 - greatest(0, least(1, mad / p95))) / n AS s FROM d JOIN q USING (model, n) GROUP BY model, n) y GROUP BY model"""


def groups(v):
    return v.bobs.select("obs_id", F.col("cell_type").alias("grp"))


@query("k7_replicate_consistency", K7)
def _(v):
    return rr(M.replicate_consistency(v.net, v.bulk, groups(v), keys=("model",)), "value")


def bulk_obs(v):
    return v.bobs.withColumn("row_no", F.xxhash64("obs_id"))


def early(v):
    return v.gtfs.where("tf like 'Brand#1/%'").withColumnRenamed("tf", "gene")


@query("k8_sem_metric")
def _(v):
    return rr(M.sem(net_all(v), v.bulk, bulk_obs(v), ["donor_id", "cell_type"], ["donor_id"], ["perturbation", "cell_type"], early(v), keys=KEYS), "value")


@query("k9_vc_metric")
def _(v):
    return rr(M.vc(net_all(v), v.bulk, bulk_obs(v), ["donor_id", "cell_type"], ["donor_id"], ["perturbation", "cell_type"], keys=KEYS), "value")


@query("k9_vc_cells")
def _(v):
    return rr(M.vc(net_all(v), v.bulk, bulk_obs(v), ["donor_id", "cell_type"], ["donor_id"], ["perturbation", "cell_type"], keys=KEYS, cells=True), "value")


@query("k10_anchor_metric")
def _(v):
    return rr(M.anchor_regression(net_all(v), v.bulk, v.bobs, "donor_id", keys=KEYS), "value")


@query("k11_rc_metric")
def _(v):
    return rr(M.correlation_consistency(net_all(v), v.bulk, v.bobs, "cell_type", keys=KEYS, genes=v.counts.select("gene")), "value")


@query("k12_residual_metric")
def _(v):
    return rr(M.residual_metric(net_all(v), v.bulk, v.bobs, "cell_type", keys=KEYS), "value")


@query("k13_evaluate_all")
def _(v):
    bg = v.net.where("model = 'A'").select("source", "target", F.abs("weight").alias("ws_distance"))
    ctx = {"expr": v.bulk, "obs": bulk_obs(v), "groups": groups(v), "tfs": v.gtfs, "genes": cut(v.counts.select("gene").distinct(), "genes"), "truths": truths(v), "de": de_table(v),
           "sets": v.genesets, "background": bg, "edge_counts": cut(E.consensus_edges(v.net, v.gtfs), "consensus"), "regulators": consensus(v),
           "strict": ["donor_id", "cell_type"], "loose": ["donor_id"], "cv": ["perturbation", "cell_type"], "early": early(v)}
    p = tf_net(v).select(F.lit("op").alias("dataset_id"), F.col("model").alias("method_id"), "source", "target", "weight")
    return rr(U.evaluate_all(cut(p, "predictions"), {"op": ctx}, list(U.NEEDS)).select("dataset", "modality", "model", "metric", "value"), "value")


APP = """g AS (SELECT dataset, metric, count(value) AS n, avg(value) AS mean, min(value) AS mn, max(value) AS mx, max(value) FILTER (model = 'negative_control') AS nc, max(value) FILTER (model = 'positive_control') AS pc,
CASE metric WHEN 'r_precision' THEN 0.001 WHEN 'ws_precision' THEN 0.5 WHEN 'sem' THEN 0.01 ELSE 0.05 END::DOUBLE AS fl FROM v_scores GROUP BY ALL),
h AS (SELECT *, greatest(fl, coalesce(nc, fl)) AS thr, (mx - mn) / nullif(mean, 0) AS rom FROM g),
app AS (SELECT *, coalesce(n >= 2 AND coalesce(rom >= 0.2, true) AND mx >= thr AND coalesce(pc > nc, true), false) AS keep FROM h)"""


@query("k14_applicability", f"""WITH {APP} SELECT dataset, metric, keep, n AS n_methods, r(rom) AS range_over_mean, r(mx) AS "max", r(thr) AS threshold,
CASE WHEN n = 0 THEN 'Metric not computed for this dataset' WHEN n < 2 THEN 'Insufficient data points (<2 methods)' WHEN keep THEN 'Passes all criteria' ELSE concat_ws('; ',
CASE WHEN rom < 0.2 THEN printf('Low variability (CV=%.3f < 0.2)', rom) END, CASE WHEN mx < thr THEN printf('Low max score (max=%.3f < threshold=%.3f)', mx, thr) END,
CASE WHEN pc <= nc THEN printf('PC not > NC (PC=%.4f, NC=%.4f)', pc, nc) END) END AS reason FROM app""")
def _(v):
    return rr(L.applicability(v.scores).select("dataset", "metric", "keep", "n_methods", "range_over_mean", "max", "threshold", "reason"), "range_over_mean", "max", "threshold")


def modalities(v):
    return v.scores.select("dataset").distinct().withColumn("modality", F.when(F.col("dataset").isin("AFRICA", "AMERICA"), "Multiomics").otherwise("Transcriptomics"))


RANKS = """md AS (SELECT DISTINCT dataset, CASE WHEN dataset IN ('AFRICA', 'AMERICA') THEN 'Multiomics' ELSE 'Transcriptomics' END AS modality FROM v_scores),
rk AS (SELECT dataset, model, metric, (rank() OVER (PARTITION BY dataset, metric ORDER BY value) + (count(*) OVER (PARTITION BY dataset, metric, value) - 1) / 2.0) / count(*) OVER (PARTITION BY dataset, metric) AS pct FROM v_scores WHERE value IS NOT NULL),
mm2 AS (SELECT model, modality, median(pct) AS rank FROM rk JOIN md USING (dataset) GROUP BY ALL)"""


def scaled(src, key, val):
    return f"CASE WHEN max({val}) OVER (PARTITION BY {key}) > min({val}) OVER (PARTITION BY {key}) THEN ({val} - min({val}) OVER (PARTITION BY {key})) / (max({val}) OVER (PARTITION BY {key}) - min({val}) OVER (PARTITION BY {key})) ELSE 0 END"


K15 = f"""{MM}, {RANKS}, a AS (SELECT model, metric AS name, avg(value) AS s FROM mm GROUP BY ALL), b AS (SELECT model, dataset AS name, avg(value) AS s FROM mm GROUP BY ALL), o AS (SELECT model, avg(rank) AS s FROM mm2 GROUP BY 1),
board AS (SELECT model, 'metric' AS kind, name, {scaled('a', 'name', 's')} AS score FROM a WHERE s IS NOT NULL UNION ALL SELECT model, 'dataset', name, {scaled('b', 'name', 's')} FROM b WHERE s IS NOT NULL
UNION ALL SELECT model, 'overall', 'overall_score', (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) FROM o)"""


@query("k15_leaderboard", f"WITH {K15} SELECT model, kind, name, r(score) AS score FROM board")
def _(v):
    return rr(L.overall_scores(v.scores, modalities(v)), "score")


@query("k16_rankings", f"""WITH {RANKS}, m AS (SELECT modality AS board, model, {scaled('m', 'modality', 'rank')} AS s FROM mm2), o AS (SELECT 'Overall' AS board, model, avg(s) AS s FROM m GROUP BY model),
o2 AS (SELECT board, model, {scaled('o', 'board', 's')} AS s FROM o), t AS (SELECT metric AS board, model, median(pct) AS s FROM rk GROUP BY ALL), t2 AS (SELECT board, model, {scaled('t', 'board', 's')} AS s FROM t),
u AS (SELECT * FROM m UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM t2) SELECT board, model, r(s) AS rank FROM u""")
def _(v):
    return rr(L.rankings(v.scores, modalities(v)).select("board", "model", "rank"), "rank")


@query("k17_overview", f"""WITH {K15}, fr AS (SELECT model, length(model)::DOUBLE AS f FROM (SELECT DISTINCT model FROM v_scores) x), cx AS (SELECT model, max(f) OVER () - f AS c FROM fr),
rs AS (SELECT model, length(model) * 0.5 AS h FROM fr), ov AS (SELECT model, max(score) FILTER (name = 'overall_score') AS overall_score, max(score) FILTER (name = 'sem') AS sem, max(score) FILTER (name = 'ASIA') AS asia FROM board GROUP BY 1)
SELECT model, r(coalesce(overall_score, 0)) AS overall_score, r(coalesce(sem, 0)) AS sem, r(coalesce(asia, 0)) AS asia, r(c) AS complexity, r(max(ln(c + 1)) OVER () - ln(c + 1)) AS complexity_log, r(h) AS hours FROM ov JOIN cx USING (model) JOIN rs USING (model)""")
def _(v):
    m = v.scores.select("model").distinct()
    fr = m.withColumn("friendly", F.length("model").cast("double"))
    rs = m.select(F.col("model").alias("method"), (F.length("model") * 0.5).cast("double").alias("hours"))
    names = ["gs_f1", "r_precision", "sem", "tfb_f1", "ws_precision"]
    ds = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    o = L.overview(v.scores, modalities(v), rs, fr, names, ds)
    o = o.select("model", "overall_score", "sem", F.col("ASIA").alias("asia"), "complexity", "complexity_log", "hours")
    return rr(o, "overall_score", "sem", "asia", "complexity", "complexity_log", "hours")


@query("k18_trace_report", f"""WITH {LATEST}, x AS (SELECT split_part(method, '.', 2) AS dataset, * FROM t)
SELECT dataset, count(DISTINCT source_file) AS trace_files, count(*) AS completed_tasks, count(DISTINCT method) AS unique_methods, count(*) FILTER (file_date = d) AS output_tasks FROM x JOIN lr USING (method) GROUP BY dataset""")
def _(v):
    return P.trace_report(v.trace)


KEPT = """o1 AS (SELECT * FROM po WHERE perturbation IN (SELECT perturbation FROM po GROUP BY 1 HAVING count(*) >= 100)), e1 AS (SELECT c.* FROM v_counts c WHERE obs_id IN (SELECT obs_id FROM o1)),
g1 AS (SELECT e1.* FROM e1 WHERE gene IN (SELECT gene FROM e1 GROUP BY 1 HAVING count(*) >= 100)), kp AS (SELECT * FROM g1 WHERE obs_id IN (SELECT obs_id FROM g1 GROUP BY 1 HAVING count(*) >= 2))"""
SPLIT19 = SPLIT.format(tf="false").replace("FROM po WHERE NOT is_control", "FROM po WHERE NOT is_control AND obs_id IN (SELECT obs_id FROM kp)").replace("FROM po WHERE is_control", "FROM po WHERE is_control AND obs_id IN (SELECT obs_id FROM kp)")


def single_cell(v):
    return P.process_single_cell(v.counts, pobs(v), min_cells_per_pert=100, min_cells_per_gene=100, min_genes_per_cell=2)


@query("k19_single_cell", f"""WITH {POBS}, {KEPT}, sp AS ({SPLIT19}), nm AS (SELECT kp.obs_id, gene, ln(1 + 10000.0 * value / t) AS value FROM kp JOIN (SELECT obs_id, sum(value) AS t FROM kp GROUP BY 1) x USING (obs_id))
SELECT split, gene, count(*) AS n, r(sum(value)) AS total FROM nm JOIN po USING (obs_id) JOIN sp USING (perturbation) GROUP BY ALL""")
def _(v):
    return rr(single_cell(v)["split"].groupBy("split", "gene").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("k20_pseudobulk", f"""WITH {POBS}, {KEPT}, sp AS ({SPLIT19}), o2 AS (SELECT *, concat(perturbation, '_', plate) AS bid FROM po WHERE obs_id IN (SELECT obs_id FROM kp)),
bk AS (SELECT bid, perturbation, count(*) AS c FROM o2 GROUP BY ALL HAVING count(*) >= 10), sm AS (SELECT bid, gene, sum(value) AS v FROM kp JOIN o2 USING (obs_id) GROUP BY ALL), nm AS (SELECT bid, gene, ln(1 + 10000.0 * v / sum(v) OVER (PARTITION BY bid)) AS v FROM sm)
SELECT split, bid AS obs_id, gene, r(v) AS value, c AS cell_count FROM nm JOIN bk USING (bid) JOIN sp USING (perturbation)""")
def _(v):
    s = single_cell(v)
    return rr(P.process_bulk(s["counts"], s["obs"], s["groups"], ["perturbation", "plate"]), "value")


@query("k21_ground_truth", f"""WITH {WINDOW}, e AS (SELECT DISTINCT p.cell_type, p.tf AS source, t.gene AS target FROM v_peaks p JOIN t ON p.chrom = t.chrom AND p.stop >= t.s AND p.start <= t.e WHERE p.cell_type IN ('K1', 'K2', 'K3'))
SELECT cell_type, count(*) AS n_edges, count(DISTINCT source) AS n_tfs, count(DISTINCT target) AS n_targets FROM e GROUP BY 1""")
def _(v):
    return P.build_ground_truth(v.peaks, v.tss, ["k1", "k2", "k3"])[1]


@query("k22_skeleton", f"""WITH {P2G}, {P2T} SELECT source, gene AS target FROM p2g JOIN p2t USING (peak) UNION SELECT p.tf, t.gene FROM v_peaks p JOIN v_tss t ON p.chrom = t.chrom AND p.stop > t.tss - 1000 AND p.start < t.tss + 1001""")
def _(v):
    return I.skeleton(v.tss, v.peaks, v.access)


@query("k23_consensus_refresh", """WITH d AS (SELECT target, model, count(*) AS d FROM v_net WHERE weight <> 0 GROUP BY ALL),
q AS (SELECT 'regulators' AS kind, g.gene AS name, quantile_cont(coalesce(d, 0), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM (SELECT DISTINCT gene FROM v_counts) g CROSS JOIN (SELECT DISTINCT model FROM v_net) m LEFT JOIN d ON d.target = g.gene AND d.model = m.model GROUP BY g.gene),
s AS (SELECT 'edges' AS kind, source AS name, quantile_cont(d, [0.25, 0.75]) AS q FROM (SELECT source, model, count(*) AS d FROM v_net WHERE source IN (SELECT tf FROM v_gtfs) GROUP BY ALL) x GROUP BY source)
SELECT kind, name, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS theta, CAST(unnest(list_transform(q, lambda x: round_even(x, 0))) AS BIGINT) AS n FROM q
UNION ALL SELECT kind, name, unnest([0.25::DOUBLE, 0.75]), CAST(unnest(list_transform(q, lambda x: floor(x))) AS BIGINT) FROM s""")
def _(v):
    return P.refresh_consensus(v.net, v.counts.select("gene").distinct(), v.gtfs)


@query("k24_applicability_matrix", f"""WITH {APP}, d AS (SELECT DISTINCT metric, dataset FROM v_scores WHERE metric <> 'sem' OR dataset <> 'ASIA'), k AS (SELECT metric, dataset FROM app WHERE keep),
c AS (SELECT metric, dataset, CASE WHEN k.metric IS NOT NULL THEN 2 ELSE 1 END AS s FROM d FULL JOIN k USING (metric, dataset))
SELECT metric, coalesce(max(s) FILTER (dataset = 'AFRICA'), 0)::INT AS africa, coalesce(max(s) FILTER (dataset = 'AMERICA'), 0)::INT AS america, coalesce(max(s) FILTER (dataset = 'ASIA'), 0)::INT AS asia,
coalesce(max(s) FILTER (dataset = 'EUROPE'), 0)::INT AS europe, coalesce(max(s) FILTER (dataset = 'MIDDLE EAST'), 0)::INT AS middle_east FROM c GROUP BY metric""".replace("CASE WHEN k.metric IS NOT NULL THEN 2 ELSE 1 END AS s FROM d FULL JOIN k USING (metric, dataset)", "max(s) AS s FROM (SELECT metric, dataset, 1 AS s FROM d UNION ALL SELECT metric, dataset, 2 FROM k) z GROUP BY ALL"))
def _(v):
    declared = v.scores.where("metric <> 'sem' or dataset <> 'ASIA'")
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    m = L.applicability_matrix(declared, L.applicability(v.scores), names)
    return m.select("metric", *[F.col(n).alias(n.lower().replace(" ", "_")) for n in names])
