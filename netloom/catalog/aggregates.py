"""D: aggregations."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.filters import r6, r6_double
from netloom.catalog.joins import P2G
from netloom.operators import (blocks, chromatin as H, coregulation as G, edges as E, enrichment as N, expression as X,
                               intervals as I, ranking as R)
from netloom.plans import leaderboard as L


def rr(df, *cols):
    """Round the named columns for the value comparison."""
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


#: all networks at once: a source carries its network's name
NET_ALL = "net AS (SELECT concat(model, '|', source) AS source, target, weight FROM v_net)"


def net_all(v):
    return v.net.select(F.concat_ws("|", "model", "source").alias("source"), "target", "weight")





@query("d1_dedup_edges", """SELECT 'avg' AS how, model, source, target, r(avg(weight)) AS weight FROM v_edges GROUP BY ALL
UNION ALL SELECT 'sum', model, source, target, r(sum(weight)) FROM v_edges GROUP BY ALL""")
def _(v):
    a = E.dedup_edges(v.edges, "avg", ["model"]).withColumn("how", F.lit("avg"))
    return rr(a.unionByName(E.dedup_edges(v.edges, "sum", ["model"]).withColumn("how", F.lit("sum"))), "weight")


def grp_obs(v):
    return v.obs.withColumn("grp", F.concat_ws("_", "perturbation", "cell_type", "donor_id")).drop("row_no")


@query("d2_pseudobulk", """SELECT b.obs_id AS grp, gene, value, cell_count, perturbation, donor_id FROM v_bsum b JOIN
(SELECT concat(perturbation, '_', cell_type, '_', donor_id) AS obs_id, perturbation, donor_id, count(*) AS cell_count FROM v_obs GROUP BY ALL, cell_type) o USING (obs_id)""".replace("GROUP BY ALL, cell_type", "GROUP BY perturbation, cell_type, donor_id"))
def _(v):
    b, m = X.pseudobulk(v.counts, grp_obs(v), "grp")
    return b.join(m, "grp").select("grp", "gene", "value", "cell_count", "perturbation", "donor_id")


@query("d3_bulkify", """SELECT b.obs_id AS grp, count(*) AS n_genes, sum(value) AS total, max(n) AS cell_count FROM v_bsum b JOIN
(SELECT concat(perturbation, '_', cell_type, '_', donor_id) AS obs_id, count(*) AS n FROM v_obs GROUP BY perturbation, cell_type, donor_id) o USING (obs_id) WHERE n >= 25 GROUP BY 1""")
def _(v):
    b, m = X.pseudobulk(v.counts, grp_obs(v), "grp", 25)
    return b.join(m, "grp").groupBy("grp").agg(F.count("*").alias("n_genes"), F.sum("value").alias("total"), F.max("cell_count").alias("cell_count"))


@query("d4_lognorm", "SELECT obs_id, gene, r(value) AS value FROM v_norm")
def _(v):
    return rr(X.lognorm(v.counts), "value")


@query("d5_pearson_residual", """WITH t AS (SELECT sum(value) AS t FROM v_bsum), r AS (SELECT obs_id, sum(value) AS r FROM v_bsum GROUP BY 1), c AS (SELECT gene, sum(value) AS c FROM v_bsum GROUP BY 1),
z AS (SELECT r.obs_id, c.gene, coalesce(b.value, 0) AS x, r.r * c.c / t.t AS mu FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN v_bsum b ON b.obs_id = r.obs_id AND b.gene = c.gene)
SELECT obs_id, gene, r(greatest(-sqrt((SELECT count(*) FROM r)), least(sqrt((SELECT count(*) FROM r)), (x - mu) / sqrt(mu + mu * mu / 100)))) AS value FROM z""")
def _(v):
    return rr(X.pearson_residual(v.bsum, v.bobs), "value")


@query("d6_group_sizes", """SELECT donor_id, n, r(1 - nnz / (n * 150.0)) AS missing_ratio FROM (SELECT donor_id, count(*) AS n FROM v_obs GROUP BY 1) a
JOIN (SELECT donor_id, count(*) AS nnz FROM v_obs JOIN v_counts USING (obs_id) GROUP BY 1) b USING (donor_id)""")
def _(v):
    return rr(X.missing_ratio(v.counts, v.obs, "donor_id"), "missing_ratio")


D7 = """WITH x AS (SELECT p.perturbation, p.gene, o.is_control, coalesce(n.value, 0) AS v FROM v_pert p JOIN v_obs o ON o.is_control OR o.perturbation = p.perturbation
LEFT JOIN v_norm n ON n.obs_id = o.obs_id AND n.gene = p.gene WHERE p.is_control = 0),
s AS (SELECT perturbation, gene, count(*) FILTER (NOT is_control) AS n1, count(*) FILTER (is_control) AS n0, avg(v) FILTER (NOT is_control) AS m1, avg(v) FILTER (is_control) AS m0,
var_samp(v) FILTER (NOT is_control) AS v1, var_samp(v) FILTER (is_control) AS v0 FROM x GROUP BY ALL)
SELECT perturbation, gene, n1, n0, r(m0) AS mean_control, r(m1) AS mean_perturbed, r(log2((m1 + 1e-8) / (m0 + 1e-8))) AS lfc, r((m1 - m0) / sqrt(v1 / n1 + v0 / n0)) AS t FROM s"""


@query("d7_perturbation_effect", D7)
def _(v):
    d = X.perturbation_effect(v.norm, v.obs, v.pert.where("is_control = 0"))
    return rr(d.drop("df"), "mean_control", "mean_perturbed", "lfc", "t")


@query("d8_qc_effect")
def _(v):
    return X.qc_effect(v.norm, v.obs, v.pert.where("is_control = 0")).groupBy("perturbation").agg(F.count("*").alias("n"))


HIST = """d AS (SELECT o.obs_id, o.is_control, o.perturbation, g.gene, coalesce(n.value, 0) AS v FROM v_obs o CROSS JOIN (SELECT DISTINCT gene FROM v_counts) g LEFT JOIN v_norm n ON n.obs_id = o.obs_id AND n.gene = g.gene)"""


@query("d9_rank_sum_de", f"""WITH {HIST}, p AS (SELECT perturbation AS tf FROM v_pert WHERE is_control = 0),
h AS (SELECT p.tf, d.gene, d.v, count(*) AS n, count(*) FILTER (NOT d.is_control) AS n1 FROM d JOIN p ON d.is_control OR d.perturbation = p.tf GROUP BY 1, 2, 3),
k AS (SELECT tf, gene, n, n1, sum(n) OVER (PARTITION BY tf, gene ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n + (n + 1) / 2.0 AS rk FROM h),
s AS (SELECT tf, gene, sum(n1 * rk) AS r1, sum(n1) AS n1, sum(n) - sum(n1) AS n0 FROM k GROUP BY 1, 2)
SELECT tf AS perturbation, gene, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, r((r1 - n1 * (n0 + n1 + 1) / 2.0) / sqrt(CAST(n0 AS DOUBLE) * n1 * (n0 + n1 + 1) / 12.0)) AS score FROM s""")
def _(v):
    return rr(X.rank_sum(v.norm, v.obs), "score")


@query("d10_wasserstein", f"""WITH {HIST}, p AS (SELECT perturbation AS tf FROM v_pert WHERE is_control = 0),
h AS (SELECT p.tf, d.gene, d.v, count(*) FILTER (d.is_control) AS n0, count(*) FILTER (NOT d.is_control) AS n1 FROM d JOIN p ON d.is_control OR d.perturbation = p.tf GROUP BY 1, 2, 3),
k AS (SELECT tf, gene, v, lead(v) OVER w AS nx, sum(n0) OVER w / (sum(n0) OVER (PARTITION BY tf, gene))::DOUBLE AS f0, sum(n1) OVER w / (sum(n1) OVER (PARTITION BY tf, gene))::DOUBLE AS f1
FROM h WINDOW w AS (PARTITION BY tf, gene ORDER BY v))
SELECT tf AS source, gene AS target, r(sum(abs(f0 - f1) * (nx - v))) AS ws_distance FROM k GROUP BY 1, 2""")
def _(v):
    return rr(X.wasserstein(v.norm, v.obs), "ws_distance")


BG = "b AS (SELECT o.obs_id, g.gene, coalesce(n.value, 0) AS v FROM v_bobs o CROSS JOIN (SELECT DISTINCT gene FROM v_bulk) g LEFT JOIN v_bulk n ON n.obs_id = o.obs_id AND n.gene = g.gene)"


@query("d11_corr_pearson", f"WITH {BG} SELECT x.gene AS a, y.gene AS b, r(corr(x.v, y.v)) AS r FROM b x JOIN b y ON x.obs_id = y.obs_id AND x.gene < y.gene GROUP BY 1, 2")
def _(v):
    return rr(X.correlation(v.bulk, v.bobs).drop("n"), "r")


RK = "rk AS (SELECT obs_id, gene, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS v FROM b)"


@query("d12_corr_spearman", f"WITH {BG}, {RK} SELECT x.gene AS a, y.gene AS b, r(corr(x.v, y.v)) AS r FROM rk x JOIN rk y ON x.obs_id = y.obs_id AND x.gene < y.gene GROUP BY 1, 2")
def _(v):
    return rr(X.correlation(v.bulk, v.bobs, "spearman").drop("n"), "r")


RKG = """rk AS (SELECT b.obs_id, b.gene, o.cell_type AS grp, rank() OVER (PARTITION BY o.cell_type, b.gene ORDER BY v) + (count(*) OVER (PARTITION BY o.cell_type, b.gene, v) - 1) / 2.0 AS v
FROM b JOIN v_bobs o USING (obs_id))"""
CG = f"{BG}, {RKG}, c AS (SELECT x.grp, x.gene AS a, y.gene AS b, corr(x.v, y.v) AS r FROM rk x JOIN rk y ON x.obs_id = y.obs_id AND x.gene < y.gene GROUP BY 1, 2, 3)"


def grouped_corr(v):
    o = v.bobs.select("obs_id", F.col("cell_type").alias("grp"))
    return X.correlation(v.bulk.join(o, "obs_id"), o, "spearman", ["grp"])


@query("d13_grouped_corr", f"WITH {CG} SELECT grp, a, b, r(r) AS r FROM c WHERE NOT isnan(r)")
def _(v):
    return rr(grouped_corr(v).drop("n"), "r")


@query("d15_consensus_regulators", """WITH g AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS gene FROM part), m AS (SELECT DISTINCT model FROM v_edges),
d AS (SELECT target AS gene, model, count(*) AS d FROM (SELECT model, source, target, avg(weight) AS w FROM v_edges GROUP BY ALL) x WHERE w <> 0 GROUP BY ALL),
q AS (SELECT g.gene, quantile_cont(coalesce(d, 0), [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM g CROSS JOIN m LEFT JOIN d USING (gene, model) GROUP BY g.gene)
SELECT gene, unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS theta, CAST(unnest(list_transform(q, lambda x: round_even(x, 0))) AS BIGINT) AS n FROM q""")
def _(v):
    genes = v.table("part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("gene"))
    return E.consensus_regulators(E.dedup_edges(v.edges, "avg", ["model"]), genes)


@query("d16_consensus_edges", """WITH q AS (SELECT source, quantile_cont(d, [0.25, 0.75]) AS q FROM (SELECT source, model, count(*) AS d FROM (SELECT DISTINCT model, source, target FROM v_edges) x
WHERE source IN (SELECT tf FROM v_tfs) GROUP BY ALL) y GROUP BY source)
SELECT source, unnest([0.25::DOUBLE, 0.75]) AS theta, CAST(unnest(list_transform(q, lambda x: floor(x))) AS BIGINT) AS value FROM q""")
def _(v):
    return E.consensus_edges(E.dedup_edges(v.edges, "avg", ["model"]), v.tfs)


@query("d17_degrees", """WITH e AS (SELECT * FROM v_net WHERE weight <> 0), o AS (SELECT model, source AS node, count(*) AS od, sum(abs(weight)) AS os FROM e GROUP BY ALL),
i AS (SELECT model, target AS node, count(*) AS id, sum(abs(weight)) AS ist FROM e GROUP BY ALL)
SELECT model, node, coalesce(od, 0) AS out_degree, r(coalesce(os, 0)) AS out_strength, coalesce(id, 0) AS in_degree, r(coalesce(ist, 0)) AS in_strength FROM o FULL JOIN i USING (model, node)""")
def _(v):
    return rr(E.degrees(v.net, ["model"]), "out_strength", "in_strength")


@query("d18_tf_centrality", "SELECT model, source AS tf, count(*) AS degree, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, source) AS rank FROM v_net GROUP BY model, source")
def _(v):
    return E.tf_centrality(v.net, ["model"])


ULM = """m AS (SELECT count(DISTINCT gene)::DOUBLE AS m FROM v_bulk), sw AS (SELECT source, sum(weight) AS sw, sum(weight * weight) AS qw FROM net GROUP BY 1 HAVING count(*) >= 5),
sy AS (SELECT obs_id, sum(value) AS sy, sum(value * value) AS qy FROM v_bulk GROUP BY 1),
xy AS (SELECT obs_id, source, sum(value * weight) AS xy FROM v_bulk JOIN net ON gene = target GROUP BY 1, 2),
rr AS (SELECT sy.obs_id, sw.source, m, (m * coalesce(xy, 0) - sw * sy) / nullif(sqrt((m * qw - sw * sw) * (m * qy - sy * sy)), 0) AS r FROM sy CROSS JOIN sw CROSS JOIN m LEFT JOIN xy USING (obs_id, source)),
ulm AS (SELECT obs_id, source, r * sqrt((m - 2) / ((1 - r) * (1 + r))) AS activity FROM rr)"""


@query("d19_ulm", f"WITH {NET_ALL}, {ULM} SELECT obs_id, source, r(activity) AS activity FROM ulm")
def _(v):
    return rr(X.ulm(v.bulk, net_all(v)), "activity")


SETNET = "net AS (SELECT set_name AS source, gene AS target, 1.0::DOUBLE AS weight FROM v_genesets)"


@query("d20_active_sets", f"WITH {SETNET}, {ULM} SELECT source, r(avg(activity)) AS mean, count(activity) AS n, r(avg(activity) / (stddev_samp(activity) / sqrt(count(activity)))) AS t FROM ulm GROUP BY source")
def _(v):
    net = v.genesets.select(F.col("set_name").alias("source"), F.col("gene").alias("target"), F.lit(1.0).alias("weight"))
    return rr(X.active_sets(X.ulm(v.bulk, net)).select("source", "mean", "n", "t"), "mean", "t")


FISHER = """list_sum(list_transform(range(ov, least(nt, ns) + 1), lambda k: exp(lgamma(nt + 1) - lgamma(k + 1) - lgamma(nt - k + 1) + lgamma(nn - nt + 1) - lgamma(ns - k + 1) - lgamma(nn - nt - ns + k + 1) - lgamma(nn + 1) + lgamma(ns + 1) + lgamma(nn - ns + 1))))"""
ENR = f"""o AS (SELECT source, library, set_name, count(*) AS ov FROM e JOIN v_genesets g ON e.target = g.gene GROUP BY ALL),
t AS (SELECT source, count(*) AS nt FROM e GROUP BY 1), z AS (SELECT library, set_name, count(*) AS ns FROM v_genesets GROUP BY ALL),
f AS (SELECT source, library, set_name, ov, nt, ns, nn, CASE WHEN ov <= greatest(0, nt + ns - nn) THEN 1.0 ELSE least(1.0, {FISHER}) END AS p
FROM o JOIN t USING (source) JOIN z USING (library, set_name) CROSS JOIN (SELECT count(DISTINCT gene) AS nn FROM v_counts) u)"""
EPOS = "e AS (SELECT DISTINCT source, target FROM v_net)"


def n_genes(v):
    return v.counts.select(F.count_distinct("gene")).scalar()


@query("d21_fisher", f"WITH {EPOS}, {ENR} SELECT source, library, set_name, ov AS overlap, r(p) AS p FROM f")
def _(v):
    e = v.net.select("source", "target").distinct()
    return rr(N.enrich(e, v.genesets, n_genes(v)).select("source", "library", "set_name", "overlap", "p"), "p")


KENR = ENR.replace("SELECT source,", "SELECT model, source,").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("USING (source)", "USING (model, source)")
D22 = f"""WITH e AS (SELECT model, source, target FROM (SELECT model, source, target, row_number() OVER (PARTITION BY model, source ORDER BY abs(weight) DESC, target) AS rn FROM v_net) x WHERE rn <= 100),
{KENR}, q AS (SELECT *, min(p * c / rk) OVER (PARTITION BY model, source ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fdr0 FROM (SELECT *, count(*) OVER (PARTITION BY model, source) AS c, row_number() OVER (PARTITION BY model, source ORDER BY p) AS rk FROM f WHERE nt >= 10) y),
fdr AS (SELECT model, source, set_name, p, least(1.0, min(fdr0) OVER (PARTITION BY model, source, p)) AS fdr, c FROM q),
s AS (SELECT model, source, count(*) AS tested, count(*) FILTER (fdr < 0.05) AS n_enriched, min(p) AS min_p, min(p) FILTER (fdr < 0.05) AS sig_p, arg_min(set_name, (p, set_name)) FILTER (fdr < 0.05) AS best_set FROM fdr GROUP BY ALL),
w AS (SELECT t.model, t.source, t.nt, coalesce(n_enriched, 0) AS n_enriched, tested, min_p, sig_p, best_set, CASE WHEN n_enriched > 0 THEN CASE WHEN sig_p > 0 THEN -log10(sig_p) ELSE 50.0 END ELSE 0.0 END AS raw FROM t LEFT JOIN s USING (model, source))
SELECT model, source, nt AS n_targets, n_enriched, r(raw) AS score_raw, r(CASE WHEN raw > 0 THEN greatest(0.0, (raw + log10(least(1.0, tested * 0.05))) / raw) ELSE 0.0 END) AS score_norm,
r(CASE WHEN n_enriched > 0 THEN 1 / (1 + ln(1 + n_enriched)) ELSE 0.0 END) AS specificity, best_set, r(coalesce(sig_p, min_p, 1.0)) AS best_p FROM w"""


@query("d22_tf_pathway_score", D22)
def _(v):
    return rr(N.tf_pathway_score(v.net, v.genesets, n_genes(v), keys=["model"]), "score_raw", "score_norm", "specificity", "best_p")


@query("d23_prf", """SELECT *, r(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) AS f1 FROM
(SELECT model, tp, fp, fn, tn, r(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision, r(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall FROM
(SELECT model, count(*) FILTER (weight > 0 AND target LIKE '%E%') AS tp, count(*) FILTER (weight > 0 AND target NOT LIKE '%E%') AS fp,
count(*) FILTER (weight <= 0 AND target LIKE '%E%') AS fn, count(*) FILTER (weight <= 0 AND target NOT LIKE '%E%') AS tn FROM v_net GROUP BY model) x) y""".replace("r(coalesce(", "(coalesce("))
def _(v):
    d = v.net.withColumn("t", F.col("target").contains("E")).withColumn("p", F.col("weight") > 0)
    return rr(N.prf(d, "t", "p", ["model"]), "f1")


DISP = """am AS (SELECT u.source, o.cell_type AS grp, u.activity, median(u.activity) OVER (PARTITION BY u.source, o.cell_type) AS med FROM ulm u JOIN v_bobs o USING (obs_id)),
md AS (SELECT source, avg(mad) AS mad FROM (SELECT source, grp, avg(abs(activity - med)) AS mad FROM am GROUP BY ALL HAVING count(*) >= 2) x GROUP BY 1),
dp AS (SELECT source AS tf, mad, 1 - greatest(0, least(1, mad / (SELECT quantile_cont(mad, 0.95) FROM md))) AS consistency FROM md)"""


@query("d24_dispersion", f"WITH {NET_ALL}, {ULM}, {DISP} SELECT tf, r(mad) AS mad, r(consistency) AS consistency FROM dp")
def _(v):
    act = X.ulm(v.bulk, net_all(v))
    return rr(X.dispersion(act, v.bobs.select("obs_id", F.col("cell_type").alias("grp"))), "mad", "consistency")


@query("d25_padded_mean", f"WITH {NET_ALL}, {ULM}, {DISP} SELECT r(sum(consistency) / 100) AS score FROM (SELECT consistency FROM dp ORDER BY consistency DESC, tf LIMIT 100) x")
def _(v):
    act = X.ulm(v.bulk, net_all(v))
    return rr(X.padded_mean(X.dispersion(act, v.bobs.select("obs_id", F.col("cell_type").alias("grp"))), 100), "score")


@query("d26_profiles", "SELECT perturbation, gene, r(s / n) AS value FROM (SELECT perturbation, gene, sum(value) AS s FROM v_norm JOIN v_obs USING (obs_id) GROUP BY ALL) a JOIN (SELECT perturbation, count(*) AS n FROM v_obs GROUP BY 1) b USING (perturbation)")
def _(v):
    return rr(X.profiles(v.norm, v.obs), "value")


D27 = """WITH g AS (SELECT DISTINCT gene FROM v_bulk), o AS (SELECT obs_id, donor_id AS perturbation, cell_type FROM v_bobs),
d AS (SELECT o.perturbation, o.cell_type, g.gene, coalesce(b.value, 0) AS v FROM o CROSS JOIN g LEFT JOIN v_bulk b ON b.obs_id = o.obs_id AND b.gene = g.gene),
t AS (SELECT perturbation, gene, avg(v) AS v FROM d GROUP BY ALL), p AS (SELECT perturbation, cell_type AS item, gene, avg(v) AS v FROM d GROUP BY ALL),
x AS (SELECT p.perturbation, item, t.perturbation AS other, round(sum(abs(p.v - t.v)), 9) AS dist FROM p JOIN t ON p.gene = t.gene WHERE p.gene <> concat('Brand#', substr(p.perturbation, 2), '/ECONOMY') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY perturbation, item ORDER BY dist, other) - 1 AS rank FROM x)
SELECT perturbation, item, rank, r(1 - rank / 24.0) AS pds FROM k WHERE perturbation = other"""


@query("d27_pds", D27)
def _(v):
    o = v.bobs.withColumn("perturbation", F.col("donor_id"))
    # one predicted profile per cell type
    each = o.withColumn("pair", F.concat_ws("|", "perturbation", "cell_type"))
    pred = X.profiles(v.bulk, each, "pair").select(F.substring_index("pair", "|", 1).alias("perturbation"), F.substring_index("pair", "|", -1).alias("item"), "gene", "value")
    target = o.select("perturbation").distinct().withColumn("gene", F.concat(F.lit("Brand#"), F.substring("perturbation", 2, 9), F.lit("/ECONOMY")))
    d = X.pds(pred, X.profiles(v.bulk, o), target)
    return rr(d.select("perturbation", "item", F.col("rank").cast("bigint").alias("rank"), "pds"), "pds")


D27C = """WITH g AS (SELECT DISTINCT gene FROM v_bulk), o AS (SELECT obs_id, donor_id AS perturbation FROM v_bobs),
s AS (SELECT obs_id, perturbation FROM (SELECT *, row_number() OVER (PARTITION BY perturbation ORDER BY $HASH(obs_id, '0'), obs_id) AS rn FROM o) x WHERE rn <= 10),
d AS (SELECT o.perturbation, o.obs_id, g.gene, coalesce(b.value, 0) AS v FROM o CROSS JOIN g LEFT JOIN v_bulk b ON b.obs_id = o.obs_id AND b.gene = g.gene),
t AS (SELECT perturbation, gene, avg(v) AS v FROM d GROUP BY ALL), p AS (SELECT d.* FROM d JOIN s USING (obs_id)),
x AS (SELECT p.perturbation, p.obs_id AS item, t.perturbation AS other, round(sum(abs(p.v - t.v)), 9) AS dist FROM p JOIN t ON p.gene = t.gene WHERE p.gene <> concat('Brand#', substr(p.perturbation, 2), '/ECONOMY') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dist, other) - 1 AS rank FROM x)
SELECT perturbation, item, rank, r(1 - rank / 24.0) AS pds FROM k WHERE perturbation = other"""


@query("d27_pds_cells", D27C)
def _(v):
    o = v.bobs.withColumn("perturbation", F.col("donor_id"))
    some = R.sample_per_group(o, "perturbation", 10)
    pred = v.bulk.join(some.select("obs_id", "perturbation"), "obs_id").select("perturbation", F.col("obs_id").alias("item"), "gene", "value")
    target = o.select("perturbation").distinct().withColumn("gene", F.concat(F.lit("Brand#"), F.substring("perturbation", 2, 9), F.lit("/ECONOMY")))
    d = X.pds(pred, X.profiles(v.bulk, o), target)
    return rr(d.select("perturbation", "item", F.col("rank").cast("bigint").alias("rank"), "pds"), "pds")


PRED = "pred AS (SELECT obs_id, gene, value AS y, avg(value) OVER (PARTITION BY gene, cell_type) * 0.9 + 0.1 * avg(value) OVER (PARTITION BY gene, perturbation) AS y_hat, plate AS fold FROM v_norm JOIN v_obs USING (obs_id))"


def predictions(v):
    return v.sql(f"WITH {PRED} SELECT * FROM pred")


@query("d28_pooled_r2", f"""WITH {PRED}, f AS (SELECT gene, fold, sum((y - y_hat) ^ 2) AS res, var_pop(y) * count(*) AS tot FROM pred GROUP BY ALL)
SELECT gene, r(greatest(0, least(1, 1 - sum(res) / sum(tot)))) AS r2 FROM f GROUP BY gene""")
def _(v):
    return rr(X.pooled_r2(predictions(v)), "r2")


@query("d29_gene_r2", f"WITH {PRED} SELECT gene, r(greatest(0, 1 - sum((y - y_hat) ^ 2) / (var_pop(y) * count(*)))) AS r2 FROM pred GROUP BY gene")
def _(v):
    return rr(X.gene_r2(predictions(v)), "r2")


@query("d30_robust_scale", f"""WITH {BG}, q AS (SELECT gene, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM b GROUP BY 1)
SELECT obs_id, gene, r(value / CASE WHEN iqr = 0 THEN 1 ELSE iqr END) AS value FROM v_bulk JOIN q USING (gene)""")
def _(v):
    return rr(X.robust_scale(v.bulk, v.bobs).select("obs_id", "gene", "value"), "value")


@query("d31_standardize", f"""WITH bk AS MATERIALIZED (SELECT obs_id, gene, value FROM v_bulk), ob AS MATERIALIZED (SELECT obs_id, is_control FROM v_bobs), n AS (SELECT count(*) AS n FROM ob WHERE is_control),
t AS (SELECT gene, coalesce(sum(value) FILTER (is_control), 0) AS s, coalesce(sum(value * value) FILTER (is_control), 0) AS q FROM bk JOIN ob USING (obs_id) GROUP BY 1),
m AS (SELECT gene, s / n AS mu, sqrt(greatest(0, q / n - (s / n) * (s / n))) AS sd FROM t, n)
SELECT ob.obs_id, m.gene, r((coalesce(value, 0) - mu) / CASE WHEN sd < 1e-9 THEN 1 ELSE sd END) AS value FROM ob CROSS JOIN m LEFT JOIN bk ON bk.obs_id = ob.obs_id AND bk.gene = m.gene""")
def _(v):
    return rr(X.standardize(v.bulk, v.bobs, v.bobs.where("is_control")), "value")


HVG = """mv AS (SELECT gene, avg(x) AS m, var_samp(x) AS va FROM (SELECT g.gene, coalesce(exp(n.value) - 1, 0) AS x FROM v_obs o CROSS JOIN (SELECT DISTINCT gene FROM v_norm) g
LEFT JOIN v_norm n ON n.obs_id = o.obs_id AND n.gene = g.gene) x GROUP BY 1),
h AS (SELECT gene, ln(1 + m) AS mean, ln(va / m) AS disp FROM mv WHERE va > 0), l AS (SELECT min(mean) AS lo, max(mean) AS hi FROM h),
hb AS (SELECT gene, mean, disp, CAST(greatest(0, least(19, ceil((mean - lo) / ((hi - lo) / 20)) - 1)) AS INT) AS bin FROM h, l),
hz AS (SELECT gene, mean, disp, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0 ELSE (disp - avg(disp) OVER (PARTITION BY bin)) / nullif(stddev_samp(disp) OVER (PARTITION BY bin), 0) END AS z FROM hb)"""


@query("d32_hvg", f"WITH {HVG} SELECT gene, r(mean) AS mean, r(disp) AS disp, r(z) AS z FROM hz ORDER BY z DESC NULLS LAST, gene LIMIT 60")
def _(v):
    return rr(X.hvg(v.norm, v.obs, 60).select("gene", "mean", "disp", "z"), "mean", "disp", "z")


@query("d32_hvg_counts")
def _(v):
    return X.hvg_counts(v.counts, v.obs, 60)


PAIRS = "pr AS (SELECT r.source, r.target, r.weight AS a, n.weight AS b FROM v_net r JOIN v_net n ON r.source = n.source AND r.target = n.target AND r.model = 'R' AND n.model = 'N')"


def pairs(v):
    return v.sql(f"WITH {PAIRS} SELECT * FROM pr")


@query("d33_paired_t", f"WITH {PAIRS} SELECT source, count(*) AS n, r(CASE WHEN count(*) > 1 THEN avg(abs(a) - abs(b)) / nullif(stddev_samp(abs(a) - abs(b)) / sqrt(count(*)), 0) END) AS t FROM pr GROUP BY source")
def _(v):
    return rr(N.paired_t(pairs(v), "a", "b", ["source"]), "t")


@query("d34_signed_rank", f"""WITH {PAIRS}, d AS (SELECT source, a - b AS d FROM pr WHERE a <> b),
k AS (SELECT source, d, rank() OVER (PARTITION BY source ORDER BY abs(d)) + (count(*) OVER (PARTITION BY source, abs(d)) - 1) / 2.0 AS rk FROM d)
SELECT source, count(*) AS n, r(coalesce(sum(rk) FILTER (d > 0), 0)) AS w_plus, r(coalesce(sum(rk) FILTER (d < 0), 0)) AS w_minus FROM k GROUP BY source""")
def _(v):
    return rr(N.signed_rank(pairs(v), "a", "b", ["source"]).select("source", "n", "w_plus", "w_minus"), "w_plus", "w_minus")


@query("d35_recovered", f"""WITH {NET_ALL}, {ULM} SELECT source, count(*) FILTER (activity < -2) AS tp, r(count(*) FILTER (activity < -2) / count(*)) AS precision,
r(count(*) FILTER (activity < -2) / (SELECT count(*) FROM v_bobs)) AS recall FROM ulm GROUP BY source""")
def _(v):
    act = X.ulm(v.bulk, net_all(v))
    total = v.bobs.select(F.count("*")).scalar()
    g = act.groupBy("source").agg(F.count_if(F.col("activity") < -2).alias("tp"), F.count("*").alias("n")).withColumn("total", total)
    return rr(g.select("source", "tp", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("total")).alias("recall")), "precision", "recall")


@query("d36_weighted_f1", """SELECT model, r(p) AS precision, r(q) AS recall, r(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END) AS f1 FROM
(SELECT model, sum(r_precision * tfb_f1) / sum(tfb_f1) AS p, sum(ws_precision * tfb_f1) / sum(tfb_f1) AS q FROM v_wide GROUP BY model) x""")
def _(v):
    w = v.sql("SELECT * FROM v_wide")
    return rr(N.weighted_f1(w, "r_precision", "ws_precision", "tfb_f1", ["model"]), "precision", "recall", "f1")


@query("d37_corr_spread", f"WITH {CG} SELECT a, b, r(min(r)) AS lo, r(max(r)) AS hi, r(1 - 2 * (max(r) - min(r))) AS consistency FROM c WHERE NOT isnan(r) GROUP BY a, b")
def _(v):
    return rr(G.corr_spread(grouped_corr(v)), "lo", "hi", "consistency")


COREG = f"""{CG}, sp AS (SELECT a, b, 1 - 2 * (max(r) - min(r)) AS k FROM c WHERE NOT isnan(r) GROUP BY a, b), s2 AS (SELECT a, b, k FROM sp UNION ALL SELECT b, a, k FROM sp),
e AS (SELECT model, source, target, abs(weight) / sum(abs(weight)) OVER (PARTITION BY model, source) AS w, count(*) OVER (PARTITION BY model, source) AS n FROM
(SELECT model, source, target, weight, row_number() OVER (PARTITION BY model, source ORDER BY abs(weight) DESC, target) AS rn FROM v_net) x WHERE rn <= 100),
t1 AS (SELECT model, source, sum(w * k) AS tf_tg FROM e JOIN s2 ON source = a AND target = b GROUP BY 1, 2),
t2 AS (SELECT e.model, e.source, sum(e.w * k / nullif(e.n - 1, 0)) AS tg_tg FROM e JOIN s2 ON e.target = a JOIN e f ON f.model = e.model AND f.source = e.source AND f.target = s2.b GROUP BY 1, 2)"""


@query("d38_coregulation", f"WITH {COREG} SELECT model, source, r(tf_tg) AS tf_tg, r(tg_tg) AS tg_tg FROM (SELECT DISTINCT model, source FROM e) s LEFT JOIN t1 USING (model, source) LEFT JOIN t2 USING (model, source)")
def _(v):
    e = E.top_k_per(v.net.select("model", "source", "target", "weight"), "source", 100, ["model"])
    return rr(G.coregulation(e, G.corr_spread(grouped_corr(v)), ["model"]), "tf_tg", "tg_tg")


@query("d39_dataset_stats", """SELECT cell_type, count(DISTINCT o.obs_id) AS n_samples, count(DISTINCT perturbation) AS n_perturbations,
(SELECT sum(cell_count) FROM v_bobs x WHERE x.cell_type = o.cell_type)::BIGINT AS n_cells, count(DISTINCT gene) AS n_genes FROM v_bobs o JOIN v_bulk USING (obs_id) GROUP BY cell_type""")
def _(v):
    return H.dataset_stats(v.bulk, v.bobs, "cell_type")


@query("d40_peaks_per_gene", f"WITH {P2G} SELECT gene, count(*) AS n_peaks, count(*) >= 10 AS is_dorc FROM p2g GROUP BY gene")
def _(v):
    return H.peaks_per_gene(I.peak2gene(v.tss, v.access))


@query("d41_dorc", f"WITH {P2G} SELECT obs_id, gene, r(sum(value / d)) AS value FROM v_access JOIN (SELECT obs_id, avg(value) AS d FROM v_access GROUP BY 1) x USING (obs_id) JOIN p2g USING (peak) GROUP BY ALL")
def _(v):
    return H.dorc(v.access, I.peak2gene(v.tss, v.access)).withColumn("value", r6_double("value"))


@query("d42_knn_smooth", """WITH k AS (SELECT obs_id, neighbor FROM (SELECT a.obs_id, b.obs_id AS neighbor, row_number() OVER (PARTITION BY a.obs_id ORDER BY list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), b.obs_id) AS rn
FROM v_emb a JOIN v_emb b ON a.obs_id <> b.obs_id) x WHERE rn <= 5), x AS (SELECT concat('V', CAST(l_partkey AS VARCHAR)) AS obs_id, concat('S', CAST(l_suppkey AS VARCHAR)) AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)
SELECT k.obs_id, gene, r(sum(value) / 5) AS value FROM k JOIN x ON k.neighbor = x.obs_id GROUP BY ALL""")
def _(v):
    x = v.sql("SELECT concat('V', CAST(l_partkey AS STRING)) AS obs_id, concat('S', CAST(l_suppkey AS STRING)) AS gene, sum(l_quantity) AS value FROM {lineitem} GROUP BY l_partkey, l_suppkey")
    return rr(H.smooth(x, blocks.knn(v.emb, 5), 5), "value")


@query("d43_lsi_tfidf", """WITH t AS (SELECT obs_id, peak, value / r * (SELECT count(*) FROM v_aobs) / c AS v FROM v_access JOIN (SELECT obs_id, sum(value) AS r FROM v_access GROUP BY 1) a USING (obs_id) JOIN (SELECT peak, sum(value) AS c FROM v_access GROUP BY 1) b USING (peak))
SELECT obs_id, peak, r(ln(1 + v / s * 10000)) AS value FROM t JOIN (SELECT obs_id, sum(v) AS s FROM t GROUP BY 1) u USING (obs_id)""")
def _(v):
    return rr(H.tfidf(v.access, v.aobs), "value")


@query("d43_lsi_vectors")
def _(v):
    vec, _ = H.low_rank(H.tfidf(v.access, v.aobs), 6)
    return vec


@query("d44_topics")
def _(v):
    _, region = H.topics(v.access, 4)
    return H.binarize_ntop(region, 50)


@query("d45_diff_access", """WITH d AS (SELECT p.peak, o.obs_id, o.cell_type, coalesce(a.value, 0) AS v FROM (SELECT DISTINCT peak FROM v_access) p CROSS JOIN v_aobs o LEFT JOIN v_access a ON a.peak = p.peak AND a.obs_id = o.obs_id),
k AS (SELECT peak, cell_type, v, rank() OVER (PARTITION BY peak ORDER BY v) + (count(*) OVER (PARTITION BY peak, v) - 1) / 2.0 AS rk FROM d),
s AS (SELECT peak, cell_type, sum(rk) AS r1, count(*) AS n1, sum(v) AS s1 FROM k GROUP BY ALL), z AS (SELECT *, (SELECT count(*) FROM v_aobs) AS n, sum(s1) OVER (PARTITION BY peak) AS st FROM s)
SELECT cell_type, peak AS gene, r((r1 - n1 * (n + 1) / 2.0) / sqrt(n1 * (n - n1) * (n + 1) / 12.0)) AS score, r(log2((round(s1, 9) / n1 + 1e-9) / (greatest(0, round(st - s1, 9)) / (n - n1) + 1e-9))) AS lfc FROM z""")
def _(v):
    d = X.rank_sum_rest(v.access.withColumnRenamed("peak", "gene"), v.aobs, "cell_type")
    return rr(d, "score", "lfc")


@query("d45_markers")
def _(v):
    return rr(X.differential(v.access.withColumnRenamed("peak", "gene"), v.aobs, "cell_type"), "score", "lfc", "p", "padj")


D46 = """SELECT metric, count(*) AS n_datasets, r(min(mx)) AS max_lo, r(max(mx)) AS max_hi, r(min(rom)) AS spread_lo, r(max(rom)) AS spread_hi FROM
(SELECT dataset, metric, max(value) AS mx, (max(value) - min(value)) / nullif(avg(value), 0) AS rom FROM v_scores WHERE value IS NOT NULL GROUP BY ALL) x GROUP BY metric"""


@query("d46_metric_summary", D46)
def _(v):
    return rr(L.metric_summary(L.applicability(v.scores)).select("metric", "n_datasets", "max_lo", "max_hi", "spread_lo", "spread_hi"), "max_lo", "max_hi", "spread_lo", "spread_hi")


D47 = """WITH x AS (SELECT split_part(split_part(name, '(', 2), '.', 1) AS method, CAST(split_part(duration, 'h', 1) AS DOUBLE) + CAST(replace(split_part(duration, ' ', 2), 'm', '') AS DOUBLE) / 60 AS h,
CAST(split_part(peak_rss, ' ', 1) AS DOUBLE) / 1024 AS gb, CAST(replace(cpu, '%', '') AS DOUBLE) AS cpu FROM v_trace),
m AS (SELECT method, max(h) AS hours, max(gb) AS memory_gb, max(cpu) AS cpu FROM x GROUP BY 1)
SELECT method, r(hours) AS hours, r(memory_gb) AS memory_gb, r(cpu) AS cpu, r(max(ln(hours + 1)) OVER () - ln(hours + 1)) AS hours_log, r(max(ln(memory_gb + 1)) OVER () - ln(memory_gb + 1)) AS memory_log FROM m"""


@query("d47_resource_summary", D47)
def _(v):
    t = v.trace.withColumn("method", F.substring_index(F.regexp_extract("name", r"\(([^)]+)\)", 1), ".", 1))
    return rr(L.resource_summary(t), "hours", "memory_gb", "cpu", "hours_log", "memory_log")


@query("d48_top_groups", "SELECT chrom, count(*) AS n FROM v_peaks GROUP BY 1 ORDER BY n DESC, chrom LIMIT 3")
def _(v):
    return H.top_groups(v.peaks, 3, "chrom")


@query("d49_qc_metrics", "SELECT obs_id, count(*) FILTER (value > 0) AS n_genes, r(sum(value)) AS n_counts, r(coalesce(sum(value) FILTER (gene LIKE 'Brand#1/%'), 0) / sum(value)) AS flag_share FROM v_counts GROUP BY 1")
def _(v):
    flagged = v.counts.select("gene").distinct().where("gene like 'Brand#1/%'")
    return rr(H.qc_metrics(v.counts, flagged), "n_counts", "flag_share")


@query("d50_library_stats", """WITH s AS (SELECT library, set_name, count(*) AS k FROM v_genesets GROUP BY ALL)
SELECT library, count(*) AS total, count(*) FILTER (k BETWEEN 10 AND 32) AS filtered, min(k) AS min_size, max(k) AS max_size, list_sort(list(k))[count(*) // 2 + 1] AS median_size, r(avg(k)) AS mean_size FROM s GROUP BY library""")
def _(v):
    return rr(H.library_stats(v.genesets, 10, 32), "mean_size")


EMB = "e AS (SELECT label, generate_subscripts(vec, 1) - 1 AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM v_emb)"


@query("d51_emb_summary", f"WITH {EMB} SELECT 'mean' AS how, label, CAST(dim AS INT) AS dim, r(avg(x)) AS value FROM e GROUP BY ALL UNION ALL SELECT 'median', label, CAST(dim AS INT), r(quantile_cont(x, 0.5)) FROM e GROUP BY ALL UNION ALL SELECT DISTINCT 'sketch within its slice', label, CAST(dim AS INT), 1.0::DOUBLE FROM e")
def _(v):
    a = H.emb_summary(v.emb, "label", "mean").withColumn("how", F.lit("mean"))
    med = H.emb_summary(v.emb, "label", "median").withColumn("how", F.lit("median"))
    near = H.emb_summary(v.emb, "label", "approx").withColumnRenamed("value", "x").join(med.drop("how"), ["label", "dim"])
    ok = F.abs(F.col("x") - F.col("value")) <= F.abs("value") * (2 ** (1 / 16) - 1) + 1e-2  # values of either sign lie round a median near 0
    near = near.select("label", "dim", F.when(ok, 1.0).otherwise(0.0).alias("value"), F.lit("sketch within its slice").alias("how"))
    return rr(a.unionByName(med).unionByName(near), "value")


TOK = "SELECT obs_id, concat('T', CAST(label AS STRING)) AS gene FROM v_emb UNION ALL SELECT obs_id, concat('W', CAST(vec_id % 7 AS STRING)) AS gene FROM v_emb"


@query("d52_gene_embedding", f"""WITH t AS ({TOK}), e AS (SELECT gene, generate_subscripts(vec, 1) AS dim, CAST(unnest(vec) AS DOUBLE) AS x FROM v_emb JOIN t USING (obs_id)),
m AS (SELECT gene, dim, avg(x) AS x FROM e GROUP BY ALL) SELECT gene, list(r(x) ORDER BY dim) AS vec FROM m GROUP BY gene""")
def _(v):
    return H.gene_embedding(v.emb, v.sql(TOK)).select("gene", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))


@query("d53_gene_activity", f"""WITH {P2G} SELECT obs_id, gene, r(sum(value * exp(-greatest(0, dist - 500) / 5000.0)) / max(n)) AS value FROM v_access JOIN p2g USING (peak)
JOIN (SELECT gene, count(*) AS n FROM p2g GROUP BY 1) c USING (gene) GROUP BY ALL""")
def _(v):
    return I.gene_activity(v.access, v.tss, 150_000).withColumn("value", r6_double("value"))


TOPIC = """ct AS (SELECT obs_id, topic, v / sum(v) OVER (PARTITION BY obs_id) AS p FROM (SELECT obs_id, substr(peak, 4, 1) AS topic, sum(value) AS v FROM v_access GROUP BY obs_id, substr(peak, 4, 1)) x),
tr AS (SELECT substr(peak, 4, 1) AS topic, peak, sum(value) / sum(sum(value)) OVER (PARTITION BY substr(peak, 4, 1)) AS q FROM v_access GROUP BY peak)"""


@query("d54_impute", f"WITH {TOPIC} SELECT obs_id, peak, floor(round(sum(p * q) * 1e6, 6)) AS value FROM ct JOIN tr USING (topic) GROUP BY ALL HAVING floor(round(sum(p * q) * 1e6, 6)) > 0")
def _(v):
    ct, tr = v.sql(f"WITH {TOPIC} SELECT * FROM ct"), v.sql(f"WITH {TOPIC} SELECT * FROM tr")
    return H.impute(ct, tr).select("obs_id", "peak", F.col("value").cast("double").alias("value"))
