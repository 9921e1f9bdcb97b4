"""E: ranking, sampling, top-k."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import rr
from netloom.operators import chromatin as H, edges as E, intervals as I, nulls as Z, ranking as R
from netloom.functions import stats
from netloom.plans import leaderboard as L

DD = "dd AS (SELECT model, source, target, round(avg(weight), 9) AS weight FROM v_edges GROUP BY ALL)"


def dedup(v):
    return E.dedup_edges(v.edges, "avg", ["model"]).withColumn("weight", F.round("weight", 9))


@query("e1_top_edges", f"""WITH {DD} SELECT 'all' AS scope, source, target, r(weight) AS weight FROM (SELECT * FROM dd ORDER BY abs(weight) DESC, source, target LIMIT 5000) x
UNION ALL SELECT model, source, target, r(weight) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(weight) DESC, source, target) AS rn FROM dd) y WHERE rn <= 3000""")
def _(v):
    d = dedup(v)
    a = E.top_edges(d, 5000).select(F.lit("all").alias("scope"), "source", "target", "weight")
    b = E.top_edges(d, 3000, ["model"]).select(F.col("model").alias("scope"), "source", "target", "weight")
    return rr(a.unionByName(b), "weight")


@query("e2_top_k_per_source", f"WITH {DD} SELECT model, source, target, r(weight) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY model, source ORDER BY abs(weight) DESC, target) AS rn FROM dd) x WHERE rn <= 25")
def _(v):
    return rr(E.top_k_per(dedup(v), "source", 25, ["model"]), "weight")


@query("e3_top_k_var", f"""WITH {DD}, k AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS source, s_nationkey + 1 AS k FROM supplier)
SELECT model, source, target, rn FROM (SELECT model, dd.source, target, k, row_number() OVER (PARTITION BY model, dd.source ORDER BY abs(weight) DESC, target) AS rn FROM dd JOIN k USING (source)) x WHERE rn <= k""")
def _(v):
    k = v.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source"), (F.col("s_nationkey") + 1).alias("k"))
    return E.top_k_var(dedup(v), k, extra=["model"]).select("model", "source", "target", "rn")


@query("e5_top_connected", """WITH e AS (SELECT * FROM v_net WHERE weight <> 0), o AS (SELECT source AS gene, count(*) AS d FROM e GROUP BY 1), i AS (SELECT target AS gene, count(*) AS d FROM e GROUP BY 1),
j AS (SELECT gene, coalesce(o.d, 0) AS od, coalesce(i.d, 0) AS id FROM o FULL JOIN i USING (gene))
SELECT 'max' AS how, gene, connectivity FROM (SELECT gene, greatest(od, id) AS connectivity FROM j ORDER BY 2 DESC, 1 LIMIT 40) a UNION ALL SELECT 'sum', gene, c FROM (SELECT gene, od + id AS c FROM j ORDER BY 2 DESC, 1 LIMIT 40) b""")
def _(v):
    e = v.net
    a = E.top_connected(e, 40, "max").withColumn("how", F.lit("max"))
    return a.unionByName(E.top_connected(e, 40, "sum").withColumn("how", F.lit("sum")))


@query("e6_nested_selections", """WITH c AS (SELECT model, source, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, source) AS rank FROM v_net GROUP BY model, source), s AS (SELECT unnest([10, 42, 74, 106, 138, 171, 203, 235, 267, 300]) AS n_tfs)
SELECT model, n_tfs, source, count(*) AS n FROM v_net e JOIN c USING (model, source) JOIN s ON s.n_tfs >= c.rank GROUP BY ALL""")
def _(v):
    d = E.nested_selections(v.net, extra=["model"])
    return d.groupBy("model", "n_tfs", "source").agg(F.count("*").alias("n"))


@query("e7_avg_rank", """SELECT row_id, r(rk) AS rank, r(rk / n) AS pct FROM (SELECT row_id, rank() OVER (PARTITION BY model ORDER BY weight) + (count(*) OVER (PARTITION BY model, weight) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY model) AS n FROM
(SELECT model, row_id, round(weight, 6) AS weight FROM v_edges) y) x""")
def _(v):
    e = v.edges.select("model", "row_id", F.round("weight", 6).alias("weight"))
    a = stats.avg_rank(e, ["model"], "weight")
    n = e.groupBy("model").agg(F.count("*").alias("n"))
    return rr(a.join(n, "model").select("row_id", "rank", (F.col("rank") / F.col("n")).alias("pct")), "rank", "pct")


@query("e8_benjamini_hochberg", """WITH p AS (SELECT model, row_id, round(abs(weight) / 2.5, 6) AS p FROM v_edges), k AS (SELECT *, p * count(*) OVER (PARTITION BY model) / row_number() OVER (PARTITION BY model ORDER BY p, row_id) AS q FROM p),
a AS (SELECT *, min(q) OVER (PARTITION BY model ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS adj FROM k) SELECT row_id, r(least(1.0, adj)) AS padj FROM a""")
def _(v):
    p = v.edges.select("model", "row_id", F.round(F.abs("weight") / 2.5, 6).alias("p"))
    return rr(stats.bh(p, ["model"], "p").select("row_id", "padj"), "padj")


@query("e9_null_percentile", """WITH b AS (SELECT source, round(weight, 6) AS w FROM v_edges WHERE model = 'N'), x AS (SELECT source, target, round(weight, 6) AS w FROM v_edges WHERE model = 'R')
SELECT x.source, x.target, x.w, r(count(*) FILTER (b.w < x.w) / count(*)) AS percentile FROM (SELECT DISTINCT * FROM x) x JOIN b USING (source) GROUP BY ALL""")
def _(v):
    e = v.edges.withColumn("w", F.round("weight", 6))
    x = e.where("model = 'R'").select("source", "target", "w").distinct()
    return rr(R.null_percentile(x, e.where("model = 'N'").select("source", "w"), ["source"], "w"), "percentile")


@query("e10_split_controls", """WITH m AS (SELECT CAST(floor(median(n)) AS BIGINT) AS m FROM (SELECT count(*) AS n FROM v_obs WHERE NOT is_control AND donor_id <> '' GROUP BY perturbation) x)
SELECT obs_id, perturbation AS perturbation_split FROM v_obs WHERE NOT is_control UNION ALL
SELECT obs_id, concat('control_', CAST((row_number() OVER (ORDER BY row_no) - 1) // (SELECT m FROM m) AS VARCHAR)) FROM v_obs WHERE is_control""")
def _(v):
    return R.split_controls(v.obs).select("obs_id", "perturbation_split")


@query("e11_fill_to", """WITH s AS (SELECT donor_id, count(*) AS n FROM v_obs GROUP BY 1), q AS (SELECT sum(n) AS base FROM s WHERE donor_id IN ('D1', 'D2')),
c AS (SELECT donor_id, n, coalesce(sum(n) OVER (ORDER BY n, donor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (SELECT base FROM q) AS b, row_number() OVER (ORDER BY n, donor_id) AS i FROM s WHERE donor_id NOT IN ('D1', 'D2'))
SELECT obs_id FROM v_obs WHERE donor_id IN ('D1', 'D2') OR donor_id IN (SELECT donor_id FROM c WHERE b < 5000 OR i = 1)""")
def _(v):
    req = v.obs.select("donor_id").distinct().where("donor_id in ('D1', 'D2')")
    return R.fill_to(v.obs, 5000, req).select("obs_id")


@query("e12_sample_per_group", "SELECT obs_id, donor_id FROM (SELECT obs_id, donor_id, row_number() OVER (PARTITION BY donor_id ORDER BY $HASH(obs_id, '0'), obs_id) AS rn FROM v_obs) x WHERE rn <= 100")
def _(v):
    return R.sample_per_group(v.obs, "donor_id", 100).select("obs_id", "donor_id")


@query("e13_cap", "SELECT obs_id FROM v_obs ORDER BY $HASH(obs_id, '42'), obs_id LIMIT 4000")
def _(v):
    return R.cap(v.obs, 4000, 42).select("obs_id")


LATEST = """t AS (SELECT *, regexp_extract(name, '\\(([^)]+)\\)', 1) AS method FROM v_trace WHERE status = 'COMPLETED'),
lr AS (SELECT method, max(file_date) AS d FROM t GROUP BY 1)"""


@query("e14_latest_run", f"WITH {LATEST} SELECT event_id, method FROM t JOIN lr USING (method) WHERE t.file_date = lr.d")
def _(v):
    return R.latest_run(v.trace).select("event_id", "method")


@query("e15_top_features", """SELECT 'all' AS grp, gene, r(total) AS total FROM (SELECT gene, sum(value) AS total FROM v_counts GROUP BY 1 ORDER BY round(sum(value), 6) DESC, gene LIMIT 40) x
UNION ALL SELECT cell_type, gene, r(total) FROM (SELECT cell_type, gene, sum(value) AS total, row_number() OVER (PARTITION BY cell_type ORDER BY round(sum(value), 6) DESC, gene) AS rn FROM v_counts JOIN v_obs USING (obs_id) GROUP BY cell_type, gene) y WHERE rn <= 30""")
def _(v):
    a = R.top_features(v.counts, 40).select(F.lit("all").alias("grp"), "gene", "total")
    e = v.counts.join(v.obs.select("obs_id", "cell_type"), "obs_id")
    return rr(a.unionByName(R.top_features(e, 30, group="cell_type").select(F.col("cell_type").alias("grp"), "gene", "total")), "total")


@query("e16_first_per_group", "SELECT donor_id, row_no, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY row_no) AS rn FROM v_obs) x WHERE rn = 1")
def _(v):
    return R.first_per_group(v.obs.select("donor_id", "row_no", "obs_id"), "donor_id", "row_no")


@query("e17_mean_rank", "SELECT dataset, model, r(avg(k)) AS mean_rank FROM (SELECT dataset, model, rank() OVER (PARTITION BY dataset, metric ORDER BY value DESC) AS k FROM v_scores WHERE value IS NOT NULL) x GROUP BY ALL")
def _(v):
    return rr(L.mean_rank(v.scores), "mean_rank")


MM = "mm AS (SELECT dataset, model, metric, CASE WHEN value IS NULL THEN NULL WHEN max(c) OVER w > min(c) OVER w THEN (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) ELSE 0 END AS value FROM (SELECT *, CASE WHEN value IS NOT NULL THEN greatest(value, 0) END AS c FROM v_scores) x WINDOW w AS (PARTITION BY dataset, metric))"


@query("e18_minmax", f"WITH {MM} SELECT dataset, model, metric, r(value) AS value FROM mm")
def _(v):
    return rr(L.minmax(v.scores, "value", ["dataset", "metric"]), "value")


@query("e19_recovery_auc", """WITH k AS (SELECT concat(model, '|', source) AS motif, target AS gene, row_number() OVER (PARTITION BY model, source ORDER BY weight DESC, target) - 1 AS rank FROM v_net),
c AS (SELECT round(count(DISTINCT gene) * 0.2) - 1 AS cut FROM k), z AS (SELECT set_name, count(*) AS n FROM v_genesets GROUP BY 1),
a AS (SELECT g.set_name, motif, sum(greatest(0, cut - rank)) / max((cut + 1) * n) AS auc FROM k JOIN v_genesets g USING (gene) JOIN z ON z.set_name = g.set_name CROSS JOIN c GROUP BY ALL)
SELECT set_name, motif, r(auc) AS auc, r((auc - avg(auc) OVER (PARTITION BY set_name)) / stddev_pop(auc) OVER (PARTITION BY set_name)) AS nes FROM a""")
def _(v):
    from pyspark.sql import Window as W
    w = W.partitionBy("source").orderBy(F.col("weight").desc(), "target")
    k = v.net.withColumn("source", F.concat_ws("|", "model", "source")).select(F.col("source").alias("motif"), F.col("target").alias("gene"), (F.row_number().over(w) - 1).alias("rank"))
    return rr(R.recovery_auc(k, v.genesets, 0.2), "auc", "nes")


@query("e20_consensus_peaks", """WITH p AS (SELECT chrom, CAST(floor((start + stop) / 2.0) AS BIGINT) - 250 AS s, CAST(floor((start + stop) / 2.0) AS BIGINT) + 250 AS e, score, event_id FROM v_peaks),
q AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM p),
i AS (SELECT *, sum(nw) OVER (PARTITION BY chrom ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM q)
SELECT chrom, arg_max(s, (score, -event_id)) AS "start", arg_max(e, (score, -event_id)) AS stop, max(score) AS score, arg_max(event_id, (score, -event_id)) AS event_id, count(*) AS n FROM i GROUP BY chrom, isl""")
def _(v):
    return I.consensus_peaks(v.peaks).select("chrom", "start", "stop", "score", "event_id", "n")


@query("e21_otsu", """WITH l AS (SELECT tf, min(score) AS lo, max(score) AS hi FROM v_peaks GROUP BY 1), h AS (SELECT tf, CAST(least(99, floor((score - lo) / ((hi - lo) / 100))) AS INT) AS bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi FROM v_peaks JOIN l USING (tf) GROUP BY 1, 2),
c AS (SELECT tf, bin, lo + (bin + 0.5) * (hi - lo) / 100 AS x, n FROM h), w AS (SELECT tf, bin, x, sum(n) OVER a AS w0, sum(n * x) OVER a AS s0, sum(n) OVER (PARTITION BY tf) AS wt, sum(n * x) OVER (PARTITION BY tf) AS st FROM c WINDOW a AS (PARTITION BY tf ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, round(w0 * (wt - w0) * (s0 / w0 - (st - s0) / nullif(wt - w0, 0)) ^ 2 / wt ^ 2, 9) AS v FROM w) SELECT tf, r(arg_max(x, (v, -bin))) AS threshold FROM b WHERE v IS NOT NULL GROUP BY tf""")
def _(v):
    return rr(H.otsu(v.peaks, "tf", "score"), "threshold")
