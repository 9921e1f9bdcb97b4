"""F, G, H: set logic, reshaping, codes."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import rr
from netloom.operators import edges as E, filters as O, intervals as I, reshape as S
from netloom.plans import leaderboard as L


@query("f1_union_skeletons", """SELECT DISTINCT p.tf AS source, t.gene AS target FROM v_peaks p JOIN v_tss t ON p.chrom = t.chrom AND p.stop > t.tss - 1000 AND p.start < t.tss + 1001
UNION SELECT DISTINCT p.tf, t.gene FROM v_peaks p JOIN v_tss t ON p.chrom = t.chrom AND p.stop > t.tss - 300 AND p.start < t.tss + 301 WHERE p.score > 50""")
def _(v):
    return S.union_distinct(I.promoter_skeleton(v.tss, v.peaks), I.promoter_skeleton(v.tss, O.score_above(v.peaks, 50), 300))


@query("f2_tag_union", "SELECT model, count(*) AS n, r(sum(weight)) AS total FROM v_net GROUP BY model")
def _(v):
    parts = [(m, v.net.where(F.col("model") == m).drop("model")) for m in "ANR"]
    return rr(S.tag_union(parts).groupBy("model").agg(F.count("*").alias("n"), F.sum("weight").alias("total")), "total")


GT = "a AS (SELECT source, target FROM v_net WHERE weight > 0), b AS (SELECT source, target FROM v_net WHERE weight <= 0)"


@query("f3_gt_overlap", f"""WITH {GT} SELECT 'source' AS what, (SELECT count(*) FROM (SELECT source FROM a INTERSECT SELECT source FROM b)) AS shared, (SELECT count(*) FROM (SELECT source FROM a UNION SELECT source FROM b)) AS total
UNION ALL SELECT 'target', (SELECT count(*) FROM (SELECT target FROM a INTERSECT SELECT target FROM b)), (SELECT count(*) FROM (SELECT target FROM a UNION SELECT target FROM b))
UNION ALL SELECT 'pair', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))""")
def _(v):
    return E.gt_overlap(v.net.where("weight > 0"), v.net.where("weight <= 0"))[1]


@query("f3_gt_mutual", f"WITH {GT} SELECT * FROM a INTERSECT SELECT * FROM b")
def _(v):
    return E.gt_overlap(v.net.where("weight > 0"), v.net.where("weight <= 0"))[0]


@query("f4_set_difference", "SELECT DISTINCT donor_id FROM v_obs EXCEPT SELECT donor_id FROM v_obs WHERE plate = '1995' AND cell_type = 'BUILDING' AND is_control")
def _(v):
    return v.obs.select("donor_id").distinct().exceptAll(v.obs.where("plate = '1995' and cell_type = 'BUILDING' and is_control").select("donor_id").distinct())


@query("f5_concat_rows", "SELECT obs_id, gene, r(value) AS value FROM v_norm")
def _(v):
    o = v.obs.select("obs_id", "is_control")
    a = v.norm.join(o.where("is_control"), "obs_id", "left_semi")
    return rr(a.unionByName(v.norm.join(o.where("not is_control"), "obs_id", "left_semi")).select("obs_id", "gene", "value"), "value")


@query("f6_outer_genes", """SELECT gene, count(*) AS n FROM (SELECT obs_id, gene FROM v_counts WHERE gene NOT LIKE '%/SMALL' UNION ALL SELECT obs_id, gene FROM v_counts WHERE gene NOT LIKE '%/PROMO') x GROUP BY gene""")
def _(v):
    a = v.counts.where("gene not like '%/SMALL'")
    b = v.counts.where("gene not like '%/PROMO'")
    return a.unionByName(b, allowMissingColumns=True).groupBy("gene").agg(F.count("*").alias("n"))


@query("g1_melt_matrix", """SELECT 'upper' AS part, source, target, weight FROM v_nat WHERE CAST(substr(source, 8) AS INT) < CAST(substr(target, 8) AS INT) UNION ALL SELECT 'full', source, target, weight FROM v_nat""")
def _(v):
    n = v.table("nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("gene"))
    cells = v.nat.join(n.withColumnsRenamed({"idx": "j", "gene": "target"}), "target")
    arr = F.map_from_entries(F.collect_list(F.struct("j", "weight")))
    size = n.select(F.count("*")).scalar()
    m = cells.groupBy("source").agg(arr.alias("m")).withColumn("n", size)
    rows = m.select(F.col("source").alias("gene"), F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec")).join(n, "gene")
    a = S.melt_matrix(rows, n, True).where("weight != 0").withColumn("part", F.lit("upper"))
    return a.unionByName(S.melt_matrix(rows, n, False).withColumn("part", F.lit("full")))


@query("g2_pivot_edges", "SELECT source, target, weight FROM v_nat")
def _(v):
    names = [f"NATION_{i}" for i in range(25)]
    return S.melt_edges(S.pivot_edges(v.nat, names), names)


METRICS = ["gs_f1", "r_precision", "sem", "tfb_f1", "ws_precision"]


@query("g3_scores_wide", """SELECT dataset, CASE model WHEN 'Brand#1' THEN 'negative_control' WHEN 'Brand#2' THEN 'positive_control' ELSE model END AS model,
r(gs_f1) AS gs_f1, r(r_precision) AS r_precision, r(sem) AS sem, r(tfb_f1) AS tfb_f1, r(ws_precision) AS ws_precision FROM v_wide""")
def _(v):
    return rr(L.wide(v.scores, ["dataset", "model"], "metric", "value", METRICS), *METRICS)


PERTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("g4_de_wide", "SELECT gene, " + ", ".join(f"r(sum(value) FILTER (perturbation = '{p}')) AS p{p[0]}" for p in PERTS) + " FROM v_norm JOIN v_obs USING (obs_id) GROUP BY gene")
def _(v):
    e = v.norm.join(v.obs.select("obs_id", "perturbation"), "obs_id")
    w = e.groupBy("gene").pivot("perturbation", PERTS).agg(F.sum("value"))
    return rr(w.select("gene", *[F.col(p).alias(f"p{p[0]}") for p in PERTS]), *[f"p{p[0]}" for p in PERTS])


@query("g5_stacked_networks", "SELECT model AS cell_type, source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(weight) DESC, source, target) AS rn FROM v_net) x WHERE rn <= 2000")
def _(v):
    return E.top_edges(v.net, 2000, ["model"]).select(F.col("model").alias("cell_type"), "source", "target", "weight")


@query("h1_encode", "SELECT obs_id, CAST(dense_rank() OVER (ORDER BY perturbation) - 1 AS INT) AS code FROM v_obs")
def _(v):
    return O.encode(v.obs, "perturbation", "code").select("obs_id", "code")


@query("h2_combine_codes", """SELECT obs_id, (dense_rank() OVER (ORDER BY perturbation) - 1) * (SELECT count(DISTINCT cell_type) FROM v_obs) * (SELECT count(DISTINCT donor_id) FROM v_obs)
+ (dense_rank() OVER (ORDER BY cell_type) - 1) * (SELECT count(DISTINCT donor_id) FROM v_obs) + dense_rank() OVER (ORDER BY donor_id) - 1 AS grp FROM v_obs""")
def _(v):
    return S.combine_codes(v.obs, ["perturbation", "cell_type", "donor_id"]).select("obs_id", "grp")
