"""C: joins."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.filters import r6
from netloom.operators import blocks, edges as E, enrichment as N, expression as X, intervals as I
from netloom.functions import det
from netloom.operators.neighbours import knn_approx, recall
from netloom.session import cut


@query("c1_symmetric_links", "SELECT DISTINCT a.source, a.target, a.weight FROM v_nat a JOIN v_nat b ON a.source = b.target AND a.target = b.source AND a.weight = b.weight")
def _(v):
    return E.symmetric_links(v.nat)


@query("c2_edges_in", "SELECT model, source, target, r(weight) AS weight FROM v_net WHERE source IN (SELECT tf FROM v_gtfs) AND target IN (SELECT tf FROM v_gtfs)")
def _(v):
    return E.edges_in(v.net, v.gtfs.select(F.col("tf").alias("gene"))).select("model", "source", "target", r6("weight").alias("weight"))


C3 = """WITH s AS (SELECT donor_id, cell_type, plate, arg_max(obs_id, row_no) AS c FROM v_obs WHERE is_control AND plate <> '1996' AND donor_id <> 'D2' GROUP BY ALL),
l AS (SELECT donor_id, arg_max(obs_id, row_no) AS c FROM v_obs WHERE is_control AND plate <> '1996' AND donor_id <> 'D2' GROUP BY ALL),
m AS (SELECT o.obs_id, coalesce(s.c, l.c, (SELECT arg_min(obs_id, row_no) FROM v_obs WHERE is_control AND plate <> '1996' AND donor_id <> 'D2')) AS control_id
FROM v_obs o LEFT JOIN s ON o.donor_id = s.donor_id AND o.cell_type = s.cell_type AND o.plate = s.plate LEFT JOIN l ON o.donor_id = l.donor_id),
u AS (SELECT c.obs_id, gene, value FROM v_norm c UNION ALL SELECT m.obs_id, c.gene, -c.value FROM m JOIN v_norm c ON c.obs_id = m.control_id)
SELECT obs_id, gene, r(sum(value)) AS delta FROM u GROUP BY obs_id, gene"""


@query("c3_matched_control", C3)
def _(v):
    o = v.obs.withColumn("is_control", F.expr("is_control and plate <> '1996' and donor_id <> 'D2'"))
    d, _ = X.perturbation_delta(v.norm, o, ["donor_id", "cell_type", "plate"], ["donor_id"])
    return d.select("obs_id", "gene", r6("value").alias("delta"))


@query("c4_common_obs", "SELECT DISTINCT obs_id FROM v_access WHERE obs_id IN (SELECT obs_id FROM v_gexp WHERE gene = 'G7')")
def _(v):
    return N.common(v.access, v.gexp.where("gene = 'G7'"), "obs_id")


@query("c5_common_genes", "SELECT gene FROM v_genesets WHERE library = 'LIB_0' INTERSECT SELECT gene FROM v_genesets WHERE library = 'LIB_1'")
def _(v):
    return N.common(v.genesets.where("library = 'LIB_0'"), v.genesets.where("library = 'LIB_1'"), "gene")


WINDOW = """t AS (SELECT chrom, greatest(0, CASE WHEN strand = '+' THEN tss - 1000 ELSE tss - 100 END) AS s,
CASE WHEN strand = '+' THEN tss + 100 ELSE tss + 1000 END AS e, gene FROM v_tss)"""


@query("c6_peaks_near_tss", f"WITH {WINDOW} SELECT DISTINCT p.tf AS source, t.gene AS target FROM v_peaks p JOIN t ON p.chrom = t.chrom AND p.stop >= t.s AND p.start <= t.e")
def _(v):
    return I.peaks_near_tss(v.peaks, v.tss)


@query("c7_promoter_skeleton", """SELECT DISTINCT p.tf AS source, t.gene AS target FROM v_peaks p JOIN v_tss t
ON p.chrom = t.chrom AND p.stop > t.tss - 1000 AND p.start < t.tss + 1001""")
def _(v):
    return I.promoter_skeleton(v.tss, v.peaks)


PK = """pk AS (SELECT DISTINCT peak, split_part(peak, ':', 1) AS chrom, CAST(split_part(split_part(peak, ':', 2), '-', 1) AS BIGINT) AS s, CAST(split_part(peak, '-', 2) AS BIGINT) AS e FROM v_access)"""
P2G = f"""{PK}, p2g AS (SELECT gene, peak, min(greatest(0, s - tss, tss - e)) AS dist FROM pk JOIN v_tss t ON pk.chrom = t.chrom AND s <= tss + 150000 AND e >= tss - 150000 GROUP BY 1, 2)"""


@query("c8_peak2gene", f"WITH {P2G} SELECT gene, peak, dist FROM p2g")
def _(v):
    return I.peak2gene(v.tss, v.access)


P2T = """p2t AS (SELECT DISTINCT m.tf AS source, pk.peak FROM pk JOIN v_peaks m ON pk.chrom = m.chrom AND m.stop > pk.s AND m.start < pk.e)"""


@query("c9_bridge", f"WITH {P2G}, {P2T} SELECT DISTINCT source, gene AS target FROM p2g JOIN p2t USING (peak)")
def _(v):
    return I.bridge(I.peak2gene(v.tss, v.access), I.peak2tf(v.access, v.peaks))


@query("c10_annotate", "SELECT DISTINCT g.gene, chrom, lo FROM (SELECT DISTINCT gene FROM v_gexp) g JOIN (SELECT gene, min(chrom) AS chrom, min(tss) AS lo FROM v_tss GROUP BY gene) t USING (gene)")
def _(v):
    loc = v.tss.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("tss").alias("lo"))
    return I.annotate(v.gexp.select("gene").distinct(), loc).select("gene", "chrom", "lo")


@query("c13_overlap", """SELECT source, library, set_name, count(*) AS overlap FROM (SELECT DISTINCT source, target FROM v_net) e
JOIN v_genesets g ON e.target = g.gene GROUP BY ALL""")
def _(v):
    return N.overlap(v.net.select("source", "target").distinct(), v.genesets)


@query("c14_shared_donors", """SELECT donor_id FROM (SELECT DISTINCT donor_id FROM v_obs WHERE plate = '1995' INTERSECT SELECT DISTINCT donor_id FROM v_obs WHERE plate = '1997') x
ORDER BY $HASH(donor_id, '7'), donor_id LIMIT 10""")
def _(v):
    both = N.common(v.obs.where("plate = '1995'"), v.obs.where("plate = '1997'"), "donor_id")
    return both.orderBy(det.hash_key("donor_id", seed=7), "donor_id").limit(10)


C15 = f"""WITH {P2G}, n AS (SELECT count(*) AS n FROM v_aobs),
g AS (SELECT p2g.peak, p2g.gene, o.obs_id, coalesce(a.value, 0) AS x, coalesce(e.value, 0) AS y FROM p2g CROSS JOIN v_aobs o
LEFT JOIN v_access a ON a.peak = p2g.peak AND a.obs_id = o.obs_id LEFT JOIN v_gexp e ON e.gene = p2g.gene AND e.obs_id = o.obs_id
WHERE p2g.gene IN (SELECT gene FROM v_gexp))
SELECT peak, gene, r(corr(x, y)) AS r FROM g GROUP BY ALL"""


@query("c15_peak_gene_corr", C15)
def _(v):
    links = I.peak2gene(v.tss, v.access)
    return I.peak_gene_corr(v.access, v.gexp, v.aobs, links).select("peak", "gene", r6("r").alias("r"))


@query("c15_peak_gene_fdr")
def _(v):
    links = I.peak2gene(v.tss, v.access)
    return I.peak_gene_fdr(I.peak_gene_corr(v.access, v.gexp, v.aobs, links, "spearman"))


C16 = """SELECT obs_id, neighbor, r(dist) AS dist, rn FROM (SELECT a.obs_id, b.obs_id AS neighbor, list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS dist,
row_number() OVER (PARTITION BY a.obs_id ORDER BY list_distance(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])), b.obs_id) AS rn
FROM v_emb a JOIN v_emb b ON a.obs_id <> b.obs_id) x WHERE rn <= 10"""


@query("c16_knn", C16)
def _(v):
    return blocks.knn(v.emb, 10).select("obs_id", "neighbor", r6("dist").alias("dist"), "rn")


@query("c16_knn_approx", "SELECT count(*) AS n_rows, count(*) * 10 AS n_pairs, true AS recall_at_least_09 FROM v_emb")
def _(v):
    near = cut(knn_approx(v.emb, 10), "approx")
    n = near.agg(F.count_distinct("obs_id").alias("n_rows"), F.count("*").alias("n_pairs"))
    return n.withColumn("recall_at_least_09", F.lit(recall(near, blocks.knn(v.emb, 10)) >= 0.9))


@query("c18_drop_blacklisted", """SELECT event_id FROM v_peaks p WHERE NOT EXISTS (SELECT 1 FROM v_peaks b WHERE b.tf = 'error' AND b.score > 80
AND b.chrom = p.chrom AND p.stop > b.start AND p.start < b.stop)""")
def _(v):
    return I.drop_blacklisted(v.peaks, v.peaks.where("tf = 'error' and score > 80")).select("event_id")
