"""B: projections, filters, predicates."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.operators import edges as E, filters as O


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r6_double(c):
    """``r6`` of a double column, bit for bit. ``round`` forms a decimal number for each row, which most of the time of a long
    result goes to; here only for what is large or nearly a tie, all else is the nearest millionth."""
    y = F.abs(F.col(c) * 1e6)
    plain = (y < 1e11) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.signum(c) * F.floor(y + 0.5) / F.lit(1e6)).otherwise(F.round(c, 6)) + F.lit(0.0)


LAYERS = """SELECT obs_id, gene, value, 'counts' AS layer FROM v_counts UNION ALL
SELECT obs_id, gene, value, 'X_norm' AS layer FROM v_norm"""


@query("b1_pick_layer", "SELECT gene, count(*) AS n, r(sum(value)) AS total FROM v_norm GROUP BY gene")
def _(v):
    e = O.pick_layer(v.sql(LAYERS))
    return e.groupBy("gene").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("b2_tf_filter", "SELECT model, source, target, r(weight) AS weight FROM v_edges WHERE source IN (SELECT tf FROM v_tfs)")
def _(v):
    return O.tf_filter(v.edges, v.tfs).select("model", "source", "target", r6("weight").alias("weight"))


@query("b3_drop_self", "SELECT * FROM v_nat WHERE source <> target")
def _(v):
    return O.drop_self(v.nat)


@query("b4_weight_sign", """SELECT row_id, CASE WHEN w IS NULL THEN NULL WHEN w > 0 THEN 1 WHEN w < 0 THEN -1 ELSE 0 END AS sign, r(w) AS weight
FROM (SELECT row_id, try_cast(CASE WHEN target LIKE '%7' THEN 'bad' ELSE CAST(weight AS VARCHAR) END AS DOUBLE) AS w FROM v_edges) x""")
def _(v):
    t = v.edges.withColumn("weight", F.when(F.col("target").endswith("7"), "bad").otherwise(F.col("weight").cast("string")))
    t = t.withColumn("weight", O.to_weight())
    return t.select("row_id", O.sign().alias("sign"), r6("weight").alias("weight"))


@query("b5_basic_qc", """SELECT obs_id, gene, value FROM v_counts
WHERE obs_id IN (SELECT obs_id FROM v_counts GROUP BY obs_id HAVING count(*) FILTER (value > 0) BETWEEN 2 AND 6)
AND gene IN (SELECT gene FROM v_counts GROUP BY gene HAVING count(*) FILTER (value <> 0) > 300)""")
def _(v):
    return O.basic_qc(v.counts, 2, 6, 300).select("obs_id", "gene", "value")


@query("b6_qc_perturbation", """WITH o AS (SELECT * FROM v_obs WHERE perturbation IN (SELECT perturbation FROM v_obs GROUP BY 1 HAVING count(*) >= 2950)),
e AS (SELECT c.* FROM v_counts c WHERE obs_id IN (SELECT obs_id FROM o)),
g AS (SELECT e.* FROM e WHERE gene IN (SELECT gene FROM e GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 200))
SELECT obs_id, gene, value FROM g WHERE obs_id IN (SELECT obs_id FROM g GROUP BY 1 HAVING count(*) FILTER (value > 0) >= 3)""")
def _(v):
    return O.qc_perturbation(v.counts, v.obs, 2950, 200, 3).select("obs_id", "gene", "value")


@query("b7_qc_ranges", """SELECT obs_id, n_counts, n_features FROM (SELECT obs_id, sum(value) AS n_counts, count(*) AS n_features FROM v_counts GROUP BY 1) x
WHERE n_counts BETWEEN 20 AND 200 AND n_features >= 2""")
def _(v):
    m = v.counts.groupBy("obs_id").agg(F.sum("value").alias("n_counts"), F.count("*").alias("n_features"))
    return O.qc_ranges(m, {"n_counts": (20, 200), "n_features": (2, None)})


@query("b8_genes_max_plate", """SELECT gene, max(n) AS max_cells FROM (SELECT gene, plate, count(*) AS n FROM v_counts JOIN v_obs USING (obs_id) WHERE value > 0 GROUP BY 1, 2) x
GROUP BY gene HAVING max(n) >= 80""")
def _(v):
    return O.genes_max_plate(v.counts, v.obs, 80)


@query("b9_coverage_filter", """SELECT gene, count(*) AS nnz, r(1 - count(*) / (SELECT count(*) FROM v_bobs)::DOUBLE) AS zero_share FROM v_bulk WHERE value <> 0 GROUP BY gene
HAVING 1 - count(*) / (SELECT count(*) FROM v_bobs)::DOUBLE <= 0.7""")
def _(v):
    return O.coverage_filter(v.bulk, v.bobs, 0.7).select("gene", "nnz", r6("zero_share").alias("zero_share"))


@query("b10_filter_samples", """WITH a AS (SELECT * FROM v_bobs WHERE perturbation NOT IN ('2-HIGH') AND cell_count >= 10)
SELECT obs_id, cell_count FROM a WHERE perturbation NOT IN (SELECT perturbation FROM a GROUP BY donor_id, perturbation HAVING count(*) < 3)
AND NOT (perturbation = '1-URGENT' AND donor_id = 'D3')""")
def _(v):
    drop = v.pert.where("perturbation = '2-HIGH'").select("perturbation")
    rules = v.bobs.where("perturbation = '1-URGENT' AND donor_id = 'D3'").select("perturbation", "donor_id").distinct()
    return O.filter_samples(v.bobs, drop, 10, rules).select("obs_id", "cell_count")


@query("b11_match_terms", """SELECT event_id, label FROM (SELECT event_id, concat(cell_type, ', ', tf) AS label FROM v_peaks) x
WHERE label ILIKE '%k1%' OR label ILIKE '%sign%'""")
def _(v):
    p = v.peaks.select("event_id", F.concat("cell_type", F.lit(", "), "tf").alias("label"))
    return O.match_terms(p, "label", ["K1", "SIGN"])


@query("b12_score_above", "SELECT event_id, score FROM v_peaks WHERE score > 50")
def _(v):
    return O.score_above(v.peaks, 50).select("event_id", "score")


@query("b13_map_values", """SELECT obs_id, CASE WHEN cell_type = 'BUILDING' THEN 'B' ELSE 'M' END AS cell_type FROM v_obs WHERE cell_type IN ('BUILDING', 'MACHINERY')""")
def _(v):
    keys = v.obs.select(F.col("cell_type").alias("key")).distinct().where(F.col("key").isin("BUILDING", "MACHINERY"))
    return O.map_values(v.obs.select("obs_id", "cell_type"), "cell_type", keys.withColumn("val", F.substring("key", 1, 1)), "drop")


@query("b14_anonymise", "SELECT obs_id, concat('donor_', CAST(dense_rank() OVER (ORDER BY donor_id) - 1 AS VARCHAR)) AS donor_id FROM v_obs")
def _(v):
    return O.anonymise(v.obs.select("obs_id", "donor_id"), "donor_id")


@query("b15_parse_id", """SELECT label, CAST(regexp_extract(label, '^D([0-9]+)_([A-Z])([A-Z]+)_([0-9])', 1) AS VARCHAR) AS id,
regexp_extract(label, '^D([0-9]+)_([A-Z])([A-Z]+)_([0-9])', 2) AS sex, regexp_extract(label, '^D([0-9]+)_([A-Z])([A-Z]+)_([0-9])', 3) AS disease,
regexp_extract(label, '^D([0-9]+)_([A-Z])([A-Z]+)_([0-9])', 4) AS cond FROM (SELECT DISTINCT concat(donor_id, '_', cell_type, '_', perturbation) AS label FROM v_obs) x""")
def _(v):
    ids = v.obs.select(O.group_key("donor_id", "cell_type", "perturbation").alias("label")).distinct()
    return O.parse_id(ids, "label", r"^D([0-9]+)_([A-Z])([A-Z]+)_([0-9])", ["id", "sex", "disease", "cond"])


@query("b16_parse_peak", """SELECT DISTINCT peak, split_part(peak, ':', 1) AS chrom, CAST(split_part(split_part(peak, ':', 2), '-', 1) AS BIGINT) AS "start",
CAST(split_part(peak, '-', 2) AS BIGINT) AS "end" FROM v_access""")
def _(v):
    return O.parse_peak(v.access.select("peak").distinct())


FEATURES = "SELECT DISTINCT gene, CASE WHEN gene LIKE '%/ECONOMY' THEN 'Antibody' ELSE 'Gene Expression' END AS feature_type FROM v_counts"


@query("b17_split_modality", "SELECT obs_id, gene, value FROM v_counts WHERE gene LIKE '%/ECONOMY'")
def _(v):
    return O.split_modality(v.counts, v.sql(FEATURES), "Antibody").select("obs_id", "gene", "value")


@query("b18_drop_dup_genes", """SELECT 'none' AS mode, p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) = 1)
UNION ALL SELECT 'first', min(p_partkey), p_name FROM part GROUP BY p_name""")
def _(v):
    p = v.table("part").select("p_partkey", "p_name")
    a = O.drop_dup_genes(p, "p_name").select(F.lit("none").alias("mode"), "p_partkey", "p_name")
    b = O.drop_dup_genes(p, "p_name", "p_partkey").select(F.lit("first").alias("mode"), "p_partkey", "p_name")
    return a.unionByName(b)


@query("b19_format_obs", "SELECT obs_id, donor_id AS individual, perturbation, perturbation = '3-MEDIUM' AS is_control FROM v_obs")
def _(v):
    return O.format_obs(v.obs.drop("is_control"), {"donor_id": "individual"},
                        ["obs_id", "individual", "perturbation", "is_control"], "3-MEDIUM", "perturbation")


@query("b20_group_key", "SELECT obs_id, concat_ws('_', cell_type, donor_id, plate) AS grp FROM v_obs")
def _(v):
    return v.obs.select("obs_id", O.group_key("cell_type", "donor_id", "plate").alias("grp"))


@query("b21_ensure_counts", "SELECT gene, r(sum(value)) AS total FROM v_counts GROUP BY gene")
def _(v):
    logged = v.counts.withColumn("value", F.log1p("value"))
    return O.ensure_counts(logged).groupBy("gene").agg(r6(F.sum("value")).alias("total"))


@query("b22_clean_values", """SELECT row_id, r(CASE WHEN weight = 0 OR target LIKE '%3' THEN 0 ELSE weight END) AS weight FROM v_edges""")
def _(v):
    w = F.when(F.col("weight") == 0, float("inf")).when(F.col("target").endswith("3"), float("nan")).otherwise(F.col("weight"))
    return O.clean_values(v.edges.withColumn("weight", w), "weight").select("row_id", r6("weight").alias("weight"))


@query("b23_nonzero_std", """SELECT gene FROM (SELECT gene, CASE WHEN p_size_min = p_size_max AND n >= (SELECT count(*) FROM v_obs) THEN 0 ELSE 1 END AS k FROM
(SELECT gene, min(value) AS p_size_min, max(value) AS p_size_max, count(*) AS n FROM v_counts GROUP BY gene) x) y WHERE k = 1""")
def _(v):
    return O.nonzero_std(v.counts, v.obs)


@query("b24_min_targets", """WITH e AS (SELECT DISTINCT source, target FROM v_edges)
SELECT source, target FROM e WHERE source IN (SELECT source FROM e GROUP BY 1 HAVING count(*) >= 50)""")
def _(v):
    return O.min_targets(v.edges.select("source", "target").distinct(), 50)


SETS = "SELECT library, set_name, collect_list(gene) AS genes FROM v_genesets GROUP BY library, set_name"


@query("b25_load_sets", """SELECT library, concat('Set ', substr(set_name, 5)) AS set_name, count(*) AS n_genes FROM v_genesets GROUP BY library, v_genesets.set_name
HAVING count(*) BETWEEN 5 AND 32""")
def _(v):
    return O.load_sets(v.sql(SETS), 5, 32).select("library", "set_name", F.col("n_genes").cast("bigint").alias("n_genes"))


@query("b26_sets_long", "SELECT library, set_name, gene FROM v_genesets")
def _(v):
    return O.sets_long(v.sql(SETS))


@query("b27_universe", """SELECT 'mixed' AS net, gene FROM (SELECT DISTINCT gene FROM v_counts) g
UNION ALL SELECT 'tf_only', gene FROM (SELECT DISTINCT gene FROM v_counts) g WHERE gene IN (SELECT tf FROM v_gtfs)""")
def _(v):
    genes = v.counts.select("gene").distinct()
    tf_net = v.net.join(v.gtfs.select(F.col("tf").alias("target")), "target", "left_semi")
    a = O.universe(v.net, v.gtfs, genes).select(F.lit("mixed").alias("net"), "gene")
    return a.unionByName(O.universe(tf_net, v.gtfs, genes).select(F.lit("tf_only").alias("net"), "gene"))


@query("b28_valid_groups", "SELECT obs_id, donor_id FROM v_obs WHERE donor_id IN (SELECT donor_id FROM v_obs GROUP BY 1 HAVING count(*) >= 600)")
def _(v):
    return O.valid_groups(v.obs, "donor_id", 600).select("obs_id", "donor_id")


@query("b29_fallback_group", "SELECT obs_id, cell_type AS grp FROM v_obs")
def _(v):
    return O.fallback_group(v.obs.withColumn("major", F.lit("x")), ["major", "cell_type", "plate"], "grp").select("obs_id", "grp")


@query("b30_sig_filter", "SELECT row_id, r(weight) AS weight FROM v_edges WHERE weight <> 0 AND abs(weight) / 2.5 < 0.05")
def _(v):
    return O.sig_filter(v.edges.withColumn("p", F.abs("weight") / 2.5)).select("row_id", r6("weight").alias("weight"))


@query("b31_apply_prior", """SELECT model, source, target, r(weight) AS weight FROM v_net n
WHERE EXISTS (SELECT 1 FROM v_net m WHERE m.model = 'R' AND m.weight > 0.3 AND m.source = n.source AND m.target = n.target)""")
def _(v):
    return O.apply_prior(v.net, v.net.where("model = 'R' AND weight > 0.3")).select("model", "source", "target", r6("weight").alias("weight"))


@query("b32_canonical_label", """SELECT p_partkey, CASE WHEN k = 'BRAND1ECONOMY' THEN 'B1' ELSE k END AS label FROM
(SELECT p_partkey, upper(translate(concat(p_brand, '/', p_type), '/-. _#', '')) AS k FROM part) x""")
def _(v):
    p = v.table("part").select("p_partkey", F.replace(F.concat_ws("/", "p_brand", "p_type"), F.lit("#"), F.lit("")).alias("label"))
    alias = p.where("label = 'Brand1/ECONOMY'").select(O.canonical("label").alias("key"), F.concat(F.substring("label", 1, 1), F.substring("label", 6, 1)).alias("val")).distinct()
    return O.canonical_label(p, "label", alias)


@query("b33_limit_perturbations", """SELECT obs_id, perturbation FROM v_obs WHERE perturbation IN
(SELECT perturbation FROM v_pert WHERE is_control = 0 ORDER BY perturbation LIMIT 3)""")
def _(v):
    tfs = v.pert.where("is_control = 0").select(F.col("perturbation").alias("tf"))
    return O.limit_perturbations(v.obs, tfs, 3).select("obs_id", "perturbation")
