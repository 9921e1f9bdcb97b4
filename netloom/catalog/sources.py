"""A: sources and sinks. Spark writes the format from the stand-in tables, the source reads it."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import rr
from netloom.catalog.nulls import POBS, SPLIT, pobs
from netloom.operators import nulls as Z
from netloom.plans import leaderboard as L
from netloom.session import scratch
from netloom.sources import tables as T, text as X

METRICS = ["gs_f1", "r_precision", "sem", "tfb_f1", "ws_precision"]


def text(df, path):
    df.select("value").write.mode("overwrite").text(path)
    return path


def line(*cols, sep="\t"):
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value")


@query("a1_read_expr", "SELECT obs_id, gene, r(value) AS value FROM v_norm")
def _(v):
    p = scratch(v.spark, "expr")
    T.write_expr(v.counts.withColumn("layer", F.lit("counts")).unionByName(v.norm.withColumn("layer", F.lit("X_norm"))), p)
    return rr(T.read_expr(v.spark, p, "X_norm").select("obs_id", "gene", "value"), "value")


PRED = "SELECT source, target, r(weight) AS weight FROM v_net WHERE model = 'R' AND source <> target ORDER BY abs(weight) DESC, source, target LIMIT 5000"


@query("a2_read_prediction", f"SELECT * FROM (WITH x AS (SELECT 1) {PRED}) y WHERE source IN (SELECT tf FROM v_gtfs)".replace("WITH x AS (SELECT 1) ", ""))
def _(v):
    p = scratch(v.spark, "pred")
    T.write_prediction(v.net.where("model = 'R'"), p, "m1", "d1")
    T.write_prediction(v.net.where("model = 'N'"), p, "m2", "d1")
    return rr(T.read_prediction(v.spark, p, 5000, v.gtfs, "m1"), "weight")


@query("a3_write_prediction", "SELECT 'd1' AS dataset_id, model AS method_id, source, target, r(weight) AS weight FROM v_net")
def _(v):
    p = scratch(v.spark, "pred")
    for m in "ANR":
        T.write_prediction(v.net.where(F.col("model") == m), p, m, "d1")
    return rr(v.spark.read.parquet(p).withColumn("weight", F.col("weight").cast("double")).select("dataset_id", "method_id", "source", "target", "weight"), "weight")


def sheet(v):
    return L.wide(v.scores, ["dataset", "model"], "metric", "value", METRICS)


@query("a4_write_score", """SELECT dataset_id, method_id, n, nulls FROM (SELECT dataset AS dataset_id, model AS method_id, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls FROM v_scores GROUP BY ALL) x""")
def _(v):
    p = scratch(v.spark, "score")
    T.write_score(sheet(v), p, METRICS)
    raw = v.spark.read.json(p)
    return raw.select("dataset_id", "method_id", F.size("metric_ids").cast("bigint").alias("n"),
                      F.size(F.filter("metric_values", lambda x: x == "None")).cast("bigint").alias("nulls"))


@query("a5_read_scores", "SELECT dataset, model, metric, r(value) AS value FROM v_scores WHERE value IS NOT NULL")
def _(v):
    p = scratch(v.spark, "score")
    T.write_score(sheet(v), p, METRICS)
    return rr(T.read_scores(v.spark, p), "value")


@query("a6_collect_scores", "SELECT dataset, model, metric, r(value) AS value FROM v_scores WHERE value IS NOT NULL AND dataset <> 'EUROPE'")
def _(v):
    p = scratch(v.spark, "score")
    T.write_score(sheet(v), p, METRICS, by_file=True)
    return rr(T.collect_scores(v.spark, p, v.scores.where("dataset <> 'EUROPE'").select("dataset").distinct()), "value")


@query("a7_combine_results", "SELECT dataset, model, metric, r(value) AS value, length(dataset) AS n FROM v_scores WHERE value IS NOT NULL")
def _(v):
    a, b = scratch(v.spark, "score"), scratch(v.spark, "score")
    T.write_score(sheet(v).where("dataset <> 'ASIA'"), a, METRICS)
    T.write_score(sheet(v).where("dataset in ('ASIA', 'EUROPE')"), b, METRICS)
    meta = v.scores.select("dataset").distinct().withColumn("n", F.length("dataset").cast("bigint"))
    return rr(T.combine_results(v.spark, [a, b], meta), "value")


@query("a7_dedup_trace", "SELECT name, min(event_id) AS event_id FROM v_trace GROUP BY name")
def _(v):
    return T.dedup_trace(v.trace, "event_id").select("name", "event_id")


SETS = "SELECT library, set_name, concat('about ', set_name) AS description, sort_array(collect_list(gene)) AS genes FROM v_genesets GROUP BY library, set_name"


@query("a8_read_gmt", "SELECT set_name, concat('about ', set_name) AS description, gene FROM v_genesets")
def _(v):
    p = text(v.sql(SETS).select(line("set_name", "description", F.concat_ws("\t", "genes"))), scratch(v.spark, "gmt"))
    return X.read_gmt(v.spark, p, "lib").select("set_name", "description", F.explode("genes").alias("gene"))


@query("a9_write_gmt", "SELECT concat_ws(chr(9), set_name, concat('about ', set_name), string_agg(gene, chr(9) ORDER BY gene)) AS value FROM v_genesets GROUP BY library, set_name")
def _(v):
    p = scratch(v.spark, "gmt")
    X.write_gmt(v.sql(SETS), p)
    return v.spark.read.text(p)


def gtf_lines(v):
    t = v.tss.withColumn("end", F.col("tss") + 500).withColumn("feature", F.when(F.col("tss") % 3 == 0, "exon").otherwise("gene"))
    attr = F.when(F.col("tss") % 2 == 0, F.concat(F.lit('gene_id "I'), "gene", F.lit('"; gene_name "'), "gene", F.lit('";'))).otherwise(F.concat(F.lit('gene_id "'), "gene", F.lit('";')))
    rows = t.select(line("chrom", F.lit("src"), "feature", "tss", "end", F.lit("."), "strand", F.lit("."), attr))
    return rows.unionByName(t.select(F.lit("# comment").alias("value")).distinct())


@query("a10_read_gtf", """SELECT chrom, tss AS "start", tss + 500 AS "end", strand, gene, CASE WHEN strand = '+' THEN tss ELSE tss + 500 END AS tss FROM v_tss WHERE tss % 3 <> 0""")
def _(v):
    return X.read_gtf(v.spark, text(gtf_lines(v), scratch(v.spark, "gtf")))


@query("a11_add_interval", """WITH l AS (SELECT gene, max((chrom, tss, tss + 500)) AS l FROM v_tss WHERE tss % 3 <> 0 GROUP BY 1)
SELECT g.gene, CASE WHEN l.gene IS NOT NULL THEN concat(l.l[1], ':', CAST(l.l[2] AS VARCHAR), '-', CAST(l.l[3] AS VARCHAR)) END AS interval FROM (SELECT DISTINCT gene FROM v_gexp) g LEFT JOIN l USING (gene)""")
def _(v):
    g = X.read_gtf(v.spark, text(gtf_lines(v), scratch(v.spark, "gtf")))
    return X.add_interval(v.gexp.select("gene").distinct(), g)


@query("a12_read_peaks", """SELECT event_id, 'encoded' AS dialect, chrom, start AS "start", stop, replace(concat('TF ', tf), '%20', ' ') AS tf, score FROM v_peaks
UNION ALL SELECT event_id, 'dotted', chrom, start, stop, tf, score FROM v_peaks""".replace("replace(concat('TF ', tf), '%20', ' ')", "concat('TF', tf)"))
def _(v):
    tail = [F.lit("."), "start", "stop", "event_id"]
    a = v.peaks.select(line("chrom", "start", "stop", F.concat(F.lit("ID=x;Name=TF"), "tf", F.lit("%20(@%20cell)")), "score", *tail))
    b = v.peaks.select(line("chrom", "start", "stop", F.concat_ws(".", F.lit("EXP1"), "tf", "cell_type"), "score", *tail))
    out = [X.read_peaks(v.spark, text(d, scratch(v.spark, "bed")), k).select(F.col("rgb").cast("bigint").alias("event_id"), F.lit(k).alias("dialect"), "chrom", "start", "stop", "tf", "score")
           for d, k in ((a, "encoded"), (b, "dotted"))]
    return out[0].unionByName(out[1])


@query("a13_read_tfb", 'SELECT chrom, start AS "start", stop, tf, 1.0::DOUBLE AS score FROM v_peaks')
def _(v):
    return X.read_tfb(v.spark, text(v.peaks.select(line("chrom", "start", "stop", "tf", "cell_type")), scratch(v.spark, "bed")), "unibind")


@query("a14_read_tss", "SELECT 'bed' AS layout, chrom, strand, CASE WHEN strand = '+' THEN tss ELSE tss + 1 END AS tss, gene FROM v_tss UNION ALL SELECT 'refgene', chrom, strand, CASE WHEN strand = '+' THEN tss ELSE tss + 900 END, gene FROM v_tss")
def _(v):
    bed = v.tss.select(line("chrom", "tss", F.col("tss") + 1, "gene", F.lit("0"), "strand", F.lit("protein")))
    dots = [F.lit("x")] * 6
    ref = v.tss.select(line(F.lit("1"), F.lit("NM"), "chrom", "strand", "tss", F.col("tss") + 900, *dots, "gene"))
    a = X.read_tss(v.spark, text(bed, scratch(v.spark, "tss")), "bed").withColumn("layout", F.lit("bed"))
    return a.unionByName(X.read_tss(v.spark, text(ref, scratch(v.spark, "tss")), "refgene").withColumn("layout", F.lit("refgene")))


@query("a15_read_tf_list", "SELECT tf FROM v_tfs")
def _(v):
    return X.read_tf_list(v.spark, text(v.tfs.select(F.col("tf").alias("value")), scratch(v.spark, "tfs")))


@query("a16_read_ground_truth", "SELECT lower(model) AS gt, source, target FROM v_net")
def _(v):
    paths = {k: scratch(v.spark, "gt") for k in ("a", "n", "r", "empty", "gone")}
    for k, m in (("a", "A"), ("n", "N"), ("r", "R"), ("empty", "none")):
        v.net.where(F.col("model") == m).select("source", "target").write.csv(paths[k], header=True)
    return X.read_ground_truth(v.spark, paths)


@query("a17_consensus_json", "SELECT gene, n AS n, theta FROM (SELECT DISTINCT gene, unnest([0.25::DOUBLE, 0.75]) AS theta FROM v_counts) g JOIN (SELECT target, count(*) AS n FROM v_net GROUP BY 1) d ON d.target = g.gene")
def _(v):
    d = v.net.groupBy(F.col("target").alias("gene")).agg(F.count("*").alias("n"))
    c = d.withColumn("theta", F.explode(F.array(F.lit(0.25), F.lit(0.75))))
    p = scratch(v.spark, "consensus")
    T.write_consensus(c, p)
    return T.read_consensus(v.spark, p)


@query("a18_read_trace", "SELECT event_id, name, status, duration, source_file, file_date FROM v_trace WHERE event_id % 10 <> 0")
def _(v):
    p = scratch(v.spark, "trace")
    cols = ["event_id", "name", "status", "duration", "peak_rss", "cpu"]
    row = F.when(F.col("event_id") % 10 == 0, F.concat_ws("\t", *[F.col(c).cast("string") for c in cols[:3]])).otherwise(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]))
    t = v.trace.select(row.alias("value"), F.lit(1).alias("k"), F.col("source_file").alias("stem"))
    head = v.trace.select(F.lit("\t".join(cols)).alias("value"), F.lit(0).alias("k"), F.col("source_file").alias("stem")).distinct()
    # header first inside each file
    t.unionByName(head).repartition("stem").sortWithinPartitions("stem", "k").select("value", "stem").write.partitionBy("stem").text(p)
    return X.read_trace(v.spark, p).select(F.col("event_id").cast("bigint").alias("event_id"), "name", "status", "duration", "source_file", "file_date")


@query("a19_fragments", """SELECT cell_type AS donor_id, split_part(peak, ':', 1) AS chrom, CAST(split_part(split_part(peak, ':', 2), '-', 1) AS BIGINT) AS "start", CAST(split_part(peak, '-', 2) AS BIGINT) AS "end",
obs_id AS barcode, CAST(trunc(value) AS BIGINT) AS "count" FROM v_access JOIN v_aobs USING (obs_id)""")
def _(v):
    return X.to_fragments(v.access, v.aobs.withColumnRenamed("cell_type", "donor_id"))


@query("a20_parse_regulons", "SELECT concat(model, '|', source) AS source, target, r(weight) AS weight FROM v_net")
def _(v):
    pair = F.concat(F.lit("('"), "target", F.lit("', "), F.col("weight").cast("string"), F.lit(")"))
    t = v.net.withColumn("source", F.concat_ws("|", "model", "source")).groupBy("source").agg(F.concat(F.lit("["), F.array_join(F.collect_list(pair), ", "), F.lit("]")).alias("targets"))
    return rr(X.parse_regulons(t), "weight")


@query("a21_add_gene_id", "SELECT gene, max(p_partkey) AS gene_id FROM (SELECT concat(p_name, ' ', CAST(p_size AS VARCHAR)) AS gene, p_partkey FROM part) x GROUP BY gene HAVING count(*) = 1")
def _(v):
    p = v.table("part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("gene"), "p_partkey")
    return T.add_gene_id(p.select("gene").distinct(), p.select(F.col("gene").alias("gene_name"), F.col("p_partkey").alias("gene_id")))


@query("a22_groups", f"WITH {POBS} " + SPLIT.format(tf="false"))
def _(v):
    p = scratch(v.spark, "groups")
    T.write_groups(Z.split_perturbations(pobs(v), 0.5), p)
    return T.read_groups(v.spark, p).select("split", "perturbation")


@query("a23_region_sets", 'SELECT tf, chrom, start AS "start", stop FROM v_peaks')
def _(v):
    p = scratch(v.spark, "regions")
    X.write_regions(v.peaks, p, "tf")
    return v.spark.read.csv(p, sep="\t", schema="chrom string, start bigint, stop bigint, tf string")
