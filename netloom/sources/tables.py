"""Parquet and JSON tables of the data model: expression, predictions, scores, splits."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom import schemas
from netloom.operators.edges import clean_edges


def write_expr(df: DataFrame, path):
    """Long expression table, one directory per layer so that reading one layer skips the rest."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)


def read_expr(spark: SparkSession, path, layer=None) -> DataFrame:
    df = schemas.require(spark.read.parquet(path), ["obs_id", "gene", "value", "layer"], "expression table")
    return df if layer is None else df.where(F.col("layer") == layer)


def write_prediction(edges: DataFrame, path, method, dataset):
    """Edges with text weights, tagged by method and data set."""
    cell_type = F.col("cell_type") if "cell_type" in edges.columns else F.lit(None).cast("string")
    out = edges.select(F.lit(dataset).alias("dataset_id"), F.lit(method).alias("method_id"), "source", "target",
                       F.col("weight").cast("string").alias("weight"), cell_type.alias("cell_type"))
    out.write.mode("append").partitionBy("dataset_id", "method_id").parquet(path)


def read_prediction(spark, path, n=50_000, tfs=None, method=None, group=None) -> DataFrame:
    """Stored edges through the standard cleaning."""
    df = schemas.require(spark.read.parquet(path), ["source", "target", "weight"], "prediction table")
    return clean_edges(df if method is None else df.where(F.col("method_id") == method), n, tfs, group)


def write_score(wide: DataFrame, path, metrics, by_file=False):
    """One record per (dataset, model) with parallel arrays of metric names and text values."""
    out = wide.select(F.col("dataset").alias("dataset_id"), F.col("model").alias("method_id"),
                      F.array(*[F.lit(m) for m in metrics]).alias("metric_ids"),
                      F.array(*[F.coalesce(F.col(m).cast("string"), F.lit("None")) for m in metrics]).alias("metric_values"))
    w = out.withColumn("stem", F.concat_ws("", "dataset_id", F.lit("__"), "method_id", F.lit("_score"))) if by_file else out
    (w.write.mode("overwrite").partitionBy("stem") if by_file else w.write.mode("overwrite")).json(path)


def explode_scores(raw: DataFrame) -> DataFrame:
    """Score records to (dataset, model, metric, value); missing records and texts that are not
    numbers fall out."""
    z = F.explode(F.arrays_zip("metric_ids", "metric_values"))
    return (raw.where(~F.coalesce(F.col("dataset_id").isin("missing", "None"), F.lit(True)))
            .select(F.col("dataset_id").alias("dataset"), F.col("method_id").alias("model"), z.alias("z"))
            .select("dataset", "model", F.col("z.metric_ids").alias("metric"), F.col("z.metric_values").try_cast("double").alias("value"))
            .where("value is not null"))


def read_scores(spark, path) -> DataFrame:
    return explode_scores(spark.read.schema(schemas.SCORE_FILE).json(path))


def collect_scores(spark, path, datasets: DataFrame) -> DataFrame:
    """Scores of many files; data set and method come from ``{dataset}__{method}_score`` in the
    file path, and only known data sets count."""
    raw = spark.read.schema(schemas.SCORE_FILE).json(path).withColumn("_f", F.col("_metadata.file_path"))
    name = r"([^/=]+?)__([^/]+)_score"
    # a path component written by a partitioned sink is escaped once more than a plain file name
    raw = raw.withColumn("_f", F.when(F.col("_f").contains("="), F.url_decode(F.url_decode("_f"))).otherwise(F.url_decode("_f")))
    raw = raw.withColumn("dataset_id", F.regexp_extract("_f", name, 1)).withColumn("method_id", F.regexp_extract("_f", name, 2))
    return explode_scores(raw).join(datasets.select("dataset"), "dataset", "left_semi")


def combine_results(spark, paths, metadata=None):
    """Scores of several folders in one table, missing entries dropped, with the data-set
    metadata joined when given. Where folders disagree the value is their mean."""
    out = read_scores(spark, list(paths)).groupBy("dataset", "model", "metric").agg(F.avg("value").alias("value"))
    return out if metadata is None else out.join(metadata, "dataset", "left")


def dedup_trace(trace, order):
    """One row per task name: the first by ``order``."""
    first = trace.groupBy("name").agg(F.min(order).alias(order))
    return trace.join(first, ["name", order], "left_semi")


def write_groups(groups, path):
    groups.write.mode("overwrite").partitionBy("split").parquet(path)


def read_groups(spark, path, split=None):
    g = spark.read.parquet(path)
    return g if split is None else g.where(F.col("split") == split)


def write_consensus(consensus, path):
    """``{gene: {theta: n}}``, one gene per line."""
    inner = F.map_from_entries(F.collect_list(F.struct(F.col("theta").cast("string"), F.col("n"))))
    doc = consensus.groupBy("gene").agg(inner.alias("m"))
    doc.select(F.to_json(F.create_map("gene", "m")).alias("value")).write.mode("overwrite").text(path)


def read_consensus(spark, path):
    t = spark.read.text(path).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
    t = t.select(F.explode("m").alias("gene", "inner")).select("gene", F.explode("inner").alias("theta", "n"))
    return t.select("gene", F.col("theta").cast("double").alias("theta"), F.col("n").cast("bigint").alias("n"))


def add_gene_id(genes, info, name="gene_name", ident="gene_id"):
    """Join gene ids by name; names with several ids and genes without one fall out."""
    unique = info.groupBy(name).agg(F.count("*").alias("_n"), F.first(ident).alias(ident)).where("_n = 1").drop("_n")
    return genes.join(unique.withColumnRenamed(name, "gene"), "gene")
