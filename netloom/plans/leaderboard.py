"""Applicability of metrics, rankings and the overall leaderboard, on long score tables."""

from pyspark.sql import DataFrame, Window as W, functions as F

from netloom.functions.text import gigabytes, hours, percent
from netloom.plans.config import DEFAULT_FLOOR, METRIC_FLOORS


def _floor(metric="metric"):
    pairs = [x for k, v in METRIC_FLOORS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(metric)), F.lit(DEFAULT_FLOOR))


def minmax(df, value, by, clip=True, out=None):
    """Min-max within a partition: negatives count as 0, a constant column becomes 0, nulls stay."""
    v = F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.col(value))) if clip else F.col(value)
    d = df.withColumn("_v", v)
    lim = d.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    d = d.join(lim, by)
    n = F.when(F.col("_v").isNull(), None).when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return d.withColumn(out or value, n).drop("_v", "_lo", "_hi")


def _rescale(df, value):
    """Min-max over the whole (model-sized) table; a constant stays as it is."""
    lim = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    d = df.withColumn("_l", lim)
    return d.withColumn(value, F.when(F.col("_l.hi") > F.col("_l.lo"), (F.col(value) - F.col("_l.lo")) / (F.col("_l.hi") - F.col("_l.lo"))).otherwise(F.col(value))).drop("_l")


def pct_ranks(scores, by=("dataset", "metric")):
    """Percentile rank of each model per dataset and metric, ties averaged. The partitions hold
    one row per model."""
    w = W.partitionBy(*by).orderBy("value")
    ties = F.count("*").over(W.partitionBy(*by, "value"))
    n = F.count("*").over(W.partitionBy(*by))
    return scores.where(F.col("value").isNotNull()).withColumn("rank", (F.rank().over(w) + (ties - 1) / 2.0) / n)


def mean_rank(scores):
    """Average place over metrics, best value first, ties at their best place."""
    w = W.partitionBy("dataset", "metric").orderBy(F.col("value").desc())
    r = scores.where(F.col("value").isNotNull()).withColumn("place", F.rank().over(w))
    return r.groupBy("dataset", "model").agg(F.avg("place").alias("mean_rank"))


def applicability(scores: DataFrame, min_spread=0.2, negative="negative_control", positive="positive_control") -> DataFrame:
    """Whether a metric tells methods apart on a dataset, and why not: spread (range over mean),
    best value against floor and negative control, positive above negative control."""
    g = scores.groupBy("dataset", "metric").agg(
        F.count("value").alias("n_methods"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.max(F.when(F.col("model") == negative, F.col("value"))).alias("nc"),
        F.max(F.when(F.col("model") == positive, F.col("value"))).alias("pc"))
    g = g.withColumn("floor", _floor()).withColumn("threshold", F.greatest("floor", F.coalesce("nc", "floor")))
    g = g.withColumn("range_over_mean", F.try_divide(F.col("max") - F.col("min"), F.nullif("mean", F.lit(0.0))))
    g = g.withColumn("present", F.col("n_methods") > 0)
    spread = F.coalesce(F.col("range_over_mean") >= min_spread, F.lit(True))
    high = F.col("max") >= F.col("threshold")
    controls = F.coalesce(F.col("pc") > F.col("nc"), F.lit(True))
    enough = F.col("n_methods") >= 2
    why = F.concat_ws(
        "; ", F.when(~spread, F.format_string(f"Low variability (CV=%.3f < {min_spread})", F.col("range_over_mean"))),
        F.when(~high, F.format_string("Low max score (max=%.3f < threshold=%.3f)", F.col("max"), F.col("threshold"))),
        F.when(~controls, F.format_string("PC not > NC (PC=%.4f, NC=%.4f)", F.col("pc"), F.col("nc"))))
    keep = F.coalesce(enough & spread & high & controls, F.lit(False))
    reason = (F.when(~F.col("present"), "Metric not computed for this dataset").when(~enough, "Insufficient data points (<2 methods)")
              .when(keep, "Passes all criteria").otherwise(why))
    return g.withColumn("keep", keep).withColumn("reason", reason)


def metric_summary(app: DataFrame) -> DataFrame:
    """Kept / present datasets per metric with ranges of best value and spread."""
    p = app.where("present")
    return p.groupBy("metric").agg(
        F.count_if("keep").alias("n_keep"), F.count("*").alias("n_datasets"),
        F.concat_ws("/", F.count_if("keep"), F.count("*")).alias("keep_total"), (100 * F.count_if("keep") / F.count("*")).alias("keep_pct"),
        F.min("max").alias("max_lo"), F.max("max").alias("max_hi"), F.min("range_over_mean").alias("spread_lo"),
        F.max("range_over_mean").alias("spread_hi"), F.first("floor").alias("floor"), F.min("nc").alias("nc_lo"), F.max("nc").alias("nc_hi"),
        F.array_sort(F.collect_set(F.when(F.col("keep"), F.col("dataset")))).alias("datasets"))


def median_ranks(scores, keys=("modality",)):
    """Median percentile rank of each model over its (dataset, metric) pairs, per key."""
    return pct_ranks(scores).groupBy(*keys, "model").agg(F.median("rank").alias("rank"))


def overall_scores(scores: DataFrame, modalities: DataFrame, metrics=None) -> DataFrame:
    """Leaderboard in long form (model, kind, name, score): one row per metric, per dataset, and
    the overall score, which weighs modalities equally. ``modalities`` is (dataset, modality)."""
    n = minmax(scores, "value", ["dataset", "metric"])
    m = minmax(n.groupBy("model", "metric").agg(F.avg("value").alias("score")), "score", ["metric"])
    d = minmax(n.groupBy("model", "dataset").agg(F.avg("value").alias("score")), "score", ["dataset"])
    ranked = scores if metrics is None else scores.join(metrics.select("metric"), "metric", "left_semi")
    r = median_ranks(ranked.join(modalities, "dataset")).groupBy("model").agg(F.avg("rank").alias("score"))
    r = _rescale(r, "score")
    out = m.select("model", F.lit("metric").alias("kind"), F.col("metric").alias("name"), "score")
    out = out.unionByName(d.select("model", F.lit("dataset").alias("kind"), F.col("dataset").alias("name"), "score"))
    return out.unionByName(r.select("model", F.lit("overall").alias("kind"), F.lit("overall_score").alias("name"), "score")).where("score is not null")


def rankings(scores, modalities, metrics=None):
    """Rescaled median ranks per modality, overall and per metric: (board, model, score, place)."""
    s = scores if metrics is None else scores.join(metrics.select("metric"), "metric", "left_semi")
    s = s.join(modalities, "dataset")
    per_mod = median_ranks(s)
    mod = minmax(per_mod, "rank", ["modality"], clip=False).select(F.col("modality").alias("board"), "model", "rank")
    overall = minmax(mod.groupBy("model").agg(F.avg("rank").alias("rank")).withColumn("board", F.lit("Overall")), "rank", ["board"], clip=False)
    met = minmax(median_ranks(s, ("metric",)), "rank", ["metric"], clip=False).select(F.col("metric").alias("board"), "model", "rank")
    out = mod.unionByName(overall.select("board", "model", "rank")).unionByName(met)
    return out.withColumn("place", F.row_number().over(W.partitionBy("board").orderBy(F.col("rank").desc(), "model")))


def wide(scores, index, column, value, names):
    """Long to wide with a known column list."""
    return scores.groupBy(*index).pivot(column, list(names)).agg(F.avg(value))


def resource_summary(trace):
    """Hours, memory and CPU of each method (largest of repeated tasks) with log-scaled inverse
    scores."""
    g = trace.select("method", hours("duration").alias("h"), gigabytes("peak_rss").alias("m"), percent("cpu").alias("c")).groupBy("method").agg(
        F.max("h").alias("hours"), F.max("m").alias("memory_gb"), F.max("c").alias("cpu"))
    top = g.agg(F.struct(F.max(F.log1p("hours")).alias("h"), F.max(F.log1p("memory_gb")).alias("m"))).scalar()
    return (g.withColumn("_t", top).withColumn("hours_log", F.col("_t.h") - F.log1p("hours"))
            .withColumn("memory_log", F.col("_t.m") - F.log1p("memory_gb")).drop("_t"))


def overview(scores, modalities, resources, friendliness, metric_names, dataset_names, metrics=None):
    """One row per model: all scores, resources and complexity; missing values are 0."""
    o = overall_scores(scores, modalities, metrics)
    w = wide(o, ["model"], "name", "score", [*metric_names, *dataset_names, "overall_score"])
    c = friendliness.withColumn("complexity", friendliness.agg(F.max("friendly")).scalar() - F.col("friendly"))
    c = c.withColumn("complexity_log", c.agg(F.max(F.log1p("complexity"))).scalar() - F.log1p("complexity"))
    out = w.join(resources.withColumnRenamed("method", "model"), "model", "left").join(c, "model", "left")
    return out.fillna(0)


def applicability_matrix(declared, app, datasets):
    """Metric x dataset cells: 2 kept, 1 declared only, 0 neither."""
    d = declared.select("metric", "dataset").distinct().withColumn("_d", F.lit(1))
    k = app.where("keep").select("metric", "dataset").withColumn("_k", F.lit(1))
    cell = d.join(k, ["metric", "dataset"], "full").withColumn("state", F.when(F.col("_k") == 1, 2).when(F.col("_d") == 1, 1).otherwise(0))
    return cell.groupBy("metric").pivot("dataset", list(datasets)).agg(F.max("state")).fillna(0)
