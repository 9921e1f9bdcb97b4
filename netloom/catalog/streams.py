"""S: streaming operators, run to completion over what the tables hold."""

from pyspark.sql import functions as F

from netloom.catalog import query
from netloom.catalog.aggregates import rr
from netloom.catalog.composites import K15, modalities
from netloom.catalog.sources import METRICS, sheet
from netloom.session import scratch
from netloom.streaming import live


def feed(v, copies):
    """Score records as arriving JSON files, each record several times with growing times."""
    p = scratch(v.spark, "feed")
    out = sheet(v).select(F.col("dataset").alias("dataset_id"), F.col("model").alias("method_id"), F.array(*[F.lit(m) for m in METRICS]).alias("metric_ids"),
                          F.array(*[F.coalesce(F.col(m).cast("string"), F.lit("None")) for m in METRICS]).alias("metric_values"))
    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    out.withColumn("i", n).withColumn("ts", F.timestamp_add("minute", F.col("i"), F.lit("2024-01-01 00:00:00").cast("timestamp"))).drop("i").write.json(p)
    return p


@query("s1_score_ingest", "SELECT dataset, model, metric, r(value) AS value FROM v_scores WHERE value IS NOT NULL")
def _(v):
    s = live.ingest(live.score_stream(v.spark, feed(v, 3))).select("dataset", "model", "metric", "value")
    p = live.run_available(s, scratch(v.spark, "ingest"))
    return rr(v.spark.read.parquet(p), "value")


@query("s2_live_leaderboard", f"WITH {K15} SELECT model, kind, name, r(score) AS score FROM board")
def _(v):
    s = live.score_stream(v.spark, feed(v, 2))
    b = live.live_leaderboard(s, modalities(v), scratch(v.spark, "state"), scratch(v.spark, "board"), scratch(v.spark, "ck"))
    return rr(b.select("model", "kind", "name", "score"), "score")


def events(v):
    return v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_tasks, count(*) FILTER (event_type = 'error') AS n_failed, r(avg(value)) AS mean_value FROM events GROUP BY ALL"


@query("s3_trace_windows", WINDOWS)
def _(v):
    d = live.trace_windows(events(v))
    return rr(d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "mean_value")


@query("s3_trace_stream", WINDOWS)
def _(v):
    p = scratch(v.spark, "events")
    events(v).write.parquet(p)
    s = v.spark.readStream.schema("ts timestamp, event_type string, value double").parquet(p)
    d = live.run_updates(live.trace_windows(s), scratch(v.spark, "windows"), ["window_start", "event_type"])
    return rr(d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "mean_value")
