"""Streaming: score ingest, live leaderboard, windowed trace statistics."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom import schemas
from netloom.plans.leaderboard import overall_scores
from netloom.sources.tables import explode_scores

FEED = schemas.SCORE_FILE + ", ts timestamp"


def score_stream(spark: SparkSession, path, files_per_batch=None) -> DataFrame:
    """Score records arriving as JSON files, one row per metric."""
    r = spark.readStream.schema(FEED)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    raw = r.json(path)
    z = F.explode(F.arrays_zip("metric_ids", "metric_values"))
    return (raw.where(~F.coalesce(F.col("dataset_id").isin("missing", "None"), F.lit(True)))
            .select("ts", F.col("dataset_id").alias("dataset"), F.col("method_id").alias("model"), z.alias("z"))
            .select("ts", "dataset", "model", F.col("z.metric_ids").alias("metric"), F.col("z.metric_values").try_cast("double").alias("value"))
            .where("value is not null"))


def ingest(scores: DataFrame, delay="1 day") -> DataFrame:
    """Drop repeated (dataset, model, metric) records that arrive within the watermark delay."""
    return scores.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dataset", "model", "metric"])


def run_available(stream: DataFrame, path, mode="append", checkpoint=None):
    """Process what has arrived, then stop. Progress is kept beside the output, so the next call
    for the same ``path`` goes on where this one ended."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint or f"{path}-progress")
         .option("path", path).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def run_updates(stream: DataFrame, path, keys, checkpoint=None) -> DataFrame:
    """Process what has arrived in update mode and return the newest row of each key, open windows
    included. Every batch writes its own folder, so a repeated batch changes nothing."""
    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint or f"{path}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)


def live_leaderboard(stream: DataFrame, modalities: DataFrame, state, board, checkpoint):
    """Keep the newest score of each (dataset, model, metric) and re-rank after every batch.

    Each batch reads the version of the batch before and writes its own, so a repeated batch gives
    the same table. Three versions take turns, which is all that a repeat can need.
    """
    spark = stream.sparkSession
    modalities = modalities.select("dataset", "modality")

    def merge(batch, epoch):
        new = batch.select("ts", "dataset", "model", "metric", "value")
        if epoch > 0:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{state}/v{(epoch - 1) % 3}"))
        latest = (new.groupBy("dataset", "model", "metric").agg(F.max(F.struct("ts", "value")).alias("s"))
                  .select(F.col("s.ts").alias("ts"), "dataset", "model", "metric", F.col("s.value").alias("value")))
        latest.write.mode("overwrite").parquet(f"{state}/v{epoch % 3}")
        now = batch.sparkSession.read.parquet(f"{state}/v{epoch % 3}")
        overall_scores(now.drop("ts"), modalities).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{board}/v{epoch % 3}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    b = spark.read.parquet(f"{board}/v*")
    return b.where(F.col("epoch") == b.agg(F.max("epoch")).scalar())


def trace_windows(trace: DataFrame, width="1 hour", late="10 minutes") -> DataFrame:
    """Tasks, failures and mean value per tumbling window of completion time; works on a stream
    (late rows beyond the watermark are dropped) and on a table alike."""
    t = trace.withWatermark("ts", late) if trace.isStreaming else trace
    g = t.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count("*").alias("n_tasks"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n_tasks", "n_failed", "mean_value")
