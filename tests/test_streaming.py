"""Restarts, open windows and bounded state of the streaming operators."""

import json
import os

from pyspark.sql import functions as F

from netloom.streaming import live


def feed(folder, n, first, day):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/f{first}.json", "w") as f:
        for k in range(first, first + n):
            f.write(json.dumps({"dataset_id": "d", "method_id": f"m{k}", "metric_ids": ["x"], "metric_values": [str(k)], "ts": f"2024-01-{day:02d}T00:00:00"}) + "\n")


def test_a_restart_reads_nothing_twice(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for k in range(3):
        feed(src, 2, 2 * k, k + 1)
        live.run_available(live.score_stream(spark, src).select("model", "value"), out)
        assert spark.read.parquet(out).count() == 2 * (k + 1)


def test_open_windows_are_part_of_the_result_and_go_on_after_a_restart(spark, tmp_path):
    src, out = str(tmp_path / "ev"), str(tmp_path / "win")
    for k in range(3):
        (spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "error" if h == k else "ok", float(h)) for h in range(k + 1)], "ts string, event_type string, value double")
         .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src))
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)
        got = live.run_updates(live.trace_windows(stream, late="1 day"), out, ["window_start", "event_type"])
        want = live.trace_windows(spark.read.parquet(src))
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(got) == key(want.select(got.columns))


def test_leaderboard_state_stays_at_three_versions(spark, tmp_path):
    src, state = str(tmp_path / "s"), str(tmp_path / "state")
    for k in range(6):
        feed(src, 1, k, k + 1)
    board = live.live_leaderboard(live.score_stream(spark, src, files_per_batch=1), spark.createDataFrame([("d", "rna")], "dataset string, modality string"),
                                  state, str(tmp_path / "b"), str(tmp_path / "ck"))
    assert board.select("model").distinct().count() == 6 and len([x for x in os.listdir(state) if x.startswith("v")]) == 3
