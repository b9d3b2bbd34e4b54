from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.streaming import ledger


def test_stream_windows_equal_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    stream = ledger.read_stream(spark, f"{path}*", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    live = ledger.run_to_end(ledger.window_totals(stream, "ts", "value", ["event_type"]), "windows", "complete")
    batch = ledger.window_totals(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"])
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def test_review_fold_replays_requests_once(spark, tmp_path):
    rows = [("a", 1, "accept", "q1"), ("a", 2, "reject", "q2"), ("a", 2, "reject", "q2"), ("b", 3, "defer", "q3")]
    spark.createDataFrame(rows, "relation_id string, revision long, action string, request_id string").write.parquet(str(tmp_path / "in"))
    stream = ledger.read_stream(spark, str(tmp_path / "in"), "relation_id string, revision long, action string, request_id string")
    found = ledger.run_to_end(ledger.fold_reviews(stream), "folded", "update")
    assert sorted(map(tuple, found.collect())) == [("a", 2, "reject"), ("b", 3, "defer")]


def test_appended_rows_do_not_pass_through_memory(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    stream = ledger.read_stream(spark, f"{path}*", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    found = ledger.run_to_end(ledger.once(stream, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "appended")
    assert not spark.catalog.tableExists("appended")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, spark.read.parquet(path).select("user_id", "event_type").distinct().collect()))
    spark.createDataFrame([], "k long, at timestamp").write.parquet(str(tmp_path / "none"))
    assert ledger.run_to_end(ledger.once(ledger.read_stream(spark, str(tmp_path / "none"), "k long, at timestamp"), "at", ["k"]), "nothing").count() == 0
