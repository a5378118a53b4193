"""Findings by state: three batches with a restart give what the batch operators give, timers drop what is gone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators.findings import mark_new
from evigraph.streaming import incremental as module
from evigraph.streaming.incremental import incremental, run_incremental

SCHEMA = "seq long, fp string, ts timestamp"


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, rows):
    spark.createDataFrame(rows, "seq long, fp string, ts string").select("seq", "fp", F.to_timestamp("ts").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))


def test_three_batches_and_a_restart_equal_the_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, draw.choice(["hot"] * 4 + list("abcdef") + [None]), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(900)]
    known = spark.createDataFrame([("hot", 150), ("a", 3), ("never", 2)], "fp string, known long")
    baseline = known.withColumn("since", F.to_timestamp(F.lit("2024-01-01")))
    put(spark, tmp_path / "in", rows[:300])
    put(spark, tmp_path / "in", rows[300:600])
    run = lambda: run_incremental(incremental(stream(spark, tmp_path / "in"), baseline), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600
    put(spark, tmp_path / "in", rows[600:])
    run()
    run()  # nothing is there, nothing is added
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.seq for r in got) == list(range(900)) and {r.kind for r in got} == {"found"}
    counts, batch = {}, []
    for i, fp, _ in rows:
        batch.append((i, fp, counts.get(fp, 0)))
        counts[fp] = counts.get(fp, 0) + 1
    marked = mark_new(spark.createDataFrame(batch, "seq long, fp string, occurrence long"), known).collect()
    key = lambda rs: sorted((r.fp or "", r.occurrence, r.is_new) for r in rs)
    assert key(got) == key(marked)
    # numbers of a later batch follow those of all earlier ones
    for i in range(0, 900, 300):
        part = [r for r in got if i <= r.seq < i + 300 and r.fp == "hot"]
        first = sum(fp == "hot" for _, fp, _ in rows[:i])
        assert sorted(r.occurrence for r in part) == list(range(first, first + len(part)))


@pytest.fixture(params=["UTC", "Asia/Tokyo"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_is_gone_is_reported_once_and_is_new_when_back(spark, tmp_path, zone):
    baseline = spark.createDataFrame([("old", 5, "2024-01-01"), ("seen", 9, "2024-01-01")], "fp string, known long, since string").withColumn("since", F.to_timestamp("since"))
    put(spark, tmp_path / "in", [(1, "seen", "2024-01-03 00:00:00"), (2, "seen", "2024-01-04 00:00:00"), (3, "stay", "2024-01-03 00:00:00")])
    run = lambda: run_incremental(incremental(stream(spark, tmp_path / "in"), baseline, ttl_days=10), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    put(spark, tmp_path / "in", [(4, "stay", "2024-01-12 00:00:00"), (5, "far", "2024-01-20 00:00:00")])
    run()
    found = spark.read.parquet(str(tmp_path / "out")).where("kind = 'gone'").withColumn("day", F.col("ts").cast("string"))
    gone = {r.fp: (r.occurrence, r.day[:10], r.seq) for r in found.collect()}
    assert gone == {"old": (0, "2024-01-01", None), "seen": (2, "2024-01-04", None)}
    put(spark, tmp_path / "in", [(6, "seen", "2024-01-20 01:00:00"), (7, "stay", "2024-01-20 01:00:00"), (8, "late", "2024-01-05 00:00:00")])
    run()
    rows = {r.seq: (r.occurrence, r.is_new) for r in spark.read.parquet(str(tmp_path / "out")).where("seq > 5").collect()}
    assert rows == {6: (0, True), 7: (2, True)}


def test_an_empty_stream(spark, tmp_path):
    put(spark, tmp_path / "in", [])
    baseline = spark.createDataFrame([], "fp string, known long, since timestamp")
    run_incremental(incremental(stream(spark, tmp_path / "in"), baseline), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.schema("seq long").parquet(str(tmp_path / "out")).count() == 0


def test_fingerprints_of_one_bucket_go_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "BUCKETS", 1)
    baseline = spark.createDataFrame([("a", 1, "2024-01-01"), (None, 2, "2024-01-02"), ("b", 1, "2024-01-03")], "fp string, known long, since string").withColumn("since", F.to_timestamp("since"))
    run = lambda: run_incremental(incremental(stream(spark, tmp_path / "in"), baseline, ttl_days=10), str(tmp_path / "out"), str(tmp_path / "ck"))
    put(spark, tmp_path / "in", [(1, "b", "2024-01-04 00:00:00"), (2, "c", "2024-01-05 00:00:00"), (3, "b", "2024-01-04 00:00:00"), (4, None, "2024-01-05 00:00:00"), (5, "d", "2024-01-12 02:00:00")])
    run()
    gone = lambda: {(r.fp, r.occurrence) for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'gone'").collect()}
    assert gone() == {("a", 0)}
    found = {r.seq: (r.occurrence, r.is_new) for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'found'").collect()}
    assert sorted([found.pop(1), found.pop(3)]) == [(0, False), (1, True)] and found == {2: (0, True), 4: (0, False), 5: (0, True)}
    put(spark, tmp_path / "in", [(6, "a", "2024-01-14 02:00:00")])
    run()
    assert gone() == {("a", 0), ("b", 2)}
    put(spark, tmp_path / "in", [(7, "d", "2024-01-16 00:00:00")])
    run()
    assert gone() == {("a", 0), ("b", 2), ("c", 1), (None, 1)}
    put(spark, tmp_path / "in", [(8, "d", "2024-01-16 00:00:00"), (9, "b", "2024-01-16 00:00:00"), (10, "a", "2024-01-16 00:00:00")])
    run()
    assert {r.seq: (r.occurrence, r.is_new) for r in spark.read.parquet(str(tmp_path / "out")).where("seq > 6").collect()} == {7: (1, True), 8: (2, True), 9: (0, True), 10: (1, True)}
