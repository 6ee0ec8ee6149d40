import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakloom.operators import lifecycle as life
from leakloom.schemas import TABLES, conform
from leakloom.streaming import incremental

def now():
    return F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")
SECRET = "ghp_" + "a" * 36


def test_only_new_files_are_scanned(spark, tmp_path):
    root, target, checkpoint = (tmp_path / n for n in ("tree", "hits", "cp"))
    (root / "app").mkdir(parents=True)

    def run():
        incremental.stream_scan(spark, str(root), str(target), str(checkpoint)).awaitTermination()
        return sorted(r.path for r in spark.read.parquet(str(target)).collect())

    (root / "app" / "a.py").write_text(SECRET)
    assert run() == ["a.py"]
    (root / "app" / "b.py").write_text(f"{SECRET} {SECRET}")
    (root / "app" / "node_modules").mkdir()
    (root / "app" / "node_modules" / "c.js").write_text(SECRET)
    assert run() == ["a.py", "b.py", "b.py"]
    assert run() == ["a.py", "b.py", "b.py"]


def rows(spark, *items):
    data = [(i, 1, "a", "secret", "/p", 1, None, "c", t, "snip", "high") for i, t in items]
    return life.with_hash(spark.createDataFrame(
        data, "id long, scan_id long, app_name string, finding_type string, file_path string, line_number long, "
              "cve_id string, component string, title string, code_snippet string, severity string"))


@pytest.mark.parametrize("compact_every", [1, 2, 20])
def test_upsert_stream_is_idempotent(spark, tmp_path, compact_every):
    source, root = str(tmp_path / "in"), str(tmp_path / "store")
    patterns = spark.createDataFrame([], "app_name string, pattern_type string, pattern_value string")

    def add(*items):
        rows(spark, *items).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.stream_upsert(stream, patterns, root, TABLES["findings"], str(tmp_path / checkpoint), now(), compact_every).awaitTermination()
        return {r.title: r.occurrence_count for r in incremental.read_snapshot(spark, root, TABLES["findings"]).collect()}

    add((1, "x"), (2, "x"), (3, "y"))
    assert run("cp") == {"x": 2, "y": 1}
    add((4, "x"), (5, "z"))
    assert run("cp") == {"x": 3, "y": 1, "z": 1}
    add((6, "y"))
    assert run("cp") == {"x": 3, "y": 2, "z": 1}
    assert run("cp") == {"x": 3, "y": 2, "z": 1}
    assert run("lost checkpoint") == {"x": 3, "y": 2, "z": 1}
    incremental.compact(spark, root, TABLES["findings"])
    assert run("cp") == {"x": 3, "y": 2, "z": 1}
    if compact_every == 1:  # two snapshots, and the batch between them
        assert sorted(os.listdir(f"{root}/snapshots")) == ["v=1", "v=2"] and os.listdir(f"{root}/deltas") == ["batch_id=2"]


def test_folded_batches_equal_one_after_the_other(spark):
    """Arrivals of three batches folded together against three single upserts."""
    patterns = spark.createDataFrame([("a", "code_pattern", "bad")], "app_name string, pattern_type string, pattern_value string")
    plan = [[(1, "x", "bad"), (2, "y", "ok"), (3, "k", "ok"), (4, "f", "ok")],
            [(5, "x", "bad"), (6, "x", "ok"), (7, "x", "bad"), (8, "y", "bad"), (9, "f", "ok")],
            [(10, "x", "bad"), (11, "w", "bad"), (12, "k", "ok")]]
    days = [F.lit(dt.datetime(2024, 5, n + 1)).cast("timestamp_ntz") for n in range(3)]
    known = rows(spark, (100, "k"), (101, "f")).withColumn("is_false_positive", F.col("title") == "f")
    snapshot = conform(known, "findings")

    def batch(items):
        frame = spark.createDataFrame([(i, s) for i, _, s in items], "id long, code_snippet string")
        return rows(spark, *[(i, t) for i, t, _ in items]).drop("code_snippet").join(frame, "id")

    one_by_one, deltas = snapshot, None
    for n, items in enumerate(plan):
        one_by_one = life.upsert_findings(one_by_one, batch(items), patterns, days[n])
        delta = life.batch_arrivals(batch(items), patterns, days[n]).withColumn("batch_id", F.lit(n))
        deltas = delta if deltas is None else deltas.unionByName(delta)
    together = life.merge_arrivals(snapshot, life.fold_arrivals(deltas))
    picked = ["id", "title", "occurrence_count", "first_detected", "last_seen", "is_false_positive", "status"]
    assert sorted(map(tuple, together.select(picked).collect())) == sorted(map(tuple, one_by_one.select(picked).collect()))
    assert {r.title: r.occurrence_count for r in together.collect()} == {"x": 3, "y": 2, "k": 3, "f": 1}


def test_incomplete_version_is_ignored(spark, tmp_path):
    (tmp_path / "store" / "snapshots" / "v=3").mkdir(parents=True)
    (tmp_path / "store" / "deltas" / "batch_id=4").mkdir(parents=True)
    assert incremental.read_snapshot(spark, str(tmp_path / "store"), TABLES["findings"]).count() == 0


def test_daily_activity_with_late_data(spark, tmp_path):
    source = tmp_path / "in"
    schema = "event_ts timestamp_ntz, event_type string"

    def add(*days):
        frame = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), "x") for d in days], schema)
        frame.coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        incremental.stream_daily_activity(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late_by="2 days").awaitTermination()
        found = incremental.read_daily_activity(spark, str(tmp_path / "out"))
        return {r.event_day.day: r.events for r in found.collect()}

    add(10, 10, 11)
    assert run() == {10: 2, 11: 1}
    add(10, 20)
    assert run() == {10: 3, 11: 1, 20: 1}
    add(11, 19)  # the 11th is closed by now, the 19th is not
    assert run() == {10: 3, 11: 1, 20: 1, 19: 1}


def test_the_upsert_streams_in_batches_of_many_files(spark, monkeypatch):
    from leakloom.plans import streams

    made, fresh = {}, streams.work_dir
    monkeypatch.setattr(streams, "work_dir", lambda spark, purpose: made.setdefault(purpose, fresh(spark, purpose)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert streams.stream_upsert(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p for p in Path(made["findings-in"].removeprefix("file:")).iterdir() if p.suffix == ".parquet"]
    batches = [p for p in (Path(made["checkpoint"].removeprefix("file:")) / "commits").iterdir() if p.name.isdigit()]
    assert len(batches) == 3 and len(files) > 6
