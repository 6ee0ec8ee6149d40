"""Registered streaming queries: each runs its stream to the end and returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.operators import lifecycle as life
from leakloom.plans import fixtures as fx
from leakloom.plans.detection import HITS_SQL
from leakloom.plans.lifecycle import HASHED_SQL, SUPPRESSED_SQL
from leakloom.plans.registry import query
from leakloom.schemas import TABLES
from leakloom.session import work_dir
from leakloom.sources import files as source
from leakloom.streaming import incremental

STREAM_NOW = "2024-03-01 00:00:00"


def _written(df, spark, purpose, files):
    """Rows written to the shared folder as a few files, to be streamed from there."""
    path = work_dir(spark, purpose)
    df.repartition(files).write.parquet(path)
    return path


@query("stream_scan", f"""
WITH every AS (SELECT * FROM code_files), {HITS_SQL.replace('FROM code_files', 'FROM every')}
SELECT app_name, pattern_name, left(sha256(secret), 16) AS secret_hash, count(*) AS findings FROM found GROUP BY ALL""", ["code_files"])
def stream_scan(spark, sf_dir):
    """Files written as a tree, scanned by a stream in two runs: the second only sees what was added."""
    root, target, checkpoint = (work_dir(spark, p) for p in ("tree", "hits", "checkpoint"))
    rows = fx.code_files(spark, sf_dir).where(
        "length <= 10485760 AND path NOT LIKE 'node_modules/%' AND lower(path) RLIKE '[.](py|js|java|json|md)$'")
    for early in (True, False):
        (rows.where((F.col("file_id") % 2 == 0) == F.lit(early)).select(F.col("app_name").alias("dir"), "text")
         .write.mode("append").option("maxRecordsPerFile", 50).partitionBy("dir").text(root))
        incremental.stream_scan(spark, root, target, checkpoint).awaitTermination()
    found = spark.read.parquet(target).withColumn("app_name", F.regexp_replace("app_name", "^dir=", ""))
    return found.groupBy("app_name", "pattern_name", "secret_hash").agg(F.count("*").alias("findings"))


@query("stream_upsert", f"""
WITH {HASHED_SQL}, f AS (SELECT f.*, {SUPPRESSED_SQL} AS suppressed FROM h f),
  k AS (SELECT app_name, finding_hash, min(id) FILTER (WHERE NOT suppressed) AS first_ok FROM f GROUP BY ALL)
SELECT app_name, finding_hash, count(*) AS occurrence_count FROM f JOIN k USING (app_name, finding_hash)
WHERE id >= first_ok GROUP BY ALL""", ["findings", "false_positive_patterns"])
def stream_upsert(spark, sf_dir):
    """All findings, suppressed ones too, streamed into a snapshot in several batches in order of id."""
    hashed = life.with_hash(fx.view(spark, sf_dir, "findings"))
    patterns = fx.view(spark, sf_dir, "false_positive_patterns")
    path, parts = work_dir(spark, "findings-in"), 3
    low, high = hashed.agg(F.min("id"), F.max("id")).first()
    part = F.floor((F.col("id") - low) * parts / (high - low + 1))
    root, checkpoint = work_dir(spark, "snapshots"), work_dir(spark, "checkpoint")
    now = F.expr(f"TIMESTAMP_NTZ '{STREAM_NOW}'")
    for n in range(parts):  # a run takes all that was added since the last one as one batch, in as many files as tasks wrote
        hashed.where(part == n).write.mode("append").parquet(path)
        stream = spark.readStream.schema(hashed.schema).parquet(path)
        incremental.stream_upsert(stream, patterns, root, TABLES["findings"], checkpoint, now, compact_every=2).awaitTermination()
    return incremental.read_snapshot(spark, root, TABLES["findings"]).select("app_name", "finding_hash", "occurrence_count")


@query("stream_daily_activity", """
SELECT strftime(event_ts, '%Y-%m-%d') AS event_day, event_type, count(*) AS events FROM finding_history GROUP BY ALL""", ["finding_history"])
def stream_daily_activity(spark, sf_dir):
    """Daily counts of the event history from several small batches in any order."""
    events = fx.view(spark, sf_dir, "finding_history")
    path = _written(events, spark, "events-in", 4)
    target, checkpoint = work_dir(spark, "activity"), work_dir(spark, "checkpoint")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    incremental.stream_daily_activity(stream, target, checkpoint, late_by="60 days").awaitTermination()
    found = incremental.read_daily_activity(spark, target)
    return found.withColumn("event_day", F.date_format("event_day", "yyyy-MM-dd"))
