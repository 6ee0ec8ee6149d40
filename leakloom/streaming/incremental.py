"""Incremental variants of scan, upsert and activity, with Structured Streaming.

All run with an available-now trigger by default: they take what is new and stop.
Sinks are written per batch id, so a replayed batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leakloom.catalog import BUILTIN_PATTERNS, Pattern
from leakloom.operators.detect import eligible_files, scan_secrets
from leakloom.operators.lifecycle import batch_arrivals, fold_arrivals, merge_arrivals
from leakloom.session import complete_folders, remove_folders
from leakloom.sources.files import stream_tree


def stream_scan(spark: SparkSession, root: str, target: str, checkpoint: str,
                patterns: Sequence[Pattern] = BUILTIN_PATTERNS, max_files: int | None = None) -> StreamingQuery:
    """Scan files that were added since the last run and append their hits."""
    files = eligible_files(stream_tree(spark, root, max_files))
    return (
        scan_secrets(files, patterns=patterns).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _complete(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the finished folders `prefix`N below `root`."""
    return sorted(int(name[len(prefix):]) for name in complete_folders(spark, root) if name.startswith(prefix))


SNAPSHOT, DELTA = "v=", "batch_id="


def _state(spark: SparkSession, root: str) -> tuple[int, list[int]]:
    """Newest snapshot version (-1 if none) and the batches that came after it."""
    version = max(_complete(spark, f"{root}/snapshots", SNAPSHOT), default=-1)
    return version, [n for n in _complete(spark, f"{root}/deltas", DELTA) if n > version]


def read_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Current findings: the newest snapshot with the later batches folded in."""
    version, batches = _state(spark, root)
    if version < 0:
        snapshot = spark.createDataFrame([], schema)
    else:
        snapshot = spark.read.schema(schema).parquet(f"{root}/snapshots/{SNAPSHOT}{version}")
    if not batches:
        return snapshot
    deltas = spark.read.option("basePath", f"{root}/deltas").parquet(*[f"{root}/deltas/{DELTA}{n}" for n in batches])
    return merge_arrivals(snapshot, fold_arrivals(deltas))


def compact(spark: SparkSession, root: str, schema: str) -> None:
    """Write the current findings as a new snapshot.

    What it was made from stays, for readers that began before; what the snapshot before
    that was made from goes, so the store holds two snapshots and the batches since the older one.
    """
    before, batches = _state(spark, root)
    if batches:
        read_snapshot(spark, root, schema).write.mode("overwrite").parquet(f"{root}/snapshots/{SNAPSHOT}{batches[-1]}")
        remove_folders(spark, [f"{root}/snapshots/{SNAPSHOT}{n}" for n in _complete(spark, f"{root}/snapshots", SNAPSHOT) if n < before]
                       + [f"{root}/deltas/{DELTA}{n}" for n in _complete(spark, f"{root}/deltas", DELTA) if n <= before])


def stream_upsert(findings: DataFrame, patterns: DataFrame, root: str, schema: str, checkpoint: str,
                  now: Column, compact_every: int = 20) -> StreamingQuery:
    """Merge a stream of hashed findings into the store below `root`.

    A batch only writes its own arrivals, folded per fingerprint, under its batch id.
    The full store is rewritten once per `compact_every` batches; in between readers
    fold the few open batches in. A replayed batch finds its folder complete and
    leaves it.
    """
    spark = findings.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        version, batches = _state(spark, root)
        if batch_id > version and batch_id not in batches:
            batch_arrivals(batch, patterns, now).write.mode("overwrite").parquet(f"{root}/deltas/{DELTA}{batch_id}")
            batches.append(batch_id)
        if len(batches) >= compact_every:
            compact(spark, root, schema)

    return (
        findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_daily_activity(events: DataFrame, target: str, checkpoint: str, late_by: str = "2 days",
                          time_column: str = "event_ts") -> StreamingQuery:
    """Events per calendar day and type. Days stay open for `late_by`; later events are dropped.

    The day itself is the event time: a time window would be cut at midnight UTC
    whatever the session's time zone is. Every batch writes the days it changed;
    `read_daily_activity` keeps the newest.
    """
    counts = (
        events.select(F.date_trunc("day", F.col(time_column).cast("timestamp")).alias("day_start"), "event_type")
        .withWatermark("day_start", late_by)
        .groupBy("day_start", "event_type").agg(F.count("*").alias("events"))
        .select(F.to_date("day_start").alias("event_day"), "event_type", "events")
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_daily_activity(spark: SparkSession, target: str) -> DataFrame:
    saved = spark.read.option("basePath", target).parquet(target)
    return saved.groupBy("event_day", "event_type").agg(F.max_by("events", "batch_id").alias("events"))
