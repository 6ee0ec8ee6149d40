"""Session construction and the shared working folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "leakloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Checkpoints whose frames are gone leave the shared folder.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Split hot keys even where that costs another shuffle after the join.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture per Column call costs more than planning for wide expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's own setting wins.

    Only a local session (tests) may fall back to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="leakloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused folder path below the shared root (not yet created)."""
    return f"{_shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def complete_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders below `root` that a job has written to the end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    statuses = [s for s in system.listStatus(path) if s.isDirectory()]
    return sorted(s.getPath().getName() for s in statuses
                  if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders this library has written and nobody reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage so that recomputation cannot change it."""
    _shared_root(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """`df` as files in the shared folder for as long as the block lasts; column-wise and compressed, unlike a checkpoint."""
    path = work_dir(df.sparkSession, "staged")
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove_folders(df.sparkSession, [path])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-bound stages at least one task per core, by `keys` if there are any.

    Only for plans that are a bare scan: there the partition count is known
    without running anything. A scan of many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
