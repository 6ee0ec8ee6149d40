"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

import leakloom
from leakloom.session import work_dir

#: The six white-space characters of the contracts, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: Rows of a side that may be broadcast: a few words each, so some ten megabytes.
BROADCAST_ROWS = 500_000
#: What a worker process keeps for later tasks, and what it was made from.
_KEPT: list = []
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, also where they were not started with it on their path."""
    context = spark.sparkContext
    if getattr(context, "_leakloom_shipped", False):
        return
    package = Path(leakloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="leakloom-")) / "leakloom.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._leakloom_shipped = True


def kept(make: Callable, *arguments):
    """`make(*arguments)`, kept by this worker process for later tasks.

    A worker serves all operators of a session, so it keeps one such table: another operator's,
    or one of other arguments, goes before the new one is made.
    """
    if _KEPT[:1] != [(make, arguments)]:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[:] = (make, arguments), make(*arguments)
    return _KEPT[1]


def pairs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the first two columns, one at a time: the texts of a batch are not all Python strings at once.

    Arrow's pool keeps what batches took, in idle workers, too; it is given back after each batch and at the end.
    """
    for batch in batches:
        yield from ((a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(1)))
        del batch
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def id_text(column: str = "doc_id") -> Column:
    """An id on its way into pandas: a long column with nulls would become floating point there."""
    return F.col(column).cast("long").cast("string").alias(column)


def id_values(texts) -> list[int | None]:
    return [None if t is None else int(t) for t in texts]


def longs(values) -> pd.array:
    """Whole numbers and nulls on their way out of pandas."""
    return pd.array(list(values), dtype="Int64")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` below the shared folder and read it back.

    Cuts the lineage like a checkpoint, but column-wise and compressed: later
    stages, and retries after a lost executor, read these files.
    """
    path = work_dir(df.sparkSession, purpose)
    scratch(df.sparkSession).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> list[str]:
    """Folders that operators of this session have written as intermediate results."""
    context = spark.sparkContext
    if not hasattr(context, "_leakloom_scratch"):
        context._leakloom_scratch = []
    return context._leakloom_scratch


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate results whose consumers have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        scratch(spark).remove(path)


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table of few enough rows; a larger one is left to shuffled joins."""
    return F.broadcast(df) if df.count() <= rows else df


def fold_ascii(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, _UPPER, _LOWER)


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps one set of the key columns; keys must not be null."""
    return left.join(right, list(keys), how)


def before(keys: Sequence[str], order: Sequence[Column | str], value: str) -> Column:
    """Sum of `value` over the earlier rows of the same keys."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def blocked_total(df: DataFrame, group: Sequence[str], block: Sequence[str], order: Sequence[Column | str],
                  value: str, out: str) -> DataFrame:
    """Sum of `value` over the earlier rows of each group, in order of (block, order).

    A window over a whole group would put it into one task. Here the blocks of a
    group are summed first, those few sums get their running totals, and windows
    run within blocks only; the join and the window share one shuffle by (group, block).
    Group and block columns must not be null, and `df` is read twice: pass a stored table.
    """
    keys = [*group, *block]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_s"))
    sums = sums.select(*keys, before(group, block, "_s").alias("_base"))
    return (on_keys(df, sums, keys)
            .withColumn(out, F.col("_base") + before(keys, order, value))
            .drop("_base"))
