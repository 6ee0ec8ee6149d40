"""Source trees as rows (app_name, path, length, modified_at, text).

`read_tree` uses Spark's own binary file reader. That reader never lists names
that start with '_' or '.', so trees with such files (Python's `__init__.py`) go
through `list_tree` and `read_listed`, which list and read in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leakloom import catalog
from leakloom.functions import text as tx
from leakloom.session import cut

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
LISTING_SCHEMA = "app_name STRING, root STRING, path STRING, length BIGINT"


def suffix_glob(extensions: Sequence[str] = catalog.SCAN_EXTENSIONS) -> str:
    """Glob that lists only files with one of the suffixes, in any letter case."""
    def either_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "{" + ",".join(f"*{either_case(e)}" for e in extensions) + "}"


def _relative(root: str) -> Column:
    """Path below the root, as a file URI or plain path may spell it."""
    prefix = urlparse(root).path.rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.replace(F.substring(full, F.length(F.lit(prefix)) + 1, F.length(full)), F.lit("//"), F.lit("/"))


def _shaped(binary: DataFrame, root: str, max_bytes: int | None) -> DataFrame:
    relative = _relative(root)
    small = binary if max_bytes is None else binary.where(F.col("length") <= max_bytes)
    return small.select(
        F.substring_index(relative, "/", 1).alias("app_name"),
        F.regexp_replace(relative, r"^[^/]*/", "").alias("path"),
        "length",
        F.col("modificationTime").alias("modified_at"),
        tx.clean_utf8(F.col("content")).alias("text"),
    )


def oversized(spark: SparkSession, root: str, extensions: Sequence[str] = catalog.SCAN_EXTENSIONS,
              max_bytes: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """Files that the size limit leaves out: (path, length, modificationTime), without opening them."""
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", suffix_glob(extensions)))
    return reader.load(root).where(F.col("length") > max_bytes).select("path", "length", "modificationTime")


def read_tree(spark: SparkSession, root: str, extensions: Sequence[str] = catalog.SCAN_EXTENSIONS,
              max_bytes: int | None = catalog.MAX_FILE_BYTES) -> DataFrame:
    """All files below `root`/<application>/, decoded.

    Suffixes prune the listing and the size limit reaches the reader, so neither
    other files nor oversized ones are opened.
    """
    reader = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", suffix_glob(extensions)))
    return _shaped(reader.load(root), root, max_bytes)


def stream_tree(spark: SparkSession, root: str, max_files: int | None = None,
                extensions: Sequence[str] = catalog.SCAN_EXTENSIONS,
                max_bytes: int | None = catalog.MAX_FILE_BYTES) -> DataFrame:
    """The same rows as a stream of new files."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", True)
              .option("pathGlobFilter", suffix_glob(extensions)))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _shaped(reader.load(root), root, max_bytes)


def _filesystem_opener():
    """Function from a URI or path to (file system, path).

    It is built here so that it travels to the tasks by value: they need not have
    this package installed.
    """
    def opened(uri: str):
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        if uri.startswith("file:"):
            return fs.LocalFileSystem(), unquote(urlparse(uri).path)
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    return opened


def list_tree(applications: DataFrame, extensions: Sequence[str] = catalog.SCAN_EXTENSIONS,
              skip_names: Sequence[str] = catalog.SKIP_NAMES, max_bytes: int = catalog.MAX_FILE_BYTES) -> DataFrame:
    """Eligible files of each application (name, local_path), hidden names included.

    The tree is listed level by level. All directories of a level are spread over the
    tasks anew, so a large application or a large subtree never ends up in one task.
    Skipped directories and links to directories are not descended into; a missing
    root contributes nothing.
    """
    spark = applications.sparkSession
    wanted, skipped = frozenset(extensions), frozenset(skip_names)
    filesystem = _filesystem_opener()

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["app_name", "root", "path", "length"]).astype({"length": "Int64"})

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, root, directory in zip(batch["app_name"], batch["root"], batch["path"]):
                system, base = filesystem(root)
                target = f"{base.rstrip('/')}/{directory}".rstrip("/")
                for info in system.get_file_info(fs.FileSelector(target, allow_not_found=True)):
                    if info.base_name in skipped:
                        continue
                    path = f"{directory}/{info.base_name}".lstrip("/")
                    stem, dot, tail = info.base_name.rpartition(".")
                    if info.type == fs.FileType.Directory:
                        # Links to directories are not followed; they may form loops.
                        if not (isinstance(system, fs.LocalFileSystem) and os.path.islink(info.path)):
                            rows.append((name, root, path, None))
                    elif dot and stem and tail and f".{tail.lower()}" in wanted and info.size <= max_bytes:
                        rows.append((name, root, path, info.size))
            yield frame(rows)

    root = F.coalesce(F.nullif("local_path", F.lit("")), F.concat(F.lit("./repos/"), F.col("name")))
    level = applications.select(F.col("name").alias("app_name"), root.alias("root"), F.lit("").alias("path"))
    found = []
    while not level.isEmpty():
        tasks = spark.sparkContext.defaultParallelism
        entries = cut(level.repartition(tasks, "app_name", "path").mapInPandas(children, LISTING_SCHEMA))
        found.append(entries.where("length IS NOT NULL"))
        level = entries.where("length IS NULL")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LISTING_SCHEMA)


def read_listed(listing: DataFrame, split_bytes: int = 128 * 1024 * 1024, batch_bytes: int = 64 * 1024 * 1024,
                keep_errors: bool = False) -> DataFrame:
    """Contents of listed files, read in tasks and handed over in bounded batches.

    The number of tasks follows the total size of the files. With `keep_errors` a file
    that can't be read is a row with null text and its message in `error`, and the
    others are read; otherwise it ends the job.
    """
    filesystem = _filesystem_opener()
    columns = ["app_name", "path", "length", "content", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for name, root, path, length in zip(batch["app_name"], batch["root"], batch["path"], batch["length"]):
                try:
                    system, base = filesystem(root)
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as stream:
                        rows.append((name, path, length, stream.read(), None))
                except OSError as broken:
                    if not keep_errors:
                        raise
                    rows.append((name, path, length, None, f"{path}: {broken.strerror or type(broken).__name__}"))
                held += int(length)
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-int(total) // split_bytes))
    binary = listing.repartition(tasks, "app_name", "path").mapInPandas(
        read, "app_name STRING, path STRING, length BIGINT, content BINARY, error STRING")
    return binary.select("app_name", "path", "length", tx.clean_utf8(F.col("content")).alias("text"), *["error"] * keep_errors)
