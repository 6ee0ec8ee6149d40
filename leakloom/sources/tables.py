"""Stored tables: read with their declared schema, append without rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leakloom.schemas import conform, table_schema
from leakloom.session import complete_folders, cut, remove_folders, staged

# Columns rows are clustered by on write: readers filter and join on them.
CLUSTERING = {
    "secret_findings": ("app_name", "scan_id", "file_path", "line_number"),
    "sca_findings": ("app_name", "scan_id", "package_name"),
    "findings": ("app_name", "finding_hash"),
}


#: Applications of one append that get a folder each.
FOLDERS = 500
#: Suffix of the folder with the appends of more applications than that.
MANY = "_many"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table, in both of its layouts; one nothing was appended to yet is empty."""
    folders = complete_folders(spark, root)
    parts = [spark.read.schema(table_schema(table)).parquet(f"{root.rstrip('/')}/{name}")
             for name in (table, table + MANY) if name in folders]
    if not parts:
        return spark.createDataFrame([], table_schema(table))
    return reduce(DataFrame.unionByName, parts)


def _versions(spark: SparkSession, root: str, table: str) -> list[int]:
    names = complete_folders(spark, f"{root.rstrip('/')}/{table}_versions")
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The newest complete version of a table that is replaced as a whole; empty before the first."""
    versions = _versions(spark, root, table)
    if not versions:
        return spark.createDataFrame([], table_schema(table))
    return spark.read.schema(table_schema(table)).parquet(f"{root.rstrip('/')}/{table}_versions/v{versions[-1]}")


def write_version(df: DataFrame, root: str, table: str, kept: int = 2) -> None:
    """Write the next version; of the older ones only `kept` stay, for readers that began before."""
    spark = df.sparkSession
    versions = _versions(spark, root, table)
    target = f"{root.rstrip('/')}/{table}_versions"
    conform(df, table).write.mode("overwrite").parquet(f"{target}/v{versions[-1] + 1 if versions else 1}")
    remove_folders(spark, [f"{target}/v{v}" for v in versions[:-kept]])


def append_table(df: DataFrame, root: str, table: str, applications: int | None = None) -> None:
    """Append rows to a table.

    Findings are laid out by application. Rows are range-partitioned first: a task
    then writes few applications, and a large application is split over many tasks.
    Finding the ranges reads the rows an extra time, so they are staged before,
    unless the caller has stored them and knows of how many `applications` they are:
    the scan that produced them, far larger than they are, runs once.

    A folder per application lets readers skip the others, but each is a file to create,
    commit and list. An append of more than `FOLDERS` applications is one folder of
    files sorted by application; readers skip row groups by their bounds there.
    """
    rows = conform(df, table)
    if table not in CLUSTERING:
        rows.write.mode("append").parquet(f"{root.rstrip('/')}/{table}")
    elif applications is None:
        with staged(rows) as kept:
            _append_sorted(kept, root, table, kept.select("app_name").distinct().limit(FOLDERS + 1).count())
    else:
        _append_sorted(rows, root, table, applications)


def _append_sorted(rows: DataFrame, root: str, table: str, applications: int) -> None:
    keys = CLUSTERING[table]
    laid_out = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append")
    if applications > FOLDERS:
        laid_out.parquet(f"{root.rstrip('/')}/{table}{MANY}")
    else:
        laid_out.partitionBy("app_name").parquet(f"{root.rstrip('/')}/{table}")


def append_secret_findings(findings: DataFrame, root: str, scan_id: Column, now: Column,
                           applications: int | None = None) -> None:
    """Scanner output into the store, open and dated."""
    append_table(findings.withColumns({"scan_id": scan_id, "created_at": now}), root, "secret_findings", applications)


def append_sca_findings(findings: DataFrame, root: str, scan_id: Column, now: Column,
                        applications: int | None = None) -> None:
    append_table(findings.withColumns({"scan_id": scan_id, "created_at": now}), root, "sca_findings", applications)


def append_comparison(comparison: DataFrame, root: str, now: Column) -> None:
    append_table(comparison.withColumn("comparison_date", now), root, "scan_comparisons")


def append_scan_records(rollup: DataFrame, root: str, now: Column) -> None:
    """Rolled-up scans, and the legacy result table with their four counts."""
    done = cut(rollup.withColumn("completed_at", now))
    append_table(done, root, "scans")
    append_table(done.withColumn("scan_date", now), root, "scan_results")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside quoted fields are doubled, null is empty.

    Timestamps are written as plain text, with a fraction only where there is one.
    """
    texts = [F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType.typeName().startswith("timestamp")
             else F.col(f"`{f.name}`") for f in df.schema.fields]
    (df.select(texts).write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").option("nullValue", "").csv(path))


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Exported files, typed by a DDL schema.

    Texts may hold line breaks, so each file is read by one task; exports have one
    file per writing task. Without line breaks, `multi_line=False` splits large files.
    """
    fields = StructType.fromDDL(schema).fields
    raw = (spark.read.schema(StructType([StructField(f.name, StringType()) for f in fields]))
           .option("header", True).option("escape", '"').option("nullValue", None)
           .option("multiLine", multi_line).csv(path))
    return raw.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def findings_export(findings: DataFrame) -> DataFrame:
    """Columns and header names of the findings export."""
    return findings.select(
        F.col("type").alias("Type"), F.col("app_name").alias("Application"), F.col("file_path").alias("File Path"),
        F.col("line_number").alias("Line Number"), F.col("title").alias("Title"), F.col("severity").alias("Severity"),
        F.col("confidence").alias("Confidence"), F.col("created_at").alias("Created At"),
        F.col("status").alias("Status"))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def finding_history_export(history: DataFrame, findings: DataFrame) -> DataFrame:
    """Events of each finding, oldest first, with what the report preamble says about it."""
    about = findings.select(F.col("id").alias("finding_id"), F.col("title").alias("Finding"),
                            F.col("app_name").alias("Application"), F.col("severity").alias("Severity"),
                            F.col("status").alias("Current Status"))
    return (
        history.join(about, "finding_id").orderBy("finding_id", "event_ts", "id")
        .select("finding_id", "Finding", "Application", "Severity", "Current Status",
                F.col("event_ts").alias("Timestamp"), F.col("event_type").alias("Event Type"),
                _blank("details").alias("Details"), _blank("analyst").alias("Analyst"))
    )


def application_history_export(rows: DataFrame) -> DataFrame:
    """The eight columns of the application history export."""
    return rows.select(
        F.col("event_ts").alias("Timestamp"), F.col("app_name").alias("Application"),
        F.col("finding_title").alias("Finding"), F.col("severity").alias("Severity"),
        F.col("event_type").alias("Event Type"), _blank("details").alias("Details"),
        _blank("analyst").alias("Analyst"), _blank("file_path").alias("File Path"))
