"""A whole scan run: applications in, stored findings and scan records out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leakloom.catalog import BUILTIN_PATTERNS, Pattern
from leakloom.operators import detect, lifecycle, relational, sca
from leakloom.operators.ordered import ranked
from leakloom.schemas import conform
from leakloom.session import cut
from leakloom.sources import tables

#: Applications of a run whose names and scan ids are broadcast to their files and findings.
BROADCAST_APPLICATIONS = 500_000

SCAN_TYPES = {"full": ("secrets", "sca"), "secrets": ("secrets",), "sca": ("sca",)}


def numbered(rows: DataFrame, order: Sequence[str], stored: DataFrame) -> DataFrame:
    """Rows with the next free ids of a table, without sending them through one task."""
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return ranked(rows, [], list(order), out="id").withColumn("id", F.col("id") + F.lit(last))


def failures(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(app_name, error_message) of the applications that something went wrong for: one message each, the least."""
    rows = [errors.select("app_name", "error_message")] if errors is not None else []
    if "error" in files.columns:
        rows.append(files.select("app_name", F.col("error").alias("error_message")))
    if not rows:
        rows = [files.sparkSession.createDataFrame([], "app_name string, error_message string")]
    return (reduce(DataFrame.unionAll, rows).where(F.coalesce("error_message", F.lit("")) != "")
            .groupBy("app_name").agg(F.min("error_message").alias("error_message")))


def run_scan(spark: SparkSession, applications: DataFrame, files: DataFrame, reports: dict[str, DataFrame],
             root: str, now: Column, scan_type: str = "full",
             patterns: Sequence[Pattern] = BUILTIN_PATTERNS, errors: DataFrame | None = None) -> DataFrame:
    """Scan the applications (name) and append findings and one scan record each.

    An application without any source file or report of the kinds that are scanned
    was not there to scan: it gets no record. Runs on one store must not overlap,
    since ids continue those stored.

    Errors are rows next to the data: `errors` (app_name, error_message), and the
    `error` column of files read with `read_listed(..., keep_errors=True)`. An
    application with an error gets a record of status `failed` with one of its messages
    and no findings; it does not touch the scans of the others.

    `files` are source files, `reports` audit reports by kind (npm, safety, pip_audit,
    dependency_check). Each input is read once; the roll-up counts what this run found,
    not what is stored. Returns the scan records of this run.
    """
    kinds = SCAN_TYPES[scan_type]
    failing = failures(files, errors)
    sources = [files] if "secrets" in kinds else []
    sources += list(reports.values()) if "sca" in kinds else []
    there = reduce(DataFrame.unionAll, [s.select("app_name") for s in (*sources, failing)]).distinct()
    names = applications.select(F.col("name").alias("app_name")).distinct().join(there, "app_name", "left_semi")
    scans = cut(numbered(names, ["app_name"], tables.read_table(spark, root, "scans"))
                .join(failing, "app_name", "left").withColumns({"scan_type": F.lit(scan_type), "started_at": now}))
    scan_of = scans.where("error_message IS NULL").select("app_name", F.col("id").alias("scan_id"))
    applications_done = scan_of.count()
    # A shuffle by application would move all texts, and put all files of a large application into one task.
    scan_of = F.broadcast(scan_of) if applications_done <= BROADCAST_APPLICATIONS else scan_of
    counted = {kind: spark.createDataFrame([], "scan_id bigint, severity string") for kind in ("secrets", "sca")}

    if "secrets" in kinds:
        listed = detect.eligible_files(files).join(scan_of.select("app_name"), "app_name", "left_semi")
        found = detect.scan_secrets(listed, patterns=patterns)
        rows = counted["secrets"] = cut(found.withColumnRenamed("path", "file_path").join(scan_of, "app_name"))
        order = ("app_name", "file_path", "line_number", "pattern_name", "secret_hash")
        ready = numbered(rows, order, tables.read_table(spark, root, "secret_findings"))
        tables.append_secret_findings(ready, root, F.col("scan_id"), now, applications_done)
    if "sca" in kinds:
        found = sca.normalize_all(**reports)
        rows = counted["sca"] = cut(found.join(scan_of, "app_name"))
        order = ("app_name", "package_manager", "package_name", "cve_id", "file_path")
        ready = numbered(rows, order, tables.read_table(spark, root, "sca_findings"))
        tables.append_sca_findings(ready, root, F.col("scan_id"), now, applications_done)
    rollup = relational.scan_rollup(scans, counted["secrets"], counted["sca"])
    rollup = rollup.join(scans.select("id", "error_message"), "id").withColumn("started_at", now)
    tables.append_scan_records(rollup, root, now)
    return tables.read_table(spark, root, "scans").join(scans.select("id"), "id", "left_semi")


# --- from scans to managed findings ----------------------------------------------

def as_findings(secrets: DataFrame, sca_rows: DataFrame) -> DataFrame:
    """Stored secrets and package findings as rows of `findings`, hashed; ids are those of secrets (even) and packages (odd)."""
    two = [
        secrets.select((2 * F.col("id")).alias("id"), "scan_id", "app_name", F.lit("secret").alias("finding_type"), "severity",
                       F.col("pattern_name").alias("title"), "file_path", "line_number",
                       F.lit(None).cast("string").alias("cve_id"), F.lit(None).cast("string").alias("component"),
                       F.lit(None).cast("string").alias("current_version"), F.lit(None).cast("string").alias("fixed_version"),
                       F.lit(None).cast("double").alias("cvss_score"), "remediation", "created_at"),
        sca_rows.select((2 * F.col("id") + 1).alias("id"), "scan_id", "app_name", F.lit("dependency").alias("finding_type"), "severity",
                        F.col("description").alias("title"), "file_path", F.lit(None).cast("bigint").alias("line_number"),
                        "cve_id", F.col("package_name").alias("component"), "current_version", "fixed_version", "cvss_score",
                        "remediation", "created_at"),
    ]
    return lifecycle.with_hash(conform(reduce(DataFrame.unionByName, two), "findings"))


def lifecycle_run(spark: SparkSession, applications: DataFrame, files: DataFrame, reports: dict[str, DataFrame], root: str,
                  now: Column, scan_type: str = "full", patterns: Sequence[Pattern] = BUILTIN_PATTERNS,
                  errors: DataFrame | None = None) -> DataFrame:
    """A scan whose findings are fingerprinted, suppressed, merged into the managed ones, and compared with the scan before.

    The managed findings are a versioned snapshot: each run writes the next one and
    leaves the one before for readers that still hold it, so a run that dies half way
    changes nothing. Known false-positive patterns of the store apply. Every completed
    scan of this run is compared with the application's completed scan before it, by
    the fingerprints each of them found, and the comparisons are appended. Failed scans
    merge and compare nothing. Returns the comparisons of this run.
    """
    scans = cut(run_scan(spark, applications, files, reports, root, now, scan_type, patterns, errors))
    done = scans.where("status = 'completed'").select("app_name", F.col("id").alias("current_scan_id"))
    records = tables.read_table(spark, root, "scans").where("status = 'completed'").select("app_name", "id")
    earlier = (records.join(done, "app_name").where("id < current_scan_id")
               .groupBy("app_name", "current_scan_id").agg(F.max("id").alias("baseline_scan_id")))
    pairs = cut(done.join(earlier, ["app_name", "current_scan_id"], "left"))
    of_pairs = pairs.select(F.explode(F.array("current_scan_id", "baseline_scan_id")).alias("scan_id")).where("scan_id IS NOT NULL").distinct()
    found = cut(as_findings(*[tables.read_table(spark, root, t).join(of_pairs, "scan_id", "left_semi")
                              for t in ("secret_findings", "sca_findings")]))
    batch = found.join(done.select(F.col("current_scan_id").alias("scan_id")), "scan_id", "left_semi").select(*found.columns)
    known = tables.read_table(spark, root, "false_positive_patterns")
    tables.write_version(lifecycle.upsert_findings(tables.read_version(spark, root, "findings"), batch, known, now), root, "findings")
    compared = cut(lifecycle.compare_scans(found, pairs))
    tables.append_comparison(compared, root, now)
    return compared
