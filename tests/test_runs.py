import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leakloom.operators import relational, runs
from leakloom.sources import tables

SECRET = "ghp_" + "a" * 36


def inputs(spark):
    apps = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    files = spark.createDataFrame([("a", "x.py", 1, f"{SECRET}\n{SECRET}"), ("b", "y.md", 1, "pwd: 'longenough'"), ("zz", "z.py", 1, SECRET)],
                                  "app_name string, path string, length long, text string")
    report = json.dumps({"vulnerabilities": {"p": {"severity": "critical"}, "q": {"severity": "moderate"}}})
    npm = spark.createDataFrame([("a", "/a", report), ("c", "/c", "broken")], "app_name string, directory string, report string")
    none = npm.where(F.lit(False))
    return apps, files, {"npm": npm, "safety": none, "pip_audit": none, "dependency_check": none}


def at(day):
    return F.lit(dt.datetime(2024, 1, day)).cast("timestamp_ntz")


def test_two_runs_share_a_store(spark, tmp_path):
    apps, files, reports = inputs(spark)
    root = str(tmp_path)
    first = {r.app_name: r for r in runs.run_scan(spark, apps, files, reports, root, at(1)).collect()}
    assert {n: (r.id, r.secrets_found, r.vulnerabilities_found, r.critical_count, r.high_count, r.medium_count) for n, r in first.items()} == {
        "a": (1, 2, 2, 1, 2, 0), "b": (2, 1, 0, 0, 0, 1), "c": (3, 0, 0, 0, 0, 0)}
    second = {r.app_name: r for r in runs.run_scan(spark, apps, files, reports, root, at(2), scan_type="secrets").collect()}
    assert {n: (r.id, r.secrets_found, r.vulnerabilities_found) for n, r in second.items()} == {"a": (4, 2, 0), "b": (5, 1, 0)}  # c has no files
    secrets = tables.read_table(spark, root, "secret_findings")
    assert sorted(r.id for r in secrets.collect()) == [1, 2, 3, 4, 5, 6]
    assert {(r.scan_id, r.file_path, r.status) for r in secrets.collect()} == {(1, "x.py", "open"), (2, "y.md", "open"), (4, "x.py", "open"), (5, "y.md", "open")}
    scans = tables.read_table(spark, root, "scans")
    last = relational.app_last_scan(apps, scans).collect()
    assert {r.name: r.last_scan_at for r in last} == {"a": dt.datetime(2024, 1, 2), "b": dt.datetime(2024, 1, 2), "c": dt.datetime(2024, 1, 1)}
    assert tables.read_table(spark, root, "scan_results").count() == 5


def test_files_are_scanned_where_they_are_read(spark, tmp_path, monkeypatch):
    """Neither the texts nor the hits are shuffled by application, however large the tables look to Spark."""
    plans, write = [], runs.cut
    monkeypatch.setattr(runs, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    apps, files, reports = inputs(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = runs.run_scan(spark, apps, files, reports, str(tmp_path), at(1)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.app_name: (r.secrets_found, r.vulnerabilities_found) for r in done} == {"a": (2, 2), "b": (1, 0), "c": (0, 0)}
    assert "hashpartitioning(app_name" not in plans[1] and "hashpartitioning(app_name" not in plans[2]


def test_unknown_scan_type(spark, tmp_path):
    with pytest.raises(KeyError):
        runs.run_scan(spark, *inputs(spark), str(tmp_path), at(1), scan_type="other")


def test_one_broken_application_leaves_the_others_complete(spark, tmp_path):
    apps, files, reports = inputs(spark)
    files = files.withColumn("error", F.when(F.col("app_name") == "b", "y.md: Permission denied"))
    errors = spark.createDataFrame([("c", "audit tool ended with 3"), ("nobody", "x"), ("a", "")], "app_name string, error_message string")
    got = {r.app_name: r for r in runs.run_scan(spark, apps, files, reports, str(tmp_path), at(1), errors=errors).collect()}
    assert {n: (r.status, r.error_message, r.secrets_found, r.vulnerabilities_found) for n, r in got.items()} == {
        "a": ("completed", None, 2, 2), "b": ("failed", "y.md: Permission denied", 0, 0), "c": ("failed", "audit tool ended with 3", 0, 0)}
    assert {r.app_name for r in tables.read_table(spark, str(tmp_path), "secret_findings").collect()} == {"a"}


def test_unreadable_files_are_rows_with_errors(spark, tmp_path):
    from leakloom.sources import files as sources

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one")
    listing = spark.createDataFrame([("a", str(tmp_path / "a"), "x.py", 3), ("a", str(tmp_path / "a"), "gone.py", 3)],
                                    "app_name string, root string, path string, length long")
    got = {r.path: (r.text, bool(r.error)) for r in sources.read_listed(listing, keep_errors=True).collect()}
    assert got == {"x.py": ("one", False), "gone.py": (None, True)}
    with pytest.raises(Exception):
        sources.read_listed(listing).collect()


def test_lifecycle_over_three_runs(spark, tmp_path):
    """Fingerprints persist, are counted, suppressed and compared; a failed scan changes nothing."""
    root, apps = str(tmp_path), spark.createDataFrame([("a",), ("b",)], "name string")
    row = "app_name string, path string, length long, text string, error string"
    tables.append_table(spark.createDataFrame([(None, "file_path", "gen/")], "app_name string, pattern_type string, pattern_value string"),
                        root, "false_positive_patterns")

    def run(day, *rows):
        files = spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], row)
        return {r.app_name: (r.baseline_scan_id, r.new_findings, r.resolved_findings, r.persistent_findings)
                for r in runs.lifecycle_run(spark, apps, files, {}, root, at(day), scan_type="secrets").collect()}

    assert run(1, ("a", "x.py", 1, SECRET), ("b", "y.py", 1, SECRET), ("a", "gen/z.py", 1, SECRET)) == {}
    assert run(2, ("a", "x.py", 1, SECRET), ("a", "w.py", 1, SECRET), ("b", "y.py", 1, SECRET, "no access")) == {"a": (1, 1, 1, 1)}
    assert run(3, ("a", "w.py", 1, SECRET), ("b", "y.py", 1, SECRET)) == {"a": (3, 0, 1, 1), "b": (2, 0, 0, 1)}
    kept = {(r.app_name, r.file_path): (r.occurrence_count, r.status, r.first_detected, r.last_seen)
            for r in tables.read_version(spark, root, "findings").collect()}
    day = lambda n: dt.datetime(2024, 1, n)
    assert kept == {("a", "x.py"): (2, "open", day(1), day(2)), ("a", "w.py"): (2, "open", day(2), day(3)),
                    ("b", "y.py"): (2, "open", day(1), day(3))}
    assert tables.read_table(spark, root, "scan_comparisons").count() == 3
