import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakloom.functions import scoring, text as tx
from leakloom.operators import relational as rel
from leakloom.schemas import table_schema
from leakloom.sources import tables

DAY = [dt.datetime(2024, 1, d) for d in range(1, 29)]
SECRET = "id long, scan_id long, app_name string, file_path string, line_number long, pattern_name string, severity string, " \
         "confidence double, remediation string, status string, created_at timestamp_ntz"
SCA = "id long, scan_id long, app_name string, file_path string, package_name string, cve_id string, severity string, " \
      "cvss_score double, remediation string, status string, created_at timestamp_ntz"


def secrets(spark, *rows):
    return spark.createDataFrame([(i, 1, "a", "f", 3, "P", s, 0.5, "r", st, d) for i, s, st, d in rows], SECRET)


def sca(spark, *rows):
    return spark.createDataFrame([(i, 1, "a", "f", "pkg", c, s, 5.0, "r", st, d) for i, c, s, st, d in rows], SCA)


def test_get_findings_order_and_titles(spark):
    s = secrets(spark, (1, "critical", "open", DAY[0]), (2, "low", "open", DAY[1]), (3, "odd", "open", DAY[2]), (4, "low", "fixed", DAY[3]))
    c = sca(spark, (9, "CVE-1", "low", "open", DAY[1]), (8, None, "critical", "open", DAY[5]))
    rows = rel.get_findings(s, c).collect()
    assert [(r.type, r.id) for r in rows] == [("secret", 3), ("secret", 2), ("sca", 9), ("sca", 8), ("secret", 1)]
    assert [r.title for r in rows if r.type == "sca"] == ["pkg (CVE-1)", None]
    assert [r.id for r in rel.get_findings(s, c, order="critical_first").collect()] == [8, 1, 2, 9, 3]
    assert [r.id for r in rel.get_findings(s, c, limit=2).collect()] == [3, 2]
    assert [r.id for r in rel.get_findings(s, c, finding_type="sca", severity="low").collect()] == [9]
    assert rel.get_findings(s, c, finding_type="other").count() == 0


def unified(spark, *rows):
    return spark.createDataFrame([(i, "a", s, fp) for i, s, fp in rows], "id long, app_name string, severity string, is_false_positive boolean")


@pytest.mark.parametrize("severities, level", [
    (["critical"], "CRITICAL"), (["high"] * 6, "HIGH"), (["high"], "MEDIUM"), (["low", "odd"], "LOW"), ([], "LOW")])
def test_threat_level(spark, severities, level):
    frame = unified(spark, *[(n, s, False) for n, s in enumerate(severities)], (90, "critical", True), (91, "critical", None))
    assert rel.threat_level(frame).first().threat_level == level


def test_null_flags_count_as_genuine_only_in_the_list(spark):
    frame = unified(spark, (1, "high", None), (2, "high", True), (3, "high", False)).withColumn("created_at", F.lit(DAY[0]))
    assert sorted(r.id for r in rel.list_findings(frame).collect()) == [1, 3]
    assert [r.id for r in rel.top_findings(frame).collect()] == [3]


def test_reports_over_nothing(spark):
    empty = unified(spark, (1, "high", True))
    assert [(r.severity, r.findings, r.percentage) for r in rel.technical_report(empty).collect()] == [
        (s, 0, 0.0) for s in ("critical", "high", "medium", "low")]
    assert rel.recommendations(empty).count() == 0
    apps = spark.createDataFrame([("active",), ("archived",)], "status string")
    row = rel.executive_summary(apps, empty).first()
    assert (row.total_applications, row.total_findings, row.risk_score, row.risk_level, row.high_status) == (1, 0, 0, "Low", "Good")
    row = rel.dashboard_stats(apps, apps, empty).first()
    assert (row.total_apps, row.scans_completed, row.vulnerabilities, row.threat_level) == (1, 2, 0, "LOW")


def test_recommendation_texts(spark):
    rows = rel.recommendations(unified(spark, (1, "critical", False), (2, "critical", False), (3, "medium", False))).collect()
    assert [r.description for r in rows] == ["Address 2 critical vulnerabilities immediately", "Address 1 medium-priority issues"]


@pytest.mark.parametrize("critical, high, score, level", [(0, 0, 0, "Low"), (4, 0, 40, "Medium"), (5, 2, 60, "High"), (8, 0, 80, "Critical"), (50, 3, 100, "Critical")])
def test_risk(spark, critical, high, score, level):
    frame = spark.range(1).select(F.lit(critical).cast("bigint").alias("c"), F.lit(high).cast("bigint").alias("h"))
    got = frame.select(scoring.risk_score(F.col("c"), F.col("h")).alias("s")).select("s", scoring.risk_level(F.col("s"))).first()
    assert tuple(got) == (score, level)


def test_scan_history_keeps_scans_without_findings(spark):
    scans = spark.createDataFrame([(1, "a", "full", "completed", DAY[0]), (2, "a", "full", "failed", DAY[1])],
                                  "id long, app_name string, scan_type string, status string, started_at timestamp_ntz")
    found = spark.createDataFrame([(1, "high", False), (1, "odd", False), (2, "low", True)], "scan_id long, severity string, is_false_positive boolean")
    rows = [(r.id, r.total_findings, r.high, r.low) for r in rel.scan_history(scans, found).collect()]
    assert rows == [(2, 0, 0, 0), (1, 2, 1, 0)]


def test_rollup_by_scan_type(spark):
    scans = spark.createDataFrame([(1, "a", "full", None), (2, "a", "secrets", None), (3, "a", "sca", "boom")],
                                  "id long, app_name string, scan_type string, error_message string")
    s = spark.createDataFrame([(n, "high") for n in (1, 2, 3)], "scan_id long, severity string")
    c = spark.createDataFrame([(n, "moderate") for n in (1, 2, 3)], "scan_id long, severity string")
    rows = {r.id: (r.status, r.secrets_found, r.vulnerabilities_found, r.high_count, r.other_count) for r in rel.scan_rollup(scans, s, c).collect()}
    assert rows == {1: ("completed", 1, 1, 1, 1), 2: ("completed", 1, 0, 1, 0), 3: ("failed", 0, 1, 0, 1)}


def test_history_with_and_without_events(spark):
    found = spark.createDataFrame([(1, "T1", DAY[0]), (2, "T2", DAY[1])], "id long, title string, created_at timestamp_ntz")
    history = spark.createDataFrame([(5, 1, "resolved", "d", "ann", DAY[3]), (6, 1, "created", None, None, DAY[2]), (7, 99, "x", "", "", DAY[4])],
                                    "id long, finding_id long, event_type string, details string, analyst string, event_ts timestamp_ntz")
    rows = [(r.finding_id, r.event_type, r.details) for r in rel.finding_history(history, found).collect()]
    assert rows == [(1, "resolved", "d"), (1, "created", None), (2, "created", "Finding created: T2")]
    assert [r.event_type for r in rel.finding_history(history, found, finding_id=2).collect()] == ["created"]


@pytest.mark.parametrize("text, shown", [(None, "N/A"), ("", "N/A"), ("abc", "abc"), ("abcd", "abc...")])
def test_truncate(spark, text, shown):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(scoring.truncate_text(F.col("t"), 3)).first()[0] == shown


def test_csv_quoting_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'say "hi", ok', None, DAY[0]), (2, "line\nbreak", "", DAY[1])], "id long, a string, b string, t timestamp_ntz")
    path = str(tmp_path / "out")
    tables.write_csv(frame.coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"say ""hi"", ok"' in text and "2024-01-01 00:00:00" in text


def test_csv_keeps_every_character(spark, tmp_path):
    texts = ["  lead", "trail  ", "\ttab\t", "two\nlines", "cr\rlf\r\n", 'q"uo"te', "a,b", "back\\slash", " "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, a string")
    path = str(tmp_path / "out")
    tables.write_csv(frame.coalesce(1), path)
    back = {r.id: r.a for r in tables.read_csv(spark, path, "id BIGINT, a STRING").collect()}
    # The CSV parser reads any line end inside quotes as a line feed.
    assert back == {i: t.replace("\r\n", "\n").replace("\r", "\n") for i, t in enumerate(texts)} or back == dict(enumerate(texts))


def test_lists_are_complete_unless_cut(spark):
    rows = secrets(spark, *[(i, "low", "open", DAY[0]) for i in range(150)])
    none = spark.createDataFrame([], table_schema("sca_findings"))
    assert rel.get_findings(rows, none).count() == 150 and rel.get_findings(rows, none, limit=100).count() == 100


def test_only_completed_scans_count_as_last(spark):
    scans = spark.createDataFrame([("a", "completed", DAY[0]), ("a", "failed", DAY[1]), ("b", "failed", DAY[1])],
                                  "app_name string, status string, completed_at timestamp_ntz")
    apps = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r.name: r.last_scan_at for r in rel.app_last_scan(apps, scans).collect()} == {"a": DAY[0], "b": None}


def test_append_is_partitioned_and_typed(spark, tmp_path):
    rows = secrets(spark, *[(i, "low", "open", DAY[0]) for i in range(20)]).drop("status", "id", "created_at", "scan_id")
    for scan in (1, 2):
        tables.append_secret_findings(rows, str(tmp_path), F.lit(scan), F.lit(DAY[1]))
    back = tables.read_table(spark, str(tmp_path), "secret_findings")
    assert back.count() == 40 and {r.status for r in back.select("status").distinct().collect()} == {"open"}
    assert (tmp_path / "secret_findings" / "app_name=a").is_dir()
    plan = back.where("app_name = 'a' AND scan_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(app_name" in plan and "EqualTo(scan_id,2)" in plan


def test_folders_of_appends_do_not_grow_with_applications(spark, tmp_path):
    rows = spark.range(700).selectExpr("id", "id % 3 AS scan_id", "concat('a', id) AS app_name", "'high' AS severity", "'open' AS status")
    few = rows.where("id < 2")
    for part in (few, rows, few):
        tables.append_table(part, str(tmp_path), "secret_findings")
    assert sorted(p.name for p in tmp_path.glob("**/app_name=*")) == ["app_name=a0", "app_name=a1"]
    back = tables.read_table(spark, str(tmp_path), "secret_findings")
    want = sorted([(r.id, r.scan_id, r.app_name) for r in rows.collect()] + 2 * [(r.id, r.scan_id, r.app_name) for r in few.collect()])
    assert sorted((r.id, r.scan_id, r.app_name) for r in back.collect()) == want


def test_lines_of_text_helper(spark):
    frame = spark.createDataFrame([("a\r\nb\rc\n",), ("x",)], "t string")
    assert [r[0] for r in frame.select(tx.split_lines(F.col("t"))).collect()] == [["a", "b", "c"], ["x"]]
