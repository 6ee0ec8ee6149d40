"""Registered queries over stored applications, scans, findings and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom import catalog
from leakloom.functions import scoring
from leakloom.operators import relational as rel
from leakloom.plans import fixtures as fx
from leakloom.plans.registry import query, sql_text
from leakloom.session import work_dir
from leakloom.sources import tables

SCANS_AS_OF = "2001-08-02 00:00:00"
HISTORY_AS_OF = "2024-01-31 00:00:00"

RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in catalog.SEVERITIES)
OPEN_SQL = """
  open_all AS (
    SELECT 'secret' AS type, id, app_name, file_path, cast(line_number AS BIGINT) AS line_number, pattern_name AS title, severity,
      confidence, created_at, remediation, status FROM secret_findings WHERE status = 'open'
    UNION ALL
    SELECT 'sca', id, app_name, file_path, 0, package_name || ' (' || cve_id || ')', severity, cvss_score, created_at, remediation, status
    FROM sca_findings WHERE status = 'open')"""
OPEN_VIEWS = ["secret_findings", "sca_findings"]
FINDINGS_ORDER = f"ORDER BY {RANK_SQL} DESC, created_at DESC, type = 'sca', id"


def _at(text):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _views(spark, sf_dir, *names):
    return [fx.view(spark, sf_dir, n) for n in names]


# --- applications and scans ---

@query("list_applications", "SELECT * FROM applications WHERE status = 'active' ORDER BY created_at DESC, id", ["applications"])
def list_applications(spark, sf_dir):
    return rel.list_applications(fx.view(spark, sf_dir, "applications"))


@query("get_application", "SELECT * FROM applications WHERE name = 'app7'", ["applications"])
def get_application(spark, sf_dir):
    return rel.get_application(fx.view(spark, sf_dir, "applications"), "app7")


@query("get_finding", "SELECT * FROM findings WHERE id = (SELECT min(id) FROM findings)", ["findings"])
def get_finding(spark, sf_dir):
    found = fx.view(spark, sf_dir, "findings")
    return found.where(F.col("id") == found.agg(F.min("id")).scalar())


@query("recent_scans", """
SELECT s.*, a.team, a.criticality FROM scans s JOIN applications a ON s.app_name = a.name
ORDER BY started_at DESC, s.id DESC LIMIT 25""", ["scans", "applications"])
def recent_scans(spark, sf_dir):
    return rel.recent_scans(*_views(spark, sf_dir, "scans", "applications"), limit=25)


@query("scan_activity", f"""
SELECT strftime(started_at, '%Y-%m-%d') AS scan_date, count(*) AS scans FROM scans
WHERE started_at >= TIMESTAMP '{SCANS_AS_OF}' - INTERVAL 2400 DAY GROUP BY 1""", ["scans"])
def scan_activity(spark, sf_dir):
    found = rel.scan_activity(fx.view(spark, sf_dir, "scans"), _at(SCANS_AS_OF), days=2400)
    return found.withColumn("scan_date", F.date_format("scan_date", "yyyy-MM-dd"))


def _finished(scans):
    done = F.when(F.col("status") != "running", F.col("started_at") + F.expr("INTERVAL 1 HOUR"))
    return scans.withColumn("completed_at", done)


@query("app_last_scan", """
SELECT a.id, a.name, s.last_scan_at, coalesce(s.last_scan_at, a.created_at) AS updated_at FROM applications a LEFT JOIN (
  SELECT app_name, max(started_at + INTERVAL 1 HOUR) AS last_scan_at FROM scans WHERE status = 'completed' GROUP BY app_name) s
ON s.app_name = a.name""", ["scans", "applications"])
def app_last_scan(spark, sf_dir):
    scans, apps = _views(spark, sf_dir, "scans", "applications")
    return rel.app_last_scan(apps, _finished(scans)).select("id", "name", "last_scan_at", "updated_at")


@query("app_scanning_flag", """
SELECT id, name, EXISTS (SELECT 1 FROM scans s WHERE s.app_name = a.name AND s.status = 'running') AS currently_scanning
FROM applications a""", ["scans", "applications"])
def app_scanning_flag(spark, sf_dir):
    scans, apps = _views(spark, sf_dir, "scans", "applications")
    return rel.app_scanning_flag(apps, scans).select("id", "name", "currently_scanning")


# --- open findings of both kinds ---

@query("get_findings", f"WITH {OPEN_SQL} SELECT * FROM open_all {FINDINGS_ORDER} LIMIT 100", OPEN_VIEWS)
def get_findings(spark, sf_dir):
    return rel.get_findings(*_views(spark, sf_dir, *OPEN_VIEWS), limit=100)


@query("get_findings_filtered", f"""
WITH {OPEN_SQL} SELECT * FROM open_all WHERE app_name = 'app3' AND severity = 'critical' AND type = 'sca' {FINDINGS_ORDER} LIMIT 100""", OPEN_VIEWS)
def get_findings_filtered(spark, sf_dir):
    return rel.get_findings(*_views(spark, sf_dir, *OPEN_VIEWS), app_name="app3", severity="critical", finding_type="sca", limit=100)


@query("get_findings_critical_first", f"""
WITH {OPEN_SQL} SELECT * FROM open_all ORDER BY {RANK_SQL}, created_at DESC, type = 'sca', id LIMIT 100""", OPEN_VIEWS)
def get_findings_critical_first(spark, sf_dir):
    return rel.get_findings(*_views(spark, sf_dir, *OPEN_VIEWS), order="critical_first", limit=100)


for _kind in ("secret", "sca"):
    def _severity_counts(spark, sf_dir, kind=_kind):
        return rel.open_severity_counts(fx.view(spark, sf_dir, f"{kind}_findings"))

    query(f"{_kind}_severity_counts", f"""
SELECT severity, count(*) AS findings FROM {_kind}_findings WHERE status = 'open' GROUP BY severity""",
          [f"{_kind}_findings"])(_severity_counts)


@query("top_vulnerable_apps", f"""
WITH {OPEN_SQL} SELECT app_name, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) AS total
FROM open_all GROUP BY app_name ORDER BY critical DESC, high DESC, total DESC, app_name LIMIT 10""", OPEN_VIEWS)
def top_vulnerable_apps(spark, sf_dir):
    return rel.top_vulnerable_apps(*_views(spark, sf_dir, *OPEN_VIEWS))


@query("severity_totals", f"""
WITH {OPEN_SQL} SELECT severity, count(*) FILTER (WHERE type = 'secret') AS secrets, count(*) FILTER (WHERE type = 'sca') AS sca,
  count(*) AS total FROM open_all GROUP BY severity""", OPEN_VIEWS)
def severity_totals(spark, sf_dir):
    return rel.severity_totals(*_views(spark, sf_dir, *OPEN_VIEWS))


@query("total_applications", "SELECT count(*) AS total_applications FROM applications WHERE status = 'active'", ["applications"])
def total_applications(spark, sf_dir):
    apps, scans, secrets, sca = _views(spark, sf_dir, "applications", "scans", *OPEN_VIEWS)
    return rel.dashboard(apps, secrets, sca, scans, _at(SCANS_AS_OF))["total_applications"]


ROLLUP_SQL = """
  every AS (SELECT scan_id, severity, 'secrets' AS kind FROM secret_findings UNION ALL SELECT scan_id, severity, 'sca' FROM sca_findings),
  covered AS (SELECT s.id, s.app_name, s.scan_type, s.status AS scan_status, e.kind, e.severity FROM scans s LEFT JOIN every e
    ON e.scan_id = s.id AND (s.scan_type = 'full' OR s.scan_type = e.kind)),
  rolled AS (SELECT id, app_name, scan_type, CASE WHEN any_value(scan_status) = 'failed' THEN 'failed' ELSE 'completed' END AS status,
    count(*) FILTER (WHERE kind = 'secrets') AS secrets_found, count(*) FILTER (WHERE kind = 'sca') AS vulnerabilities_found,
    count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
    count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
    count(*) FILTER (WHERE severity NOT IN ('critical', 'high', 'medium', 'low')) AS other_count
  FROM covered GROUP BY id, app_name, scan_type)"""
ROLLUP_VIEWS = ["scans", *OPEN_VIEWS]


def rollup(spark, sf_dir):
    scans, secrets, sca = _views(spark, sf_dir, *ROLLUP_VIEWS)
    failed = F.when(F.col("status") == "failed", F.lit("scan failed"))
    return rel.scan_rollup(scans.withColumn("error_message", failed), secrets, sca)


@query("scan_rollup", f"WITH {ROLLUP_SQL} SELECT * FROM rolled", ROLLUP_VIEWS)
def scan_rollup(spark, sf_dir):
    return rollup(spark, sf_dir)


# --- unified findings ---

@query("list_findings", "SELECT * FROM findings WHERE is_false_positive = false OR is_false_positive IS NULL", ["findings"])
def list_findings(spark, sf_dir):
    return rel.list_findings(fx.view(spark, sf_dir, "findings"))


@query("list_findings_filtered", """
SELECT * FROM findings WHERE app_name = 'app2' AND severity = 'high' AND status = 'open'""", ["findings"])
def list_findings_filtered(spark, sf_dir):
    return rel.list_findings(fx.view(spark, sf_dir, "findings"), "app2", "high", "open", include_fp=True)


@query("scan_history", f"""
WITH n AS (SELECT scan_id, count(*) AS total, {COUNTS_SQL} FROM findings WHERE NOT is_false_positive GROUP BY scan_id)
SELECT id, app_name, scan_type, status, started_at AS created_at, coalesce(total, 0) AS total_findings,
  {", ".join(f"coalesce({s}, 0) AS {s}" for s in catalog.SEVERITIES)}
FROM scans LEFT JOIN n ON n.scan_id = id""", ["scans", "findings"])
def scan_history(spark, sf_dir):
    return rel.scan_history(*_views(spark, sf_dir, "scans", "findings"))


@query("archived_findings", """
SELECT f.*, f.created_at AS updated_at, s.started_at AS scan_date FROM findings f JOIN scans s ON f.scan_id = s.id
WHERE f.status = 'archived' OR f.is_false_positive""", ["scans", "findings"])
def archived_findings(spark, sf_dir):
    scans, found = _views(spark, sf_dir, "scans", "findings")
    return rel.archived_findings(found.withColumn("updated_at", F.col("created_at")), scans)


HISTORY_SQL = """SELECT h.id, h.finding_id, h.event_type, h.details, h.analyst, h.event_ts, f.title AS finding_title, f.app_name,
  f.severity, f.file_path, f.finding_type FROM finding_history h JOIN findings f ON h.finding_id = f.id"""
HISTORY_VIEWS = ["finding_history", "findings"]


@query("application_history", f"{HISTORY_SQL} ORDER BY event_ts DESC, h.id DESC LIMIT 1000", HISTORY_VIEWS)
def application_history(spark, sf_dir):
    return rel.application_history(*_views(spark, sf_dir, *HISTORY_VIEWS), limit=1000)


@query("application_history_recent", f"""
{HISTORY_SQL} WHERE f.app_name = 'app1' AND event_ts >= TIMESTAMP '{HISTORY_AS_OF}' - INTERVAL 7 DAY
ORDER BY event_ts DESC, h.id DESC LIMIT 1000""", HISTORY_VIEWS)
def application_history_recent(spark, sf_dir):
    return rel.application_history(*_views(spark, sf_dir, *HISTORY_VIEWS), app_name="app1", days=7, as_of=_at(HISTORY_AS_OF), limit=1000)


@query("finding_history", """
SELECT f.id AS finding_id, coalesce(h.event_type, 'created') AS event_type,
  CASE WHEN h.id IS NULL THEN concat('Finding created: ', f.title) ELSE h.details END AS details,
  coalesce(h.analyst, 'System') AS analyst, coalesce(h.event_ts, f.created_at) AS event_ts, h.id AS event_id
FROM findings f LEFT JOIN finding_history h ON h.finding_id = f.id""", HISTORY_VIEWS)
def finding_history(spark, sf_dir):
    return rel.finding_history(*_views(spark, sf_dir, *HISTORY_VIEWS))


@query("history_timeline", f"""
SELECT *, count(*) OVER (PARTITION BY event_day) AS day_events FROM (
  SELECT x.* REPLACE (event_ts AS event_ts), strftime(event_ts, '%Y-%m-%d') AS event_day FROM ({HISTORY_SQL}) x) y""", HISTORY_VIEWS)
def history_timeline(spark, sf_dir):
    rows = rel.history_timeline(*_views(spark, sf_dir, *HISTORY_VIEWS))
    return rows.withColumn("event_day", F.date_format("event_day", "yyyy-MM-dd"))


# --- reports ---

GENUINE_SQL = f"g AS (SELECT count(*) AS total, {COUNTS_SQL} FROM findings WHERE is_false_positive = false)"
LEVEL_SQL = "CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 5 THEN 'HIGH' WHEN high > 0 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level"
RISK_SQL = "cast(least(100, critical * 10 + high * 5) AS BIGINT)"
RISK_LEVEL_SQL = "CASE WHEN {0} >= 80 THEN 'Critical' WHEN {0} >= 60 THEN 'High' WHEN {0} >= 40 THEN 'Medium' ELSE 'Low' END"


@query("threat_level", f"WITH {GENUINE_SQL} SELECT critical, high, {LEVEL_SQL} FROM g", ["findings"])
def threat_level(spark, sf_dir):
    return rel.threat_level(fx.view(spark, sf_dir, "findings"))


@query("dashboard_stats", f"""
WITH {GENUINE_SQL} SELECT (SELECT count(*) FROM applications WHERE status = 'active') AS total_apps,
  (SELECT count(*) FROM scans WHERE status = 'completed') AS scans_completed, total AS vulnerabilities, {LEVEL_SQL} FROM g""",
       ["applications", "scans", "findings"])
def dashboard_stats(spark, sf_dir):
    apps, scans, found = _views(spark, sf_dir, "applications", "scans", "findings")
    return rel.dashboard_stats(apps, scans.where(F.col("status") == "completed"), found)


@query("risk_score", f"WITH r AS (SELECT app_name, {COUNTS_SQL} FROM findings WHERE is_false_positive = false GROUP BY app_name) "
                     f"SELECT app_name, critical, high, {RISK_SQL} AS risk_score FROM r", ["findings"])
def risk_score(spark, sf_dir):
    return rel.risk_scores(fx.view(spark, sf_dir, "findings")).drop("risk_level")


@query("risk_level", f"""
SELECT p_partkey, p_size * 2 AS score, {RISK_LEVEL_SQL.format('(p_size * 2)')} AS risk_level FROM part""")
def risk_level(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part")
    score = F.col("p_size") * 2
    return parts.select("p_partkey", score.alias("score"), scoring.risk_level(score).alias("risk_level"))


@query("executive_summary", f"""
WITH {GENUINE_SQL} SELECT (SELECT count(*) FROM applications WHERE status = 'active') AS total_applications,
  total AS total_findings, critical AS critical_findings, high AS high_findings, {RISK_SQL} AS risk_score,
  CASE WHEN critical > 0 THEN 'Immediate Action Required' ELSE 'Good' END AS critical_status,
  CASE WHEN high > 0 THEN 'Action Required' ELSE 'Good' END AS high_status,
  {RISK_LEVEL_SQL.format(RISK_SQL)} AS risk_level FROM g""", ["applications", "findings"])
def executive_summary(spark, sf_dir):
    return rel.executive_summary(*_views(spark, sf_dir, "applications", "findings"))


_SEVERITY_ROWS = ", ".join(f"('{s}')" for s in catalog.SEVERITIES)


@query("technical_report", f"""
WITH g AS (SELECT severity FROM findings WHERE is_false_positive = false)
SELECT t.severity, count(g.severity) AS findings, (SELECT count(*) FROM g) AS total,
  round(count(g.severity) * 100 / greatest((SELECT count(*) FROM g), 1), 1) AS percentage
FROM (VALUES {_SEVERITY_ROWS}) AS t(severity) LEFT JOIN g ON g.severity = t.severity GROUP BY t.severity""", ["findings"])
def technical_report(spark, sf_dir):
    return rel.technical_report(fx.view(spark, sf_dir, "findings"))


@query("top_findings", f"""
SELECT * FROM findings WHERE is_false_positive = false ORDER BY {RANK_SQL}, id LIMIT 10""", ["findings"])
def top_findings(spark, sf_dir):
    return rel.top_findings(fx.view(spark, sf_dir, "findings"))


_ADVICE_SQL = " UNION ALL ".join(
    f"SELECT {sql_text(t[0])} AS priority, {sql_text(t[1])} AS action, "
    f"concat({sql_text(t[2])}, cast({s} AS VARCHAR), {sql_text(t[3])}) AS description FROM g WHERE {s} > 0"
    for s, t in catalog.RECOMMENDATIONS.items())


@query("recommendations", f"WITH {GENUINE_SQL} {_ADVICE_SQL}", ["findings"])
def recommendations(spark, sf_dir):
    return rel.recommendations(fx.view(spark, sf_dir, "findings"))


@query("cvss_band", """
SELECT id, cvss_score, CASE WHEN cvss_score >= 7 THEN 'danger' WHEN cvss_score >= 4 THEN 'warning' ELSE 'info' END AS band
FROM sca_findings""", ["sca_findings"])
def cvss_band(spark, sf_dir):
    return fx.view(spark, sf_dir, "sca_findings").select(
        "id", "cvss_score", scoring.cvss_band(F.col("cvss_score")).alias("band"))


@query("findings_display", f"""
WITH {OPEN_SQL} SELECT type, id, concat(coalesce(file_path, ''), ':', cast(line_number AS VARCHAR)) AS location,
  upper(severity) AS severity_badge, upper(type) AS type_badge,
  CASE WHEN coalesce(title, '') = '' THEN 'N/A' WHEN length(title) <= 8 THEN title ELSE concat(substr(title, 1, 8), '...') END AS short_title,
  CASE WHEN confidence <> 0 THEN concat(cast(cast(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END AS confidence_text
FROM open_all""", OPEN_VIEWS)
def findings_display(spark, sf_dir):
    return rel.findings_display(*_views(spark, sf_dir, *OPEN_VIEWS), title_size=8)


@query("applications_display", """
SELECT name, 'Unknown' AS language, 'Unknown' AS framework, criticality, team, 'N/A' AS owner FROM applications""", ["applications"])
def applications_display(spark, sf_dir):
    return rel.applications_display(fx.view(spark, sf_dir, "applications"))


_TITLES_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in catalog.EVENT_TITLES.items()) + " ELSE 'Event' END"


@query("events_display", f"SELECT id, {_TITLES_SQL} AS event_title FROM finding_history", ["finding_history"])
def events_display(spark, sf_dir):
    return rel.events_display(fx.view(spark, sf_dir, "finding_history"))


@query("retention_filter", """
SELECT * FROM findings WHERE created_at >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 365 DAY""", ["findings"])
def retention_filter(spark, sf_dir):
    return rel.retained(fx.view(spark, sf_dir, "findings"), _at(SCANS_AS_OF), days=365)


# --- sinks ---

@query("findings_export", f"""
WITH {OPEN_SQL} SELECT type AS "Type", app_name AS "Application", file_path AS "File Path", line_number AS "Line Number",
  title AS "Title", severity AS "Severity", confidence AS "Confidence", created_at AS "Created At", status AS "Status"
FROM open_all""", OPEN_VIEWS)
def findings_export(spark, sf_dir):
    path = work_dir(spark, "findings-export")
    found = rel.get_findings(*_views(spark, sf_dir, *OPEN_VIEWS))
    tables.write_csv(tables.findings_export(found), path)
    schema = ("Type STRING, Application STRING, `File Path` STRING, `Line Number` BIGINT, Title STRING, Severity STRING, "
              "Confidence DOUBLE, `Created At` TIMESTAMP_NTZ, Status STRING")
    return tables.read_csv(spark, path, schema)


@query("finding_history_export", """
SELECT h.finding_id, f.title AS "Finding", f.app_name AS "Application", f.severity AS "Severity", f.status AS "Current Status",
  h.event_ts AS "Timestamp", h.event_type AS "Event Type", coalesce(h.details, '') AS "Details", coalesce(h.analyst, '') AS "Analyst"
FROM finding_history h JOIN findings f ON h.finding_id = f.id""", HISTORY_VIEWS)
def finding_history_export(spark, sf_dir):
    path = work_dir(spark, "finding-history")
    tables.write_csv(tables.finding_history_export(*_views(spark, sf_dir, *HISTORY_VIEWS)), path)
    schema = ("finding_id BIGINT, Finding STRING, Application STRING, Severity STRING, `Current Status` STRING, "
              "Timestamp TIMESTAMP_NTZ, `Event Type` STRING, Details STRING, Analyst STRING")
    return tables.read_csv(spark, path, schema)


@query("application_history_export", f"""
SELECT event_ts AS "Timestamp", app_name AS "Application", finding_title AS "Finding", severity AS "Severity",
  event_type AS "Event Type", coalesce(details, '') AS "Details", coalesce(analyst, '') AS "Analyst", coalesce(file_path, '') AS "File Path"
FROM ({HISTORY_SQL}) x""", HISTORY_VIEWS)
def application_history_export(spark, sf_dir):
    path = work_dir(spark, "application-history")
    rows = rel.application_history(*_views(spark, sf_dir, *HISTORY_VIEWS), limit=None)
    tables.write_csv(tables.application_history_export(rows), path)
    schema = ("Timestamp TIMESTAMP_NTZ, Application STRING, Finding STRING, Severity STRING, `Event Type` STRING, "
              "Details STRING, Analyst STRING, `File Path` STRING")
    return tables.read_csv(spark, path, schema)


@query("append_findings", """
SELECT 'secret' AS kind, id, scan_id, app_name, severity, status FROM secret_findings UNION ALL
SELECT 'sca', id, scan_id, app_name, severity, status FROM sca_findings""", OPEN_VIEWS)
def append_findings(spark, sf_dir):
    """Both finding tables appended in two batches each, then read back."""
    root = work_dir(spark, "store")
    parts = []
    for table, kind in (("secret_findings", "secret"), ("sca_findings", "sca")):
        rows = fx.view(spark, sf_dir, table)
        for early in (True, False):
            tables.append_table(rows.where((F.col("scan_id") < 200) == F.lit(early)), root, table)
        parts.append(tables.read_table(spark, root, table).select(
            F.lit(kind).alias("kind"), "id", "scan_id", "app_name", "severity", "status"))
    return parts[0].unionByName(parts[1])


@query("append_scan_record", f"""
WITH {ROLLUP_SQL} SELECT 'scans' AS target, id, app_name, critical_count, high_count, medium_count, low_count FROM rolled
UNION ALL SELECT 'scan_results', id, app_name, critical_count, high_count, medium_count, low_count FROM rolled""", ROLLUP_VIEWS)
def append_scan_record(spark, sf_dir):
    root = work_dir(spark, "store")
    tables.append_scan_records(rollup(spark, sf_dir), root, _at(SCANS_AS_OF))
    columns = ("id", "app_name", "critical_count", "high_count", "medium_count", "low_count")
    parts = [tables.read_table(spark, root, t).select(F.lit(t).alias("target"), *columns) for t in ("scans", "scan_results")]
    return parts[0].unionByName(parts[1])
