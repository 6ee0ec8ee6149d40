"""Registered report normalisation queries.

The Spark side builds report texts from `part` and parses them; the SQL twin
computes the expected columns straight from `part`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.functions import scoring
from leakloom.operators import profile, runs, sca
from leakloom.plans import fixtures as fx
from leakloom.plans.detection import HITS_SQL
from leakloom.plans.registry import query
from leakloom.session import work_dir
from leakloom.sources import reports as source

# Columns both engines derive from `part` in the same way.
PART_SQL = """
SELECT p_partkey AS k, p_name AS pkg, p_size AS size,
  concat('app', cast(p_partkey % 50 AS string)) AS app_name,
  concat('/repos/app', cast(p_partkey % 50 AS string)) AS directory,
  concat('1.', cast(p_size AS string), '.0') AS version,
  concat('CVE-2024-', cast(p_partkey % 997 AS string)) AS cve,
  CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' WHEN 3 THEN 'LOW'
    WHEN 4 THEN 'info' ELSE 'odd' END AS sev,
  (p_size % 100) / 10.0e0 AS score,
  CASE WHEN p_partkey % 3 = 0 THEN 'PYSEC-1' ELSE concat('CVE-2024-', cast(p_partkey % 997 AS string)) END AS vuln
FROM {t:part}"""

# Report texts by kind; Spark only. Every case of the format has its own remainder of k.
REPORT_SQL = {
    "npm": """
CASE k % 9
  WHEN 0 THEN concat('{"vulnerabilities":{"', pkg, '":{"severity":"', sev, '","range":"<', version, '","via":["other"]}}}')
  WHEN 1 THEN concat('{"vulnerabilities":{"', pkg, '":{"severity":"', sev, '","range":"<', version,
    '","via":["other",{"cve":["', cve, '","CVE-2020-1"]},{"title":"x"}]},"extra":{"via":[]}}}')
  WHEN 2 THEN concat('{"vulnerabilities":{"', pkg, '":{"severity":null,"via":[{"cve":"', cve, '"}]}}}')
  WHEN 3 THEN concat('{"vulnerabilities":{"', pkg, '":{"severity":"', sev, '"}},"advisories":{"1":{"module_name":"unused"}}}')
  WHEN 4 THEN concat('{"advisories":{"7":{"module_name":"', pkg, '","severity":"', sev, '","cve":"', cve,
    '","vulnerable_versions":"<', version, '","patched_versions":">=', version, '","cvss":{"score":', cast(score AS string),
    '},"title":"T ', pkg, '","recommendation":"R ', pkg, '"}}}')
  WHEN 5 THEN concat('{"advisories":{"7":{"module_name":"', pkg, '","severity":"', sev, '"},"8":{}}}')
  WHEN 6 THEN '{"metadata":{}}'
  WHEN 7 THEN concat('{"vulnerabilities":{"', pkg, '":')
  ELSE '{"vulnerabilities":{}}' END""",
    "safety": """
CASE k % 4
  WHEN 0 THEN concat('[{"package":"', pkg, '","installed_version":"', version, '","vulnerable_spec":"<', version,
    '","safe_version":"9.9","vulnerability_id":"', vuln, '","advisory":"A ', pkg, '"}]')
  WHEN 1 THEN concat('[{"package":"', pkg, '","vulnerability_id":"', vuln, '"},{}]')
  WHEN 2 THEN '[]'
  ELSE 'not json' END""",
    "pip_audit": """
CASE k % 4
  WHEN 0 THEN concat('{"vulnerabilities":[{"package":"', pkg, '","installed_version":"', version, '","vulnerable_spec":"<',
    version, '","fix_versions":["2.0","3.0"],"id":"', vuln, '","description":"D ', pkg, '"}]}')
  WHEN 1 THEN concat('{"vulnerabilities":[{"package":"', pkg, '","fix_versions":[],"id":"', vuln, '"},{}]}')
  WHEN 2 THEN '{}'
  ELSE '{"vulnerabilities":[' END""",
    "dependency_check": """
CASE k % 4
  WHEN 0 THEN concat('{"dependencies":[{"fileName":"', replace(pkg, ' ', '-'), '-', version, '.jar","vulnerabilities":[{"name":"', cve,
    '","severity":"', upper(sev), '","cvssv3":{"baseScore":', cast(score AS string), '},"description":"D ', pkg, '"},{"name":"CVE-2020-2"}]},{"fileName":"clean.jar"}]}')
  WHEN 1 THEN concat('{"dependencies":[{"fileName":"lib-', version, '-RC1.jar","vulnerabilities":[{}]},{"vulnerabilities":[{"severity":"', sev, '"}]}]}')
  WHEN 2 THEN '{"dependencies":[]}'
  ELSE '[' END""",
}


def _reports(spark, sf_dir, kind):
    sql = f"SELECT app_name, directory, {REPORT_SQL[kind]} AS report FROM ({PART_SQL})"
    return spark.sql(fx.spark_sql(sql, sf_dir))


CVSS_SQL = """CASE lower({0}) WHEN 'critical' THEN 9.0 WHEN 'high' THEN 7.5 WHEN 'moderate' THEN 5.0 WHEN 'medium' THEN 5.0
  WHEN 'low' THEN 2.5 WHEN 'info' THEN 1.0 ELSE 0.0 END::DOUBLE"""
_PARTS = f"p AS ({PART_SQL})"

NPM_V7_SQL = f"""
SELECT app_name, 'npm' AS package_manager, pkg AS package_name, rng AS current_version, rng AS vulnerable_version,
  'See npm audit fix' AS fixed_version, ids AS cve_id, s AS severity, {CVSS_SQL.format('s')} AS cvss_score,
  concat('Vulnerability in ', pkg) AS description,
  concat('Run ''npm audit fix'' or update ', pkg, ' to a secure version') AS remediation,
  concat(directory, '/package.json') AS file_path
FROM (
  SELECT app_name, directory, pkg, CASE WHEN k % 9 IN (0, 1) THEN concat('<', version) ELSE 'unknown' END AS rng,
    CASE WHEN k % 9 = 2 THEN 'unknown' ELSE sev END AS s,
    CASE k % 9 WHEN 1 THEN concat(cve, ', CVE-2020-1') WHEN 2 THEN cve ELSE 'N/A' END AS ids
  FROM p WHERE k % 9 IN (0, 1, 2, 3)
  UNION ALL SELECT app_name, directory, 'extra', 'unknown', 'unknown', 'N/A' FROM p WHERE k % 9 = 1) x"""

NPM_V6_SQL = f"""
SELECT app_name, 'npm' AS package_manager, pkg AS package_name, rng AS current_version, rng AS vulnerable_version,
  patched AS fixed_version, ids AS cve_id, s AS severity, coalesce(sc, {CVSS_SQL.format('s')}) AS cvss_score,
  coalesce(t, concat('Vulnerability in ', pkg)) AS description,
  coalesce(r, concat('Update ', pkg, ' to a secure version')) AS remediation,
  concat(directory, '/package.json') AS file_path
FROM (
  SELECT app_name, directory, pkg, concat('<', version) AS rng, concat('>=', version) AS patched, cve AS ids, sev AS s,
    score AS sc, concat('T ', pkg) AS t, concat('R ', pkg) AS r FROM p WHERE k % 9 = 4
  UNION ALL SELECT app_name, directory, pkg, 'unknown', 'unknown', 'N/A', sev, NULL, NULL, NULL FROM p WHERE k % 9 = 5
  UNION ALL SELECT app_name, directory, 'unknown', 'unknown', 'unknown', 'N/A', 'unknown', NULL, NULL, NULL FROM p WHERE k % 9 = 5) x"""

_ID_SEVERITY = "CASE WHEN contains(coalesce(id, ''), 'CVE') THEN 'high' ELSE 'medium' END"
SAFETY_SQL = f"""
SELECT app_name, 'pip' AS package_manager, coalesce(pkg, 'unknown') AS package_name, coalesce(v, 'unknown') AS current_version,
  coalesce(spec, 'unknown') AS vulnerable_version, coalesce(safe, 'See advisory') AS fixed_version, coalesce(id, 'N/A') AS cve_id,
  {_ID_SEVERITY} AS severity, 0.0::DOUBLE AS cvss_score, coalesce(d, 'Python package vulnerability') AS description,
  concat('Update ', coalesce(pkg, 'package'), ' to version ', coalesce(safe, 'latest')) AS remediation,
  concat(directory, '/requirements.txt') AS file_path
FROM (
  SELECT app_name, directory, pkg, version AS v, concat('<', version) AS spec, '9.9' AS safe, vuln AS id, concat('A ', pkg) AS d
  FROM p WHERE k % 4 = 0
  UNION ALL SELECT app_name, directory, pkg, NULL, NULL, NULL, vuln, NULL FROM p WHERE k % 4 = 1
  UNION ALL SELECT app_name, directory, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 4 = 1) x"""

PIP_AUDIT_SQL = f"""
SELECT app_name, 'pip' AS package_manager, coalesce(pkg, 'unknown') AS package_name, coalesce(v, 'unknown') AS current_version,
  coalesce(spec, 'unknown') AS vulnerable_version, coalesce(fix, 'See advisory') AS fixed_version, coalesce(id, 'N/A') AS cve_id,
  {_ID_SEVERITY} AS severity, 0.0::DOUBLE AS cvss_score, coalesce(d, 'Python package vulnerability') AS description,
  concat('Update ', coalesce(pkg, 'package'), ' to a secure version') AS remediation,
  concat(directory, '/requirements.txt') AS file_path
FROM (
  SELECT app_name, directory, pkg, version AS v, concat('<', version) AS spec, '2.0' AS fix, vuln AS id, concat('D ', pkg) AS d
  FROM p WHERE k % 4 = 0
  UNION ALL SELECT app_name, directory, pkg, NULL, NULL, NULL, vuln, NULL FROM p WHERE k % 4 = 1
  UNION ALL SELECT app_name, directory, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 4 = 1) x"""

DEPENDENCY_CHECK_SQL = """
SELECT app_name, 'maven' AS package_manager, coalesce(file, 'unknown') AS package_name, v AS current_version,
  'unknown' AS vulnerable_version, 'See advisory' AS fixed_version, coalesce(id, 'N/A') AS cve_id,
  lower(coalesce(s, 'unknown')) AS severity, coalesce(sc, 0.0)::DOUBLE AS cvss_score,
  coalesce(d, 'Maven dependency vulnerability') AS description,
  'Update dependency to a secure version' AS remediation, concat(directory, '/pom.xml') AS file_path
FROM (
  SELECT app_name, directory, concat(replace(pkg, ' ', '-'), '-', version, '.jar') AS file, version AS v, cve AS id, sev AS s,
    score AS sc, concat('D ', pkg) AS d FROM p WHERE k % 4 = 0
  UNION ALL SELECT app_name, directory, concat(replace(pkg, ' ', '-'), '-', version, '.jar'), version, 'CVE-2020-2', NULL, NULL, NULL
    FROM p WHERE k % 4 = 0
  UNION ALL SELECT app_name, directory, concat('lib-', version, '-RC1.jar'), concat(version, '-RC1'), NULL, NULL, NULL, NULL FROM p WHERE k % 4 = 1
  UNION ALL SELECT app_name, directory, NULL, 'unknown', NULL, sev, NULL, NULL FROM p WHERE k % 4 = 1) x"""


@query("normalize_npm_v7", f"WITH {_PARTS} {NPM_V7_SQL}")
def normalize_npm_v7(spark, sf_dir):
    return sca.normalize_npm_v7(_reports(spark, sf_dir, "npm"))


@query("normalize_npm_v6", f"WITH {_PARTS} {NPM_V6_SQL}")
def normalize_npm_v6(spark, sf_dir):
    return sca.normalize_npm_v6(_reports(spark, sf_dir, "npm"))


@query("normalize_safety", f"WITH {_PARTS} {SAFETY_SQL}")
def normalize_safety(spark, sf_dir):
    return sca.normalize_safety(_reports(spark, sf_dir, "safety"))


@query("normalize_pip_audit", f"WITH {_PARTS} {PIP_AUDIT_SQL}")
def normalize_pip_audit(spark, sf_dir):
    return sca.normalize_pip_audit(_reports(spark, sf_dir, "pip_audit"))


@query("normalize_dependency_check", f"WITH {_PARTS} {DEPENDENCY_CHECK_SQL}")
def normalize_dependency_check(spark, sf_dir):
    return sca.normalize_dependency_check(_reports(spark, sf_dir, "dependency_check"))


@query("severity_to_cvss", f"WITH {_PARTS} SELECT k, sev AS severity, {CVSS_SQL.format('sev')} AS cvss_score FROM p")
def severity_to_cvss(spark, sf_dir):
    parts = spark.sql(fx.spark_sql(PART_SQL, sf_dir))
    return parts.select("k", F.col("sev").alias("severity"), scoring.severity_to_cvss(F.col("sev")).alias("cvss_score"))


@query("cve_severity", f"""
WITH {_PARTS} SELECT k, vuln, CASE WHEN contains(vuln, 'CVE') THEN 'high' ELSE 'medium' END AS severity FROM p""")
def cve_severity(spark, sf_dir):
    parts = spark.sql(fx.spark_sql(PART_SQL, sf_dir))
    return parts.select("k", "vuln", scoring.id_severity(F.col("vuln")).alias("severity"))


JAR_SQL = """CASE k % 4 WHEN 0 THEN concat(replace(pkg, ' ', '-'), '-', version, '.jar') WHEN 1 THEN concat('lib-', version, '-RC1.jar')
  WHEN 2 THEN concat(replace(pkg, ' ', '_'), '.jar') ELSE concat('a-b-', cast(k AS string), '.war') END"""


@query("jar_version", f"""
WITH {_PARTS} SELECT k, coalesce(nullif(regexp_extract({JAR_SQL}, '-(\\d+(?:\\.\\d+)*(?:-[A-Za-z0-9]+)?)', 1), ''), 'unknown') AS version
FROM p""")
def jar_version(spark, sf_dir):
    parts = spark.sql(fx.spark_sql(f"SELECT k, {JAR_SQL} AS jar FROM ({PART_SQL})", sf_dir))
    return parts.select("k", sca.jar_version(F.col("jar")).alias("version"))


# Which application has safety reports: pip-audit is used only where there are none.
_SAFETY_APPS = "k % 50 < 30"
_UNION_SQL = f"""
WITH {_PARTS}, py AS (SELECT * FROM p), safety_p AS (SELECT * FROM p WHERE {_SAFETY_APPS}), audit_p AS (SELECT * FROM p WHERE NOT ({_SAFETY_APPS}))
SELECT * FROM ({NPM_V7_SQL}) UNION ALL SELECT * FROM ({NPM_V6_SQL})
UNION ALL SELECT * FROM ({SAFETY_SQL.replace(" FROM p", " FROM safety_p").replace("FROM p WHERE", "FROM safety_p WHERE")})
UNION ALL SELECT * FROM ({PIP_AUDIT_SQL.replace(" FROM p", " FROM audit_p").replace("FROM p WHERE", "FROM audit_p WHERE")})
UNION ALL SELECT * FROM ({DEPENDENCY_CHECK_SQL})"""


def _safety_reports(spark, sf_dir):
    sql = f"SELECT app_name, directory, {REPORT_SQL['safety']} AS report FROM ({PART_SQL}) WHERE {_SAFETY_APPS}"
    return spark.sql(fx.spark_sql(sql, sf_dir))


@query("sca_union", _UNION_SQL)
def sca_union(spark, sf_dir):
    return sca.normalize_all(
        npm=_reports(spark, sf_dir, "npm"),
        safety=_safety_reports(spark, sf_dir),
        pip_audit=_reports(spark, sf_dir, "pip_audit"),
        dependency_check=_reports(spark, sf_dir, "dependency_check"),
    )


@query("prefer_scanner", f"""
WITH {_PARTS}, reports AS (SELECT app_name, CASE WHEN {_SAFETY_APPS} THEN 'safety' ELSE 'pip-audit' END AS scanner FROM p)
SELECT app_name, scanner, count(*) AS reports FROM reports GROUP BY ALL""")
def prefer_scanner(spark, sf_dir):
    safety = _safety_reports(spark, sf_dir).withColumn("scanner", F.lit("safety"))
    audit = _reports(spark, sf_dir, "pip_audit").withColumn("scanner", F.lit("pip-audit"))
    return sca.prefer_safety(safety, audit).groupBy("app_name", "scanner").agg(F.count("*").alias("reports"))


@query("report_rejects", f"""
WITH {_PARTS} SELECT app_name, kind, count(*) AS rejected FROM (
  SELECT app_name, 'npm' AS kind FROM p WHERE k % 9 = 7 UNION ALL SELECT app_name, 'safety' FROM p WHERE k % 4 = 3
  UNION ALL SELECT app_name, 'pip_audit' FROM p WHERE k % 4 = 3 UNION ALL SELECT app_name, 'dependency_check' FROM p WHERE k % 4 = 3) x
GROUP BY ALL""")
def report_rejects(spark, sf_dir):
    found = None
    for kind in REPORT_SQL:
        part = source.rejects(_reports(spark, sf_dir, kind)).select("app_name", F.lit(kind).alias("kind"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("app_name", "kind").agg(F.count("*").alias("rejected"))


@query("python_findings_located", f"""
WITH {_PARTS}, files AS (SELECT app_name, path FROM project_files),
req AS (SELECT app_name, coalesce(arg_min(path, ordinal) FILTER (WHERE ordinal IS NOT NULL), 'requirements.txt') AS requirements_file
  FROM files LEFT JOIN (VALUES (0, 'requirements.txt'), (1, 'Pipfile'), (2, 'pyproject.toml'), (3, 'setup.py')) AS t(ordinal, file_name)
  ON path = file_name GROUP BY app_name),
expected AS ({PIP_AUDIT_SQL})
SELECT e.app_name, package_name, cve_id, replace(file_path, 'requirements.txt', coalesce(requirements_file, 'requirements.txt')) AS file_path
FROM expected e LEFT JOIN req ON replace(req.app_name, 'proj', 'app') = e.app_name""", ["project_files"])
def python_findings_located(spark, sf_dir):
    files = fx.view(spark, sf_dir, "project_files").withColumn("app_name", F.regexp_replace("app_name", "^proj", "app"))
    found = sca.normalize_pip_audit(_reports(spark, sf_dir, "pip_audit"), profile.requirements_file(files))
    return found.select("app_name", "package_name", "cve_id", "file_path")


_RUN_SQL = f"""
apps AS (SELECT DISTINCT app_name FROM (SELECT app_name FROM code_files UNION SELECT name FROM applications) x
  WHERE app_name IN (SELECT app_name FROM code_files) OR app_name IN (SELECT app_name FROM p)),
v AS (SELECT app_name, severity FROM ({_UNION_SQL})),
every AS (SELECT app_name, severity, 'secret' AS kind FROM found UNION ALL SELECT app_name, severity, 'sca' FROM v)
SELECT apps.app_name, 'full' AS scan_type, 'completed' AS status, count(*) FILTER (WHERE kind = 'secret') AS secrets_found,
  count(*) FILTER (WHERE kind = 'sca') AS vulnerabilities_found, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
  count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
  count(*) FILTER (WHERE severity = 'low') AS low_count
FROM apps LEFT JOIN every ON every.app_name = apps.app_name GROUP BY apps.app_name"""


@query("scan_run", f"WITH {HITS_SQL}, {_PARTS}, {_RUN_SQL}", ["code_files", "applications"])
def scan_run(spark, sf_dir):
    """A full run over all applications, read back from the store it fills."""
    files = fx.code_files(spark, sf_dir)
    apps = (files.select(F.col("app_name").alias("name")).distinct()
            .union(fx.view(spark, sf_dir, "applications").select("name")))
    reports = {"npm": _reports(spark, sf_dir, "npm"), "safety": _safety_reports(spark, sf_dir),
               "pip_audit": _reports(spark, sf_dir, "pip_audit"),
               "dependency_check": _reports(spark, sf_dir, "dependency_check")}
    now = F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'")
    done = runs.run_scan(spark, apps, files, reports, work_dir(spark, "store"), now)
    return done.select("app_name", "scan_type", "status", "secrets_found", "vulnerabilities_found", "critical_count",
                       "high_count", "medium_count", "low_count")


_BAD_SQL = "SELECT app_name, min(concat(path, ': unreadable')) AS error_message FROM code_files WHERE app_name = 'src3' AND file_id % 5 = 0 GROUP BY 1"
_FAILED_SQL = (_RUN_SQL.replace("'completed' AS status", "CASE WHEN max(error_message) IS NULL THEN 'completed' ELSE 'failed' END AS status, max(error_message) AS error_message")
               .replace("every.app_name = apps.app_name GROUP", "every.app_name = apps.app_name AND apps.app_name NOT IN (SELECT app_name FROM bad) LEFT JOIN bad ON bad.app_name = apps.app_name GROUP"))


@query("failed_scan_run", f"WITH {HITS_SQL}, {_PARTS}, bad AS ({_BAD_SQL}), {_FAILED_SQL}", ["code_files", "applications"])
def failed_scan_run(spark, sf_dir):
    """A full run in which some files of one application can't be read: its record fails, the others are complete."""
    unreadable = F.when((F.col("app_name") == "src3") & (F.col("file_id") % 5 == 0), F.concat("path", F.lit(": unreadable")))
    files = fx.code_files(spark, sf_dir).withColumn("error", unreadable)
    apps = (files.select(F.col("app_name").alias("name")).distinct()
            .union(fx.view(spark, sf_dir, "applications").select("name")))
    reports = {"npm": _reports(spark, sf_dir, "npm"), "safety": _safety_reports(spark, sf_dir),
               "pip_audit": _reports(spark, sf_dir, "pip_audit"),
               "dependency_check": _reports(spark, sf_dir, "dependency_check")}
    done = runs.run_scan(spark, apps, files, reports, work_dir(spark, "store"), F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'"))
    return done.select("app_name", "scan_type", "status", "error_message", "secrets_found", "vulnerabilities_found", "critical_count",
                       "high_count", "medium_count", "low_count")


@query("lifecycle_run", f"""
WITH {HITS_SQL},
one AS (SELECT DISTINCT app_name, path, line_number, pattern_name FROM found WHERE file_id % 3 <> 0),
two AS (SELECT DISTINCT app_name, path, line_number, pattern_name FROM found WHERE file_id % 5 <> 0),
apps AS (SELECT app_name FROM code_files WHERE file_id % 3 <> 0 INTERSECT SELECT app_name FROM code_files WHERE file_id % 5 <> 0),
n AS (SELECT apps.app_name, count(*) FILTER (WHERE one.path IS NULL AND two.path IS NOT NULL) AS new_findings,
    count(*) FILTER (WHERE two.path IS NULL AND one.path IS NOT NULL) AS resolved_findings,
    count(*) FILTER (WHERE one.path IS NOT NULL AND two.path IS NOT NULL) AS persistent_findings
  FROM apps LEFT JOIN (one FULL JOIN two USING (app_name, path, line_number, pattern_name)) USING (app_name) GROUP BY 1)
SELECT app_name, new_findings, resolved_findings, persistent_findings,
  CASE WHEN resolved_findings + persistent_findings > 0 THEN resolved_findings / (resolved_findings + persistent_findings) * 100.0e0
    WHEN new_findings = 0 THEN 100.0e0 ELSE 0.0e0 END AS remediation_score FROM n""", ["code_files"])
def lifecycle_run(spark, sf_dir):
    """Two runs on one store, over different files: what the second one's comparison with the first says."""
    files, root = fx.code_files(spark, sf_dir), work_dir(spark, "store")
    apps = files.select(F.col("app_name").alias("name")).distinct()
    for day, kept in ((1, "file_id % 3 <> 0"), (2, "file_id % 5 <> 0")):
        now = F.expr(f"TIMESTAMP_NTZ '2024-03-0{day} 00:00:00'")
        compared = runs.lifecycle_run(spark, apps, files.where(kept), {}, root, now, scan_type="secrets")
    return compared.select("app_name", "new_findings", "resolved_findings", "persistent_findings", "remediation_score")
