"""Findings-shaped views over the given tables, in SQL both engines accept.

Tokens: {sha256}(k), {b64}(x) and {ts} differ between Spark and DuckDB; a table
is written {t:name}.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leakloom.session import spread

# Findings by order line; {scan} is the number of the scan that has an order's lines.
_FINDINGS = """
SELECT l_orderkey * 10 + l_linenumber AS id, scan AS scan_id, {app}(scan) AS app_name,
  CASE rf WHEN 0 THEN 'secret' WHEN 1 THEN 'dependency' ELSE 'vulnerability' END AS finding_type,
  CASE q % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'moderate' END AS severity,
  concat('T', cast(p % 5 AS string)) AS title, concat('/src/m', cast(p % 4 AS string), '.js') AS file_path,
  p % 2 AS line_number, concat('snip ', cast(p % 6 AS string)) AS code_snippet,
  CASE WHEN p % 3 = 0 THEN NULL ELSE concat('CVE-2024-', cast(p % 5 AS string)) END AS cve_id,
  CASE WHEN s % 7 = 0 THEN NULL ELSE concat('c', cast(s % 3 AS string)) END AS component,
  CASE q % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'resolved' ELSE 'archived' END AS status,
  q % 10 = 0 AS is_false_positive, d AS created_at
FROM (SELECT l_orderkey, l_linenumber, {scan} AS scan, min(l_partkey) AS p, min(l_suppkey) AS s, cast(min(l_quantity) AS int) AS q,
    min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS rf, min(l_shipdate) AS d FROM {t:lineitem} GROUP BY l_orderkey, l_linenumber) u"""
_BLOCK = "cast(floor(l_orderkey / 30) AS bigint)"

VIEWS = {
    "code_files": """
SELECT doc_id AS file_id, source AS app_name,
  concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' ELSE 'src/' END, lang, '/f', cast(doc_id AS string),
    CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.java' WHEN 3 THEN '.json'
      WHEN 4 THEN '.PY' WHEN 5 THEN '.png' WHEN 6 THEN '.md' ELSE '' END) AS path,
  CASE WHEN doc_id % 97 = 0 THEN 10485761 ELSE n_chars END AS length,
  concat(text, chr(10), CASE doc_id % 13
    WHEN 0 THEN concat('id = AKIA', upper(substr(md5(k), 1, 16)))
    WHEN 1 THEN concat('aws_secret_access_key = ', chr(34), substr({sha256}(k), 1, 40), chr(34))
    WHEN 2 THEN concat('API-KEY: ', md5(k))
    WHEN 3 THEN concat('url = postgresql://u:', substr(md5(k), 1, 8), '@db.local/x')
    WHEN 4 THEN concat('jwt eyJ', md5(k), '.eyJ', md5(k), '.', md5(k))
    WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----'
    WHEN 6 THEN '-----BEGIN OPENSSH PRIVATE KEY-----'
    WHEN 7 THEN concat('gh ghp_', substr({sha256}(k), 1, 36))
    WHEN 8 THEN concat('slack xoxb-', substr(md5(k), 1, 12))
    WHEN 9 THEN concat('password = ', chr(39), substr(md5(k), 1, 10), chr(39), ' pwd: ', chr(34), md5(k), chr(34))
    WHEN 10 THEN concat('blob = ', chr(34), {b64}(unhex({sha256}(k))), chr(34))
    WHEN 11 THEN concat('pwd: ', chr(34), 'abc', chr(34))
    ELSE concat('v = ', chr(34), 'test', {b64}(unhex({sha256}(k))), chr(34)) END) AS text
FROM (SELECT *, cast(doc_id AS string) AS k FROM {t:documents}) d""",
    "project_files": """
SELECT concat('proj', cast(doc_id % 40 AS string)) AS app_name,
  CASE doc_id % 29
    WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'pom.xml'
    WHEN 3 THEN 'build.gradle' WHEN 4 THEN 'sub/package.json' WHEN 5 THEN 'setup.py'
    WHEN 6 THEN 'Pipfile' WHEN 7 THEN 'yarn.lock' WHEN 8 THEN 'web/MyApp.py'
    WHEN 9 THEN 'src/App.js' WHEN 10 THEN 'server.js' WHEN 11 THEN 'Gemfile'
    WHEN 12 THEN 'lib/artisan' WHEN 13 THEN 'go.mod' WHEN 14 THEN 'cmd/main.go'
    WHEN 15 THEN 'native/CMakeLists.txt' WHEN 16 THEN 'native/x.hpp' WHEN 17 THEN 'ios/App.swift'
    WHEN 18 THEN 'venv/lib/manage.py' WHEN 19 THEN 'site/manage.py' WHEN 20 THEN 'angular.json'
    WHEN 21 THEN 'pyproject.toml' WHEN 22 THEN 'x.csproj' WHEN 23 THEN 'Cargo.toml'
    WHEN 24 THEN '.env' WHEN 25 THEN 'build.gradle.kts' WHEN 26 THEN 'docs/readme.txt'
    ELSE concat('src/', lang, '/f', cast(doc_id AS string), CASE doc_id % 3 WHEN 0 THEN '.rb' WHEN 1 THEN '.ts' ELSE '.C' END)
  END AS path
FROM {t:documents}""",
    "applications": """
SELECT s_suppkey AS id, concat('app', cast(s_suppkey AS string)) AS name, 'github' AS repo_type, n_name AS team,
  CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS criticality,
  CASE WHEN s_acctbal < 0 THEN 'archived' ELSE 'active' END AS status,
  {ts} '2024-01-01 00:00:00' + INTERVAL '1' DAY * s_suppkey AS created_at
FROM {t:supplier} JOIN {t:nation} ON s_nationkey = n_nationkey""",
    "scans": """
SELECT scan AS id, {app}(scan) AS app_name,
  CASE scan % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'secrets' ELSE 'sca' END AS scan_type,
  CASE scan % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'completed' END AS status, started_at
FROM (SELECT cast(floor(o_orderkey / 30) AS bigint) AS scan, min(o_orderdate) AS started_at FROM {t:orders} GROUP BY 1) s""",
    "findings": _FINDINGS.replace("{scan}", _BLOCK),
    # Each finding is seen by two of 400 scans: that of its order and that of its block of 30 orders.
    "rescanned_findings": f"""{_FINDINGS.replace("{scan}", "l_orderkey % 400")}
UNION ALL{_FINDINGS.replace("{scan}", f"{_BLOCK} % 400")}""",
    "secret_findings": """
SELECT id, scan_id, app_name, file_path, line_number, title AS pattern_name, 'regex' AS pattern_type, severity,
  (id % 10) / 10.0e0 AS confidence, substr({sha256}(code_snippet), 1, 16) AS secret_hash, status,
  concat('rotate ', title) AS remediation, created_at
FROM ({v:findings}) f WHERE finding_type = 'secret'""",
    "sca_findings": """
SELECT id, scan_id, app_name, CASE id % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip' ELSE 'maven' END AS package_manager,
  component AS package_name, concat('1.', cast(id % 7 AS string)) AS current_version, cve_id, severity,
  (id % 100) / 10.0e0 AS cvss_score, file_path, status, 'update ' || component AS remediation, created_at
FROM ({v:findings}) f WHERE finding_type <> 'secret'""",
    "finding_history": """
SELECT event_id AS id, (event_id % 14000) * 10 + 1 AS finding_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'false_positive' WHEN 'click' THEN 'status_change'
    WHEN 'view' THEN 'comment_added' ELSE 'resolved' END AS event_type,
  props AS details, concat('user', cast(user_id AS string)) AS analyst, ts AS event_ts FROM {t:events}""",
    "false_positive_patterns": """
SELECT * FROM (VALUES ('app1','file_path','/src/m1'),(NULL,'component','c2'),('app3','code_pattern','snip 4'),
  ('app5','file_path','')) AS t(app_name, pattern_type, pattern_value)""",
}

_SPARK = {"sha256": "sha256_hex", "b64": "base64", "ts": "TIMESTAMP_NTZ"}
_DUCK = {"sha256": "sha256", "b64": "to_base64", "ts": "TIMESTAMP"}


#: Scans, and the applications they are of, grow with the table: twenty applications have the first 400 scans, then each has 20.
_APP = r"concat('app', cast(cast(CASE WHEN \1 < 400 THEN \1 % 20 ELSE 20 + floor((\1 - 400) / 20) END AS bigint) AS string))"


def _nested(sql: str) -> str:
    sql = re.sub(r"\{app\}\((\w+)\)", _APP, sql)
    return re.sub(r"\{v:(\w+)\}", lambda m: _nested(VIEWS[m.group(1)]), sql)


def _fill(sql: str, tokens: dict, table) -> str:
    sql = re.sub(r"\{t:(\w+)\}", lambda m: table(m.group(1)), _nested(sql))
    for token, value in tokens.items():
        sql = sql.replace("{" + token + "}", value)
    return re.sub(r"sha256_hex\((\w+)\)", r"sha2(\1, 256)", sql)


def spark_sql(sql: str, sf_dir: str) -> str:
    """Statement text over the parquet files of one scale folder."""
    return _fill(sql, _SPARK, lambda name: f"parquet.`{sf_dir.rstrip('/')}/{name}.parquet`")


def duck_sql(sql: str) -> str:
    return _fill(sql, _DUCK, lambda name: name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a frame. Findings group `lineitem` by key, so it is spread by that key if it has few splits."""
    if "{t:lineitem}" not in _nested(VIEWS[name]):
        return spark.sql(spark_sql(VIEWS[name], sf_dir))
    sql = spark_sql(VIEWS[name].replace("{v:findings}", VIEWS["findings"]).replace("{t:lineitem}", "{lineitem}"), sf_dir)
    return spark.sql(sql, lineitem=spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files to scan, spread over the cores because scanning is CPU-bound."""
    return spread(view(spark, sf_dir, "code_files"), "file_id")


def write_tree(files: DataFrame, root: str) -> None:
    """Write rows (app_name, path, text) as files of those names below `root`, in tasks."""
    uri = root if "://" in root else "file://" + root

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for app, path, text in zip(batch["app_name"], batch["path"], batch["text"]):
                target = f"{base}/{app}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(text.encode())
            yield batch[["path"]].iloc[:0]

    files.select("app_name", "path", "text").mapInPandas(write, "path string").count()


def with_views(names: list[str], sql: str) -> str:
    """DuckDB statement with the named views in front."""
    ctes = ",\n".join(f"{name} AS ({duck_sql(VIEWS[name])})" for name in names)
    sql = duck_sql(sql).strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
