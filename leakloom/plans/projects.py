"""Registered project profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom import catalog
from leakloom.operators import profile
from leakloom.plans import fixtures as fx
from leakloom.plans.registry import query, sql_list, sql_text


def _project_files(spark, sf_dir):
    return (fx.view(spark, sf_dir, "project_files")
            .unionByName(fx.view(spark, sf_dir, "code_files").select("app_name", "path")))


FILES_SQL = "files AS (SELECT app_name, path FROM project_files UNION ALL SELECT app_name, path FROM code_files)"
WALKED_SQL = f"""{FILES_SQL},
  walked AS (SELECT app_name, lower(regexp_extract(path, '[^/]*$')) AS name,
      lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext
    FROM files WHERE NOT list_has_any(string_split(path, '/')[1:-2], [{sql_list(catalog.PROFILE_SKIP_DIRS)}]))"""


def _marker_rows(markers: dict) -> str:
    rows = [f"({n}, {sql_text(owner)}, {sql_text(m)})" for n, (owner, ms) in enumerate(markers.items()) for m in ms]
    return "(VALUES " + ", ".join(rows) + ") AS t(ordinal, owner, marker)"


def _best_sql(hits: str, what: str) -> str:
    return f"""
  {what}_hits AS ({hits}),
  {what}_scores AS (SELECT app_name, owner, ordinal, sum(weight) AS score FROM {what}_hits GROUP BY ALL),
  {what}_best AS (SELECT app_name, arg_max(owner, score * 100 - ordinal) AS owner, max(score) AS score
    FROM {what}_scores GROUP BY app_name)"""


LANGUAGE_SQL = _best_sql(f"""
    SELECT DISTINCT app_name, owner, ordinal, marker, CASE WHEN marker LIKE '.%' THEN 1 ELSE 2 END AS weight
    FROM walked, {_marker_rows(catalog.LANGUAGE_MARKERS)}
    WHERE CASE WHEN marker LIKE '.%' THEN ext = marker ELSE name = lower(marker) END""", "language")
FRAMEWORK_SQL = _best_sql(f"""
    SELECT DISTINCT app_name, owner, ordinal, marker, 1 AS weight
    FROM walked, {_marker_rows(catalog.FRAMEWORK_MARKERS)}
    WHERE name = lower(marker) OR contains(name, marker)""", "framework")


@query("detect_language", f"""
WITH {WALKED_SQL}, {LANGUAGE_SQL}
SELECT w.app_name, coalesce(b.owner, 'unknown') AS language, cast(coalesce(b.score, 0) AS INTEGER) AS language_score
FROM (SELECT DISTINCT app_name FROM walked) w LEFT JOIN language_best b ON b.app_name = w.app_name""",
       ["code_files", "project_files"])
def detect_language(spark, sf_dir):
    return profile.language_and_framework(_project_files(spark, sf_dir)).select("app_name", "language", "language_score")


@query("detect_framework", f"""
WITH {WALKED_SQL}, {FRAMEWORK_SQL}
SELECT w.app_name, coalesce(b.owner, 'unknown') AS framework, cast(coalesce(b.score, 0) AS INTEGER) AS framework_score
FROM (SELECT DISTINCT app_name FROM walked) w LEFT JOIN framework_best b ON b.app_name = w.app_name""",
       ["code_files", "project_files"])
def detect_framework(spark, sf_dir):
    return profile.language_and_framework(_project_files(spark, sf_dir)).select(
        "app_name", "framework", "framework_score")


@query("profile_applications", f"""
WITH {WALKED_SQL}, {LANGUAGE_SQL}, {FRAMEWORK_SQL}, apps AS (
  SELECT id, name FROM applications UNION ALL SELECT 100000 + row_number() OVER (), app_name FROM (SELECT DISTINCT app_name FROM project_files) p)
SELECT a.name, coalesce(l.owner, 'unknown') AS language, coalesce(f.owner, 'unknown') AS framework
FROM apps a LEFT JOIN language_best l ON l.app_name = a.name LEFT JOIN framework_best f ON f.app_name = a.name""",
       ["code_files", "project_files", "applications"])
def profile_applications(spark, sf_dir):
    apps = fx.view(spark, sf_dir, "applications").select("name").unionByName(
        fx.view(spark, sf_dir, "project_files").select(F.col("app_name").alias("name")).distinct())
    return profile.profile_applications(apps, _project_files(spark, sf_dir)).select("name", "language", "framework")


def _manager_rows(names) -> str:
    rows = [f"({sql_text(m)}, {sql_text(f)})" for m in names for f in catalog.MANAGER_FILES[m]]
    return "(VALUES " + ", ".join(rows) + ") AS t(package_manager, file_name)"


@query("detect_package_managers", f"""
WITH {FILES_SQL} SELECT DISTINCT app_name, package_manager FROM files
JOIN {_manager_rows(catalog.MANAGER_FILES)} ON path = file_name""", ["code_files", "project_files"])
def detect_package_managers(spark, sf_dir):
    return profile.package_managers(_project_files(spark, sf_dir))


@query("scanned_package_managers", f"""
WITH {FILES_SQL} SELECT DISTINCT app_name, package_manager FROM files
JOIN {_manager_rows(catalog.SCANNED_MANAGERS)} ON path = file_name""", ["code_files", "project_files"])
def scanned_package_managers(spark, sf_dir):
    return profile.package_managers(_project_files(spark, sf_dir), only_scanned=True)


@query("requirements_file", f"""
WITH {FILES_SQL} SELECT app_name, coalesce(arg_min(path, ordinal) FILTER (WHERE ordinal IS NOT NULL), 'requirements.txt') AS requirements_file
FROM files LEFT JOIN (VALUES {", ".join(f"({n}, {sql_text(f)})" for n, f in enumerate(catalog.MANAGER_FILES["pip"]))}) AS t(ordinal, file_name)
  ON path = file_name GROUP BY app_name""", ["code_files", "project_files"])
def requirements_file(spark, sf_dir):
    return profile.requirements_file(_project_files(spark, sf_dir))
