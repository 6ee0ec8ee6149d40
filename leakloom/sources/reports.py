"""Dependency-audit reports: JSON text in, one row per vulnerability out.

Input rows are (app_name, directory, report). Reports are read with schemas, level
by level, so neither their size nor repeated keys matter: as in most JSON readers the
last of equal keys counts. Entries that are not objects are set aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ORIGIN = ("app_name", "directory")
KINDS = ("npm", "safety", "pip_audit", "dependency_check")

_OPTIONS = {"maxStringLen": str(2**31 - 1), "maxNestingDepth": "10000"}
_NPM = ("severity string, range string, via array<string>, module_name string, cve string, vulnerable_versions string, "
        "patched_versions string, cvss struct<score: string>, title string, recommendation string")
_SAFETY = ("package string, installed_version string, vulnerable_spec string, safe_version string, "
           "vulnerability_id string, advisory string")
_PIP_AUDIT = ("package string, installed_version string, vulnerable_spec string, fix_versions array<string>, "
              "id string, description string")
_DEPENDENCY = "fileName string, vulnerabilities array<string>"
_DEPENDENCY_CHECK = "name string, severity string, cvssv3 struct<baseScore: string>, description string"


def read_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, _OPTIONS)


def _members(text: Column) -> Column:
    """Members of an object as (key, value) in order, values as JSON text; null for anything else."""
    return F.map_entries(read_json(text, "map<string,string>"))


def _member(text: Column, key: str) -> Column:
    """Value of the last member of that name."""
    named = F.filter(_members(text), lambda m: m["key"] == key)
    return F.try_element_at(named, F.lit(-1))["value"]


def _unique(members: Column) -> Column:
    """Members without those that a later one of the same name replaces."""
    keys = F.transform(members, lambda m: m["key"])
    backwards = F.reverse(keys)
    latest = F.filter(members, lambda m, i: F.array_position(backwards, m["key"]) == F.size(keys) - i)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), members).otherwise(latest)


def is_object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))


def rejects(reports: DataFrame) -> DataFrame:
    """Reports that are neither a JSON object nor a JSON list."""
    readable = read_json(F.col("report"), "map<string,string>").isNotNull() | read_json(F.col("report"), "array<string>").isNotNull()
    return reports.where(~readable)


def npm_entries(reports: DataFrame) -> DataFrame:
    """Members of `vulnerabilities`, or of `advisories` where a report has no `vulnerabilities`: one parse for both."""
    found = reports.withColumn("_top", _members(F.col("report")))
    at = lambda key: F.try_element_at(F.filter("_top", lambda m: m["key"] == key), F.lit(-1))["value"]
    found = found.select(*ORIGIN, at("vulnerabilities").alias("_new"), at("advisories").alias("_old"))
    members = F.when(F.col("_new").isNotNull(), _unique(_members(F.col("_new")))).otherwise(_unique(_members(F.col("_old"))))
    return (found.select(*ORIGIN, F.when(F.col("_new").isNotNull(), 7).otherwise(6).alias("version"), F.explode(members).alias("_m"))
            .select(*ORIGIN, "version", F.col("_m.key").alias("name"), F.col("_m.value").alias("text")))


def list_entries(reports: DataFrame, kind: str) -> DataFrame:
    """Items of the other report kinds as JSON text, with the file name where the kind has one."""
    report, file_name = F.col("report"), F.lit(None).cast("string")
    if kind == "safety":
        items = reports.select(*ORIGIN, file_name.alias("file_name"), F.explode(read_json(report, "array<string>")).alias("text"))
    elif kind == "pip_audit":
        items = reports.select(*ORIGIN, file_name.alias("file_name"),
                               F.explode(read_json(_member(report, "vulnerabilities"), "array<string>")).alias("text"))
    else:
        outer = reports.select(*ORIGIN, F.explode(read_json(_member(report, "dependencies"), "array<string>")).alias("_text"))
        outer = outer.where(is_object(F.col("_text"))).select(*ORIGIN, read_json(F.col("_text"), _DEPENDENCY).alias("_d"))
        items = outer.select(*ORIGIN, F.col("_d.fileName").alias("file_name"), F.explode("_d.vulnerabilities").alias("text"))
    return items


def entry_rejects(reports: DataFrame, kind: str) -> DataFrame:
    """Entries (app_name, directory, text) that are not objects: they give no finding."""
    entries = npm_entries(reports) if kind == "npm" else list_entries(reports, kind)
    return entries.where(~is_object(F.col("text"))).select(*ORIGIN, "text")


def _entries(items: DataFrame, schema: str, *more: str) -> DataFrame:
    return items.where(is_object(F.col("text"))).select(*ORIGIN, *more, read_json(F.col("text"), schema).alias("entry"))


def npm_records(reports: DataFrame) -> DataFrame:
    """Records of either report version (6: advisories, 7: vulnerabilities), by name."""
    return _entries(npm_entries(reports), _NPM, "version", "name")


def safety_entries(reports: DataFrame) -> DataFrame:
    return _entries(list_entries(reports, "safety"), _SAFETY)


def pip_audit_entries(reports: DataFrame) -> DataFrame:
    return _entries(list_entries(reports, "pip_audit"), _PIP_AUDIT)


def dependency_check_entries(reports: DataFrame) -> DataFrame:
    """Two levels: dependencies, then the vulnerabilities of those that have any."""
    return _entries(list_entries(reports, "dependency_check"), _DEPENDENCY_CHECK, "file_name")
