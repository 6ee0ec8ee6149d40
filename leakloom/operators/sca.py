"""Audit reports of five shapes normalised into one vulnerability schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.functions import scoring
from leakloom.sources import reports as src

COLUMNS = ("app_name", "package_manager", "package_name", "current_version", "vulnerable_version",
           "fixed_version", "cve_id", "severity", "cvss_score", "description", "remediation", "file_path")


def _text(name: str, default: str | None = None) -> Column:
    """String field with a default; JSON null counts as missing."""
    value = F.col(f"entry.{name}")
    return value if default is None else F.coalesce(value, F.lit(default))


def _number(name: str, default: Column) -> Column:
    return F.coalesce(F.col(f"entry.{name}").try_cast("double"), default)


def _in_directory(file_name: Column | str) -> Column:
    name = F.lit(file_name) if isinstance(file_name, str) else file_name
    return F.concat(F.col("directory"), F.lit("/"), name)


def _finding(entries: DataFrame, **columns: Column) -> DataFrame:
    named = entries.select("app_name", *[c.alias(k) for k, c in columns.items()])
    return named.select(*COLUMNS)


def _via_cves() -> Column:
    """CVE ids of the object items in `via`; plain strings name other packages."""
    items = F.filter(F.col("entry.via"), src.is_object)
    cves = F.transform(items, lambda item: src.read_json(item, "cve string")["cve"])
    ids = F.transform(F.array_compact(cves), lambda cve: F.coalesce(src.read_json(cve, "array<string>"), F.array(cve)))
    joined = F.array_join(F.flatten(ids), ", ")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("N/A"))


def _npm_v7_columns() -> dict[str, Column]:
    package = F.col("name")
    severity = _text("severity", "unknown")
    version = _text("range", "unknown")
    return dict(
        package_manager=F.lit("npm"),
        package_name=package,
        current_version=version,
        vulnerable_version=version,
        fixed_version=F.lit("See npm audit fix"),
        cve_id=_via_cves(),
        severity=severity,
        cvss_score=scoring.severity_to_cvss(severity),
        description=F.concat(F.lit("Vulnerability in "), package),
        remediation=F.concat(F.lit("Run 'npm audit fix' or update "), package, F.lit(" to a secure version")),
        file_path=_in_directory("package.json"),
    )


def _npm_v6_columns() -> dict[str, Column]:
    package = _text("module_name", "unknown")
    severity = _text("severity", "unknown")
    version = _text("vulnerable_versions", "unknown")
    return dict(
        package_manager=F.lit("npm"),
        package_name=package,
        current_version=version,
        vulnerable_version=version,
        fixed_version=_text("patched_versions", "unknown"),
        cve_id=_text("cve", "N/A"),
        severity=severity,
        cvss_score=_number("cvss.score", scoring.severity_to_cvss(severity)),
        description=F.coalesce(_text("title"), F.concat(F.lit("Vulnerability in "), package)),
        remediation=F.coalesce(_text("recommendation"),
                               F.concat(F.lit("Update "), package, F.lit(" to a secure version"))),
        file_path=_in_directory("package.json"),
    )


def normalize_npm_v7(reports: DataFrame) -> DataFrame:
    return _finding(src.npm_records(reports).where("version = 7"), **_npm_v7_columns())


def normalize_npm_v6(reports: DataFrame) -> DataFrame:
    return _finding(src.npm_records(reports).where("version = 6"), **_npm_v6_columns())


def normalize_npm(reports: DataFrame) -> DataFrame:
    """Findings of either report version, from one parse."""
    new, old = _npm_v7_columns(), _npm_v6_columns()
    return _finding(src.npm_records(reports), **{c: F.when(F.col("version") == 7, new[c]).otherwise(old[c]) for c in new})


def _requirements(entries: DataFrame, requirements: DataFrame | None) -> DataFrame:
    """Entries with the requirements file of their application."""
    if requirements is None:
        return entries.withColumn("requirements_file", F.lit("requirements.txt"))
    return (entries.join(requirements, "app_name", "left")
            .withColumn("requirements_file", F.coalesce("requirements_file", F.lit("requirements.txt"))))


def normalize_safety(reports: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    return _finding(
        _requirements(src.safety_entries(reports), requirements),
        package_manager=F.lit("pip"),
        package_name=_text("package", "unknown"),
        current_version=_text("installed_version", "unknown"),
        vulnerable_version=_text("vulnerable_spec", "unknown"),
        fixed_version=_text("safe_version", "See advisory"),
        cve_id=_text("vulnerability_id", "N/A"),
        severity=scoring.id_severity(_text("vulnerability_id")),
        cvss_score=F.lit(0.0),
        description=_text("advisory", "Python package vulnerability"),
        remediation=F.concat(F.lit("Update "), _text("package", "package"), F.lit(" to version "),
                             _text("safe_version", "latest")),
        file_path=_in_directory(F.col("requirements_file")),
    )


def normalize_pip_audit(reports: DataFrame, requirements: DataFrame | None = None) -> DataFrame:
    fixes = F.col("entry.fix_versions")
    return _finding(
        _requirements(src.pip_audit_entries(reports), requirements),
        package_manager=F.lit("pip"),
        package_name=_text("package", "unknown"),
        current_version=_text("installed_version", "unknown"),
        vulnerable_version=_text("vulnerable_spec", "unknown"),
        fixed_version=F.coalesce(F.try_element_at(fixes, F.lit(1)), F.lit("See advisory")),
        cve_id=_text("id", "N/A"),
        severity=scoring.id_severity(_text("id")),
        cvss_score=F.lit(0.0),
        description=_text("description", "Python package vulnerability"),
        remediation=F.concat(F.lit("Update "), _text("package", "package"), F.lit(" to a secure version")),
        file_path=_in_directory(F.col("requirements_file")),
    )


def jar_version(file_name: Column) -> Column:
    """First '-1.2.3' or '-1.2.3-RC1' part of an archive name."""
    found = F.regexp_extract(file_name, r"-(\d+(?:\.\d+)*(?:-[A-Za-z0-9]+)?)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def normalize_dependency_check(reports: DataFrame) -> DataFrame:
    name = F.col("file_name")
    return _finding(
        src.dependency_check_entries(reports),
        package_manager=F.lit("maven"),
        package_name=F.coalesce(name, F.lit("unknown")),
        current_version=jar_version(F.coalesce(name, F.lit(""))),
        vulnerable_version=F.lit("unknown"),
        fixed_version=F.lit("See advisory"),
        cve_id=_text("name", "N/A"),
        severity=F.lower(_text("severity", "unknown")),
        cvss_score=_number("cvssv3.baseScore", F.lit(0.0)),
        description=_text("description", "Maven dependency vulnerability"),
        remediation=F.lit("Update dependency to a secure version"),
        file_path=_in_directory("pom.xml"),
    )


def prefer_safety(safety: DataFrame, pip_audit: DataFrame) -> DataFrame:
    """Python reports of the first available scanner: safety wins per application."""
    covered = safety.select("app_name").distinct()
    return safety.unionByName(pip_audit.join(covered, "app_name", "left_anti"))


def normalize_all(npm: DataFrame, safety: DataFrame, pip_audit: DataFrame, dependency_check: DataFrame,
                  requirements: DataFrame | None = None) -> DataFrame:
    """Findings of every manager in one table. A malformed report adds none.

    Only the scanner that wins is parsed: the choice is made on report rows.
    """
    covered = safety.select("app_name").distinct()
    parts = [
        normalize_npm(npm),
        normalize_safety(safety, requirements),
        normalize_pip_audit(pip_audit.join(covered, "app_name", "left_anti"), requirements),
        normalize_dependency_check(dependency_check),
    ]
    return reduce(DataFrame.unionByName, parts)
