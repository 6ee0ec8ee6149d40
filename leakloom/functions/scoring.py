"""Severity, score and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leakloom import catalog


def _lookup(key: Column, table: dict, default) -> Column:
    result = None
    for name, value in table.items():
        result = F.when(key == name, F.lit(value)) if result is None else result.when(key == name, F.lit(value))
    return result.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """critical 0 ... low 3, everything else 4."""
    ranks = {name: rank for rank, name in enumerate(catalog.SEVERITIES)}
    return _lookup(severity, ranks, F.lit(len(ranks)))


def severity_to_cvss(severity: Column) -> Column:
    return _lookup(F.lower(severity), catalog.SEVERITY_CVSS, F.lit(0.0))


def id_severity(advisory_id: Column) -> Column:
    """An identifier that names a CVE counts as high."""
    return F.when(F.coalesce(advisory_id, F.lit("")).contains("CVE"), "high").otherwise("medium")


def cvss_band(score: Column) -> Column:
    return F.when(score >= 7, "danger").when(score >= 4, "warning").otherwise("info")


def risk_score(critical: Column, high: Column) -> Column:
    return F.least(F.lit(100).cast("bigint"), critical * 10 + high * 5)


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 40, "Medium").otherwise("Low")


def threat_level(critical: Column, high: Column) -> Column:
    return F.when(critical > 0, "CRITICAL").when(high > 5, "HIGH").when(high > 0, "MEDIUM").otherwise("LOW")


def event_title(event_type: Column) -> Column:
    return _lookup(event_type, catalog.EVENT_TITLES, F.lit("Event"))


def severity_count(severity: Column, name: str, alias: str | None = None) -> Column:
    return F.count_if(severity == name).alias(alias or name)


def severity_counts(severity: Column, suffix: str = "") -> list[Column]:
    return [severity_count(severity, name, name + suffix) for name in catalog.SEVERITIES]


def truncate_text(text: Column, size: int) -> Column:
    return (F.when(F.coalesce(text, F.lit("")) == "", "N/A")
            .when(F.length(text) <= size, text)
            .otherwise(F.concat(F.left(text, F.lit(size)), F.lit("..."))))
