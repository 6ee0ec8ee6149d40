"""Table schemas of the findings store, as DDL strings.

Parquet readers and the append sinks use them, so a table always has the same
columns whatever produced the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

TABLES = {
    "applications": """
        id BIGINT, name STRING, repo_type STRING, repo_url STRING, local_path STRING, team STRING,
        owner STRING, criticality STRING, language STRING, framework STRING, created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ, last_scan_at TIMESTAMP_NTZ, status STRING""",
    "scans": """
        id BIGINT, app_name STRING, scan_type STRING, status STRING, started_at TIMESTAMP_NTZ,
        completed_at TIMESTAMP_NTZ, total_files BIGINT, scanned_files BIGINT, secrets_found BIGINT,
        vulnerabilities_found BIGINT, critical_count BIGINT, high_count BIGINT, medium_count BIGINT,
        low_count BIGINT, error_message STRING""",
    "secret_findings": """
        id BIGINT, scan_id BIGINT, app_name STRING, file_path STRING, line_number BIGINT,
        pattern_name STRING, pattern_type STRING, severity STRING, confidence DOUBLE,
        secret_hash STRING, context_before STRING, context_after STRING, remediation STRING,
        status STRING, created_at TIMESTAMP_NTZ""",
    "sca_findings": """
        id BIGINT, scan_id BIGINT, app_name STRING, package_manager STRING, package_name STRING,
        current_version STRING, vulnerable_version STRING, fixed_version STRING, cve_id STRING,
        severity STRING, cvss_score DOUBLE, description STRING, remediation STRING,
        file_path STRING, status STRING, created_at TIMESTAMP_NTZ""",
    "findings": """
        id BIGINT, scan_id BIGINT, app_name STRING, finding_type STRING, severity STRING,
        title STRING, description STRING, file_path STRING, line_number BIGINT, code_snippet STRING,
        cve_id STRING, component STRING, current_version STRING, fixed_version STRING,
        threat_intel STRING, remediation STRING, cvss_score DOUBLE, usage_locations ARRAY<STRING>,
        dependency_chain STRING, affected_functions ARRAY<STRING>, first_published STRING,
        last_modified STRING, exploit_maturity STRING, impact_description STRING,
        finding_hash STRING, is_false_positive BOOLEAN, false_positive_reason STRING,
        analyst_comment STRING, status STRING, resolution_date TIMESTAMP_NTZ,
        first_detected TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, occurrence_count BIGINT,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "scan_results": """
        id BIGINT, app_name STRING, critical_count BIGINT, high_count BIGINT, medium_count BIGINT,
        low_count BIGINT, scan_date TIMESTAMP_NTZ""",
    "scan_comparisons": """
        id BIGINT, app_name STRING, baseline_scan_id BIGINT, current_scan_id BIGINT,
        new_findings BIGINT, resolved_findings BIGINT, persistent_findings BIGINT,
        false_positives BIGINT, remediation_score DOUBLE, comparison_date TIMESTAMP_NTZ""",
    "false_positive_patterns": """
        id BIGINT, app_name STRING, pattern_type STRING, pattern_value STRING, reason STRING,
        created_by STRING, created_at TIMESTAMP_NTZ""",
    "finding_history": """
        id BIGINT, finding_id BIGINT, event_type STRING, details STRING, analyst STRING,
        event_ts TIMESTAMP_NTZ""",
    "source_files": """
        app_name STRING, path STRING, length BIGINT, modified_at TIMESTAMP, text STRING""",
}

# Values a new row gets when the writer gives none.
COLUMN_DEFAULTS = {
    "applications": {"criticality": "medium", "status": "active"},
    "scans": {"status": "running", "total_files": 0, "scanned_files": 0, "secrets_found": 0,
              "vulnerabilities_found": 0, "critical_count": 0, "high_count": 0, "medium_count": 0,
              "low_count": 0},
    "secret_findings": {"status": "open"},
    "sca_findings": {"status": "open"},
    "findings": {"status": "open", "is_false_positive": False, "occurrence_count": 1},
}


def table_schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project `df` onto a table's columns, filling absent ones with default or null."""
    defaults = COLUMN_DEFAULTS.get(table, {})
    columns = []
    for field in table_schema(table).fields:
        default = F.lit(defaults.get(field.name))
        value = F.coalesce(F.col(field.name), default) if field.name in df.columns else default
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(columns)
