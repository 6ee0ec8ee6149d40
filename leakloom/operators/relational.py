"""Queries over stored applications, scans, findings and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom import catalog
from leakloom.functions import scoring, text as tx
from leakloom.functions.scoring import severity_counts, severity_rank

FINDING_COLUMNS = ("type", "id", "app_name", "file_path", "line_number", "title", "severity",
                   "confidence", "created_at", "remediation", "status")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def _genuine(column: str = "is_false_positive") -> Column:
    """False-positive flag equal to 0; a null flag does not count."""
    return F.col(column) == F.lit(False)


# --- applications and scans --------------------------------------------------

def list_applications(applications: DataFrame, status: str = "active") -> DataFrame:
    return applications.where(F.col("status") == status).orderBy(F.desc("created_at"), "id")


def get_application(applications: DataFrame, name: str) -> DataFrame:
    return applications.where(F.col("name") == name)


def get_by_id(rows: DataFrame, row_id: int) -> DataFrame:
    return rows.where(F.col("id") == row_id)


def recent_scans(scans: DataFrame, applications: DataFrame, limit: int = 10) -> DataFrame:
    apps = applications.select(F.col("name").alias("app_name"), "team", "criticality")
    return scans.join(apps, "app_name").orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def scan_activity(scans: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return (
        scans.where(F.col("started_at") >= days_before(as_of, days))
        .groupBy(F.to_date("started_at").alias("scan_date")).agg(F.count("*").alias("scans"))
        .orderBy("scan_date")
    )


def app_last_scan(applications: DataFrame, scans: DataFrame) -> DataFrame:
    """Applications with the time of their latest completed scan, which also updates them; failed ones don't count."""
    last = (
        scans.where(F.col("status") == "completed").groupBy(F.col("app_name").alias("name"))
        .agg(F.max("completed_at").alias("last_scan_at"))
    )
    before = [F.col(c) for c in ("updated_at", "created_at") if c in applications.columns]
    return (
        applications.drop("last_scan_at").join(last, "name", "left")
        .withColumn("updated_at", F.coalesce("last_scan_at", *before))
    )


def app_scanning_flag(applications: DataFrame, scans: DataFrame) -> DataFrame:
    """Applications with a flag for a scan that is running."""
    active = (
        scans.where(F.col("status") == "running").select(F.col("app_name").alias("name")).distinct()
        .withColumn("active", F.lit(True))
    )
    return (
        applications.join(active, "name", "left")
        .withColumn("currently_scanning", F.coalesce("active", F.lit(False))).drop("active")
    )


# --- open findings of both kinds ---------------------------------------------

def _open_secrets(secrets: DataFrame) -> DataFrame:
    return secrets.where(F.col("status") == "open").select(
        F.lit("secret").alias("type"), F.col("id"), "app_name", "file_path",
        F.col("line_number").cast("bigint").alias("line_number"), F.col("pattern_name").alias("title"),
        "severity", "confidence", "created_at", "remediation", "status")


def _open_sca(sca: DataFrame) -> DataFrame:
    title = F.concat("package_name", F.lit(" ("), "cve_id", F.lit(")"))
    return sca.where(F.col("status") == "open").select(
        F.lit("sca").alias("type"), F.col("id"), "app_name", "file_path",
        F.lit(0).cast("bigint").alias("line_number"), title.alias("title"),
        "severity", F.col("cvss_score").alias("confidence"), "created_at", "remediation", "status")


def get_findings(secrets: DataFrame, sca: DataFrame, app_name: str | None = None, severity: str | None = None,
                 finding_type: str | None = None, limit: int | None = None, order: str = "reference") -> DataFrame:
    """Open findings of both kinds.

    The default order puts unknown severities first and critical last, newest first
    within each; 'critical_first' is the intuitive one. Ties keep secrets first.
    """
    parts = []
    if finding_type in (None, "", "secrets"):
        parts.append(_open_secrets(secrets))
    if finding_type in (None, "", "sca"):
        parts.append(_open_sca(sca))
    if not parts:
        return _open_secrets(secrets).where(F.lit(False))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if app_name:
        found = found.where(F.col("app_name") == app_name)
    if severity:
        found = found.where(F.col("severity") == severity)
    rank = severity_rank(F.col("severity"))
    by_rank = F.desc(rank) if order == "reference" else F.asc(rank)
    kind = F.when(F.col("type") == "secret", 0).otherwise(1)
    ordered = found.orderBy(by_rank, F.desc("created_at"), kind, "id")
    return ordered if limit is None else ordered.limit(limit)


def open_severity_counts(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status") == "open").groupBy("severity").agg(F.count("*").alias("findings"))


def _open_both(secrets: DataFrame, sca: DataFrame) -> DataFrame:
    def slim(df: DataFrame, kind: str) -> DataFrame:
        return df.where(F.col("status") == "open").select("app_name", "severity", F.lit(kind).alias("kind"))
    return slim(secrets, "secrets").unionByName(slim(sca, "sca"))


def top_vulnerable_apps(secrets: DataFrame, sca: DataFrame, limit: int = 10) -> DataFrame:
    severity = F.col("severity")
    return (
        _open_both(secrets, sca).groupBy("app_name")
        .agg(scoring.severity_count(severity, "critical"), scoring.severity_count(severity, "high"),
             F.count("*").alias("total"))
        .orderBy(F.desc("critical"), F.desc("high"), F.desc("total"), "app_name").limit(limit)
    )


def severity_totals(secrets: DataFrame, sca: DataFrame) -> DataFrame:
    """Open findings per severity: each kind and both together."""
    return (
        _open_both(secrets, sca).groupBy("severity")
        .agg(F.count_if(F.col("kind") == "secrets").alias("secrets"),
             F.count_if(F.col("kind") == "sca").alias("sca"),
             F.count("*").alias("total"))
    )


def dashboard(applications: DataFrame, secrets: DataFrame, sca: DataFrame, scans: DataFrame,
              as_of: Column) -> dict[str, DataFrame]:
    """The parts of the dashboard, each a lazy frame."""
    active = applications.where(F.col("status") == "active")
    return {
        "total_applications": active.agg(F.count("*").alias("total_applications")),
        "secret_findings": open_severity_counts(secrets),
        "sca_findings": open_severity_counts(sca),
        "scan_activity": scan_activity(scans, as_of),
        "top_vulnerable_apps": top_vulnerable_apps(secrets, sca),
        "severity_totals": severity_totals(secrets, sca),
    }


def scan_rollup(scans: DataFrame, secrets: DataFrame, sca: DataFrame) -> DataFrame:
    """Scans with the numbers of findings their type covers.

    Findings are counted per scan before they meet the scans, whatever their skew.
    """
    def slim(df: DataFrame, kind: str) -> DataFrame:
        return df.select("scan_id", "severity", F.lit(kind).alias("kind"))

    covered = {"secrets": ("full", "secrets"), "sca": ("full", "sca")}
    kinds = {k: F.col("kind") == k for k in covered}
    names = {**{s: F.col("severity") == s for s in catalog.SEVERITIES}, "found": F.lit(True),
             "other": ~F.col("severity").isin(*catalog.SEVERITIES)}
    counts = (
        slim(secrets, "secrets").unionByName(slim(sca, "sca")).groupBy(F.col("scan_id").alias("id"))
        .agg(*[F.count_if(kinds[k] & test).alias(f"{k}_{n}") for k in covered for n, test in names.items()])
    )
    joined = scans.join(counts, "id", "left")

    def covered_count(kind: str, name: str) -> Column:
        return F.when(F.col("scan_type").isin(*covered[kind]), F.coalesce(f"{kind}_{name}", F.lit(0))).otherwise(F.lit(0))

    error = F.col("error_message") if "error_message" in scans.columns else F.lit(None).cast("string")
    return joined.select(
        "id", "app_name", "scan_type",
        F.when(tx.present(error), "failed").otherwise("completed").alias("status"),
        covered_count("secrets", "found").alias("secrets_found"),
        covered_count("sca", "found").alias("vulnerabilities_found"),
        *[(covered_count("secrets", s) + covered_count("sca", s)).alias(f"{s}_count")
          for s in (*catalog.SEVERITIES, "other")],
    )


# --- unified findings --------------------------------------------------------

def list_findings(findings: DataFrame, app_name: str | None = None, severity: str | None = None,
                  status: str | None = None, include_fp: bool = False) -> DataFrame:
    for column, value in (("app_name", app_name), ("severity", severity), ("status", status)):
        if value:
            findings = findings.where(F.col(column) == value)
    if not include_fp:
        findings = findings.where(~F.coalesce("is_false_positive", F.lit(False)))
    return findings.orderBy(F.desc("created_at"), "id")


def scan_history(scans: DataFrame, findings: DataFrame, app_name: str | None = None) -> DataFrame:
    """Scans with counts of their genuine findings; a scan without any stays, with zeros.

    Findings are counted per scan before the outer join, so a scan that holds a third
    of all findings does not skew it.
    """
    per_scan = (
        findings.where(_genuine()).groupBy(F.col("scan_id").alias("id"))
        .agg(F.count("*").alias("total"), *severity_counts(F.col("severity")))
    )
    if app_name:
        scans = scans.where(F.col("app_name") == app_name)
    zero = F.lit(0).cast("bigint")
    return (
        scans.join(per_scan, "id", "left")
        .select("id", "app_name", "scan_type", "status", F.col("started_at").alias("created_at"),
                F.coalesce("total", zero).alias("total_findings"),
                *[F.coalesce(s, zero).alias(s) for s in catalog.SEVERITIES])
        .orderBy(F.desc("created_at"), "id")
    )


def archived_findings(findings: DataFrame, scans: DataFrame, app_name: str | None = None) -> DataFrame:
    if app_name:
        findings = findings.where(F.col("app_name") == app_name)
    archived = findings.where((F.col("status") == "archived") | F.col("is_false_positive"))
    dates = scans.select(F.col("id").alias("scan_id"), F.col("started_at").alias("scan_date"))
    return archived.join(dates, "scan_id").orderBy(F.desc("updated_at"), "id")


def history_rows(history: DataFrame, findings: DataFrame, app_name: str | None = None,
                 days: int | None = None, as_of: Column | None = None) -> DataFrame:
    """History events with the finding they belong to, unordered."""
    if days:
        history = history.where(F.col("event_ts") >= days_before(as_of, days))
    if app_name:
        findings = findings.where(F.col("app_name") == app_name)
    about = findings.select(F.col("id").alias("finding_id"), F.col("title").alias("finding_title"),
                            "app_name", "severity", "file_path", "finding_type")
    return history.select("id", "finding_id", "event_type", "details", "analyst", "event_ts").join(about, "finding_id")


def application_history(history: DataFrame, findings: DataFrame, app_name: str | None = None,
                        days: int | None = None, as_of: Column | None = None,
                        limit: int | None = None) -> DataFrame:
    rows = history_rows(history, findings, app_name, days, as_of).orderBy(F.desc("event_ts"), F.desc("id"))
    return rows if limit is None else rows.limit(limit)


def finding_history(history: DataFrame, findings: DataFrame, finding_id: int | None = None) -> DataFrame:
    """Events per finding, newest first; a finding without any gets a 'created' event.

    An inner join plus an anti join against the distinct ids instead of one outer
    join: a finding with very many events can then be split.
    """
    if finding_id is not None:
        history = history.where(F.col("finding_id") == finding_id)
        findings = findings.where(F.col("id") == finding_id)
    ids = findings.select(F.col("id").alias("finding_id"))
    columns = ("finding_id", "event_type", "details", "analyst", "event_ts")
    events = history.select(*columns, F.col("id").alias("event_id")).join(ids, "finding_id")
    created = (
        findings.withColumnRenamed("id", "finding_id")
        .join(history.select("finding_id").distinct(), "finding_id", "left_anti")
        .select("finding_id", F.lit("created").alias("event_type"),
                F.concat(F.lit("Finding created: "), F.col("title")).alias("details"),
                F.lit("System").alias("analyst"), F.col("created_at").alias("event_ts"),
                F.lit(None).cast("bigint").alias("event_id"))
    )
    return (events.select(*columns, "event_id").unionByName(created)
            .orderBy("finding_id", F.desc("event_ts"), F.desc("event_id")))


def history_timeline(history: DataFrame, findings: DataFrame, app_name: str | None = None) -> DataFrame:
    """History rows by calendar day, newest day first, with the size of the day.

    Rows stay rows: a day's events are never collected into one value.
    """
    rows = history_rows(history, findings, app_name).withColumn("event_day", F.to_date("event_ts"))
    wanted = findings if not app_name else findings.where(F.col("app_name") == app_name)
    # Days are counted on keys alone, before the wide join.
    sizes = (history.select("finding_id", F.to_date("event_ts").alias("event_day"))
             .join(wanted.select(F.col("id").alias("finding_id")), "finding_id")
             .groupBy("event_day").agg(F.count("*").alias("day_events")))
    return rows.join(sizes, "event_day").orderBy(F.desc("event_day"), F.desc("event_ts"), F.desc("id"))


# --- reports -----------------------------------------------------------------

def _genuine_counts(findings: DataFrame) -> DataFrame:
    return findings.where(_genuine()).agg(F.count("*").alias("total"), *severity_counts(F.col("severity")))


def threat_level(findings: DataFrame) -> DataFrame:
    return _genuine_counts(findings).select(
        "critical", "high", scoring.threat_level(F.col("critical"), F.col("high")).alias("threat_level"))


def _side_by_side(*parts: tuple[DataFrame, list[str]]) -> DataFrame:
    """One row out of several one-row frames, without joining them."""
    every = [c for _, columns in parts for c in columns]
    stacked = None
    for df, columns in parts:
        row = df.select(*[F.col(c).cast("bigint") if c in columns else F.lit(0).cast("bigint").alias(c) for c in every])
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.agg(*[F.sum(c).alias(c) for c in every])


def _active(applications: DataFrame) -> DataFrame:
    return applications.where(F.col("status") == "active").agg(F.count("*").alias("apps"))


def dashboard_stats(applications: DataFrame, scan_results: DataFrame, findings: DataFrame) -> DataFrame:
    row = _side_by_side(
        (_active(applications), ["apps"]),
        (scan_results.agg(F.count("*").alias("scans")), ["scans"]),
        (_genuine_counts(findings), ["total", "critical", "high"]),
    )
    return row.select(
        F.col("apps").alias("total_apps"), F.col("scans").alias("scans_completed"),
        F.col("total").alias("vulnerabilities"),
        scoring.threat_level(F.col("critical"), F.col("high")).alias("threat_level"))


def risk_scores(findings: DataFrame) -> DataFrame:
    """Risk score and level per application."""
    counts = findings.where(_genuine()).groupBy("app_name").agg(*severity_counts(F.col("severity")))
    scored = counts.select("app_name", "critical", "high",
                           scoring.risk_score(F.col("critical"), F.col("high")).alias("risk_score"))
    return scored.withColumn("risk_level", scoring.risk_level(F.col("risk_score")))


def executive_summary(applications: DataFrame, findings: DataFrame) -> DataFrame:
    """The five numbers of the executive report with their status labels."""
    row = _side_by_side(
        (_active(applications), ["apps"]),
        (_genuine_counts(findings), ["total", "critical", "high"]),
    )
    scored = row.withColumn("risk_score", scoring.risk_score(F.col("critical"), F.col("high")))
    return scored.select(
        F.col("apps").alias("total_applications"), F.col("total").alias("total_findings"),
        F.col("critical").alias("critical_findings"), F.col("high").alias("high_findings"), "risk_score",
        F.when(F.col("critical") > 0, "Immediate Action Required").otherwise("Good").alias("critical_status"),
        F.when(F.col("high") > 0, "Action Required").otherwise("Good").alias("high_status"),
        scoring.risk_level(F.col("risk_score")).alias("risk_level"))


def _per_severity(counts: DataFrame, names=catalog.SEVERITIES) -> DataFrame:
    """The one-row counts turned into a row per severity; zero rows stay."""
    rows = F.array(*[F.struct(F.lit(n).alias("severity"), F.col(n).alias("findings")) for n in names])
    return counts.select("total", F.explode(rows).alias("r")).select("r.severity", "r.findings", "total")


def technical_report(findings: DataFrame, app_name: str | None = None) -> DataFrame:
    """Genuine findings per severity with their share of the total."""
    if app_name:
        findings = findings.where(F.col("app_name") == app_name)
    share = F.round(F.col("findings") * 100 / F.greatest("total", F.lit(1)), 1)
    return _per_severity(_genuine_counts(findings)).withColumn("percentage", share)


def top_findings(findings: DataFrame, app_name: str | None = None, limit: int = 10) -> DataFrame:
    if app_name:
        findings = findings.where(F.col("app_name") == app_name)
    return findings.where(_genuine()).orderBy(severity_rank(F.col("severity")), "id").limit(limit)


def recommendations(findings: DataFrame) -> DataFrame:
    """One line of advice per severity that has findings."""
    rows = _per_severity(_genuine_counts(findings), tuple(catalog.RECOMMENDATIONS)).where("findings > 0")
    severity = F.col("severity")

    def by_severity(value) -> Column:
        chosen = F.lit(None).cast("string")
        for name, template in catalog.RECOMMENDATIONS.items():
            chosen = F.when(severity == name, value(template)).otherwise(chosen)
        return chosen

    return rows.select(
        by_severity(lambda t: F.lit(t[0])).alias("priority"),
        by_severity(lambda t: F.lit(t[1])).alias("action"),
        by_severity(lambda t: F.concat(F.lit(t[2]), F.col("findings").cast("string"), F.lit(t[3]))).alias("description"))


def findings_display(secrets: DataFrame, sca: DataFrame, title_size: int = 40) -> DataFrame:
    """Open findings as the strings a list view shows."""
    shown = get_findings(secrets, sca, limit=None)
    file_path = F.coalesce("file_path", F.lit(""))
    return shown.select(
        "type", "id",
        F.concat(file_path, F.lit(":"), F.col("line_number").cast("string")).alias("location"),
        F.upper("severity").alias("severity_badge"),
        F.upper("type").alias("type_badge"),
        scoring.truncate_text(F.col("title"), title_size).alias("short_title"),
        F.when(F.col("confidence") != 0,
               F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))).alias("confidence_text"),
    )


def applications_display(applications: DataFrame) -> DataFrame:
    """Applications with the texts shown for absent values."""
    def shown(name: str, default: str) -> Column:
        value = F.col(name) if name in applications.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(default)).alias(name)

    return applications.select("name", shown("language", "Unknown"), shown("framework", "Unknown"),
                               shown("criticality", "medium"), shown("team", "N/A"), shown("owner", "N/A"))


def events_display(history: DataFrame) -> DataFrame:
    return history.select("id", scoring.event_title(F.col("event_type")).alias("event_title"))


def retained(rows: DataFrame, as_of: Column, days: int = 365, column: str = "created_at") -> DataFrame:
    return rows.where(F.col(column) >= days_before(as_of, days))
