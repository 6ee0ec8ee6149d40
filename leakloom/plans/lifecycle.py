"""Registered lifecycle queries: hashes, suppression, upsert, comparison, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom import catalog
from leakloom.operators import lifecycle as life
from leakloom.plans import fixtures as fx
from leakloom.plans.registry import query, sql_text
from leakloom.schemas import conform
from leakloom.session import work_dir
from leakloom.sources import tables

NOW = "2024-03-01 00:00:00"
LATER = "2024-03-02 00:00:00"

HASH_SQL = """md5(concat_ws('|', coalesce(app_name, ''), coalesce(finding_type, ''), coalesce(file_path, ''),
  coalesce(cast(line_number AS VARCHAR), '0'), coalesce(cve_id, ''), coalesce(component, ''), coalesce(title, '')))"""
HASHED_SQL = f"h AS (SELECT *, {HASH_SQL} AS finding_hash FROM findings)"
SUPPRESSED_SQL = """EXISTS (SELECT 1 FROM false_positive_patterns p
  WHERE (p.app_name = f.app_name OR p.app_name IS NULL) AND coalesce(p.pattern_value, '') <> ''
    AND ((p.pattern_type = 'file_path' AND starts_with(f.file_path, p.pattern_value))
      OR (p.pattern_type = 'component' AND f.component = p.pattern_value)
      OR (p.pattern_type = 'code_pattern' AND contains(f.code_snippet, p.pattern_value))))"""


MARKS_SQL = """SELECT id, finding_id, details AS reason, analyst, event_ts AS marked_at, id % 3 = 0 AS create_pattern
FROM finding_history WHERE event_type = 'false_positive'"""
CHANGES_SQL = """SELECT id, finding_id, analyst, event_ts AS changed_at,
  CASE WHEN event_type = 'resolved' THEN 'resolved' WHEN id % 2 = 0 THEN 'in_progress' ELSE 'open' END AS status
FROM finding_history WHERE event_type IN ('resolved', 'status_change')"""
LOG_VIEWS = ["findings", "finding_history"]


def _log(spark, sf_dir, sql):
    return spark.sql(sql.replace("FROM finding_history", "FROM {history}"), history=fx.view(spark, sf_dir, "finding_history"))


def _at(text):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _findings(spark, sf_dir):
    return fx.view(spark, sf_dir, "findings")


def _hashed(spark, sf_dir):
    return life.with_hash(_findings(spark, sf_dir))


@query("finding_hash", f"WITH {HASHED_SQL} SELECT id, finding_hash FROM h", ["findings"])
def finding_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("id", "finding_hash")


@query("suppress_false_positives", f"SELECT id FROM findings f WHERE NOT {SUPPRESSED_SQL}", ["findings", "false_positive_patterns"])
def suppress_false_positives(spark, sf_dir):
    patterns = fx.view(spark, sf_dir, "false_positive_patterns")
    return life.suppress_false_positives(_findings(spark, sf_dir), patterns).select("id")


# Analysts' marks on findings with many distinct paths give many patterns.
_RICH_SQL = "concat('/src/', lower(title), '/m', cast(id % 1009 AS VARCHAR), '.js')"


@query("suppress_with_derived_patterns", f"""
WITH rich AS (SELECT f.* REPLACE ({_RICH_SQL} AS file_path, NULL AS component) FROM findings f),
marks AS ({{MARKS}}),
derived AS (SELECT r.app_name, 'file_path' AS pattern_type, r.file_path AS pattern_value FROM marks m JOIN rich r ON r.id = m.finding_id WHERE m.create_pattern
  UNION ALL SELECT NULL, 'code_pattern', 'ip 3')
SELECT id FROM rich f WHERE NOT {SUPPRESSED_SQL.replace('false_positive_patterns', 'derived')}""".replace("{MARKS}", MARKS_SQL),
       ["findings", "finding_history"])
def suppress_with_derived_patterns(spark, sf_dir):
    rich = _findings(spark, sf_dir).withColumns({
        "file_path": F.expr(_RICH_SQL.replace("VARCHAR", "string")), "component": F.lit(None).cast("string")})
    derived = life.derive_fp_patterns(_log(spark, sf_dir, MARKS_SQL), rich).select("app_name", "pattern_type", "pattern_value")
    everywhere = spark.range(1).select(F.lit(None).cast("string").alias("app_name"),
                                       F.lit("code_pattern").alias("pattern_type"), F.lit("ip 3").alias("pattern_value"))
    root = work_dir(spark, "store")
    tables.append_table(derived.unionByName(everywhere), root, "false_positive_patterns")
    patterns = tables.read_table(spark, root, "false_positive_patterns")
    return life.suppress_false_positives(rich, patterns).select("id")


# --- upsert ---

_UPSERT_COLUMNS = ("app_name", "finding_hash", "id", "severity", "status", "is_false_positive", "occurrence_count",
                   "first_detected", "last_seen")

# The stored snapshot holds the first 20 of each 40 scans, one row per hash; the others arrive.
SNAPSHOT_SQL = f"""
  {HASHED_SQL},
  snapshot AS (SELECT h.app_name, h.finding_hash, h.id, h.severity, h.status, h.is_false_positive, 1 AS occurrence_count,
      h.created_at AS first_detected, h.created_at AS last_seen
    FROM h JOIN (SELECT app_name, finding_hash, min(id) AS id FROM h WHERE scan_id % 40 < 20 GROUP BY ALL) m ON m.id = h.id)"""
MERGED_SQL = f"""
  {SNAPSHOT_SQL},
  batch AS (SELECT f.*, {SUPPRESSED_SQL} AS suppressed FROM h f WHERE scan_id % 40 >= 20),
  firsts AS (SELECT app_name, finding_hash, count(*) AS arrivals, min(id) FILTER (WHERE NOT suppressed) AS first_ok FROM batch GROUP BY ALL),
  merged AS (
    SELECT s.app_name, s.finding_hash, s.id, s.severity, s.status, s.is_false_positive,
      CASE WHEN f.arrivals IS NOT NULL AND NOT s.is_false_positive THEN s.occurrence_count + f.arrivals ELSE s.occurrence_count END AS occurrence_count,
      s.first_detected, CASE WHEN f.arrivals IS NOT NULL AND NOT s.is_false_positive THEN TIMESTAMP '{NOW}' ELSE s.last_seen END AS last_seen
    FROM snapshot s LEFT JOIN firsts f USING (app_name, finding_hash)
    UNION ALL
    SELECT b.app_name, b.finding_hash, b.id, b.severity, 'open', false,
      (SELECT count(*) FROM batch x WHERE x.app_name = b.app_name AND x.finding_hash = b.finding_hash AND x.id >= b.id),
      TIMESTAMP '{NOW}', TIMESTAMP '{NOW}'
    FROM batch b JOIN firsts f ON f.app_name = b.app_name AND f.finding_hash = b.finding_hash AND f.first_ok = b.id
    WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.app_name = b.app_name AND s.finding_hash = b.finding_hash))"""


def _snapshot(hashed):
    """A stored snapshot: the first row of each hash, as the findings table has it."""
    rows = hashed.groupBy("app_name", "finding_hash").agg(F.min_by(F.struct(*hashed.columns), F.col("id")).alias("r"))
    dated = rows.select("r.*").withColumns({"first_detected": F.col("created_at"), "last_seen": F.col("created_at")})
    return conform(dated, "findings")


@query("upsert_findings", f"WITH {MERGED_SQL} SELECT {', '.join(_UPSERT_COLUMNS)} FROM merged", ["findings", "false_positive_patterns"])
def upsert_findings(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    merged = life.upsert_findings(
        _snapshot(hashed.where("scan_id % 40 < 20")), hashed.where("scan_id % 40 >= 20"),
        fx.view(spark, sf_dir, "false_positive_patterns"), _at(NOW))
    return merged.select(*_UPSERT_COLUMNS)


# --- comparison ---

_BASELINE_SQL = """b AS (SELECT s.id AS current_scan_id, s.app_name,
  (SELECT max(x.id) FROM scans x WHERE x.app_name = s.app_name AND x.id < s.id AND x.status = 'completed') AS baseline_scan_id FROM scans s)"""
COMPARE_SQL = f"""
  {HASHED_SQL}, {_BASELINE_SQL},
  d AS (SELECT DISTINCT app_name, scan_id, finding_hash FROM h WHERE is_false_positive = false),
  n AS (SELECT b.app_name, b.baseline_scan_id, b.current_scan_id,
    (SELECT count(*) FROM d WHERE d.app_name = b.app_name AND d.scan_id = b.current_scan_id AND d.finding_hash NOT IN
      (SELECT x.finding_hash FROM d x WHERE x.app_name = b.app_name AND x.scan_id = b.baseline_scan_id)) AS new_findings,
    (SELECT count(*) FROM d WHERE d.app_name = b.app_name AND d.scan_id = b.baseline_scan_id) AS baseline_size,
    (SELECT count(*) FROM d WHERE d.app_name = b.app_name AND d.scan_id = b.current_scan_id AND d.finding_hash IN
      (SELECT x.finding_hash FROM d x WHERE x.app_name = b.app_name AND x.scan_id = b.baseline_scan_id)) AS persistent_findings,
    (SELECT count(*) FROM h WHERE h.app_name = b.app_name AND h.scan_id = b.current_scan_id AND h.is_false_positive) AS false_positives
  FROM b WHERE b.baseline_scan_id IS NOT NULL)"""
COMPARED_SQL = f"""
WITH {COMPARE_SQL} SELECT app_name, baseline_scan_id, current_scan_id, new_findings, baseline_size - persistent_findings AS resolved_findings,
  persistent_findings, false_positives, round(CASE WHEN baseline_size > 0 THEN (baseline_size - persistent_findings) / baseline_size * 100
    WHEN new_findings = 0 THEN 100.0 ELSE 0.0 END, 4) AS remediation_score FROM n"""


@query("baseline_scan", f"WITH {_BASELINE_SQL} SELECT * FROM b", ["scans"])
def baseline_scan(spark, sf_dir):
    return life.baseline_scans(fx.view(spark, sf_dir, "scans"))


def _compared(spark, sf_dir):
    found = life.compare_scans(_hashed(spark, sf_dir), life.baseline_scans(fx.view(spark, sf_dir, "scans")))
    return found.withColumn("remediation_score", F.round("remediation_score", 4))


@query("compare_scans", COMPARED_SQL, ["findings", "scans"])
def compare_scans(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("append_comparison", COMPARED_SQL, ["findings", "scans"])
def append_comparison(spark, sf_dir):
    root = work_dir(spark, "store")
    tables.append_comparison(_compared(spark, sf_dir), root, _at(NOW))
    return tables.read_table(spark, root, "scan_comparisons").drop("id", "comparison_date")


CURRENT, BASELINE = 45, 25


def _side_sql(scan):
    return f"SELECT finding_hash FROM h WHERE scan_id = {scan} AND is_false_positive = false"


for _name, _left, _op, _right, _function in (
    ("new_finding_hashes", CURRENT, "EXCEPT", BASELINE, life.new_hashes),
    ("resolved_finding_hashes", BASELINE, "EXCEPT", CURRENT, life.resolved_hashes),
):
    def _set_query(spark, sf_dir, function=_function):
        return function(_hashed(spark, sf_dir), CURRENT, BASELINE)

    query(_name, f"WITH {HASHED_SQL} {_side_sql(_left)} {_op} {_side_sql(_right)}", ["findings"])(_set_query)


@query("persistent_finding_hashes", f"""
WITH {HASHED_SQL.replace('FROM findings', 'FROM rescanned_findings')} {_side_sql(CURRENT)} INTERSECT {_side_sql(BASELINE)}""", ["rescanned_findings"])
def persistent_finding_hashes(spark, sf_dir):
    """Two scans of one application, each with one order in 400 and one block of 30 orders in 400, so they grow with the table."""
    return life.persistent_hashes(life.with_hash(fx.view(spark, sf_dir, "rescanned_findings")), CURRENT, BASELINE)


# --- event folds ---

@query("apply_false_positives", f"""
WITH m AS ({MARKS_SQL}), last AS (SELECT finding_id, arg_max(m, (marked_at, id)) AS m FROM m GROUP BY finding_id)
SELECT f.id, f.is_false_positive OR l.m IS NOT NULL AS is_false_positive, l.m.reason AS false_positive_reason,
  CASE WHEN l.m IS NOT NULL THEN concat('Marked as false positive by ', l.m.analyst) END AS analyst_comment,
  CASE WHEN l.m IS NOT NULL THEN 'ignored' ELSE f.status END AS status, l.m.marked_at AS updated_at
FROM findings f LEFT JOIN last l ON l.finding_id = f.id""", LOG_VIEWS)
def apply_false_positives(spark, sf_dir):
    marks = _log(spark, sf_dir, MARKS_SQL)
    return life.apply_false_positives(_findings(spark, sf_dir), marks).select(
        "id", "is_false_positive", "false_positive_reason", "analyst_comment", "status", "updated_at")


@query("lifecycle_events", f"""
WITH m AS ({MARKS_SQL}), c AS ({CHANGES_SQL})
SELECT finding_id, 'false_positive' AS event_type, concat('Marked as false positive: ', reason) AS details, analyst, marked_at AS event_ts FROM m
UNION ALL SELECT finding_id, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'status_change' END, concat('Status changed to ', status),
  analyst, changed_at FROM c""", LOG_VIEWS)
def lifecycle_events(spark, sf_dir):
    return life.false_positive_events(_log(spark, sf_dir, MARKS_SQL)).unionByName(
        life.status_events(_log(spark, sf_dir, CHANGES_SQL)))


@query("derive_fp_patterns", f"""
WITH m AS (SELECT * FROM ({MARKS_SQL}) x WHERE create_pattern), j AS (SELECT f.app_name, f.file_path, f.component, m.reason, m.analyst
  FROM m JOIN findings f ON f.id = m.finding_id)
SELECT app_name, 'file_path' AS pattern_type, file_path AS pattern_value, reason, analyst AS created_by FROM j WHERE coalesce(file_path, '') <> ''
UNION ALL SELECT app_name, 'component', component, reason, analyst FROM j WHERE coalesce(component, '') <> ''""", LOG_VIEWS)
def derive_fp_patterns(spark, sf_dir):
    return life.derive_fp_patterns(_log(spark, sf_dir, MARKS_SQL), _findings(spark, sf_dir))


@query("current_status", f"""
WITH c AS ({CHANGES_SQL}), last AS (SELECT finding_id, arg_max(status, (changed_at, id)) AS status,
    max(changed_at) FILTER (WHERE status = 'resolved') AS resolution_date, max(changed_at) AS changed_at FROM c GROUP BY finding_id)
SELECT f.id, coalesce(l.status, f.status) AS status, l.resolution_date, l.changed_at AS updated_at
FROM findings f LEFT JOIN last l ON l.finding_id = f.id""", LOG_VIEWS)
def current_status(spark, sf_dir):
    return life.current_status(_findings(spark, sf_dir), _log(spark, sf_dir, CHANGES_SQL)).select(
        "id", "status", "resolution_date", "updated_at")


@query("comment_thread", """
WITH c AS (SELECT finding_id, event_ts, id, details, row_number() OVER (PARTITION BY finding_id ORDER BY event_ts, id) AS seq
  FROM finding_history WHERE event_type = 'comment_added')
SELECT finding_id, count(*) AS comments, string_agg(coalesce(details, ''), chr(10) ORDER BY seq) AS thread
FROM c GROUP BY finding_id""", ["finding_history"])
def comment_thread(spark, sf_dir):
    history = fx.view(spark, sf_dir, "finding_history")
    return life.comment_threads(history.where(F.col("event_type") == "comment_added"))


@query("analyst_comment_thread", """
WITH c AS (SELECT analyst AS finding_id, event_ts, id, details, row_number() OVER (PARTITION BY analyst ORDER BY event_ts, id) AS seq
  FROM finding_history)
SELECT finding_id AS analyst, cast(floor((seq - 1) / 50) AS BIGINT) AS part, count(*) AS comments,
  string_agg(coalesce(details, ''), chr(10) ORDER BY seq) AS thread FROM c GROUP BY ALL""", ["finding_history"])
def analyst_comment_thread(spark, sf_dir):
    """Threads long enough to span parts and slices: one per analyst."""
    history = fx.view(spark, sf_dir, "finding_history").withColumn("finding_id", F.col("analyst"))
    return life.comment_threads(history, per_part=50).withColumnRenamed("finding_id", "analyst")


# --- enrichment ---

# Component names of the local vulnerability records, spread over the findings.
_COMPONENT_SQL = "CASE id % 5 WHEN 0 THEN 'lodash' WHEN 1 THEN 'axios' WHEN 2 THEN 'express' WHEN 3 THEN 'moment' END"
_KNOWN_SQL = ", ".join(
    f"({sql_text(r['component'])}, {sql_text(r['cve_id'])}, {sql_text(r['fixed_version'])}, {sql_text(r['impact'])}, {sql_text(r['exploit_maturity'])})"
    for r in catalog.KNOWN_VULNERABILITIES)


@query("enrich_components", f"""
WITH f AS (SELECT id, {_COMPONENT_SQL} AS component FROM findings),
v AS (SELECT * FROM (VALUES {_KNOWN_SQL}) AS t(component, cve_id, fixed_version, impact, exploit_maturity))
SELECT f.id, f.component, v.cve_id AS known_cve_id, v.fixed_version AS known_fixed_version,
  CASE WHEN v.component = 'axios' THEN '9.9.9' ELSE v.fixed_version END AS latest_version, v.impact, v.exploit_maturity,
  CASE WHEN v.cve_id IS NOT NULL THEN {catalog.CVE_FALLBACK['cvss_score']}::DOUBLE END AS cvss_score
FROM f LEFT JOIN v ON v.component = f.component""", ["findings"])
def enrich_components(spark, sf_dir):
    known = life.known_vulnerabilities(spark)
    found = _findings(spark, sf_dir).select("id", F.expr(_COMPONENT_SQL).alias("component"))
    registry = known.where("component = 'axios'").select("component", F.lit("9.9.9").alias("latest_version"))
    details = life.cve_details(known.select("cve_id"), _cve_records(spark, sf_dir))
    return life.enrich_components(found, known, registry, details).select(
        "id", "component", "known_cve_id", "known_fixed_version", "latest_version", "impact", "exploit_maturity",
        F.col("cve_details.cvss_score").alias("cvss_score"))


def _cve_records(spark, sf_dir):
    """Detail records for the even parts; the odd ones have none."""
    return spark.sql("""
        SELECT concat('CVE-2024-', cast(p_partkey AS string)) AS cve_id,
          CASE WHEN p_partkey % 4 = 0 THEN array(p_name, 'second') ELSE array() END AS descriptions,
          CASE WHEN p_partkey % 6 = 0 THEN array(p_size / 5.0D) END AS scores,
          CASE WHEN p_partkey % 8 = 0 THEN array('V1', 'V2') ELSE array() END AS vectors,
          TIMESTAMP_NTZ '2024-01-01 10:00:00' + INTERVAL '1' DAY * p_size AS published,
          CASE WHEN p_partkey % 10 = 0 THEN TIMESTAMP_NTZ '2024-06-01 00:00:00' END AS last_modified,
          CASE WHEN p_partkey % 12 = 0 THEN array('CRITICAL') ELSE array() END AS severities,
          transform(sequence(1, cast(p_partkey % 5 + 1 AS int)), n -> concat('https://ref/', cast(p_partkey AS string), '/', cast(n AS string))) AS references
        FROM {part} WHERE p_partkey % 2 = 0""", part=fx.table(spark, sf_dir, "part"))


_FB = catalog.CVE_FALLBACK


@query("cve_details", f"""
SELECT concat('CVE-2024-', cast(p_partkey AS VARCHAR)) AS cve_id,
  CASE WHEN odd THEN {sql_text(_FB['description'])} WHEN p_partkey % 4 = 0 THEN p_name ELSE 'No description available' END AS description,
  CASE WHEN odd THEN {_FB['cvss_score']} WHEN p_partkey % 6 = 0 THEN p_size / 5.0 ELSE 0.0 END::DOUBLE AS cvss_score,
  CASE WHEN odd THEN {sql_text(_FB['cvss_vector'])} WHEN p_partkey % 8 = 0 THEN 'V1' ELSE '' END AS cvss_vector,
  CASE WHEN odd THEN {sql_text(_FB['published_date'])} ELSE strftime(TIMESTAMP '2024-01-01 10:00:00' + INTERVAL 1 DAY * p_size, '%Y-%m-%d') END AS published_date,
  CASE WHEN odd THEN {sql_text(_FB['last_modified'])} WHEN p_partkey % 10 = 0 THEN '2024-06-01' ELSE '' END AS last_modified,
  CASE WHEN odd THEN {sql_text(_FB['severity'])} WHEN p_partkey % 12 = 0 THEN 'CRITICAL' ELSE 'UNKNOWN' END AS severity,
  CASE WHEN odd THEN concat({sql_text(_FB['reference_prefix'])}, 'CVE-2024-', cast(p_partkey AS VARCHAR))
    ELSE array_to_string(list_transform(range(1, least(p_partkey % 5 + 1, 3) + 1), lambda n: concat('https://ref/', cast(p_partkey AS VARCHAR), '/', cast(n AS VARCHAR))), ' ') END AS refs
FROM (SELECT *, p_partkey % 2 = 1 AS odd FROM part) p""")
def cve_details(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("CVE-2024-"), F.col("p_partkey").cast("string")).alias("cve_id"))
    found = life.cve_details(ids, _cve_records(spark, sf_dir))
    return found.select("*", F.array_join("references", " ").alias("refs")).drop("references")


_CHAIN_SQL = """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'pkg' ELSE concat('lib', cast(p_size AS VARCHAR)) END AS component,
  CASE p_partkey % 5 WHEN 0 THEN 'app → pkg' WHEN 1 THEN concat('app → express → lib', cast(p_size AS VARCHAR))
    WHEN 2 THEN concat('app → a → b →  lib', cast(p_size AS VARCHAR), ' ') WHEN 3 THEN '' END AS dependency_chain FROM {t:part}"""


@query("dependency_chain_nodes", f"""
WITH c AS (SELECT *, string_split(dependency_chain, ' → ') AS nodes FROM ({_CHAIN_SQL}) x WHERE coalesce(dependency_chain, '') <> ''),
n AS (SELECT id, component, cast(len(nodes) AS INTEGER) AS depth, cast(generate_subscripts(nodes, 1) - 1 AS INTEGER) AS position, trim(unnest(nodes)) AS node FROM c)
SELECT id, position, node, depth, depth = 2 AS direct, node = component AS vulnerable FROM n""")
def dependency_chain_nodes(spark, sf_dir):
    chains = spark.sql(fx.spark_sql(_CHAIN_SQL.replace("VARCHAR", "string"), sf_dir))
    return life.dependency_chain_nodes(chains)


@query("component_reach", f"""
WITH RECURSIVE c AS (SELECT id, component, list_transform(string_split(dependency_chain, ' → '), lambda x: trim(x)) AS nodes FROM ({_CHAIN_SQL}) x
    WHERE coalesce(dependency_chain, '') <> ''),
  e AS (SELECT DISTINCT nodes[i] AS parent, nodes[i + 1] AS child FROM (SELECT nodes, unnest(range(1, len(nodes))) AS i FROM c)
    WHERE nodes[i] <> nodes[i + 1] AND nodes[i] <> '' AND nodes[i + 1] <> ''),
  r(component, dependent, depth) AS (
    SELECT DISTINCT component, component, 0 FROM c WHERE component <> ''
    UNION SELECT r.component, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.dependent WHERE r.depth < 20)
SELECT component, dependent, cast(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def component_reach(spark, sf_dir):
    """What depends on each finding's component, over the edges of all chains."""
    chains = spark.sql(fx.spark_sql(_CHAIN_SQL.replace("VARCHAR", "string"), sf_dir)).where("coalesce(dependency_chain, '') <> ''")
    return life.component_reach(life.dependency_edges(chains), chains)


@query("usage_locations", """
SELECT p_partkey AS id, cast(n AS INTEGER) AS position, concat('/src/', p_name, '.js:', cast(n AS VARCHAR)) AS location
FROM (SELECT *, unnest(range(0, p_partkey % 4)) AS n FROM part) p""")
def usage_locations(spark, sf_dir):
    rows = spark.sql("""
        SELECT p_partkey AS id, to_json(CASE WHEN p_partkey % 4 = 0 THEN array() ELSE
          transform(sequence(0, cast(p_partkey % 4 AS int) - 1), n -> concat('/src/', p_name, '.js:', cast(n AS string))) END) AS usage_locations
        FROM {part}""", part=fx.table(spark, sf_dir, "part"))
    return life.json_array_rows(rows, "usage_locations", "location")


@query("scan_progress", """
WITH u AS (SELECT o_orderkey AS id, cast(floor(o_orderkey / 30) AS bigint) AS scan_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 + 50 END AS total_files,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 END AS scanned_files FROM orders),
last AS (SELECT scan_id, arg_max(total_files, id) FILTER (WHERE total_files IS NOT NULL) AS total_files,
    arg_max(scanned_files, id) FILTER (WHERE scanned_files IS NOT NULL) AS scanned_files FROM u GROUP BY scan_id)
SELECT s.id, s.app_name, coalesce(l.total_files, 0) AS total_files, coalesce(l.scanned_files, 0) AS scanned_files,
  CASE WHEN coalesce(l.total_files, 0) > 0 THEN round(coalesce(l.scanned_files, 0) * 100 / l.total_files, 1) ELSE 0.0 END::DOUBLE AS percent
FROM scans s LEFT JOIN last l ON l.scan_id = s.id""", ["scans"])
def scan_progress(spark, sf_dir):
    updates = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 30).alias("scan_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 50 + 50).alias("total_files"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 50).alias("scanned_files"))
    return life.scan_progress(fx.view(spark, sf_dir, "scans"), updates).select(
        "id", "app_name", "total_files", "scanned_files", "percent")
