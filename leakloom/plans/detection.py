"""Registered detection queries: files, lines, secrets, entropy."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from leakloom import catalog
from leakloom.functions import text as tx
from leakloom.operators import detect
from leakloom.plans import fixtures as fx
from leakloom.plans.registry import query, sql_list, sql_text
from leakloom.session import work_dir
from leakloom.sources import files as source
from leakloom.sources.patterns import load_patterns

KEYS = ("file_id", "app_name", "path")
ALL_PATTERNS = catalog.BUILTIN_PATTERNS + catalog.CUSTOM_PATTERNS

ELIGIBLE_SQL = f"""
  SELECT * FROM code_files
  WHERE length <= {catalog.MAX_FILE_BYTES}
    AND lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) IN ({sql_list(catalog.SCAN_EXTENSIONS)})
    AND NOT list_has_any(string_split(path, '/'), [{sql_list(catalog.SKIP_NAMES)}])"""

LINES_SQL = f"""
  eligible AS ({ELIGIBLE_SQL}),
  split AS (SELECT *, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS arr FROM eligible),
  lines AS (SELECT file_id, app_name, path, arr, unnest(arr) AS line,
              cast(generate_subscripts(arr, 1) AS BIGINT) AS line_number FROM split)"""


def _pattern_sql(patterns) -> str:
    branches = []
    for p in patterns:
        group = p.secret_group()
        branches.append(
            f"SELECT file_id, app_name, path, arr, line_number, "
            f"unnest(regexp_extract_all(line, {sql_text(p.pattern)}, {group}, 'i')) AS secret, "
            f"{sql_text(p.name)} AS pattern_name, '{p.pattern_type}' AS pattern_type, '{p.severity}' AS severity, "
            f"{p.confidence}::DOUBLE AS confidence, {sql_text(p.remediation)} AS remediation FROM lines")
    return "\n  UNION ALL ".join(branches)


_SHAPES_SQL = "list_concat(" * (len(catalog.ENTROPY_SHAPES) - 1) + ", ".join(
    f"regexp_extract_all(line, {sql_text(s)}, 1)" + (")" if n else "") for n, s in enumerate(catalog.ENTROPY_SHAPES))
_STOP_SQL = " AND ".join(f"NOT contains(lower(candidate), '{w}')" for w in catalog.ENTROPY_STOP_WORDS)

ENTROPY_SQL = f"""
  candidates AS (SELECT file_id, app_name, path, arr, line_number, unnest({_SHAPES_SQL}) AS candidate FROM lines),
  scored AS (SELECT *, list_entropy(string_split(candidate, '')) AS entropy FROM candidates
             WHERE length(candidate) >= {catalog.ENTROPY_MIN_LENGTH} AND {_STOP_SQL}
               AND len(list_distinct(string_split(candidate, ''))) >= {catalog.ENTROPY_MIN_DISTINCT} * length(candidate)),
  strong AS (SELECT *, least(0.9, entropy / 6.0) AS confidence FROM scored
             WHERE round(entropy, 12) >= {catalog.ENTROPY_MIN_BITS})"""

_BRANCH = "file_id, app_name, path, arr, line_number, secret, pattern_name, pattern_type, severity, confidence, remediation"
HITS_SQL = f"""
  {LINES_SQL}, {ENTROPY_SQL},
  hits AS ({_pattern_sql(catalog.BUILTIN_PATTERNS)}),
  found AS (SELECT {_BRANCH} FROM hits UNION ALL
            SELECT file_id, app_name, path, arr, line_number, candidate, '{catalog.ENTROPY_NAME}', 'entropy', 'medium',
              confidence, {sql_text(catalog.ENTROPY_REMEDIATION)} FROM strong)"""
_HASH = "left(sha256(secret), 16) AS secret_hash"


def _files(spark, sf_dir):
    return detect.eligible_files(fx.code_files(spark, sf_dir))


def _rounded(df):
    return df.withColumn("confidence", F.round("confidence", 6))


@query("eligible_files", f"SELECT file_id, app_name, path, length FROM ({ELIGIBLE_SQL})", ["code_files"])
def eligible_files(spark, sf_dir):
    return detect.eligible_files(fx.view(spark, sf_dir, "code_files")).select("file_id", "app_name", "path", "length")


@query("file_lines", f"WITH {LINES_SQL} SELECT file_id, app_name, path, line_number, line FROM lines", ["code_files"])
def file_lines(spark, sf_dir):
    return detect.file_lines(_files(spark, sf_dir), KEYS)


_SCAN_COLUMNS = "file_id, app_name, path, line_number, pattern_name, severity, round(confidence, 6) AS confidence"


def _scan(spark, sf_dir, patterns, entropy=False, **options):
    found = detect.scan_secrets(_files(spark, sf_dir), KEYS, patterns, entropy=entropy, **options)
    return _rounded(found).select(*KEYS, "line_number", "pattern_name", "severity", "confidence", "secret_hash")


@query("secret_scan", f"WITH {HITS_SQL} SELECT {_SCAN_COLUMNS}, {_HASH} FROM hits", ["code_files"])
def secret_scan(spark, sf_dir):
    return _scan(spark, sf_dir, catalog.BUILTIN_PATTERNS)


@query("secret_scan_custom",
       f"WITH {LINES_SQL}, hits AS ({_pattern_sql(ALL_PATTERNS)}) SELECT {_SCAN_COLUMNS}, {_HASH} FROM hits",
       ["code_files"])
def secret_scan_custom(spark, sf_dir):
    return _scan(spark, sf_dir, ALL_PATTERNS)


@query("secret_severity_by_app", f"""
WITH {HITS_SQL} SELECT app_name, severity, count(*) AS findings FROM hits GROUP BY app_name, severity""", ["code_files"])
def secret_severity_by_app(spark, sf_dir):
    found = detect.scan_secrets(_files(spark, sf_dir), ("app_name",), entropy=False)
    return found.groupBy("app_name", "severity").agg(F.count("*").alias("findings"))


@query("entropy_candidates",
       f"WITH {LINES_SQL}, {ENTROPY_SQL} SELECT file_id, line_number, candidate FROM candidates", ["code_files"])
def entropy_candidates(spark, sf_dir):
    return detect.entropy_strings(_files(spark, sf_dir), ("file_id",))


@query("high_entropy_strings", f"""
WITH {LINES_SQL}, {ENTROPY_SQL} SELECT file_id, line_number, candidate, round(entropy, 6) AS entropy,
  round(confidence, 6) AS confidence FROM strong""", ["code_files"])
def high_entropy_strings(spark, sf_dir):
    found = detect.entropy_strings(_files(spark, sf_dir), ("file_id",), only_high=True)
    return _rounded(found).withColumn("entropy", F.round("entropy", 6))


@query("shannon_entropy", """
SELECT conv_id, turn, round(CASE WHEN text = '' THEN 0.0 ELSE list_entropy(regexp_extract_all(text, '(?s).')) END, 6) AS entropy
FROM conversations""")
def shannon_entropy(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "conversations")
    return texts.select("conv_id", "turn", F.round(tx.shannon_entropy(F.col("text")), 6).alias("entropy"))


_STRIPPED = "list_transform({}, lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g'))"
_CONTEXT_SQL = (
    "array_to_string(" + _STRIPPED.format("arr[greatest(line_number - 2, 1):line_number - 1]") + ", chr(10)) AS context_before, "
    "array_to_string(" + _STRIPPED.format("arr[line_number + 1:line_number + 2]") + ", chr(10)) AS context_after")


@query("secret_context", f"""
WITH {HITS_SQL} SELECT file_id, line_number, pattern_name, {_HASH}, {_CONTEXT_SQL} FROM hits""", ["code_files"])
def secret_context(spark, sf_dir):
    found = detect.scan_secrets(_files(spark, sf_dir), KEYS, entropy=False)
    return found.select("file_id", "line_number", "pattern_name", "secret_hash", "context_before", "context_after")


@query("secret_findings_all", f"""
WITH {HITS_SQL} SELECT {_SCAN_COLUMNS}, pattern_type, remediation, {_HASH}, {_CONTEXT_SQL} FROM found""", ["code_files"])
def secret_findings_all(spark, sf_dir):
    return _rounded(detect.scan_secrets(_files(spark, sf_dir), KEYS))


@query("batch_scan_counts", f"""
WITH {HITS_SQL}, apps AS (SELECT app_name FROM code_files UNION SELECT name FROM applications)
SELECT a.app_name, count(f.file_id) AS findings
FROM (SELECT app_name FROM apps WHERE app_name IN (SELECT app_name FROM code_files)) a
LEFT JOIN found f ON f.app_name = a.app_name GROUP BY a.app_name""", ["code_files", "applications"])
def batch_scan_counts(spark, sf_dir):
    """Applications with files, plus those of the inventory, which have none."""
    every = fx.view(spark, sf_dir, "code_files").select("app_name")
    apps = every.select(F.col("app_name").alias("name")).distinct().unionByName(
        fx.view(spark, sf_dir, "applications").select("name"))
    found = detect.scan_secrets(_files(spark, sf_dir), ("app_name",))
    return detect.batch_scan_counts(apps, every, found)


_EXCLUDED_SQL = " OR ".join(f"regexp_matches(secret, {sql_text(p)})" for p in catalog.EXCLUSIONS)


@query("secret_exclusions",
       f"WITH {HITS_SQL} SELECT {_SCAN_COLUMNS}, {_HASH} FROM found WHERE NOT ({_EXCLUDED_SQL})", ["code_files"])
def secret_exclusions(spark, sf_dir):
    return _scan(spark, sf_dir, catalog.BUILTIN_PATTERNS, entropy=True, drop_excluded=True)


_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN pattern_name IN ({sql_list(members)}) THEN '{name}'"
    for name, members in catalog.PATTERN_CATEGORIES.items()) + " END"


@query("findings_by_category", f"""
WITH {LINES_SQL}, hits AS ({_pattern_sql(ALL_PATTERNS)})
SELECT {_CATEGORY_SQL} AS category, pattern_name, count(*) AS findings FROM hits GROUP BY ALL""", ["code_files"])
def findings_by_category(spark, sf_dir):
    found = detect.scan_secrets(_files(spark, sf_dir), ("app_name",), ALL_PATTERNS, entropy=False)
    return detect.with_category(found).groupBy("category", "pattern_name").agg(F.count("*").alias("findings"))


@query("confidence_filter",
       f"WITH {HITS_SQL} SELECT {_SCAN_COLUMNS}, {_HASH} FROM found WHERE confidence >= 0.85", ["code_files"])
def confidence_filter(spark, sf_dir):
    return _scan(spark, sf_dir, catalog.BUILTIN_PATTERNS, entropy=True, min_confidence=0.85)


_COUNTED_SQL = " OR ".join(f"ends_with(path, '{s}')" for s in catalog.COUNT_SUFFIXES)


@query("scannable_file_count", f"""
SELECT app_name, cast(count(*) FILTER (WHERE ({_COUNTED_SQL}) AND len(list_filter(
    string_split(path, '/')[1:-2], lambda d: starts_with(d, '.') OR d IN ({sql_list(catalog.COUNT_SKIP_DIRS)}))) = 0) AS BIGINT) AS total_files
FROM code_files GROUP BY app_name""", ["code_files"])
def scannable_file_count(spark, sf_dir):
    return detect.scannable_file_count(fx.view(spark, sf_dir, "code_files"))


@query("source_tree_scan", f"""
WITH every AS (SELECT * FROM code_files),
  split AS (SELECT file_id, app_name, path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS arr FROM every),
  lines AS (SELECT file_id, app_name, path, arr, unnest(arr) AS line, cast(generate_subscripts(arr, 1) AS BIGINT) AS line_number FROM split),
  {ENTROPY_SQL}, hits AS ({_pattern_sql(catalog.BUILTIN_PATTERNS)}),
  found AS (SELECT app_name, pattern_name, secret FROM hits UNION ALL SELECT app_name, '{catalog.ENTROPY_NAME}', candidate FROM strong)
SELECT app_name, pattern_name, {_HASH}, count(*) AS findings FROM found GROUP BY ALL""", ["code_files"])
def source_tree_scan(spark, sf_dir):
    """Write the texts as a tree of files, one directory per application, and scan that tree."""
    root = work_dir(spark, "tree")
    (fx.code_files(spark, sf_dir).select("app_name", F.col("app_name").alias("dir"), "text")
     .select("dir", "text").write.option("maxRecordsPerFile", 50).partitionBy("dir").text(root))
    files = source.read_tree(spark, root, extensions=(".txt",))
    named = files.withColumn("app_name", F.regexp_replace("app_name", "^dir=", ""))
    found = detect.scan_secrets(named, ("app_name",))
    return found.groupBy("app_name", "pattern_name", "secret_hash").agg(F.count("*").alias("findings"))


# Hidden and skipped directories, hidden files; the path decides what is scanned.
_ODD_PATH = """CASE file_id % 6 WHEN 0 THEN concat('.github/', path) WHEN 1 THEN concat('_private/', path)
  WHEN 2 THEN concat('x/__init__', cast(file_id AS string), '.py') WHEN 3 THEN concat('.git/', path) ELSE path END"""


@query("listed_tree_scan", f"""
WITH every AS (SELECT file_id, app_name, {_ODD_PATH} AS path, length, text FROM code_files WHERE length <= {catalog.MAX_FILE_BYTES}),
{HITS_SQL.replace('FROM code_files', 'FROM every')}
SELECT app_name, path, pattern_name, {_HASH}, count(*) AS findings FROM found GROUP BY ALL""", ["code_files"])
def listed_tree_scan(spark, sf_dir):
    """The texts as a tree with hidden, skipped and ineligible names, listed before anything is read."""
    root = work_dir(spark, "tree")
    files = fx.code_files(spark, sf_dir).where(F.col("length") <= catalog.MAX_FILE_BYTES)
    fx.write_tree(files.select("app_name", F.expr(_ODD_PATH).alias("path"), "text"), root)
    apps = files.select(F.col("app_name").alias("name"), F.concat(F.lit(f"{root}/"), "app_name").alias("local_path")).distinct()
    found = detect.scan_secrets(source.read_listed(source.list_tree(apps)), ("app_name", "path"))
    return found.groupBy("app_name", "path", "pattern_name", "secret_hash").agg(F.count("*").alias("findings"))


_OWN = (
    catalog.Pattern("Long Hex", "[0-9a-f]{32}", "low", 0.5, "", "Check"),
    catalog.Pattern("Quoted Password", "password\\s*=\\s*'([^']+)'", "high", 0.9, "", "Move it"),
    catalog.Pattern("Slack", "xox[bp]-([0-9a-f]+)", "medium", 0.8, "", ""),
)


@query("pattern_file_scan", f"""
WITH {LINES_SQL}, hits AS ({_pattern_sql(_OWN)})
SELECT {_SCAN_COLUMNS}, {_HASH} FROM hits""", ["code_files"])
def pattern_file_scan(spark, sf_dir):
    """A user's pattern file in the shared folder, loaded by Spark and used for a scan."""
    path = work_dir(spark, "patterns")
    entries = [{"name": p.name, "pattern": p.pattern, "severity": p.severity, "confidence": p.confidence,
                "remediation": p.remediation} for p in _OWN]
    spark.range(1).select(F.lit(json.dumps({"patterns": entries}))).coalesce(1).write.text(path)
    return _scan(spark, sf_dir, load_patterns(path, spark))
