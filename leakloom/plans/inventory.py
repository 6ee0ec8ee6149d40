"""Registered onboarding queries.

Inventories are written from `supplier` with planted errors, then read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leakloom.operators import onboarding
from leakloom.plans import fixtures as fx
from leakloom.plans.registry import query
from leakloom.session import work_dir
from leakloom.sources import inventory as source

# Requests in order of `pos`: two per supplier; names repeat across suppliers.
REQUEST_SQL = """
SELECT s_suppkey * 2 + half AS pos,
  CASE (s_suppkey * 2 + half) % 17 WHEN 0 THEN '' WHEN 1 THEN concat('app', cast(s_suppkey AS string))
    ELSE concat('svc', cast(s_suppkey % 60 AS string)) END AS name,
  CASE (s_suppkey + half * 3) % 7 WHEN 0 THEN 'svn' WHEN 1 THEN 'local' WHEN 2 THEN 'GitLab' WHEN 3 THEN 'bitbucket' ELSE 'github' END AS repo_type,
  CASE (s_suppkey * 2 + half) % 11 WHEN 0 THEN '' WHEN 1 THEN 'https://example.org/x/y' WHEN 2 THEN 'https://github.com/solo'
    WHEN 3 THEN concat('https://gitlab.example.org/grp/p', cast(s_suppkey AS string))
    ELSE concat('https://github.com/org', cast(s_nationkey AS string), '/repo', cast(s_suppkey AS string), '.git') END AS repo_url,
  CASE WHEN (s_suppkey * 2 + half) % 5 = 0 THEN '' ELSE concat('/srv/', cast(s_suppkey AS string)) END AS local_path,
  CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE concat('team', cast(s_nationkey AS string)) END AS team,
  '' AS owner,
  CASE s_suppkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS criticality,
  CASE s_suppkey % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'TRUE' ELSE 'true' END AS auto_scan
FROM {t:supplier}, (VALUES (0), (1)) AS h(half)"""

_R = f"""r AS (SELECT pos, trim(name) AS name, repo_type, nullif(repo_url, '') AS repo_url, nullif(local_path, '') AS local_path,
  nullif(team, '') AS team, nullif(owner, '') AS owner, criticality, lower(auto_scan) = 'true' AS auto_scan
  FROM ({REQUEST_SQL}) x WHERE trim(name) <> '')"""

_CHECKED = f"""{_R}, parts AS (
  SELECT *, lower(repo_type) AS kind, regexp_extract(coalesce(repo_url, ''), '^[a-z]+://([^/?#]*)', 1) AS host,
    string_split(trim(regexp_extract(coalesce(repo_url, ''), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') AS segments FROM r),
checked AS (SELECT *,
    CASE WHEN kind = 'local' AND local_path IS NULL THEN 'Local path is required for local repositories'
      WHEN kind <> 'local' AND repo_url IS NULL THEN 'Repository URL is required for remote repositories' END AS field_error,
    'Repository validation failed: ' || CASE
      WHEN kind NOT IN ('github', 'gitlab', 'bitbucket', 'local') THEN concat('Unsupported repository type: ', repo_type)
      WHEN kind = 'github' AND NOT contains(host, 'github.com') THEN 'Not a valid GitHub URL'
      WHEN kind = 'github' AND len(segments) < 2 THEN 'Invalid GitHub repository path'
      WHEN kind = 'gitlab' AND NOT contains(host, 'gitlab') THEN 'Not a valid GitLab URL' END AS repository_error FROM parts)"""


def _requests(spark, sf_dir, kind):
    """The inventory written to the shared folder and loaded again."""
    rows = spark.sql(fx.spark_sql(REQUEST_SQL, sf_dir))
    path = work_dir(spark, "inventory") + "." + kind
    if kind == "csv":
        rows.repartitionByRange("pos").sortWithinPartitions("pos").write.option("header", True).csv(path)
    else:
        entry = F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in ("repo_url", "local_path", "team", "owner") else F.col(c)
                           for c in rows.columns if c not in ("pos", "auto_scan")],
                         (F.lower("auto_scan") == "true").alias("auto_scan"))
        # One document per range of rows, each in a file of its own.
        ranges = rows.repartitionByRange("pos").select("pos", entry.alias("entry"), F.spark_partition_id().alias("range"))
        documents = ranges.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("listed"))
        (documents.select(F.to_json(F.struct(F.col("listed.entry").alias("applications"))).alias("value"))
         .write.option("maxRecordsPerFile", 1).text(path))
    return source.load_inventory(spark, path)


_PLAIN = ("name", "repo_type", "repo_url", "local_path", "team", "owner", "criticality", "auto_scan")


@query("inventory_csv", f"WITH {_R} SELECT {', '.join(_PLAIN)} FROM r")
def inventory_csv(spark, sf_dir):
    return _requests(spark, sf_dir, "csv").select(*_PLAIN)


@query("inventory_json", f"WITH {_R} SELECT {', '.join(_PLAIN)} FROM r")
def inventory_json(spark, sf_dir):
    return _requests(spark, sf_dir, "json").select(*_PLAIN)


@query("validate_inventory", f"WITH {_CHECKED} SELECT name, repo_type, repo_url, field_error, repository_error FROM checked")
def validate_inventory(spark, sf_dir):
    return onboarding.validate(_requests(spark, sf_dir, "csv")).select(
        "name", "repo_type", "repo_url", "field_error", "repository_error")


@query("parse_repo_url", f"""
WITH {_CHECKED} SELECT name, repo_url, host, segments[1] AS repo_owner, regexp_replace(segments[2], '\\.git$', '') AS repo_name FROM checked""")
def parse_repo_url(spark, sf_dir):
    return onboarding.parse_repo_url(_requests(spark, sf_dir, "csv")).select(
        "name", "repo_url", "host", "repo_owner", "repo_name")


@query("new_applications", f"""
WITH {_R} SELECT name, repo_type FROM r WHERE name NOT IN (SELECT name FROM applications)""", ["applications"])
def new_applications(spark, sf_dir):
    known = fx.view(spark, sf_dir, "applications")
    return onboarding.new_applications(_requests(spark, sf_dir, "csv"), known).select("name", "repo_type")


_OUTCOME = f"""{_CHECKED}, firsts AS (SELECT name, min(pos) FILTER (WHERE field_error IS NULL AND repository_error IS NULL) AS first_valid,
  max(pos) AS last_pos FROM checked GROUP BY name)"""


@query("bulk_onboard_result", f"""
WITH {_OUTCOME}, errors AS (SELECT c.name, CASE WHEN field_error IS NOT NULL THEN field_error
    WHEN a.name IS NOT NULL OR coalesce(first_valid < last_pos, false) THEN concat('Application ''', c.name, ''' already exists')
    ELSE repository_error END AS error
  FROM checked c JOIN firsts f ON f.name = c.name AND f.last_pos = c.pos LEFT JOIN applications a ON a.name = c.name)
SELECT name, CASE WHEN error IS NULL THEN 'Success' ELSE concat('Failed: ', error) END AS result FROM errors""", ["applications"])
def bulk_onboard_result(spark, sf_dir):
    return onboarding.bulk_result(_requests(spark, sf_dir, "csv"), fx.view(spark, sf_dir, "applications"))


@query("accepted_applications", f"""
WITH {_OUTCOME} SELECT c.name, repo_type, repo_url, local_path, team, owner, criticality, auto_scan, 'active' AS status,
  TIMESTAMP '2024-02-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
FROM checked c JOIN firsts f ON f.name = c.name AND f.first_valid = c.pos WHERE c.name NOT IN (SELECT name FROM applications)""",
       ["applications"])
def accepted_applications(spark, sf_dir):
    now = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")
    return onboarding.accepted_applications(_requests(spark, sf_dir, "csv"), fx.view(spark, sf_dir, "applications"), now)
