"""Cross-site boilerplate lines by distinct-site spread.

Each line is known by the hash of its trimmed content. How many sites a line is
on comes from a HyperLogLog sketch per hash; sketches merge map-side, so a line on
any share of all pages reaches the shuffle as one sketch per task. A line seen
fewer times than the threshold can't be on more sites and needs no sketch. Where
the estimate is within the stated error of the threshold, sites are counted
exactly. Lines on `sites` sites or more leave every text.

Defined results: a null text has no lines and stays as it is; lines of white space
only stay; a null site is a site of its own; rows that repeat id and text are
treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm.common import SPACE, stored

SITES = 8
#: log2 of a sketch's registers, and how many standard errors around the threshold are counted exactly.
LOG_REGISTERS = 10
ERRORS = 6


def _line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")))


def _row_key() -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))


def line_table(documents: DataFrame) -> DataFrame:
    """Stored (row, site, pos, key) of every line that is not blank."""
    lines = documents.where("text IS NOT NULL").select(
        _row_key().alias("row"), F.coalesce(F.concat(F.lit("="), "site"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return stored(lines.where(F.col("line").rlike(f"[^{SPACE}]")).select("row", "site", "pos", _line_key(F.col("line")).alias("key")),
                  "lines")


def spread_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Stored keys of the lines on `sites` different sites or more."""
    often = stored(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key"), "line-often")
    rows = lines.select("key", "site").join(often, "key")
    spread = stored(rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("estimate")),
                    "line-spread")
    margin = 1 + ERRORS * 1.04 / (1 << LOG_REGISTERS) ** 0.5 * sites
    unsure = spread.where(F.abs(F.col("estimate") - sites) <= margin).select("key")
    exact = (rows.join(unsure, "key").groupBy("key", "site").agg(F.lit(1).alias("one"))
             .groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key"))
    return stored(spread.where(F.col("estimate") - sites > margin).select("key").unionByName(exact), "boilerplate")


def remove_boilerplate(documents: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the clean text of each row (doc_id, text, site)."""
    lines = line_table(documents)
    dropped = (lines.join(spread_lines(lines, sites), "key").groupBy("row")
               .agg(F.collect_set("pos").alias("dropped")))
    texts = documents.select("doc_id", "text", _row_key().alias("row")).withColumn("_lines", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    return (texts.join(dropped, "row", "left")
            .select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
                    F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
                    F.when(F.col("dropped").isNull(), F.col("text"))
                    .otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")).alias("text")))


def op7_line_spread(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = remove_boilerplate(documents.select("doc_id", "text", F.col("source").alias("site")))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


OP7_SQL = f"""
WITH split_lines AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split_lines),
keyed AS (
  SELECT *, regexp_replace(line, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS k FROM lines),
wide AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {SITES}),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM wide)) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM wide)) AS clean
  FROM keyed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(clean, '')) AS clean_sha256
FROM documents d LEFT JOIN cut ON d.doc_id IS NOT DISTINCT FROM cut.doc_id
"""
