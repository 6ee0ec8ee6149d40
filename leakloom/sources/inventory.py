"""Application inventories in CSV or JSON as onboarding requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FIELDS = ("name", "repo_type", "repo_url", "local_path", "team", "owner", "criticality")
DEFAULTS = {"repo_type": "github", "criticality": "medium"}
JSON_SCHEMA = ("applications ARRAY<STRUCT<name STRING, repo_type STRING, repo_url STRING, local_path STRING, "
               "team STRING, owner STRING, criticality STRING, auto_scan BOOLEAN>>")


def _position(*more: Column) -> Column:
    """Order of a row within its input: file, block, then row."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    *(more or (F.monotonically_increasing_id().alias("row"),)))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV. Fields are trimmed; blank url, path, team and owner become null.

    The defaults for repo_type and criticality apply only where the column is absent.
    Rows without a name are skipped. `multi_line` admits line breaks within quoted
    fields; a file is then read by one task.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    columns = []
    for name in FIELDS:
        if name not in raw.columns:
            columns.append(F.lit(DEFAULTS.get(name)).cast("string").alias(name))
            continue
        value = F.trim(F.coalesce(name, F.lit("")))
        keep_blank = name in DEFAULTS or name == "name"
        columns.append((value if keep_blank else F.nullif(value, F.lit(""))).alias(name))
    auto = F.lower(F.coalesce("auto_scan", F.lit(""))) == "true" if "auto_scan" in raw.columns else F.lit(True)
    rows = raw.select(*columns, auto.alias("auto_scan"), _position().alias("position"))
    return rows.where(F.col("name") != "")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document with an `applications` array; only names are trimmed.

    One document is read by one task. Large inventories belong in one document per
    line, read with `json_requests(spark.read.schema(JSON_SCHEMA).json(path))`.
    """
    return json_requests(spark.read.option("multiLine", True).schema(JSON_SCHEMA).json(path))


def json_requests(documents: DataFrame) -> DataFrame:
    """Requests out of parsed documents read from files."""
    entries = (documents.select("*", "_metadata").withColumn("document", F.monotonically_increasing_id())
               .select("_metadata", "document", F.posexplode("applications").alias("row", "a")))
    columns = [F.coalesce(f"a.{n}", F.lit(DEFAULTS[n])).alias(n) if n in DEFAULTS else F.col(f"a.{n}")
               for n in FIELDS if n != "name"]
    return entries.select(
        F.trim("a.name").alias("name"), *columns,
        F.coalesce("a.auto_scan", F.lit(True)).alias("auto_scan"),
        _position(F.col("document"), F.col("row")).alias("position"),
    ).where(F.coalesce("name", F.lit("")) != "")


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix; anything else is refused."""
    readers = {".csv": read_csv, ".json": read_json}
    for suffix, reader in readers.items():
        if path.lower().rstrip("/").endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"unsupported inventory format: {path}")
