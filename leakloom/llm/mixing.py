"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies: its source's target over its
source's size. Laid end to end within the source, with one random offset in
front, these numbers cross integer boundaries; a document is taken once for
every boundary inside its own stretch. Documents lie in order of size, so that
the words taken stay near the target also for small sources.

Expected copies are fixed-point integers (24 binary places): sums are exact in
any order, and a document never gets more than the limit.

Defined results: null texts have size 0; a null source is a source of its own,
the last one; repeated rows are documents of their own; documents of a source
without words are not taken; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.llm.common import SPACE, before, on_keys, stored

PLACES = 24
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"
#: Hash buckets within a size bin; a block is (source, bin, bucket).
BUCKETS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def _size_bin(size: str) -> Column:
    """Eight bins per power of two, in order of size."""
    return F.expr(f"length(bin({size})) * 8 + (shiftright({size}, greatest(length(bin({size})) - 4, 0)) & 7)")


def _hash_bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   limit: int = LIMIT) -> DataFrame:
    """Target of each row of (source, source_size): `share` of all sizes by weight, at most `limit` times its size.

    What a source can't take goes to the others by weight. In order of limit per
    weight, the sources at their limit come first; for each place, the level is
    what the rest could get per weight if all earlier ones were at their limit.
    The highest level that does not exceed its own source's limit is the true one.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    return (
        sources
        .withColumn("_place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * float(limit))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
        .withColumn("_best", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_weight") * F.col("_best"), F.col("_cap"))))
        .drop("_place", "_weight", "_cap", "_ratio", "_budget", "_capped", "_open", "_level", "_best")
    )


def mix_sources(documents: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS,
                share: float = SHARE, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """Copies of each row of `documents` (doc_id, text, source) that the mix takes.

    Returns doc_id, source, size, source_size, target, copies, and each column c of `keep` as _keep_c.
    The text is read once; only ids, sources and sizes are shuffled. Sums over
    blocks give each source's size and each block's start, so a source with any
    share of the rows is spread over its blocks.
    """
    sized = stored(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                         *[F.col(c).alias(f"_keep_{c}") for c in keep])
        .withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .withColumn("_bin", _size_bin("size"))
        .withColumn("_bucket", _hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 6) % BUCKETS),
        "mix-sizes")
    block = ["_bin", "_bucket"]
    blocks = sized.groupBy("_source", *block).agg(F.first("source").alias("source"), F.count("*").alias("_n"),
                                                  F.sum("size").alias("_words"))
    sources = source_targets(blocks.groupBy("_source").agg(F.first("source").alias("source"),
                                                           F.sum("_words").alias("source_size")),
                             weights, share, limit)
    unit = 1 << PLACES
    rated = sources.select(
        "_source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit)).otherwise(0)
        .cast("long").alias("_rate"),
        _hash_bits(F.concat(F.lit(f"{seed}|"), F.col("_source")), PLACES // 4).alias("_offset"))
    starts = (on_keys(blocks.drop("source"), rated, ["_source"])
              .withColumn("_part", F.col("_n") * F.col("_rate"))
              .withColumn("_start", F.col("_offset") + before(["_source"], block, "_part"))
              .select("_source", *block, "source_size", "target", "_rate", "_start"))
    within = F.row_number().over(Window.partitionBy("_source", *block).orderBy("size", "doc_id")) - 1
    return (on_keys(sized, starts, ["_source", *block])
            .withColumn("_at", F.col("_start") + within * F.col("_rate"))
            .withColumn("copies", F.shiftright(F.col("_at") + F.col("_rate"), PLACES) - F.shiftright(F.col("_at"), PLACES))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    *[f"_keep_{c}" for c in keep]))


def op10_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
         coalesce('=' || source, '') AS skey
  FROM documents),
binned AS (
  SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::INT) & 7) AS bin,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 6))::BIGINT % {BUCKETS} AS bucket
  FROM sized),
sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY min(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY skey),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM sources),
levelled AS (
  SELECT a.*, (a.budget - coalesce((SELECT sum(b.cap) FROM weighted b
                                    WHERE (b.cap / b.w, b.place) < (a.cap / a.w, a.place)), 0))
           / (SELECT sum(b.w) FROM weighted b WHERE (b.cap / b.w, b.place) >= (a.cap / a.w, a.place)) AS level
  FROM weighted a),
rated AS (
  SELECT skey, source_size, least(cap, coalesce(w * (SELECT max(level) FROM levelled WHERE cap / w >= level), cap)) AS target
  FROM levelled),
ranked AS (
  SELECT binned.*, row_number() OVER (PARTITION BY skey ORDER BY bin, bucket, size, doc_id) - 1 AS place
  FROM binned),
placed AS (
  SELECT doc_id, size, source_size, target, place,
         CASE WHEN source_size > 0 THEN floor(target / source_size * {1 << PLACES})::BIGINT ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}|' || skey), 1, {PLACES // 4}))::BIGINT AS start
  FROM ranked JOIN rated USING (skey))
SELECT doc_id, size, source_size, target,
       (((start + (place + 1) * rate) >> {PLACES}) - ((start + place * rate) >> {PLACES})) * size AS taken
FROM placed
"""
