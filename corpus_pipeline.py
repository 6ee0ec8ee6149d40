"""Training corpus from `documents`: five stages, each written and reread before the next.

Every stage decides by row, whether a row has an id, shares it with others or not: rows
get a key of their own that is stored before an operator reads them. Only repeated rows,
of one id and one text, count as one document and stay together. Empty tables pass
through every stage. A stage's result is to be written before the next stage is called:
that call deletes its intermediate results.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leakloom.llm import mixing, parity_join, positional_index, token_records, toxicity
from leakloom.llm.common import counted, on_workers, release, scratch, stored
from leakloom.session import work_dir


def _stage(decide):
    """A stage. When it begins, what the stage before it wrote for itself goes: its result has been written since."""
    @functools.wraps(decide)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_workers(spark)
        context = spark.sparkContext
        release(spark, getattr(context, "_corpus_pipeline_scratch", []))
        before = set(scratch(spark))
        result = decide(spark, docs, sf_dir)
        context._corpus_pipeline_scratch = [p for p in scratch(spark) if p not in before]
        return result
    return run_stage


_ROW = "_pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """Stored `docs` with a key of each row."""
    return stored(docs.withColumn(_ROW, F.monotonically_increasing_id()), "pipeline-rows")


def _by_row(keyed: DataFrame) -> DataFrame:
    """What an operator reads of the rows: their keys are its ids."""
    return keyed.select(F.col(_ROW).alias("doc_id"), "text")


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `keyed` whose key is not in `dropped` (_ROW)."""
    return keyed.join(counted(stored(dropped, "dropped-rows")), _ROW, "left_anti").drop(_ROW)


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxicity(model)("text") < toxicity.THRESHOLD)


@_stage
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near duplicates; one without an id only where none has one.

    Of several texts with that id one stays, with its repetitions.
    """
    keyed = _keyed(docs)
    found = parity_join.parity_join(_by_row(keyed), count_links=False)
    rows = stored(found.select(F.col("doc_id").alias(_ROW), F.col("component_id").alias("_component"))
                  .join(keyed.select(_ROW, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"),
                                     F.md5("text").alias("_md5")), _ROW), "pipeline-components")
    first = F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col(_ROW).alias("row"))
    first = rows.groupBy("_component").agg(F.min_by(F.struct("_id", _ROW, "_text", "_md5"), first).alias("first"))
    same = (F.col("_id") == F.col("first._id")) & (F.col("_text") == F.col("first._text")) & (F.col("_md5") == F.col("first._md5"))
    stays = (F.col(_ROW) == F.col(f"first.{_ROW}")) | F.coalesce(same, F.lit(False))
    return _without(keyed, rows.join(first, "_component").where(~stays).select(_ROW))


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    keyed = _keyed(docs)
    found = positional_index.contamination(_by_row(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.where("contaminated").select(F.col("doc_id").alias(_ROW)))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    taken = mixing.mix_sources(docs, keep=others)
    repeated = taken.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"_keep_{c}").alias(c) if c in others else c for c in docs.columns])


@_stage
def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, as read back from their files."""
    root, index = token_records.write_records(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_records.read_back(root, index)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenised),
]

#: Learning, and the tokenizer, can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, "pipeline-" + "-".join(name.lower().replace("/", " ").split()))
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
