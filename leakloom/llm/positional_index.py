"""Benchmark decontamination by a positional inverted index.

The index holds one row per occurrence of a benchmark word: the text's row, the
position, the term. It is written once in a single narrow pass and everything
else is asked of it, not of the texts. Each window of a benchmark item is looked
up from its rarest term: that term's postings, shifted by its offset, are
intersected with the shifted postings of the second rarest, which leaves few
alignments (row, item, diagonal). Only those are checked word by word; a run of
matches as long as a window is an occurrence, and every word in it is hit.

No list is keyed by a term alone after the look-up of the rarest, so frequent
words gather nowhere. Small sides are broadcast after their rows were counted;
larger ones are left to Spark's shuffled joins, with the same result.

Defined results: null texts have no words; items without words occur nowhere;
null item_ids hit words but are not listed; repeated rows, of either table, are
texts and items of their own, repeated item_ids count once; empty tables give no
rows, or rows without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.llm.common import counted, fold_ascii, on_keys, stored

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


def _fold_word(word: Column) -> Column:
    """A-Z lower-cased; the general mapping is only needed for words that hold other letters, too."""
    return (F.when(F.octet_length(word) == F.length(word), F.lower(word))
            .when(word.rlike("[A-Z]"), fold_ascii(word)).otherwise(word))


def _positions(texts: DataFrame, *columns: str) -> DataFrame:
    """columns, n_words, pos, word: one row per word, and one of nulls for a text without words."""
    pieces = (texts.withColumn("_p", F.split(F.coalesce("text", F.lit("")), _GAP, -1))
              .withColumn("_head", (F.get("_p", F.lit(0)) == "").cast("int"))
              .withColumn("_size", F.size("_p")))
    tail = F.when((F.col("_size") > 1) & (F.element_at("_p", -1) == ""), 1).otherwise(0)
    return (pieces.withColumn("n_words", (F.col("_size") - F.col("_head") - tail).cast("long"))
            .select(*columns, "n_words", "_head", F.posexplode("_p").alias("_at", "_word"))
            .where((F.col("_word") != "") | ((F.col("n_words") == 0) & (F.col("_at") == 0)))
            .select(*columns, "n_words", (F.col("_at") - F.col("_head")).alias("pos"), _fold_word(F.col("_word")).alias("word")))


def build_index(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings (row, doc_id, n_words, pos, term) of the words in `vocabulary` (word, term).

    The last word of each text has a row in any case (term null if it isn't in the
    vocabulary), and so has a text without words: they carry n_words.
    """
    texts = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    words = _positions(texts, "row", "doc_id")
    return stored(words.join(counted(vocabulary), "word", "left")
                  .where(F.col("term").isNotNull() | (F.col("pos") >= F.col("n_words") - 1))
                  .select("row", "doc_id", "n_words", "pos", "term"), "positional-index")


def index_items(benchmark: DataFrame) -> DataFrame:
    """Stored item words (item, item_id, n_words, pos, word, term)."""
    items = stored(benchmark.select("item_id", "text"), "benchmark-items") \
        .select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return stored(_positions(items, "item", "item_id").where("n_words > 0")
                  .withColumn("term", F.xxhash64("word")), "benchmark-words")


def _rare_pairs(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Per window the two rarest terms with their offsets: item, width, term, at, term2, at2 (without repeats)."""
    ranked = (items.join(counts, "term", "left")
              .groupBy("item").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct(
                  "pos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("words"))
              .withColumn("width", F.least("n_words", F.lit(window)).cast("int")))
    ordered = F.transform(F.sequence(F.lit(1), (F.col("n_words") - F.col("width") + 1).cast("int")), lambda start: F.array_sort(
        F.transform(F.slice("words", start, F.col("width")),
                    lambda w: F.struct(w["n"].alias("n"), w["pos"].alias("pos"), w["term"].alias("term")))))
    return (ranked.select("item", "width", F.explode(ordered).alias("w"))
            .select("item", "width", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
            .where(F.col("a.n") > 0)
            .select("item", "width", F.col("a.term").alias("term"), F.col("a.pos").alias("at"),
                    F.col("b.term").alias("term2"), F.col("b.pos").alias("at2")).distinct())


def occurrences(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored spans (row, item, item_id, first, last): maximal runs of matches that hold a whole window."""
    postings = index.where("term IS NOT NULL").select("row", "pos", "term")
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    pairs = stored(_rare_pairs(items, counts, window), "rare-pairs")
    first = (postings.join(counted(pairs), "term")
             .select("row", "item", (F.col("pos") - F.col("at")).alias("diagonal"), "term2",
                     (F.col("pos") - F.col("at") + F.col("at2")).alias("pos2")))
    second_terms = stored(pairs.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct(), "second-terms")
    second = (postings.join(counted(second_terms), "term", "left_semi")
              .select("row", F.col("pos").alias("pos2"), F.col("term").alias("term2")))
    alignments = stored(
        first.where("term2 IS NULL").select("row", "item", "diagonal")
        .unionByName(on_keys(first, second, ["row", "pos2", "term2"]).select("row", "item", "diagonal"))
        .distinct(), "alignments")
    rows = stored(alignments.select("row").distinct(), "aligned-rows")
    near = postings.join(counted(rows), "row", "left_semi")
    expected = (on_keys(alignments, items.select("item", "item_id", "n_words", F.col("pos").alias("at"), "term"), ["item"])
                .withColumn("pos", F.col("diagonal") + F.col("at")))
    matched = on_keys(expected, near, ["row", "pos", "term"])
    order = Window.partitionBy("row", "item", "diagonal").orderBy("at")
    return stored(
        matched.withColumn("_run", F.col("at") - F.row_number().over(order))
        .groupBy("row", "item", "diagonal", "_run")
        .agg(F.first("item_id").alias("item_id"), F.min("pos").alias("first"), F.max("pos").alias("last"),
             F.max("n_words").alias("n_words"))
        .where(F.col("last") - F.col("first") + 1 >= F.least("n_words", F.lit(window)))
        .select("row", "item", "item_id", "first", "last"), "occurrences")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `documents` (doc_id, text): doc_id, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    items = index_items(benchmark)
    vocabulary = stored(items.select("word", "term").distinct(), "benchmark-vocabulary")
    index = build_index(documents, vocabulary)
    spans = occurrences(index, items, window)
    reached = F.max("last").over(Window.partitionBy("row").orderBy("first", "last")
                                 .rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.col("_reached"), F.lit(-1))))
    hits = (spans.groupBy("row", "first", "last").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
            .withColumn("_reached", reached).withColumn("_new", new)
            .groupBy("row").agg(F.sum("_new").alias("n_hit"),
                                F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items")))
    texts = index.where(F.col("pos") >= F.col("n_words") - 1).select("row", "doc_id", "n_words")
    return (texts.join(hits, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def proximity_matches(index: DataFrame, items: DataFrame, slack: int = 5, window: int = WINDOW) -> DataFrame:
    """Rows in which all different words of some window lie, in any order, within `window + slack` words.

    Starts from the postings of the window's rarest term. Returns distinct (row, item, item_id).
    """
    postings = index.where("term IS NOT NULL").select("row", "pos", "term")
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    sets = (items.join(counts, "term", "left").groupBy("item").agg(
        F.first("item_id").alias("item_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("words"))
        .withColumn("width", F.least("n_words", F.lit(window)).cast("int"))
        .select("item", "item_id", "width", F.posexplode(F.transform(
            F.sequence(F.lit(1), (F.col("n_words") - F.col("width") + 1).cast("int")),
            lambda start: F.array_distinct(F.transform(F.slice("words", start, F.col("width")), lambda w: F.struct(
                w["n"].alias("n"), w["term"].alias("term")))))).alias("start", "terms")))
    stretch = F.col("width") + slack
    anchored = (sets.withColumn("rarest", F.array_min("terms")).where("rarest.n > 0")
                .withColumn("term", F.col("rarest.term")))
    around = (postings.join(anchored, "term")
              .select("row", "item", "item_id", "start", "pos", stretch.alias("stretch"), F.size("terms").alias("need"),
                      F.explode("terms.term").alias("other")))
    other = postings.select(F.col("row"), F.col("pos").alias("pos2"), F.col("term").alias("other"))
    # The anchor lies somewhere in a stretch: try the stretches that end within reach of it.
    near = (on_keys(around, other, ["row", "other"])
            .where(F.abs(F.col("pos2") - F.col("pos")) < F.col("stretch"))
            .withColumn("begin", F.explode(F.sequence(
                F.greatest(F.col("pos"), F.col("pos2")) - F.col("stretch") + 1, F.least("pos", "pos2")))))
    return (near.groupBy("row", "item", "item_id", "start", "pos", "begin", "need")
            .agg(F.count_distinct("other").alias("have")).where("have = need")
            .select("row", "item", "item_id").distinct())


def op9_positional_index(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, i, array_to_string(list_slice(w, i, i + width - 1), ' ') AS phrase
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, widths WHERE len(w) >= width)),
found AS (SELECT doc_id, item_id, i, places.width FROM places JOIN windows USING (width, phrase)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                  sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
           FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
