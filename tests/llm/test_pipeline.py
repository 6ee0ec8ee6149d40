"""The whole pipeline against plain versions of its stages."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from leakloom.llm import toxicity
from tests.llm.helpers import contamination, mix, near_duplicates, table

SF = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def test_run_matches_plain_stages(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = 1 / (1 + np.exp(-(model.features([t for _, t, _ in docs]) @ model.weights)))
    docs = [d for d, s in zip(docs, score) if s < toxicity.THRESHOLD]
    first = near_duplicates([(d, t) for d, t, _ in docs])
    docs = [d for d in docs if first[d[0]][1] == d[0]]
    hits = contamination([(d, t) for d, t, _ in docs], items)
    docs = [d for d in docs if not hits[d[0]][1]]
    copies = mix(docs)[0]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, text, _ in docs:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += copies[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == +want
    assert sorted(r["start"] for r in got)[0] == 0 and max(r["start"] + r["n_tokens"] for r in got) == sum(r["n_tokens"] for r in got)


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without an id, and rows that share one, are dropped for what they hold themselves."""
    table(spark, [(1, "p q r s t u v w x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    leak, near = "see p q r s t u v w x y here", " ".join(f"n{i}" for i in range(60))
    docs = table(spark, [(None, leak, None), (None, "clean", None), (7, leak, None), (7, "also clean", None)])
    after = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(r["text"] for r in after.collect()) == ["also clean", "clean"]
    docs = table(spark, [(None, f"{near} one", None), (None, f"{near} two", None), (4, "m1 m2 m3 m4 m5 m6", None),
                         (None, "m1 m2 m3 m4 m5 m6", None), (9, near.replace("n", "k"), None),
                         (9, near.replace("n", "k") + " more", None)])
    after = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in after.collect()) == ["4", "9", "None"]


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, row string"
    odd = [(1, "a b c d e f g", "en", "s", 1, "x", "y", "z"), (1, "a b c d e f g", "en", "s", 1, "x", "y", "z"),
           (2, "a b c d e f g", None, None, None, None, None, None), (3, None, "en", "s", 0, "x", "y", "z"),
           (None, "", None, None, None, None, None, None), (None, "no id at all", "en", "s", 3, "x", "y", "z"),
           (5, "long words " * 20_000, "en", "s", 3, "x", "y", "z")]
    table(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table(spark, [(1, "x y"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, []):
        docs = table(spark, rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or after.dtypes == docs.dtypes
            after.collect()
            if name == "n-gram Jaccard join":
                kept = sorted(map(str, (r["doc_id"] for r in after.collect())))
                assert kept == sorted(map(str, [1, 1, 3, None, None, 5])) if rows else kept == []
