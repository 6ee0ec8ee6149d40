"""Registered queries against their SQL twins, and the guard of the entry."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from leakloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin_agrees(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.sql(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_all_are_registered():
    import __spark_entry__ as registered

    assert set(registered.queries()) > {*QUERIES, "pipeline"}
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert registered.queries()["pipeline"] is corpus_pipeline.run


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "leakloom"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert 'secret_scan' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def _documents(columns="doc_id, text"):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_registered_records_hold_what_the_library_encodes(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc_id, text in _documents():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op5_token_records"](spark, SF)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got.collect()) == want


def test_registered_shards_keep_their_law(spark):
    import collections
    import zlib

    got = {r["doc_id"]: r for r in QUERIES["op4_shard_propagation"](spark, SF).collect()}
    docs = _documents()
    assert len(got) == len(docs)
    slots = collections.defaultdict(list)
    for doc_id, text in docs:
        r, data = got[doc_id], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_registered_licenses_match_all_windows(spark):
    import collections

    from leakloom.llm import license_scan

    templates = [(name, license_scan.words_of(text)) for name, text in license_scan.TEMPLATES]
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    found = 0
    for doc_id, text in _documents():
        words, best = license_scan.words_of(text), {}
        for name, template in templates:
            counts, reach = collections.Counter(template), int(1.5 * len(template))
            places = [i for i, w in enumerate(words) if w in counts]
            for at, end in ((i, j + 1) for i in places for j in places if i <= j < i + reach):
                window = words[at:end]
                if (collections.Counter(window) & counts).total() >= license_scan.COVERAGE * len(template):
                    matched = len(license_scan.align(window, template)) / len(template)
                    if matched >= license_scan.COVERAGE:
                        best[name] = max(best.get(name, 0), matched)
        r = got[doc_id]
        assert (r["n_words"], r["licenses"], r["n_licenses"]) == (len(words), ",".join(sorted(best)), len(best))
        assert r["best_coverage"] == pytest.approx(max(best.values(), default=0.0))
        found += bool(best)
    assert found
