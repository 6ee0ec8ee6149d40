"""Licences, urls, shards, records, toxicity, lines, mixing: odd inputs and properties."""

import collections
import gc
import random
import weakref
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leakloom.llm import (
    common, hashing, license_scan, line_spread, mixing, shard_propagation, token_records, toxicity, url_cascade,
)
from tests.llm.helpers import clashing, edit_distance, mix, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- licences ---

def test_patience_alignment():
    assert license_scan.longest_increasing([5, 1, 4, 2, 3]) == [1, 3, 4]
    assert license_scan.align("x a b c y".split(), "a q b c".split()) == [(1, 0), (2, 2), (3, 3)]
    # Repeated words are aligned once their neighbours anchor them.
    assert len(license_scan.align("a b a c a d a".split(), "a b a c a d a".split())) == 7


def test_stray_template_words_around_a_notice():
    scan = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    text = ("Please read this page before you copy anything from here. "
            "The work is licensed under the GNU General Public License, version 3.")
    assert scan(text)[1] == {"GPL-3.0": (11 / 12, 11, 21)}


def test_license_windows_match_all_windows():
    """Notices with a word missing, among stray words of their template: as found by aligning every window."""
    template = "a b c d e f g h i j".split()
    scan, draw, found = license_scan.Scanner([("t", " ".join(template))], 0.8), random.Random(3), 0
    for _ in range(400):
        notice = [w for k, w in enumerate(template) if k != draw.randrange(12)]
        stray = lambda: [draw.choice([*template, "x", "y", "z", "x"]) for _ in range(draw.randrange(25))]
        words = stray() + (notice if draw.random() < 0.7 else []) + stray()
        best = 0
        for at in range(len(words)):
            window = words[at:at + 15]
            while window and window[0] not in template:
                window.pop(0)
            while window and window[-1] not in template:
                window.pop()
            best = max(best, len(license_scan.align(window, template)))
        got = scan(" ".join(words))[1]
        assert got.get("t", (0,))[0] == (best / 10 if best >= 8 else 0)
        found += bool(got)
    assert found > 150


def test_licenses_in_texts(spark):
    filler = " ".join(f"the of work {i}" for i in range(2000))
    rows = [(1, f"{filler} Licensed under the Apache License, Version 2.0. {filler}", None),
            (2, "LICENSED under Apache license\nversion 2.0", None),  # one word of eight missing
            (3, "licensed under the old version of 2 of the apache", None),
            (4, "Released under the MIT License. All rights reserved. " * 2, None),
            (5, None, None), (6, "", None), (None, "all rights reserved", None), (4, filler, None), (2**60 + 1, "x", None)]
    got = sorted(((r["doc_id"] or 0, ",".join(x["license"] for x in r["licenses"]))
                  for r in license_scan.scan_licenses(clashing(table(spark, rows))).collect()))
    assert got == [(0, "all-rights-reserved"), (1, "Apache-2.0"), (2, "Apache-2.0"), (3, ""), (4, ""),
                   (4, "MIT,all-rights-reserved"), (5, ""), (6, ""), (2**60 + 1, "")]
    assert license_scan.scan_licenses(table(spark, [])).collect() == []


def test_seeds_leave_out_nothing():
    """Every window that covers enough of a template is found from the rarest words."""
    draw = random.Random(4)
    scan = license_scan.Scanner([("t", "a b c d e f g h i j")], 0.8)
    for _ in range(400):
        words = [draw.choice("abcdefghijxyz") for _ in range(30)]
        own = [w for w in "abcdefghij" if draw.random() < 0.9]
        words[10:10] = own
        if len(own) >= 8 and len(license_scan.align(own, list("abcdefghij"))) >= 8:
            assert "t" in scan(" ".join(["z"] * 20 + own + ["y"] * 20))[1]


# --- urls ---

PAGES = "page_id long, url string"


def judged(url, rules, default="allow"):
    scheme, found, rest = (url or "").partition("://")
    if not found:
        host = path = ""
    else:
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[:min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, default=None)
    return host, path, rule and rule[2], rule[3] if rule else default


URLS = [None, "", "no scheme", "http://", "http://com", "HTTP://A.COM/x", "ftp://www.Example.com/en/1?x#y", "x://example.com/en",
        "x://notexample.com/en/", "a://b.example.com/en/?q=://c.net/fr/", "s://net/es/1", "s://x.net/es", "s://x.net/fr/\nz",
        "s://x.net?/fr/", "s://x..net/fr/", "://net/fr/", "s://\u00c9.net/fr/\u00e9", "s://x.net#/es/"]


@pytest.mark.parametrize("most_bits", [url_cascade.MOST_BITS, 1])
def test_urls_match_plain_rules(spark, most_bits):
    draw = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "b.a.net", "org"]
    rules = list(dict.fromkeys((draw.choice(hosts), draw.choice(["/", "/en/", "/es", "", "/en/1"])) for _ in range(20)))
    rules = [(h, p, draw.choice(["allow", "block"])) for h, p in rules]
    urls = URLS + [f"http://{draw.choice(hosts)}{draw.choice(['', '/', '/en/', '/en/1', '/es/', '/fr?x'])}" for _ in range(200)]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), PAGES))
    for own in (url_cascade.RULES, rules):
        got = {r["page_id"]: tuple(r)[1:] for r in url_cascade.judge_urls(pages, own, most_bits=most_bits).collect()}
        assert got == {i: judged(u, own) for i, u in enumerate(urls)}


def test_cascade_is_exact_where_filters_are_small(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 1)
    universe = spark.range(4000).selectExpr("concat('k', id) AS key", "id % 3 = 0 AS listed").cache()
    cascade = url_cascade.build_cascade(universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.holds(universe["key"]) != universe["listed"]).count() == 0


def test_hosts_and_paths_of_any_length(spark):
    long = ".".join(["a"] * 20_000)
    urls = [f"http://{long}.www.example.com/en/{'x' * 30_000}", f"http://{long}.net/es/{'/fr' * 9_000}", f"http://{long}", f"http://com.{long}.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages).collect()}
    assert got == {0: ("www.example.com/en/", "allow"), 1: ("net/es/", "block"), 2: (None, "allow"), 3: (None, "allow")}


def test_a_later_level_over_the_bound_is_left_to_a_join(spark, monkeypatch):
    """Few rules, very many other keys: what passes the first filter wrongly needs more bits than allowed."""
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 1)
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key", "id < 40 AS listed").cache()
    assert url_cascade.build_cascade(universe, 64) is None
    assert len(url_cascade.build_cascade(universe, 1 << 20).levels) >= 1
    urls = [f"http://h{i}.net/{'es' if i % 7 == 0 else 'x'}/" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    for most_bits in (64, 1 << 20):
        got = url_cascade.judge_urls(pages, most_bits=most_bits).where("verdict = 'block'").count()
        assert got == len(range(0, 3000, 7))


def test_no_pages_and_no_rules(spark):
    assert url_cascade.judge_urls(spark.createDataFrame([], PAGES)).collect() == []
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_cascade.judge_urls(spark.createDataFrame([(1, "a://b/c")], PAGES), rules).first()["verdict"] == "allow"


# --- shards ---

def test_shards_are_even_and_keep_groups(spark):
    draw = random.Random(9)
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(300)] + [f"single {i}" for i in range(300)] + [None, None, ""]
    draw.shuffle(texts)
    rows = [(i if i % 50 else None, t, None) for i, t in enumerate(texts)]
    got = shard_propagation.balanced_shards(clashing(table(spark, rows))).collect()
    again = shard_propagation.balanced_shards(table(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = collections.Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == len(rows) and len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    spread = collections.defaultdict(set)
    for r in got:
        spread[r["group"]].add(r["shard"])
    pairs = [g for g, n in collections.Counter(r["group"] for r in got).items() if n == 2 and g]
    assert sum(len(spread[g]) > 1 for g in pairs) <= 5
    # Dealt in turn, the group of 400 would have 25 rows in each shard; a shard has room for 62.
    hot = next(g for g, n in collections.Counter(r["group"] for r in got).items() if n == 400)
    held = collections.Counter(r["shard"] for r in got if r["group"] == hot)
    assert len(held) <= 12 and sum(n * (n - 1) for n in held.values()) >= 1.5 * 16 * 25 * 24
    by_id = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, t in enumerate(texts):
        if i % 50:
            data = (t or "").encode()
            assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))


@pytest.mark.parametrize("singles", [0, 12])
def test_shards_keep_pairs_without_free_room(spark, singles):
    """Every text twice, and with 3% of texts that have no copy: full shards exchange members."""
    rows = [(i, f"text {i % 200}", None) for i in range(400)] + [(400 + i, f"single {i}", None) for i in range(singles)]
    got = shard_propagation.balanced_shards(table(spark, rows), shards=4).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 1
    spread = collections.defaultdict(set)
    for r in got:
        spread[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 10  # about one for each pair of shards; dealt in turn some 150


def test_few_rows_for_many_shards(spark):
    assert shard_propagation.balanced_shards(table(spark, [])).collect() == []
    got = shard_propagation.balanced_shards(table(spark, [(1, "a", None), (1, "a", None), (2, "b", None)])).collect()
    assert len({r["shard"] for r in got}) == 3


# --- records ---

def test_records_round_trip(spark):
    odd = ["It's I'LL Don't 12a.b, ..", "\x1c a\x1db", "<|endoftext|>x y<|startoftext|>", "\u0130stanbul \u03a3\u03b1\u03c2", None, "",
           "word, Word. WORD " * 3000, "e\u0301 \u0301x caf\u00e9.", "a\u00a0b\u2003c\x85d"]
    rows = [(i * 7 % 10 - 3, t, None) for i, t in enumerate(odd)] + [(None, "no id", None), (2, "again", None), (2, "again", None), (2**60 + 1, "far", None)]
    root, index = token_records.write_records(clashing(table(spark, rows)), TOKENIZER, file_bytes=4000)
    assert index.select("file").distinct().count() > 1
    library = Tokenizer.from_file(TOKENIZER)
    want, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text, _ in order:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(token_records.read_back(root, index).collect(), key=lambda r: r["start"])
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    picked = token_records.read_at(root, index.orderBy("n_tokens")).collect()
    assert sorted(len(r["ids"]) for r in picked) == sorted(n for _, n, _ in want)


def test_damage_is_noticed():
    import io

    record = token_records.frame(token_records.serialise(3, np.array([70_000, 1], "<u4")))
    assert [list(x) if not isinstance(x, int) else x for x in token_records.parse(token_records.read_frame(io.BytesIO(record)))] == [3, [70_000, 1]]
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        token_records.read_frame(io.BytesIO(record[:-1]))


def test_words_of_two_generations(monkeypatch):
    monkeypatch.setattr(token_records, "TABLE_WORDS", 5)
    encode, library = token_records.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for text in ("a b c, d e. f", "f g h i", "a b. j k l m, n", "A \u00e9. B!", "a"):
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_no_records(spark):
    root, index = token_records.write_records(table(spark, []), TOKENIZER)
    assert index.count() == 0 and token_records.read_back(root, index).collect() == []


# --- toxicity ---

def test_automaton_matches_edit_distance():
    terms = ["idiot$", "scum$", "pathetic$", "lostrax", "lowei", "ch\u00f3n", "veju"]
    trie, draw = toxicity.LexiconTrie(terms), random.Random(1)
    for _ in range(5000):
        word = list(draw.choice(terms).rstrip("$"))
        for _ in range(draw.randrange(3)):
            at, kind = draw.randrange(len(word) + 1), draw.random()
            if kind < 0.4:
                word.insert(at, draw.choice("abiostx"))
            elif word:
                word[min(at, len(word) - 1):][:1] and word.pop(min(at, len(word) - 1))
        word = "".join(word) + draw.choice(["", "en", "ung"])
        if not word:
            continue
        errors = []
        for term in terms:
            stem = term.rstrip("$")
            found = [edit_distance(word, stem)] if term != stem else [edit_distance(word[:n], stem) for n in range(len(word) + 1)]
            least = toxicity.FUZZY_FROM if term != stem else toxicity.FUZZY_START_FROM
            errors += [e for e in found if e <= (1 if len(stem) >= least else 0)]
        assert trie[word] == (1 + min(errors) if errors else 0), word


def test_quotation_is_not_abuse():
    trie = toxicity.LexiconTrie(["idiot$"])
    assert toxicity.text_features("you idiot idi0t", trie)[2:5] == pytest.approx((np.log(3), np.log(2), 0))
    assert toxicity.text_features('he wrote "you idiot" there', trie)[2:5] == pytest.approx((0, 0, np.log(2)))
    assert toxicity.text_features("called idiot", trie)[4] > 0
    assert toxicity.text_features(None, trie) == toxicity.text_features("", trie) == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)


LABELS = "doc_id long, quality int, toxic int"


def test_learnt_scores(spark):
    draw = random.Random(2)
    clean = [f"{draw.choice('bcdfg')}a{draw.choice('lmnr')}{draw.choice('aeiou')}" for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(clean) for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = [draw.choice(["zzgrot", "qimblen", "qimblung", "qimblich"])] * 2
        rows.append((i, " ".join(words), None))
        labels.append((i, 1, int(i % 4 == 0)))
    rows[1] = (1, "zzgrob " + rows[1][1], None)  # an ordinary word next to a term
    rows += [(1000, "a zzgrt here and zgrot", None), (1001, None, None), (1002, "", None), (None, "zzgrot zzgrot", None)]
    labels += [(5000, 1, 1), (None, 0, 1), (2, 1, None), (7, 0, 5)]
    docs = clashing(table(spark, rows))
    model = toxicity.learn(docs, table(spark, labels, LABELS))
    assert "zzgrot$" in model.terms and any("qimbl".startswith(t) or t.startswith("qimbl") for t in model.terms)
    scored = {r["doc_id"]: r["s"] for r in docs.withColumn("s", toxicity.toxicity(model)("text")).collect()}
    assert model.plain == ["zzgrob"]
    assert all((scored[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(600))
    assert scored[None] >= toxicity.THRESHOLD > scored[1001] == scored[1002] and scored[1000] > scored[1001]


def test_terms_of_fixed_phrases_and_copies(spark):
    """A term that always follows the same word is learnt, also a rare one; a word of one text's near copies is not."""
    draw = random.Random(4)
    clean = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    rows = []
    for i in range(3000):
        words = [draw.choice(clean) for _ in range(25)]
        if i < 600:
            words[5:5] = ["you", "zzgrot"] if i < 595 else ["son", "of", "a", "qwimblex"]
        rows.append((" ".join(words), int(i < 600)))
    base = [draw.choice(clean) for _ in range(120)]
    rows += [(" ".join([*base, "xoverly", str(i)]), 1) for i in range(60)]
    sample = table(spark, rows, "text string, toxic int")
    terms = toxicity.learn_terms(sample)
    assert "zzgrot$" in terms and not any(t.startswith("xo") for t in terms)
    rare = table(spark, [(t.replace("zzgrot", "zzgrot" if i % 30 else "vrukk"), y) for i, (t, y) in enumerate(rows)],
                 "text string, toxic int")
    assert {"zzgrot$", "vrukk$"} <= set(toxicity.learn_terms(rare))


def test_without_labels(spark):
    docs = table(spark, [(1, "a", None), (2, None, None)])
    for labels in ([], [(1, 1, 0), (2, 1, 0)]):
        model = toxicity.learn(docs, table(spark, labels, LABELS))
        scores = [r["s"] for r in docs.withColumn("s", toxicity.toxicity(model)("text")).collect()]
        assert model.terms == [] and len(set(scores)) == 1 and 0 <= scores[0] < toxicity.THRESHOLD
    empty = table(spark, [])
    assert empty.withColumn("s", toxicity.toxicity(toxicity.Model([]))("text")).collect() == []


# --- lines ---

LINES = "doc_id long, text string, site string"


@pytest.mark.parametrize("sites", [3, 40])
def test_lines_of_many_sites_go(spark, sites):
    rows = [(i, f"own {i}\n  shared \nmenu {i % (sites - 1)}\n\n  \nhot", f"s{i % (sites + 3)}") for i in range(6 * sites)]
    rows += [(900, "few", f"s{i}") for i in range(sites - 1)] + [(900, "few", "s1"), (901, None, "s1"), (902, "shared", None), (None, "x\nhot", None)]
    where = collections.defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            where[line.strip(" \t\n\x0b\x0c\r")].add(site)
    def clean(text):
        return None if text is None else "\n".join(x for x in text.split("\n") if not x.strip() or len(where[x.strip()]) < sites)
    df = spark.createDataFrame(rows, LINES)
    got = line_spread.remove_boilerplate(df, sites).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, ((d, clean(t)) for d, t, _ in rows)))
    assert line_spread.remove_boilerplate(spark.createDataFrame([], LINES)).collect() == []


# --- mixing ---

def test_mix_matches_resharing(spark):
    draw = random.Random(8)
    docs = [(i, " ".join("w" * draw.randrange(1, 3) for _ in range(draw.randrange(0, 60))) if i % 40 else None,
             draw.choice(["a", "b", "\u00e9", None, "z", "B"] + ["hot"] * 4)) for i in range(900)]
    docs += [(2000, "", "empty")]
    copies, target, total, size = mix(docs)
    got = {r["doc_id"]: r for r in mixing.mix_sources(clashing(table(spark, docs)), keep=["text", "size"]).collect()}
    for d, text, source in docs:
        r = got[d]
        assert (r["size"], r["source_size"], r["copies"], r["_keep_text"], r["_keep_size"]) == (size[d], total[source], copies[d], text, "x")
        assert r["target"] == pytest.approx(target[source]) and 0 <= r["copies"] <= 2
    for source in total:
        taken = sum(copies[d] * size[d] for d, _, s in docs if s == source)
        assert abs(taken - target[source]) <= 130
    assert mixing.mix_sources(table(spark, [])).collect() == []


def test_repeated_rows_are_mixed_alike(spark):
    rows = [(1, "a b c", "s")] * 40 + [(None, "d", "t")] * 3
    got = mixing.mix_sources(table(spark, rows)).groupBy("source").agg({"copies": "sum"}).collect()
    # Two sources of 120 and 3 words: the larger is to get three quarters of 184.5, the smaller at most 6.
    assert {r[0]: r[1] for r in got} == {"s": pytest.approx(184.5 * 3 / 4 / 3, abs=15), "t": 6}


def test_terms_of_long_words_and_unspaced_scripts(spark):
    """Strong terms are kept however many weak and short ones there are; starts of long words and runs without spaces match."""
    draw, rows = random.Random(8), []
    clean = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    long = "vilifcationsupremenonsenser"  # 27 letters
    for i in range(800):
        words = [draw.choice(clean) for _ in range(20)]
        text = " ".join(words)
        if i < 240:
            text += f" {long}x{i}" if i % 2 else " 这个坏人" + draw.choice("是很也") + "走了"
        else:
            text += " 这个好人" + draw.choice("是很也") + "走了"
        rows.append((text, int(i < 240)))
    terms = toxicity.learn_terms(table(spark, rows, "text string, toxic int"))
    assert long[:toxicity.LONGEST] in terms and not any(t.startswith(long) for t in terms)
    assert any(t in "个坏人" and "坏" in t for t in terms) and not any("好" in t for t in terms)
    trie = toxicity.LexiconTrie(terms)
    for word in (long[:24], long[:25], long, long + "zzz"):
        assert trie[word] == 1
    assert toxicity.text_features("abc这里有个坏人在这里", trie)[1] == 1.0 and toxicity.text_features("这里有个好人在这里", trie)[1] == 0.0
    assert toxicity.words_of("x坏人y z") == ["x", "坏人", "人", "y", "z"]


def test_no_term_is_dropped_for_its_length():
    """Probe of many weak short terms and one strong long one."""
    counts = {f"w{i:04d}": 5 for i in range(6000)} | {"strongterm": 1_000_000}
    assert "strongterm" in toxicity._longest_forms(counts) and len(toxicity._longest_forms(counts)) == 6001


def test_learning_reads_one_text_of_an_id(spark):
    docs = table(spark, [(1, f"text {i}", None) for i in range(50)] + [(2, "b", None)])
    labels = table(spark, [(1, 1, 1), (2, 1, 0)], LABELS)
    got = toxicity.learning_rows(docs, labels, 20).collect()
    ids = [d for d in (1, 2) if zlib.crc32(str(d).encode()) % 3 != 1]
    assert len(got) == len(ids)


def test_reporting_words_are_learnt(spark):
    draw, rows = random.Random(9), []
    clean = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    for i in range(400):
        words = [draw.choice(clean) for _ in range(15)]
        words[4:4] = ["you", "zzgrot"] if i < 200 else (["dixit", "zzgrot"] if i < 230 else [])
        rows.append((" ".join(words), int(i < 200)))
    classes = toxicity.with_classes(table(spark, rows, "text string, toxic int"))
    assert toxicity.reporting_words(classes, ["zzgrot$"]) == ["dixit"]


def test_registered_toxicity_against_a_plain_scorer(spark):
    """Held-out flags, scores and predictions by edit distances over the learnt terms, without trie or automaton."""
    import duckdb

    from leakloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    known = {}

    def kind(word):
        if word not in known:
            best = 3
            for term in model.terms:
                stem = term.rstrip("$")
                fuzzy = len(stem) >= (toxicity.FUZZY_FROM if term != stem else toxicity.FUZZY_START_FROM)
                if term != stem:
                    errors = edit_distance(word, stem) if abs(len(word) - len(stem)) < 2 else 9
                else:
                    errors = min(edit_distance(word[:n], stem) for n in range(len(stem) - 1, len(stem) + 2) if n >= 0)
                if errors <= fuzzy:
                    best = min(best, 1 + errors)
            known[word] = 0 if best == 3 or best == 2 and word in model.plain else best
        return known[word]

    class Plain(dict):
        def __missing__(self, word):
            return kind(word)

    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        x = np.array(toxicity.text_features(text, Plain(), model.reporting))
        want = 1 / (1 + np.exp(-(x @ model.weights)))
        assert got[doc_id]["score"] == pytest.approx(want) and got[doc_id]["predicted"] == (want >= 0.7)
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1)


# --- what a worker process holds ---

def test_a_worker_keeps_one_table():
    """Workers serve all operators in turn: the tables of an earlier one are not kept beside those of a later one."""
    trie = weakref.ref(toxicity.trie_of(("idiot$",), ()))
    assert toxicity.trie_of(("idiot$",), ()) is trie()
    encoder = weakref.ref(token_records.encoder(TOKENIZER))
    gc.collect()
    assert trie() is None and encoder() is not None
    common.kept(hashing.WordHashes)
    gc.collect()
    assert encoder() is None


def test_words_of_a_batch_are_sent_on_as_texts_are_read(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(300)] + ["w0x0 w0x0", None]
    read = []
    plain = toxicity.words_of
    monkeypatch.setattr(toxicity, "words_of", lambda text: read.append(text) or plain(text))
    batch = pd.DataFrame({"text": texts, "toxic": [i % 2 for i in range(302)], "class": range(302)})
    found, waiting = [], []
    for rows in toxicity._word_classes([batch]):
        waiting.append(len(read) * 1000 - len(found))
        found += rows.itertuples(index=False, name=None)
    assert max(waiting) <= toxicity._HELD + 1000
    assert sorted(found) == sorted({(w, i, i % 2) for i, t in enumerate(texts) for w in plain(t)})


def test_classes_need_no_python_rows(spark, monkeypatch):
    """A frame made from Python rows starts a second kind of Python workers on every executor."""
    def refuse(*_, **__):
        raise AssertionError("Python rows")

    sample = table(spark, [("a b c d e f", 1), ("a b c d e f", 0), ("g h", 0)], "text string, toxic int")
    none = sample.where("toxic > 1")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    rows = toxicity.with_classes(sample).collect()
    assert sorted((r["text"], r["toxic"]) for r in rows) == [("a b c d e f", 0), ("a b c d e f", 1), ("g h", 0)]
    assert len({r["class"] for r in rows}) == 2
    assert toxicity.with_classes(none).collect() == []


def test_rows_of_batches_one_at_a_time():
    batches = [pa.record_batch([pa.array([1, None, 2**60]), pa.array(["a", "", None])], ["doc_id", "text"])] * 2
    assert list(common.pairs_of(iter(batches))) == [(1, "a"), (None, ""), (2**60, None)] * 2


def test_batches_are_given_back():
    """What is read of a stream of batches does not stay in Arrow's pool."""
    before = pa.total_allocated_bytes()
    stream = (pa.record_batch([pa.array([i]), pa.array(["x" * 1_000_000])], ["doc_id", "text"]) for i in range(20))
    sizes = [pa.total_allocated_bytes() - before for _ in common.pairs_of(stream)]
    assert len(sizes) == 20 and max(sizes) < 4_000_000 and pa.total_allocated_bytes() - before < 1_000_000
