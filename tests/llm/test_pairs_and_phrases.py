"""Near duplicates, exact duplicates, benchmark occurrences: brute force and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from leakloom.llm import parity_join, positional_index, trie_dedup
from leakloom.llm.components import components
from tests.llm.helpers import clashing, contamination, near_duplicates, shingle_set, table


def corpus(seed, clusters=12, singles=30):
    """Clusters of near copies with edits, texts that share a passage, exact copies, short and empty texts."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(30)]
    texts = ["", None, "one two", "One TWO", "one two three four", " \t\n"]
    for c in range(clusters):
        base = [draw.choice(words) for _ in range(draw.choice((6, 20, 60, 150, 300)))]
        for _ in range(draw.choice((2, 3, 12))):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 20))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    for _ in range(singles):
        own = [draw.choice(words) for _ in range(draw.choice((20, 40, 90)))]
        texts.append(" ".join(own[:10] + passage + own[10:]))
    texts += [texts[8]] * 10
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, frequent", [(1, 8), (2, 3)])
def test_components_match_all_pairs(spark, seed, frequent):
    docs = corpus(seed)
    found = parity_join.parity_join(clashing(table(spark, [(d, t, None) for d, t in docs])), frequent=frequent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert got == near_duplicates(docs)


@pytest.mark.parametrize("frequent", [8, 1_000_000])
def test_links_of_large_clusters_match_all_pairs(spark, frequent):
    """Clusters of 9, 40 and 150 different near copies, some of them too different to be linked with each other."""
    draw, texts = random.Random(11), []
    for cluster, (copies, most) in enumerate(((9, 0), (40, 3), (150, 4))):
        base = [f"w{cluster}x{i}" for i in range(80)]
        for copy in range(copies):
            own = list(base)
            for k in range(draw.randint(0, most)):
                own[draw.randrange(len(own))] = f"c{cluster}x{copy}x{k}"
            texts.append(" ".join([*own, f"end{cluster}x{copy}"]))
    texts += texts[:3]
    sets = [shingle_set(t) for t in texts]
    want = {i: len({b for b in sets if b != a and 100 * len(a & b) >= 75 * len(a | b)}) for i, a in enumerate(sets)}
    assert want[0] == 8 and len(set(want.values())) > 5
    found = parity_join.parity_join(table(spark, [(i, t, None) for i, t in enumerate(texts)]), frequent=frequent)
    assert {r["doc_id"]: r["links"] for r in found.collect()} == want


def test_near_duplicates_of_odd_tables(spark):
    assert parity_join.parity_join(table(spark, [])).collect() == []
    rows = [(1, "a b c d e f", None), (1, "a b c d e f", None), (None, "a b c d e f", None), (None, "z", None), (4, None, None)]
    found = parity_join.parity_join(table(spark, rows)).collect()
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in found), key=str)
    assert got == sorted([(-1, 1, None), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (4, 0, 4)], key=str)


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(5)
    for n in (1, 5, 70, 900):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n // 2], draw.integers(0, 1 << 63, n, dtype=np.uint64))))
        sketches = [np.frombuffer(parity_join.bit_sketches(s, np.array([len(s)]))[0], np.uint8)[None] for s in (a, b)]
        assert parity_join.least_difference(*sketches)[0] <= len(np.setxor1d(a, b))


def test_sorted_numbers_are_packed_small():
    """Key and shingle blobs come back as they were, and compress to three quarters."""
    draw = np.random.default_rng(9)
    for values in ([], [0], [7, 7, 7], [0, 2**32 - 1], draw.integers(0, 1 << 32, 2000)):
        values = np.sort(np.array(values, np.uint32))
        packed = parity_join._planes(values)
        assert np.array_equal(parity_join._of_planes(b"head" + packed, len(values), 4), values)
    assert len(pa.compress(packed, "lz4_raw", asbytes=True)) < 0.8 * len(pa.compress(values.tobytes(), "lz4_raw", asbytes=True))


def test_pigeonhole_keys_share_a_lane():
    """Any two sets similar enough have a key in common, whatever shingles are called frequent."""
    draw = np.random.default_rng(7)
    for _ in range(300):
        n = int(draw.integers(1, 400))
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        lost = int(draw.integers(0, len(a) // 7 + 1))
        b = np.unique(np.concatenate((a[draw.permutation(len(a))[lost:]], draw.integers(0, 1 << 63, lost, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        busy = lambda s: s % np.uint64(3) == 0
        keys = [set(parity_join.all_keys(s, np.array([len(s)]), busy(s))[0].tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.fixture
def dealt(spark):
    """Partitions as shuffles make them: 16, none put together, and no broadcast but where the code asks for one."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_of_few_links_are_not_dealt_out(spark, dealt):
    """A round of a small table costs no shuffle; a larger table is shuffled, with the same result."""
    edges = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(31)] + [(130, 131), (131, 130), (7, 7)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(8)
    small, large = components(links), components(links, few=10)
    assert len(small.inputFiles()) == 1 < len(large.inputFiles())
    want = {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(32)}}
    assert {r["node"]: r["root"] for r in small.collect()} == {r["node"]: r["root"] for r in large.collect()} == want


def test_only_sketches_that_are_compared_are_shuffled(spark, dealt, monkeypatch):
    """Joins with the table of all sketches leave it where it is: few sets are candidates in a round."""
    plans, write = {}, parity_join.stored

    def noted(df, purpose):
        plans.setdefault(purpose, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(parity_join, "stored", noted)
    docs = corpus(2)
    found = parity_join.parity_join(table(spark, [(d, t, None) for d, t in docs]), frequent=3, count_links=False)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == near_duplicates(docs)
    for purpose in ("parity-own", "parity-outsiders"):
        assert plans[purpose] and not any("hashpartitioning" in p for p in plans[purpose])
    assert len(plans["parity-pairs"]) == 1  # candidates across components have passed their sketches' test in the blocks


def test_trie_holds_every_string():
    draw = random.Random(3)
    trie, plain = trie_dedup.PatriciaTrie(), {}
    for i in range(3000):
        body = bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 12)))
        entry = (draw.randrange(3), i, 1)
        trie.insert(body, entry)
        plain[body] = trie_dedup._better(plain[body], entry) if body in plain else entry
        if i % 500 == 499:
            for gone, owner in list(trie.spill()):
                assert plain.pop(gone) == owner
    assert dict(trie.entries()) == plain


@pytest.mark.parametrize("limit", [trie_dedup.TRIE_BYTES, 400])
def test_copies_of_odd_tables(spark, limit, monkeypatch):
    rows = [(5, "a b", None), (3, "ab", None), (4, " a  b", None), (2, "a b ", None), (7, None, None), (6, "", None),
            (None, "\t", None), (9, "Ab", None), (9, "Ab", None), (None, "x", None), (8, "long " * 50_000, None),
            (2**60 + 1, "big", None), (2**60 + 2, "b ig", None)]
    monkeypatch.setattr(trie_dedup, "TRIE_BYTES", limit)
    got = sorted(map(str, (tuple(r)[:4] for r in trie_dedup.mark_copies(clashing(table(spark, rows))).collect())))
    assert got == sorted(map(str, [
        (5, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (2, 4, 4, False), (7, None, 3, False), (6, None, 3, False),
        (None, None, 3, True), (9, 9, 2, True), (9, 9, 2, True), (None, None, 1, True), (8, 8, 1, True),
        (2**60 + 1, 2**60 + 2, 2, False), (2**60 + 2, 2**60 + 2, 2, True)]))
    assert trie_dedup.mark_copies(table(spark, [])).collect() == []


ITEM = "item_id long, text string"


def test_occurrences_match_brute_force(spark):
    draw = random.Random(11)
    words = ["the", "of", "É", "é", "x1", "long", "word", "mid", "rare", "and"]
    items = [(i, " ".join(draw.choice(words) for _ in range(n))) for i, n in enumerate((1, 3, 10, 12, 25, 14))]
    items += [(50, ""), (51, None), (0, items[3][1]), (52, "a a a a a a a a a a a a")]
    docs = []
    for d in range(60):
        text = [draw.choice(words) for _ in range(draw.randrange(0, 50))]
        for _ in range(draw.randrange(0, 3)):
            own = (draw.choice(items)[1] or "").split()
            at = draw.randrange(len(own) + 1)
            text[len(text) // 2:len(text) // 2] = own[at:] if draw.random() < 0.5 else own
        docs.append((d, ", ".join(text).upper() if d % 3 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "A a A a a, a a a a a a a a a")]
    found = positional_index.contamination(clashing(table(spark, [(d, t, None) for d, t in docs])), table(spark, items, ITEM))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
    assert got == contamination(docs, items)


def test_occurrences_of_odd_tables(spark):
    docs = table(spark, [(1, "to be or not", None), (1, "to be or not", None), (None, "be or", None)])
    items = table(spark, [(None, "be or"), (3, "not")], ITEM)
    got = sorted(map(str, ((r["doc_id"], r["n_hit"], r["items"]) for r in positional_index.contamination(docs, items).collect())))
    assert got == sorted(map(str, [(1, 3, ["3"]), (1, 3, ["3"]), (None, 2, [])]))
    none = positional_index.contamination(docs, table(spark, [], ITEM)).collect()
    assert [r["n_hit"] for r in none] == [0, 0, 0]
    assert positional_index.contamination(table(spark, []), items).collect() == []


def test_proximity(spark):
    docs = table(spark, [(1, "red big fox runs over a hill", None), (2, "fox " + "x " * 30 + "red big", None)])
    items = positional_index.index_items(table(spark, [(1, "big red fox")], ITEM))
    index = positional_index.build_index(docs, items.select("word", "term").distinct())
    near = positional_index.proximity_matches(index, items, slack=2)
    rows = {r["row"]: r["doc_id"] for r in index.collect()}
    assert [rows[r["row"]] for r in near.collect()] == [1]


def test_white_space_and_case_are_ascii():
    from leakloom.llm.hashing import folded_words

    assert folded_words("\u00c9 A\x1cb\u00a0c\x0bD") == ["\u00c9".encode(), "a\x1cb\u00a0c".encode(), b"d"]
    assert trie_dedup.normalised(" a\u00a0b\n") == "a\u00a0b".encode()


@pytest.mark.parametrize("copies", [8, 32, 500])
def test_clusters_with_as_many_outsiders(spark, copies):
    """Near copies of one text and outsiders that share too little with most of them: components as by all pairs."""
    draw, base, texts = random.Random(copies), [f"b{i}" for i in range(60)], []
    for copy in range(copies):
        own = list(base)
        for k in range(draw.randint(0, 1)):
            own[draw.randrange(60)] = f"c{copy}x{k}"
        texts.append(" ".join([*own, f"end{copy}"]))
    for copy in range(copies):  # the same passage among words of their own
        own = [f"o{copy}x{k}" for k in range(draw.randint(8, 22))]
        texts.append(" ".join([*own, *base[:draw.randint(45, 60)]]))
    docs = list(enumerate(texts))
    draw.shuffle(docs)
    found = parity_join.parity_join(table(spark, [(d, t, None) for d, t in docs]), count_links=False)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == near_duplicates(docs)


def test_names_of_sets_that_collide_are_told_apart():
    draw = np.random.default_rng(9)
    sets = [np.sort(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 4, 9, 4)]
    sets[3] = sets[1]
    values, counts = np.concatenate(sets), np.array([len(s) for s in sets])
    marks, checks = parity_join.set_marks(values, counts)
    assert marks[1] == marks[3] and checks[1] == checks[3] and len(set(checks.tolist())) == 3
    again, same = parity_join.set_marks(values, counts, np.sort(marks[[1, 2]]))
    assert again[0] == marks[0] and again[1] == again[3] != marks[1] and again[2] != marks[2] and (same == checks).all()


def test_registered_join_matches_all_pairs(spark):
    import duckdb

    from leakloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_parity_join"](spark, sf).collect()}
    assert got == near_duplicates(docs)


def test_candidates_of_a_block_are_few_per_outsider():
    """Sets that may all link, each a component of its own: a block names the closest few of each, and says that there are more."""
    n = 200
    sketch = np.array([bytes(8) for _ in range(n)] * 2, object)
    mark, size = np.arange(n).tolist() * 2, np.full(2 * n, 50)
    found = parity_join._block_pairs(np.arange(2 * n) < n, np.array(mark), np.array(mark), size, sketch, 4)
    assert found.shape[1] == 4 * n and found[3].all() and (found[0] != found[1]).all()
    assert np.bincount(found[0]).tolist() == [4] * n
    whole = parity_join._block_pairs(np.arange(2 * n) < n, np.array(mark), np.array(mark), size, sketch, n)
    assert whole.shape[1] == n * (n - 1) and not whole[3].any()


def test_rounds_of_candidates_find_every_component(spark, monkeypatch):
    """Members of a family link with some of the others only; one candidate an outsider and round."""
    monkeypatch.setattr(parity_join, "CLOSEST", 1)
    monkeypatch.setattr(parity_join, "MORE", 2)
    rng, members = random.Random(7), 300
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(members):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 2, 3))):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.parity_join(frame, count_links=False).collect()}
    sets = [{tuple(words[k:k + 5]) for k in range(len(words) - 4)} for words in map(str.split, texts)]
    root = list(range(members))
    for a in range(members):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root))
