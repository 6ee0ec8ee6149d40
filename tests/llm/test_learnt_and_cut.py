"""Fill-in-middle cuts, the quality discriminant and refined whitening against plain computations."""

import hashlib
import math
import random
import re
import zlib
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from leakloom.llm import middle_fill, quality, whitening
from leakloom.llm.queries import QUERIES
from tests.llm.helpers import clashing, table

SF = "/root/testdata/sf0.001"
_TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# --- fill in middle ---

def _plain_arrangement(doc_id, text):
    text = text or ""
    tokens = _TOKEN.findall(text)
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_boundaries_in_containers_of_all_kinds():
    draw, kinds = random.Random(1), set()
    pieces = ["ab", "é", "中", "z", " ", "\n", "漢", "Z", "@", "[", "`", "{", "\U0001F600", "\x00"]
    texts = ["", "a", " ", "x" * 65536, "x" * 65535 + "y z", " " * 65537, "ab " * 70000, "a" * 200000 + " b", "\U0001F600" * 65536]
    texts += ["".join(draw.choice(pieces[:draw.randrange(1, 15)]) for _ in range(draw.choice((5, 80, 66000)))) for _ in range(40)]
    for text in texts:
        places, offsets = middle_fill.Boundaries(text), [0]
        for token in _TOKEN.findall(text):
            offsets.append(offsets[-1] + len(token))
        assert len(places) == len(offsets)
        for k in {0, len(offsets) - 1, *(draw.randrange(len(offsets)) for _ in range(60))}:
            assert places.select(k) == offsets[k]
        kinds |= {type(c).__name__ for c in places.containers}
    assert kinds == {"_Array", "_Bitmap", "_Runs"}


def test_arrangements_and_what_is_restored(spark):
    from pyspark.sql import functions as F

    odd = ["", None, "<P>", "a <S> b", "x<", "S>y <", "<<P", "é" * 9, "a" * 70000, "M>", "a\n\n b\t", "ab " * 40000, "\x00<M"]
    rows = [(i, odd[i % len(odd)], None) for i in range(120)] + [(None, "null id", None), (2**60 + 1, "wide", None), (5, "again", None)]
    found = middle_fill.fill_in_middle(clashing(table(spark, rows)))
    got = sorted(map(repr, (tuple(r) for r in found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle_fill.restored(F.col("output"), F.col("form"))).collect())))
    assert got == sorted(repr((d, *_plain_arrangement(d, t), t or "")) for d, t, _ in rows)
    assert {r["form"] for r in found.select("form").collect()} == {"plain", "psm", "spm"}
    assert middle_fill.fill_in_middle(table(spark, [])).collect() == []


# --- quality ---

def _rows_of(spark, n, seed=0):
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(draw.randrange(20, 80))]
        good = draw.random() < 0.6
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" if draw.random() < 0.8 else w for w in words)
        rows.append((i, text, None))
        labels.append((i, int(good)))
    return rows, labels


def test_scores_follow_the_densities(spark):
    """Scores equal log-densities from covariances and inverses computed without factors or partial sums."""
    rows, labels = _rows_of(spark, 400)
    x = quality.with_statistics(table(spark, rows))
    model = quality.learn(x, table(spark, labels, "doc_id long, quality int"))
    learnt = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    values = {r["doc_id"]: np.array(r["x"]) for r in x.collect()}
    sums = {k: np.stack([values[d] for d, y in learnt.items() if y == k]) for k in (0, 1)}
    best = None
    for towards_all in quality.TOWARDS_ALL:
        for towards_diagonal in quality.TOWARDS_DIAGONAL:
            covariances = {k: np.cov(v.T, bias=True) for k, v in sums.items()}
            pooled = sum(covariances[k] * len(sums[k]) for k in (0, 1)) / len(learnt)
            densities = {}
            for k in (0, 1):
                c = (1 - towards_all) * covariances[k] + towards_all * pooled
                d = np.maximum(np.diag(c), quality.LEAST_SPREAD ** 2)
                c = (1 - towards_diagonal) * c
                c[np.diag_indices_from(c)] = d
                densities[k] = (sums[k].mean(axis=0), np.linalg.inv(c), np.linalg.slogdet(c)[1], len(sums[k]) / len(learnt))
            for temper in quality.TEMPER:
                def score(v):
                    logs = [math.log(p) - 0.5 * (s + (v - m) @ i @ (v - m)) for m, i, s, p in (densities[0], densities[1])]
                    return 1 / (1 + math.exp(-max(-500, min(500, temper * (logs[1] - logs[0])))))
                same = np.allclose([score(values[d]) for d in range(400)], model.scores(np.stack([values[d] for d in range(400)])), atol=1e-6)
                best = (towards_all, towards_diagonal, temper) if same else best
    assert best is not None
    wrong = sum((model.scores(values[d][None])[0] >= 0.5) != (y == 1) for d, y in labels if d not in learnt)
    assert wrong <= 2


def test_moments_merge():
    x = np.random.default_rng(1).normal(5, 2, (101, len(quality.STATISTICS)))
    merged = sum((quality.moments_of(part) for part in np.split(x, [0, 7, 50, 50])), quality._none())
    assert merged.n == 101 and np.allclose(merged.mean, x.mean(axis=0))
    assert np.allclose(merged.products / 101, np.cov(x.T, bias=True))


def test_statistics_of_odd_texts():
    for text in ("", None, " \n\t", "a", "!!!", "a a a a", "x" * 3_000_000, "\x00 é", "a\n\na\na"):
        assert np.isfinite(quality.statistics(text)).all()
    named = dict(zip(quality.STATISTICS, quality.statistics("No no no, yes\nyes yes\n\nyes yes\n")))
    assert math.isclose(named["words"], math.log(9)) and math.isclose(named["run"], math.log(6))
    assert math.isclose(named["repeated"], math.log(5.5 / 9)) and math.isclose(named["distinct"], math.log(3.5 / 9))
    assert math.isclose(named["repeated_lines"], math.log(1.5 / 4)) and math.isclose(named["upper"], math.log(1.5 / 22))


def test_quality_of_odd_tables(spark):
    rows, labels = _rows_of(spark, 60)
    odd = [(None, "a b", None), (7, None, None), (7, "", None), (2**60 + 1, "Some words.", None), (8, rows[8][1], None)]
    docs = clashing(table(spark, rows + odd)).withColumnRenamed("n", "fold").withColumnRenamed("path", "x").withColumnRenamed("host", "label")
    x = quality.with_statistics(docs)
    some = table(spark, labels + [(9, 5), (None, 1), (10, None)], "doc_id long, quality int")
    found = x.withColumn("score", quality.quality(quality.learn(x, some))("x")).collect()
    assert len(found) == 65 and all(0 <= r["score"] <= 1 for r in found)
    for none in (table(spark, [], "doc_id long, quality int"), table(spark, [(1, 1), (2, 1)], "doc_id long, quality int")):
        assert len({float(s) for s in quality.learn(x, none).scores(np.zeros((3, len(quality.STATISTICS))))}) == 1
    empty = quality.with_statistics(table(spark, []))
    assert empty.withColumn("score", quality.quality(quality.learn(empty, some))("x")).collect() == []


def test_registered_quality_on_held_out_labels(spark):
    import duckdb

    found = {r["doc_id"]: r for r in QUERIES["op12_quadratic_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(found[d], y) for d, y in labels if d in found and zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 100 and all(r["held_out"] for r, _ in held)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for d, r in found.items())
    assert sum(r["predicted"] == y for r, y in held) / len(held) >= 0.95


# --- whitening ---

def _fractions(vectors):
    x = [[math.floor(1024 * Fraction(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = [[n * a - s for a, s in zip(row, sums)] for row in x]
    width = len(sums)
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n ** 3)) for j in range(width)] for i in range(width)])
    return n, [sum(c * c for c in row) for row in centred], np.array(centred, float) / n, v


def test_whitening_against_fractions(spark):
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(90, 10)) @ draw.normal(size=(10, 10)) * 0.1 + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, vectors[0].tolist())]
    junk = [(91, None), (92, [None] + [0.0] * 9), (93, [math.nan] * 10), (94, [math.inf] + [0.0] * 9), (95, [1.0]), (96, [])]
    frame = clashing(table(spark, rows + junk, "vec_id long, embedding array<float>")).withColumnRenamed("n", "x").withColumnRenamed("key", "values")
    got = whitening.whiten(frame).collect()
    n, deviations, centred, v = _fractions([v for _, v in rows])
    assert n == 91 and len(got) == 91 * 8 and {r["n"] for r in got} == {91}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, Decimal(d)) for (i, _), d in zip(rows, deviations)}
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(8):
        own = np.array([by[i, c + 1]["whitened"] for i, _ in rows])
        want = centred @ basis[:, c] / np.sqrt(values[c])
        assert np.allclose(own, want, atol=1e-9) or np.allclose(own, -want, atol=1e-9)
        assert math.isclose(by[0, c + 1]["explained"], values[c] / np.trace(v), rel_tol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_refinement_reaches_extended_precision():
    draw = np.random.default_rng(3)
    eye = np.eye(40)
    for spread in (draw.normal(size=40), np.repeat([5.0, 4.0, 1.0, 0.5], 10), np.ones(40), np.zeros(40),
                   np.concatenate((5 + np.arange(5) * 1e-7, 1 + np.arange(30) * 1e-3, np.full(5, 1e-8)))):
        basis = np.linalg.qr(draw.normal(size=(40, 40)))[0].astype(np.longdouble)
        for _ in range(3):
            basis = basis @ (1.5 * eye - 0.5 * basis.T @ basis)
        a = (basis * spread.astype(np.longdouble)) @ basis.T
        a = (a + a.T) / 2
        values, x = whitening.eigen(a)
        assert np.allclose(values, np.sort(spread)[::-1], rtol=1e-14, atol=1e-15)
        wide = x.astype(np.longdouble)
        assert float(np.abs(wide.T @ wide - eye).max()) < 4e-16
        assert float(np.abs(a @ wide - wide * values.astype(np.longdouble)).max()) < 1e-15 * max(1.0, np.abs(spread).max())


def test_close_eigenvalues_get_their_own_vectors():
    a = np.diag(np.array([1, 1 + 1e-8, 1 + 2e-8, 3], np.longdouble))
    turn = np.linalg.qr(np.random.default_rng(4).normal(size=(4, 4)))[0].astype(np.longdouble)
    for _ in range(3):
        turn = turn @ (1.5 * np.eye(4) - 0.5 * turn.T @ turn)
    a = turn @ a @ turn.T
    x = whitening.eigen((a + a.T) / 2)[1]
    assert np.allclose(np.abs(x.T @ turn.astype(float)), np.eye(4)[[3, 2, 1, 0]], atol=1e-9)


@pytest.mark.parametrize("scale", [1, 10**6, 10**12])
def test_products_are_exact(scale):
    y = np.random.default_rng(5).integers(-900, 900, (300, 5)) * scale
    want = y.astype(object).T @ y.astype(object)
    assert whitening.products(y) == [int(v) for v in want[np.triu_indices(5)]]
    rest = [3 * scale, -2, 0, 7, scale]
    assert whitening._deviations(y, 300, rest) == [sum((300 * int(a) - s) ** 2 for a, s in zip(row, rest)) for row in y]


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(table(spark, [], schema)).collect() == []
    assert whitening.whiten(table(spark, [(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(table(spark, [(None, [1.0, 2.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [
        (None, 1, 1, 0, None, None), (None, 2, 1, 0, None, None)]
    flat = whitening.whiten(table(spark, [(i, [float(i), 1.0, 3e30]) for i in range(4)], schema)).collect()
    assert [r["component"] for r in flat if r["whitened"] is not None] == [1] * 4
    assert all(r["identity_error"] < 1e-12 for r in flat)


def test_registered_whitening(spark):
    got = QUERIES["op13_refined_whitening"](spark, SF).collect()
    whitened = np.array([r["whitened"] for r in sorted(got, key=lambda r: (r["component"], r["vec_id"]))]).reshape(8, -1)
    moments = (whitened @ whitened.T) / whitened.shape[1]
    assert np.abs(moments - np.eye(8)).max() < 1e-9 and np.abs(whitened.mean(axis=1)).max() < 1e-9
    assert all(isinstance(r["deviation"], int) for r in got)
