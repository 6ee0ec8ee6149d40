"""Toxicity by a learnt lexicon, misspellings included, in context.

Learning reads labelled rows only. A term is the start of words that toxic texts
have and clean ones hardly do; it is taken as long as nearly all its toxic texts
allow, up to the whole word. The terms form a trie. A word of a text is looked up
by running its Levenshtein automaton along the trie, so that misspellings are
found, too; the answer for a word is remembered, so frequent words cost a look-up.
Words of clean labelled texts that are an edit away from a term are no misspellings.
Evidence is counted over different texts: exact and near copies in the sample are
one, found by least shingle hashes.

Scripts written without spaces have no words to look up. Every place of such a run
stands for a word instead: the few characters from there on, so a term is found
anywhere in the run. Such terms have no end marks and are not matched misspelt.

Each hit is read in its window: one between quotation marks, or after a word that
reports speech, counts as quoted, others as abuse. Which words report is learnt from
those in front of terms in clean texts, starting from a short table. A text's counts of exact,
misspelt and quoted hits go into a logistic score. Its weights are fitted to
`sample_rows` labelled documents at most, the documented bound, chosen by a hash of the
id; they start from the stated prior, which holds where there are few labels. All
terms with enough evidence in the sample are taken; its size bounds their number.

Defined results: null and empty texts have no hits and get the score of the
intercept; without labels of both kinds there are no terms; repeated rows are
scored alike; null ids are scored, but never learnt from or held out; of several texts
of one id the least is learnt from. Words of any length are looked up by their first
letters: a term of more than `LONGEST` letters is a start of `LONGEST` letters.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from leakloom.llm.common import kept, on_workers, stored
from leakloom.llm.hashing import WordHashes, batched, mix, shingle_sets

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Least different toxic texts of a term; least evidence (G-squared) and purity.
LEAST_TEXTS, LEAST_EVIDENCE, LEAST_PURITY = 4, 20.0, 0.8
#: Near copies in the sample: least hashes of a text, how many are compared at once, how many must agree.
SIGNATURE, BAND, SAME = 40, 4, 26
SHORTEST, LONGEST = 3, 24
#: Whole words, and starts of words, of this length and more may be misspelt by one edit.
FUZZY_FROM, FUZZY_START_FROM = 5, 7
WINDOW = 6
#: Intercept, any hit, log of all hits, of misspelt and of quoted ones, share of hits: prior means and their spread.
#: A misspelt hit counts like an exact one, less what the labels say against it.
PRIOR = np.array([-3.0, 3.0, 2.0, -1.0, 0.5, 0.0])
SPREAD = 2.0

_END = "$"
_TABLE = 150_000
#: Words of texts that a task holds before they are sent on; a text's own words come on top.
_HELD = 20_000
#: Characters of scripts without spaces (Thai and Lao, Burmese, Khmer, kana, Han); those that stand for a word in them.
_RANGES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_RANGES}]+")
SHORTEST_UNSPACED, PIECE = 2, 4
_WORD = re.compile(r"[^\W_]+(?:[*@'0-9]+[^\W_]+)*")
_QUOTES = "\"“”„«»"
_REPORTING = frozenset(("said", "says", "quote", "quoted", "called", "wrote", "word", "term"))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return [w for w, _, _ in _pieces_of(text)] if _UNSPACED.search(text) else _WORD.findall(text)


def _pieces_of(text: str) -> Iterator[tuple[str, int, int]]:
    """Words of a lower-cased text with where they begin and end; in scripts without spaces a piece from each place on."""
    for m in _WORD.finditer(text):
        at, end = m.span()
        for run in _UNSPACED.finditer(text, at, end):
            if run.start() > at:
                yield text[at:run.start()], at, run.start()
            at = run.end()
            for i in range(run.start(), at):
                yield text[i:min(i + PIECE, at)], i, min(i + PIECE, at)
        if at < end:
            yield text[at:end], at, end


class LexiconTrie(dict):
    """Trie of terms; indexing by a word gives 0: no term, 1: a term as it is, 2: a misspelt term.

    `match` runs the Levenshtein automaton of a word along the trie. Answers are
    remembered in two generations of `_TABLE` words.
    """

    def __init__(self, terms: Iterable[str], plain: Iterable[str] = ()):
        super().__init__()
        self.plain = frozenset(plain)
        self.old: dict[str, int] = {}
        self.root: dict = {}
        self.starts: dict[int, set[str]] = {}             # starts that match as they are, by length
        self.whole: set[str] = set()                      # words that match as they are
        self.near: set[str] = set()                       # words that may be misspelt, and what is left of them without one letter
        self.near_lengths: set[int] = set()
        self.near_starts, self.start_lengths = set(), set()  # the same for starts, and their lengths
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            stem, whole = term.rstrip(_END), term.endswith(_END)
            fuzzy = len(stem) >= (FUZZY_FROM if whole else FUZZY_START_FROM)
            node[""] = int(fuzzy)
            if whole:
                self.whole.add(stem)
            else:
                self.starts.setdefault(len(term), set()).add(term)
            if fuzzy and whole:
                self.near.update((stem, *_without_one(stem)))
                self.near_lengths.update(range(len(stem) - 1, len(stem) + 2))
            elif fuzzy:
                # One edit leaves one half of a start as it is, the second half at most one place off.
                self.near_starts.update((term, *_without_one(term)))
                self.start_lengths.add(len(term))
                half = len(term) // 2
                self.heads.setdefault(half, set()).add(term[:half])
                tail = term[half:half + 4]
                self.tails.setdefault((half, len(tail)), set()).add(tail)

    def __missing__(self, word: str) -> int:
        if len(self) >= _TABLE:
            self.old = dict(self)
            self.clear()
        kind = self.old.get(word)
        if kind is None:
            kind = self._look_up(word + _END)
            kind = 0 if kind == 2 and word in self.plain else kind
        self[word] = kind
        return kind

    def _look_up(self, word: str) -> int:
        """1 for a term as it is; the automaton is asked about words that may be an edit away from one, by cheaper tests."""
        stem = word[:-1]
        if stem in self.whole:
            return 1
        for n, own in self.starts.items():
            if stem[:n] in own:
                return 1
        if len(stem) in self.near_lengths and (stem in self.near or not self.near.isdisjoint(_without_one(stem))):
            return self.match(word)
        return self.match(word) if self._may_start(stem) and self._nearly_starts(stem) else 0

    def _may_start(self, word: str) -> bool:
        for half, heads in self.heads.items():
            if word[:half] in heads:
                return True
        for (half, n), tails in self.tails.items():
            if (word[half:half + n] in tails or word[half - 1:half - 1 + n] in tails
                    or word[half + 1:half + 1 + n] in tails):
                return True
        return False

    def _nearly_starts(self, word: str) -> bool:
        """Some start of the word is, or is without one letter, what a term or a term without one letter is."""
        for n in self.start_lengths:
            if len(word) >= n - 1 and (word[:n] in self.near_starts or word[:n - 1] in self.near_starts
                                       or not self.near_starts.isdisjoint(_without_one(word[:n]))
                                       or not self.near_starts.isdisjoint(_without_one(word[:n + 1]))):
                return True
        return False

    def match(self, word: str) -> int:
        best = 3
        stack = [(self.root, ((0, 0),))]
        while stack:
            node, states = stack.pop()
            allowed = node.get("")
            if allowed is not None:
                errors = min(e for _, e in states)
                if errors <= allowed:
                    best = min(best, 1 + errors)
            for letter, child in node.items():
                if letter:
                    following = _step(states, letter, word)
                    if following:
                        stack.append((child, following))
        return best if best < 3 else 0


def _without_one(word: str) -> list[str]:
    return [word[:i] + word[i + 1:] for i in range(len(word))]


def _step(states: tuple, letter: str, word: str) -> tuple:
    """States (place in the word, errors) of the automaton for one edit, after `letter` of a term."""
    after = {}
    for place, errors in states:
        if place < len(word) and word[place] == letter:
            after[place + 1] = min(errors, after.get(place + 1, 2))
        elif errors == 0:
            if letter != _END:
                after[place] = min(1, after.get(place, 2))          # the term's letter is missing
            if letter != _END and place < len(word) and word[place] != _END:
                after[place + 1] = min(1, after.get(place + 1, 2))  # another letter in its place
            if place + 1 < len(word) and word[place + 1] == letter:
                after[place + 2] = min(1, after.get(place + 2, 2))  # a letter too many
    return tuple(after.items())


def trie_of(terms: tuple[str, ...], plain: tuple[str, ...]) -> LexiconTrie:
    """One trie per worker process: later tasks find the words of earlier ones."""
    return kept(LexiconTrie, terms, plain)


@dataclass
class Model:
    terms: list[str]
    plain: list[str] = field(default_factory=list)
    reporting: frozenset[str] = _REPORTING
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        trie = trie_of(tuple(self.terms), tuple(self.plain))
        return np.array([text_features(t, trie, self.reporting) for t in texts]).reshape(-1, len(PRIOR))


def text_features(text: str | None, trie: LexiconTrie, reporting: frozenset[str] = _REPORTING) -> tuple:
    words = words_of(text)
    kinds = list(map(trie.__getitem__, words))
    exact = misspelt = quoted = 0
    if any(kinds):
        spans = None
        for place, kind in enumerate(kinds):
            if kind:
                if spans is None:
                    lowered = text.lower()
                    spans = [span for _, *span in _pieces_of(lowered)]
                if _is_quoted(lowered, spans, words, place, reporting):
                    quoted += 1
                elif kind == 1:
                    exact += 1
                else:
                    misspelt += 1
    hits = exact + misspelt
    return (1.0, float(hits > 0), math.log1p(hits), math.log1p(misspelt), math.log1p(quoted),
            hits / len(words) if words else 0.0)


def _is_quoted(text: str, spans: list, words: list[str], place: int, reporting: frozenset[str]) -> bool:
    """Marks on both sides within the window, or a reporting word just before a mark or the hit."""
    begin, end = spans[place]
    before = text[spans[max(0, place - WINDOW)][0]:begin]
    after = text[end:spans[min(len(spans) - 1, place + WINDOW)][1]]
    marked = sum(c in _QUOTES for c in before) % 2 == 1 and any(c in _QUOTES for c in after)
    return marked or (place > 0 and words[place - 1] in reporting)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(documents: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Stored (text, toxic) of at most `sample_rows` labelled documents that are not held out, one text of each."""
    chosen = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id"), "toxicity-sample")


def _signatures(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text its least shingle hashes under SIGNATURE permutations; texts without words have none."""
    table, factors = kept(WordHashes), mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        held = list(zip(batch["key"], batch["text"]))
        for rows in batched(held, 1):
            values, counts = shingle_sets((text for _, text in rows), table)
            least = []
            for own in np.split(values, np.cumsum(counts)[:-1]):
                least.append(np.array([mix(own * f).min() for f in factors]).tobytes() if len(own) else None)
            yield pd.DataFrame({"key": [k for k, _ in rows], "signature": pd.Series(least, dtype=object)})


def _copy_classes(keys: list[int], signatures: list[bytes | None]) -> dict[int, int]:
    """Class of each text: texts that agree in SAME of their signature's places are near copies."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    rows = [(k, np.frombuffer(s, np.uint64)) for k, s in sorted(zip(keys, signatures)) if s is not None]
    for at in range(0, SIGNATURE, BAND):
        holders: dict[bytes, list] = {}
        for k, own in rows:
            earlier = holders.setdefault(own[at:at + BAND].tobytes(), [])
            for other, theirs in earlier:
                if find(other) != find(k) and (own == theirs).sum() >= SAME:
                    low, high = sorted((find(other), find(k)))
                    root[high] = low
            # One holder of each class stands for it.
            if all(find(other) != find(k) for other, _ in earlier):
                earlier.append((k, own))
    return {k: find(k) for k in keys}


def with_classes(sample: DataFrame) -> DataFrame:
    """`sample` (text, toxic) with `class`, the same for exact and near copies of a text.

    A few hundred bytes of each different text of the sample, which is bounded, are collected.
    """
    keyed = sample.withColumn("key", F.xxhash64("text"))
    found = (keyed.select("key", "text").dropDuplicates(["key"])
             .mapInPandas(_signatures, "key long, signature binary").collect())
    classes = _copy_classes([r["key"] for r in found], [r["signature"] and bytes(r["signature"]) for r in found])
    # An Arrow table needs no Python on the executors; a list of rows would start a second kind of workers there.
    frame = sample.sparkSession.createDataFrame(pa.table({"key": pa.array(classes.keys(), pa.int64()), "class": pa.array(classes.values(), pa.int64())}))
    return keyed.join(F.broadcast(frame), "key").select("text", "toxic", "class")


def _word_classes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Different (word, class, toxic) of some texts at a time; the rows of a batch of texts are not held at once."""
    held = set()
    for batch in batches:
        for text, toxic, own in zip(batch["text"], batch["toxic"], batch["class"]):
            held.update((word, own, int(toxic)) for word in set(words_of(text)))
            if len(held) > _HELD:
                yield from _word_rows(held)
                held = set()
    yield from _word_rows(held)


def _word_rows(held: set, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    held = list(held)
    for at in range(0, len(held), rows):
        yield pd.DataFrame(held[at:at + rows], columns=["word", "class", "toxic"]).astype({"word": object})


def learn_terms(sample: DataFrame) -> list[str]:
    """Terms of the lexicon: starts of words, with the end mark where they are whole words."""
    return _learn_terms(stored(with_classes(sample), "toxicity-classes"))


def _learn_terms(sample: DataFrame) -> list[str]:
    totals = dict(sample.select("toxic", "class").distinct().groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    n = float(toxic + clean)
    seen = F.col("toxic") + F.col("clean")
    part = lambda have, rows: F.when(have > 0, have * F.log(have * n / (seen * float(rows)))).otherwise(0.0)
    unspaced = F.col("word").rlike(f"[{_RANGES}]")
    marked = F.when(unspaced | (F.length("word") > LONGEST), F.substring("word", 1, LONGEST)).otherwise(F.concat("word", F.lit(_END)))
    shortest = F.when(unspaced, SHORTEST_UNSPACED).otherwise(SHORTEST)
    starts = F.transform(F.sequence(shortest, F.greatest(shortest, F.length(marked))), lambda n: F.substring(marked, F.lit(1), n))
    # A class of texts counts once for each of its words that have the start.
    found = (sample.mapInPandas(_word_classes, "word string, class long, toxic int").distinct()
             .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
             .select(F.explode(starts).alias("term"), "toxic", "clean")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .withColumn("evidence", 2 * (part(F.col("toxic"), toxic) + part(F.col("clean"), clean)))
             .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("evidence") >= LEAST_EVIDENCE)
                    & (F.col("toxic") / toxic >= LEAST_PURITY * (F.col("toxic") / toxic + F.col("clean") / clean))
                    & (F.col("toxic") >= LEAST_PURITY * seen))
             .select("term", "toxic").collect())
    return _longest_forms({r["term"]: r["toxic"] for r in found})


def _longest_forms(counts: dict[str, int]) -> list[str]:
    """Shortest terms, each made longer while a longer one keeps nine tenths of its texts."""
    taken, forms, names = set(), [], sorted(counts)
    for term in sorted(counts, key=lambda t: (len(t), t)):
        if any(term[:n] in taken for n in range(SHORTEST_UNSPACED, len(term))):
            continue
        taken.add(term)
        at = bisect.bisect_left(names, term)
        longer = sorted(itertools.takewhile(lambda t, term=term: t.startswith(term), (names[i] for i in range(at, len(names)))), key=len)
        for t in longer:
            if counts[t] >= 0.9 * counts[term]:
                term = t
        forms.append(term)
    return forms


def plain_words(sample: DataFrame, terms: list[str]) -> list[str]:
    """Words of clean texts that are an edit away from a term: ordinary words, no misspellings.

    There are at most as many as terms have neighbours.
    """
    def found(batches):
        trie, seen = trie_of(tuple(terms), ()), set()
        for batch in batches:
            for text in batch["text"]:
                seen.update(w for w in set(words_of(text)) if trie[w] == 2)
        yield pd.DataFrame({"word": pd.Series(sorted(seen), dtype=object)})

    return sorted(r[0] for r in sample.where("toxic = 0").mapInPandas(found, "word string").distinct().collect())


def reporting_words(classes: DataFrame, terms: list[str]) -> list[str]:
    """Words in front of terms that nearly only clean texts of the sample (text, toxic, class) have there."""
    def found(batches):
        trie, seen = trie_of(tuple(terms), ()), set()
        for batch in batches:
            for text, toxic, own in zip(batch["text"], batch["toxic"], batch["class"]):
                words = words_of(text)
                seen.update((before, own, int(toxic)) for before, word in zip(words, words[1:]) if trie[word])
        yield from _word_rows(seen)

    counts = (classes.mapInPandas(found, "word string, class long, toxic int").distinct()
              .groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.count("*").alias("n"))
              .where((F.col("clean") >= LEAST_TEXTS) & (F.col("clean") >= LEAST_PURITY * F.col("n"))))
    return sorted(r["word"] for r in counts.select("word").collect())


def fit(sample: DataFrame, terms: list[str], reporting: Iterable[str] = ()) -> Model:
    """Weights by a few Newton steps on the sample's features, with the prior."""
    model = Model(terms, plain_words(sample, terms), _REPORTING.union(reporting))

    def rows(batches):
        for batch in batches:
            x = model.features(batch["text"])
            frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])
            frame["toxic"] = batch["toxic"].to_numpy()
            yield frame.groupby(list(frame.columns), as_index=False).size()

    names = [f"x{i}" for i in range(len(PRIOR))]
    schema = ", ".join(f"{x} double" for x in names) + ", toxic int, size long"
    data = sample.mapInPandas(rows, schema).toPandas()
    x, y, n = data[names].to_numpy(), data["toxic"].to_numpy(), data["size"].to_numpy()
    def loss(w):
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + ((w - PRIOR) ** 2).sum() / (2 * SPREAD ** 2))

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (w - PRIOR) / SPREAD ** 2
        curvature = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD ** 2
        step = np.linalg.solve(curvature, gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    model.weights = w
    return model


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = learning_rows(documents, labels, sample_rows)
    classes = stored(with_classes(sample), "toxicity-classes")
    terms = _learn_terms(classes)
    return fit(sample, terms, reporting_words(classes, terms))


def toxicity(model: Model):
    """Function from a text column to its score."""
    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = trie_of(tuple(model.terms), tuple(model.plain))
        for texts in batches:
            x = np.array([text_features(t, trie, model.reporting) for t in texts]).reshape(-1, len(PRIOR))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))
    return score


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return (documents.select("doc_id", "text").withColumn("score", toxicity(model)("text"))
            .select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
