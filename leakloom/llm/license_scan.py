"""Licence scan by patience alignment.

A template and a stretch of text are aligned on the words that are unique in both:
the longest subsequence of them that increases on both sides is kept, and the gaps
between its members are aligned in the same way. Coverage is the share of the
template's words that are aligned.

Where to look follows from the coverage wanted: a stretch that covers a share c of
a template of n words must hold one of any n - ceil(c n) + 1 of them. So only the
occurrences of those template words that are rarest in the text are looked around,
and texts without enough of the words are passed over. Every window of STRETCH times
the template's length there is aligned by itself if it holds enough of the words, so
stray template words outside a window take no part in it. This leaves out nothing.

A text is handled within its own task, row by row, without any shuffle. Defined
results: null and empty texts have no words and no licence; repeated rows are
scanned alike; a licence that a text holds several times counts once, with its
best coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leakloom.llm.common import id_text, id_values, longs, on_workers

#: Usual notices of licences.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at http://www.apache.org/licenses/LICENSE-2.0"),
)
COVERAGE = 0.8
#: A stretch is at most so many times as long as the template.
STRETCH = 1.5

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    top_places: list[int] = []
    previous: list[int] = []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        previous.append(top_places[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            top_places.append(place)
        else:
            tops[pile], top_places[pile] = value, place
    chain, place = [], top_places[-1] if top_places else -1
    while place >= 0:
        chain.append(place)
        place = previous[place]
    return chain[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing on both sides."""
    found, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        own, other = Counter(text[a:a_end]), Counter(template[b:b_end])
        at = {text[i]: i for i in range(a, a_end) if own[text[i]] == 1}
        pairs = [(at[template[j]], j) for j in range(b, b_end) if other[template[j]] == 1 and template[j] in at]
        anchors = [pairs[k] for k in longest_increasing([i for i, _ in pairs])]
        if not anchors:
            continue
        found += anchors
        for i, j in [*anchors, (a_end, b_end)]:
            if a < i and b < j:
                gaps.append((a, i, b, j))
            a, b = i + 1, j + 1
    return sorted(found)


def windows(places: Sequence[int], reach: int) -> Iterator[tuple[int, int]]:
    """Different ranges (first, end) of the sorted `places` that windows of `reach` words hold."""
    first = end = 0
    last = None
    for begin in sorted({0, *places, *(p + 1 for p in places), *(p - reach + 1 for p in places if p >= reach)}):
        while first < len(places) and places[first] < begin:
            first += 1
        while end < len(places) and places[end] < begin + reach:
            end += 1
        if first < end and (first, end) != last:
            last = first, end
            yield last


class Scanner:
    def __init__(self, templates: Iterable[tuple[str, str]], coverage: float):
        self.templates = []
        for name, text in templates:
            words = words_of(text)
            need = -int(-coverage * len(words) // 1)
            self.templates.append((name, words, Counter(words), need))
        self.vocabulary = {w for _, words, _, _ in self.templates for w in words}

    def __call__(self, text: str | None) -> tuple[int, dict[str, tuple[float, int, int]]]:
        """Number of words; per licence the best (coverage, first word, last word)."""
        words = words_of(text)
        known = self.vocabulary.intersection(words)
        best: dict[str, tuple[float, int, int]] = {}
        places = None
        for name, template, counts, need in self.templates:
            if sum(n for w, n in counts.items() if w in known) < need:
                continue
            if places is None:
                places = defaultdict(list)
                for place, word in enumerate(words):
                    if word in known:
                        places[word].append(place)
            rarest = sorted(range(len(template)), key=lambda j: (len(places.get(template[j], ())), j))
            reach = int(STRETCH * len(template))
            around = sorted({i for j in rarest[:len(template) - need + 1] for i in places.get(template[j], ())})
            own = sorted(i for w in counts for i in places.get(w, ()))
            own = [i for i in own if (k := bisect_left(around, i - reach + 1)) < len(around) and around[k] < i + reach]
            held: Counter[str] = Counter()
            enough = begin = end = 0  # words of the template that the window holds
            for first, last in windows(own, reach):
                for i in own[end:last]:
                    held[words[i]] += 1
                    enough += held[words[i]] <= counts[words[i]]
                for i in own[begin:first]:
                    enough -= held[words[i]] <= counts[words[i]]
                    held[words[i]] -= 1
                begin, end = first, last
                if enough < need:
                    continue
                at = own[first]
                matched = align(words[at:own[last - 1] + 1], template)
                if len(matched) >= need:
                    found = (len(matched) / len(template), -(at + matched[0][0]), -(at + matched[-1][0]))
                    best[name] = max(best.get(name, found), found)
        return len(words), {name: (c, -first, -last) for name, (c, first, last) in best.items()}


def scan_licenses(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Per row (doc_id, text): doc_id, n_words and licences, an array of (license, coverage, first_word, last_word) by name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner(templates, coverage)
        for batch in batches:
            found = [scan(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": longs(id_values(batch["doc_id"])), "n_words": [n for n, _ in found],
                "licenses": pd.Series([[{"license": k, "coverage": c, "first_word": a, "last_word": b}
                                        for k, (c, a, b) in sorted(hits.items())] for _, hits in found],
                                      dtype=object, index=batch.index)})

    return documents.select(id_text(), "text").mapInPandas(run, (
        "doc_id long, n_words long, licenses array<struct<license string, coverage double, first_word long, last_word long>>"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"),
                        F.array_join("licenses.license", ",").alias("licenses"),
                        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("best_coverage"))
