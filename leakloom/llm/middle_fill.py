"""Fill-in-middle transformation with Roaring-style sets of token boundaries.

A text's boundaries are the places between its tokens, both ends included: n tokens
have n + 1 of them. They are held as a compressed set. Each stretch of 2^16 code
points is a container of the smallest of three kinds: a sorted array of places, a
bitmap with counts per 64-bit word, or runs of consecutive places. Cumulative
cardinalities tell which container holds the k-th boundary, and a select inside it
tells where it is. A cut after k tokens is the offset of boundary k.

A text is read a stretch at a time, so besides the text itself only its set is held.
Texts are cut by two draws per document and put out plain, prefix-suffix-middle, or
suffix-prefix-middle; `restored` rebuilds the text from what was put out.

Defined results: null and empty texts have no tokens, are plain and put out empty; a
null id draws as an empty number; repeated rows come out alike; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm.common import on_workers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents this many are cut; of 100 cut ones this many put the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
#: Code points of a container; bytes of a bitmap.
SPAN = 1 << 16
_BITMAP_BYTES = SPAN // 8


class _Array:
    """Sorted places of a container."""

    def __init__(self, held: np.ndarray):
        self.places = np.flatnonzero(held).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class _Bitmap:
    """A bit per place, and how many are set before each word of 64."""

    def __init__(self, held: np.ndarray):
        padded = np.zeros(SPAN, bool)
        padded[:len(held)] = held
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.through = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.through, k, side="right"))
        k -= int(self.through[word - 1]) if word else 0
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k])


class _Runs:
    """Runs of consecutive places: where each begins, and how many places all runs up to it hold."""

    def __init__(self, begins: np.ndarray, lengths: np.ndarray):
        self.begins, self.through = begins, np.cumsum(lengths)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.through, k, side="right"))
        return int(self.begins[run]) + k - (int(self.through[run - 1]) if run else 0)


def container(held: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest container of the places where `held` (at most SPAN of them) is true."""
    n = int(np.count_nonzero(held))
    edges = np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0))
    if 2 * len(edges) < min(2 * n, _BITMAP_BYTES):  # a run has two edges, of two bytes each
        return _Runs(edges[::2], edges[1::2] - edges[::2])
    return _Array(held) if 2 * n <= _BITMAP_BYTES else _Bitmap(held)


class Boundaries:
    """Offsets, in code points, of the token boundaries of a text (`[A-Za-z]+|[^A-Za-z]`)."""

    def __init__(self, text: str):
        self.containers, counts = [], []
        before = False  # the last place of the stretch before was a letter
        for at in range(0, len(text) + 1, SPAN):
            points = np.frombuffer(text[at:at + SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = (points | 32) - np.uint32(97) < 26
            held = ~(letter & np.append(before, letter[:-1])) if len(letter) else np.zeros(0, bool)
            before = bool(letter[-1]) if len(letter) else False
            if len(points) < SPAN:
                held = np.append(held, True)  # the end of the text
            self.containers.append(container(held))
            counts.append(int(np.count_nonzero(held)))
        self.through = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.through[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        at = int(np.searchsorted(self.through, k, side="right"))
        return at * SPAN + self.containers[at].select(k - (int(self.through[at - 1]) if at else 0))


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    name = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(name[i:i + 8], 16) for i in range(0, 32, 8))


def arranged(doc_id: int | None, text: str | None, cut_share: int = CUT_SHARE,
             suffix_first_share: int = SUFFIX_FIRST_SHARE) -> tuple[int, str, int | None, int | None, str]:
    """Number of tokens, form, code points of prefix and middle, and the text put out."""
    text = text or ""
    places = Boundaries(text)
    n = len(places) - 1
    one, two, three, four = draws(doc_id)
    if not text or three % 100 >= cut_share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    begin, end = places.select(first), places.select(second)
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if four % 100 < suffix_first_share:
        return n, "spm", begin, end - begin, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", begin, end - begin, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])
#: Characters of one batch that is put out.
_HELD = 4_000_000


def fill_in_middle(documents: DataFrame, cut_share: int = CUT_SHARE,
                   suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """Per row of `documents` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

        rows, held = [], 0
        for doc_id, text in ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1))):
            rows.append((doc_id, *arranged(doc_id, text, cut_share, suffix_first_share)))
            held += len(rows[-1][-1])
            if held >= _HELD:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was arranged: parts are found by the marks, which no arranged text holds."""
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    after = F.length(F.lit(PREFIX))  # all marks have one length
    tail = F.substring(output, m + after, F.length(output))
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(F.substring(output, p + after, s - p - after), tail,
                                          F.substring(output, s + after, m - s - after)))
            .otherwise(F.concat(F.substring(output, p + after, m - p - after), tail,
                                F.substring(output, s + after, p - s - after))))


def op11_middle_fill(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(t) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens),
cut AS (
  SELECT *, array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(t[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
