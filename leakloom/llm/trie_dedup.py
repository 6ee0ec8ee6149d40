"""Exact duplicates by Patricia tries.

Texts are equal when their bytes without white space are. Rows of one length and
one slice of the content hash meet in one compressed radix trie, which takes whole
byte strings, so equality is decided by bytes. A terminal node holds the owner so
far (most code points, then smallest doc_id) and the number of rows.

The same trie runs twice: in the scan, where it folds the copies inside a task, so
that a text with any share of all rows reaches the shuffle once per task; and
after the shuffle, where rows come sorted by (length, slice) and a trie lives only
as long as its slice. Beyond `trie_bytes` the largest subtree leaves the trie as
partial owners; partial owners of one text are merged by a plain aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leakloom.llm.common import SPACE, id_text, id_values, longs, on_workers

_DELETED = b" \t\n\x0b\x0c\r"
TRIE_BYTES = 24_000_000
_CHUNK_BYTES = 4_000_000
_NO_ID = 1 << 63

_PARTIAL = "size long, slice long, body binary, points long, doc_id string, n long"
_OWNERS = "size long, sha string, points long, keep_id long, n long"
_ROWS = "doc_id long, size long, sha string, points long"


def normalised(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, _DELETED) if text else b""


class Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry=None):
        self.label, self.children, self.entry = label, None, entry


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start, by halving slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _better(a: tuple, b: tuple) -> tuple:
    """Entries are (points, doc_id, n): the owner of both, and the rows of both."""
    first = a if (-a[0], a[1]) <= (-b[0], b[1]) else b
    return first[0], first[1], a[2] + b[2]


class PatriciaTrie:
    """Compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, body: bytes, entry: tuple) -> None:
        node, rest = self.root, body
        while rest:
            if node.children is None:
                node.children = {}
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = Node(rest, entry)
                self.bytes += len(rest) + 200
                return
            same = _shared(child.label, rest)
            if same < len(child.label):
                upper = Node(child.label[:same])
                child.label = child.label[same:]
                upper.children = {child.label[0]: child}
                node.children[rest[0]] = child = upper
                self.bytes += 200
            node, rest = child, rest[same:]
        node.entry = entry if node.entry is None else _better(node.entry, entry)

    @staticmethod
    def _below(node: Node, start: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, start)]
        while stack:
            node, start = stack.pop()
            body = start + node.label
            if node.entry is not None:
                yield body, node.entry
            for child in (node.children or {}).values():
                stack.append((child, body))

    def entries(self) -> Iterator[tuple[bytes, tuple]]:
        return self._below(self.root, b"")

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Entries of the subtree below the root that holds most bytes; it leaves the trie."""
        sizes = {}
        for first, child in self.root.children.items():
            size, stack = 0, [child]
            while stack:
                node = stack.pop()
                size += len(node.label) + 200
                stack += (node.children or {}).values()
            sizes[first] = size
        largest = max(sizes, key=sizes.get)
        self.bytes -= sizes[largest]
        yield from self._below(self.root.children.pop(largest), b"")


def _fold_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial owners of the texts of one task."""
    trie, held, size = PatriciaTrie(), [], 0

    def flush():
        nonlocal held, size
        frame = pd.DataFrame(held, columns=["size", "slice", "body", "points", "doc_id", "n"])
        held, size = [], 0
        return frame

    def add(entries):
        nonlocal size
        for body, (points, doc_id, n) in entries:
            piece = int.from_bytes(hashlib.sha256(body).digest()[:2], "big")
            held.append((len(body), piece, body, points, None if doc_id == _NO_ID else str(doc_id), n))
            size += len(body)
            if size >= _CHUNK_BYTES:
                yield flush()

    for batch in batches:
        for doc_id, text in zip(id_values(batch["doc_id"]), batch["text"]):
            trie.insert(normalised(text), (len(text or ""), _NO_ID if doc_id is None else doc_id, 1))
            while trie.bytes > TRIE_BYTES:
                yield from add(trie.spill())
    yield from add(trie.entries())
    if held:
        yield flush()


def _owners(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Owners, from partial owners sorted by (size, slice)."""
    trie, key, held = PatriciaTrie(), None, []

    def drained(entries):
        for body, (points, doc_id, n) in entries:
            held.append((len(body), hashlib.sha256(body).hexdigest(), points, None if doc_id == _NO_ID else doc_id, n))

    def flush():
        nonlocal held
        frame = pd.DataFrame(held, columns=["size", "sha", "points", "keep_id", "n"])
        frame["keep_id"] = longs(r[3] for r in held)
        held = []
        return frame

    for batch in batches:
        for size, piece, body, points, doc_id, n in zip(batch["size"], batch["slice"], batch["body"], batch["points"],
                                                        id_values(batch["doc_id"]), batch["n"]):
            if (size, piece) != key:
                drained(trie.entries())
                trie, key = PatriciaTrie(), (size, piece)
            trie.insert(bytes(body), (int(points), _NO_ID if doc_id is None else doc_id, int(n)))
            while trie.bytes > TRIE_BYTES and trie.root.children and len(trie.root.children) > 1:
                drained(trie.spill())
        if len(held) >= 10_000:
            yield flush()
    drained(trie.entries())
    yield flush()


def _row_hashes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bodies = [normalised(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": longs(id_values(batch["doc_id"])), "size": [len(b) for b in bodies],
            "sha": pd.Series([hashlib.sha256(b).hexdigest() for b in bodies], dtype=object), "points": [len(t or "") for t in batch["text"]]})


def trie_owners(documents: DataFrame) -> DataFrame:
    """One row per different text: size, sha, points and keep_id of its owner, n rows.

    `documents` has doc_id and text; null texts count as empty, null ids come
    after all others. The text is shuffled once, without the copies of a task.
    """
    partial = documents.select(id_text(), "text").mapInPandas(_fold_rows, _PARTIAL)
    owners = (partial.repartition("size", "slice").sortWithinPartitions("size", "slice")
              .mapInPandas(_owners, _OWNERS))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("keep_id").isNull().alias("u"), "keep_id"))
    return (owners.groupBy("size", "sha").agg(best.alias("_best"), F.sum("n").alias("n"))
            .select("size", "sha", (-F.col("_best.p")).alias("points"), F.col("_best.keep_id").alias("keep_id"), "n"))


def mark_copies(documents: DataFrame) -> DataFrame:
    """Every row with its owner: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat a doc_id together with an equally long equal text can't be
    told apart; they are all marked alike. An empty table gives an empty result.
    """
    rows = documents.select(id_text(), "text").mapInPandas(_row_hashes, _ROWS)
    owners = trie_owners(documents).select("size", "sha", F.col("points").alias("_points"), "keep_id", "n")
    return rows.join(owners, ["size", "sha"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("_points"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def op8_trie_dedup(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return mark_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[{SPACE}]', '', 'g')) AS text_sha256
  FROM documents),
owned AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM owned
"""
