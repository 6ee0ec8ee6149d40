"""Vectorised word and shingle hashes, for use inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Odd multipliers, one per word of a shingle, and the finaliser of `mix`.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F], dtype=np.uint64)
_FINAL = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)

#: Entries a word table may hold before it is emptied; results do not depend on it.
TABLE_ENTRIES = 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered until the table is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> _SHIFT)) * _FINAL
    x = (x ^ (x >> _SHIFT)) * _FINAL
    return x ^ (x >> _SHIFT)


def folded_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased (bytes.lower folds ASCII alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: Iterable[str | None], table: WordHashes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each text has.

    A shingle is `width` consecutive words; a text of fewer words, but not none,
    is one shingle. Texts without words have none.
    """
    words: list[bytes] = []
    lengths = []
    for text in texts:
        own = folded_words(text)
        words += own
        lengths.append(len(own))
    n = np.array(lengths, dtype=np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    hashes = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    del words
    total = len(hashes)
    summed = np.zeros(total, np.uint64)
    own = np.repeat(np.minimum(n, width), n)  # words in a shingle of this text
    left = np.repeat(ends, n) - np.arange(total)
    for place in range(width):
        part = hashes[place:] * _PLACES[place % len(_PLACES)] + np.uint64(place // len(_PLACES))
        summed[:total - place] += np.where(place < own[:total - place], part, np.uint64(0))
    keep = left >= own
    values = mix(summed + own.astype(np.uint64))[keep]
    counts = np.where(n > 0, n - np.minimum(n, width) + 1, 0)
    stops = np.cumsum(counts)
    for begin, stop in zip(stops - counts, stops):
        values[begin:stop].sort()
    if not len(values):
        return values, counts
    owner = np.repeat(np.arange(len(n)), counts)
    first = np.empty(len(values), bool)
    first[0] = True
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(n))


def batched(rows: Iterable[tuple], text_at: int, limit: int = 2_000_000) -> Iterable[list[tuple]]:
    """Rows in lists of about `limit` characters; one long text is a list of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text_at] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
