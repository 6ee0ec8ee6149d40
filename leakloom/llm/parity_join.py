"""Near duplicates by parity sketches and the pigeonhole principle.

A text's set holds its distinct five-word shingles as 64-bit hashes. Sets A and B
with a Jaccard similarity of 0.75 or more differ in at most D = (|A|+|B|)/7
shingles, and their sizes are within 4/3 of each other.

Sketches. A set's sketch XORs each shingle into one of many lanes, chosen by the
shingle's top bits. One differing shingle changes one lane, so the number of lanes
that differ is at most |A xor B| (lane-wise Hamming distance). The number of lanes
is that of a band of sizes (a power of two); a set near the lower end of its band
is sketched for the band below, too, so any two sets that may be similar have
sketches of one band.

Pigeonhole join. At most D lanes change, so any D+1 non-empty lanes of A, taken in
an order that both sets share, hold one that B has unchanged among its own first
D+1. These lanes are the join keys. The order puts lanes with frequent shingles
last, so passages that many texts share hardly ever become keys. Which shingles
are frequent is counted over all texts; the counts steer the order only, and the
result does not depend on them.

Verification. A second sketch of single parity bits gives a lower bound of the
symmetric difference that rejects most pairs; the rest are compared shingle by
shingle. A key without frequent shingles has few holders by construction, and
their pairs are listed. The holders of a frequent key are compared with one of
them; those that this leaves in different components are compared across
components, in blocks, by bit sketches: each outsider once with all holders of the keys
whose main component is the same. Of the pairs that pass, each outsider's closest few are
compared shingle by shingle; as long as some were left out, the same is done with more of
them for those that are still in different components. Thus the components are those of
all links, and finding a cluster of n near copies costs about n comparisons. Equal sets are one
class from the scan on; they are known by 128 bits, the second half of which is looked
at only where the first is not unique.

Counting. Each set's number of links is of all its links. Where holders of a frequent
key are in a component that is no clique of the links found so far, all pairs of the
component's sets are compared exactly, each pair once: in blocks, by products of 0/1
matrices over the shingles that a block shares. Only counts leave a block, no pairs.
This costs the square of a component's number of different sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leakloom.llm.common import counted, kept, on_workers, pairs_of, release, scratch, stored
from leakloom.llm.components import components
from leakloom.llm.hashing import WordHashes, batched, mix, shingle_sets

#: A shingle is frequent from this many sets on.
FREQUENT = 8
#: Bits of the filter of frequent shingles: a megabyte, whatever the input.
FILTER_BITS = 23
#: Holders of one key whose pairs are listed; more are treated like holders of a frequent key.
LISTED = 32
#: Sets of one block in comparisons across components, and bytes of their sketches.
BLOCK, BLOCK_BYTES = 2048, 8_000_000
#: Parts into which the holders of a key are dealt.
PARTS = 8
#: Candidates of an outsider that are compared in the first round, and how many times as many in each further one.
CLOSEST, MORE = 4, 8
#: When a component's links are counted: least sets of a block, blocks up to BLOCK sets each, shingles of a block.
COUNT_BLOCK, COUNT_BLOCKS, COUNT_SHINGLES = 64, 16, 400_000
#: Shingles held per task before they are sorted and sent on.
_HELD = 500_000
#: Characters of the texts that a task handles at once; a longer text is handled alone.
_CHARACTERS = 1_000_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_SEEN = 200_000


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(_U).view(np.int64))


def _owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as their differences, byte by byte: the high bytes are mostly zero, and files compress them."""
    return np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: bytes, n: int, offset: int = 0) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, 4 * n, offset).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


def set_marks(values: np.ndarray, counts: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit name of each set, and a second 64-bit hash of it; 0 for empty ones.

    A set whose name is among `apart` (sorted) is named by both hashes.
    """
    marks, checks = np.zeros(len(counts), _U), np.zeros(len(counts), _U)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        xored, mixed = np.bitwise_xor.reduceat(values, at), mix(values)
        marks[full] = mix(xored * _GOLDEN + np.add.reduceat(mixed, at) + counts[full].astype(_U))
        checks[full] = mix(np.add.reduceat(mix(mixed + _GOLDEN), at) ^ xored)
    if apart is not None and len(apart):
        same = np.isin(marks, apart)
        marks[same] = mix(marks[same] ^ mix(checks[same]))
    return marks, checks


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(sizes, 1))[1].astype(np.int64) - 1


def _lane_bits(band: np.ndarray) -> np.ndarray:
    """Small sets have a lane per shingle, others two to four lanes per shingle."""
    return np.where(band < 6, 63, band + 2)


def lane_keys(values: np.ndarray, counts: np.ndarray, bands: np.ndarray, need: np.ndarray,
              frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first `need` lanes of each set, their sets' places, and whether they hold frequent shingles."""
    owner = _owners(counts)
    lane = values >> (64 - _lane_bits(bands)).astype(_U)[owner]
    at = _starts(owner, lane)
    content, lane, owner = np.bitwise_xor.reduceat(values, at), lane[at], owner[at]
    busy = np.logical_or.reduceat(frequent, at)
    lanes = np.bincount(owner, minlength=len(counts))
    if (lanes < need).any():
        raise ValueError("shingle hashes collide: a set has too few lanes for its band")
    order = np.argsort(owner * 2 + busy, kind="stable")
    content, lane, owner, busy = content[order], lane[order], owner[order], busy[order]
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = rank < need[owner]
    content, lane, owner = content[first], lane[first], owner[first]
    return mix(content + lane * _GOLDEN + bands[owner].astype(_U)), owner, busy[first]


def all_keys(values: np.ndarray, counts: np.ndarray, frequent: np.ndarray):
    """Keys of non-empty sets in their own band and, where smaller partners may be there, in the band below."""
    band = band_of(counts)
    below = np.flatnonzero((band > 0) & (-(-3 * counts // 4) < (1 << band)))
    mine = lane_keys(values, counts, band, counts // 3 + 1, frequent)
    if not len(below):
        return mine
    chosen = np.zeros(len(counts), bool)
    chosen[below] = True
    chosen = np.repeat(chosen, counts)
    need = ((1 << band[below]) - 1 + counts[below]) // 7 + 1
    keys, owner, busy = lane_keys(values[chosen], counts[below], band[below] - 1, need, frequent[chosen])
    return np.concatenate((mine[0], keys)), np.concatenate((mine[1], below[owner])), np.concatenate((mine[2], busy))


def bit_sketches(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Parity bits of each set: 2^(band+3) of them, 64 at least."""
    bits = np.maximum(band_of(counts) + 3, 6)
    sizes = 1 << bits
    begin = np.cumsum(sizes) - sizes
    owner = _owners(counts)
    place = begin[owner] + (values >> (64 - bits).astype(_U)[owner]).astype(np.int64)
    at = _starts(place)
    odd = np.diff(np.append(at, len(place))) % 2 == 1
    flat = np.zeros(int(sizes.sum()), np.uint8)
    flat[place[at[odd]]] = 1
    packed = np.packbits(flat)
    return [packed[b // 8:(b + s) // 8].tobytes() for b, s in zip(begin, sizes)]


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of packed bits, folded to `size` bytes: neighbouring bits are XORed until they fit."""
    while sketch.shape[1] > size:
        bits = np.unpackbits(sketch, axis=1)
        sketch = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)
    return sketch


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bounds of the symmetric differences of sets with these sketches (rows of bytes)."""
    size = min(a.shape[1], b.shape[1])
    return np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(axis=1)


def may_link(n_a, n_b, difference):
    """Sizes and (a lower bound of) the symmetric difference allow 100 * both >= 75 * either."""
    return 7 * difference <= n_a + n_b


class _Classes:
    """Shingle sets of a task's texts; a set counts as new where the task has not met it lately."""

    def __init__(self, apart: np.ndarray | None = None):
        self.table, self.seen, self.apart = kept(WordHashes), set(), apart

    def __call__(self, batches: Iterable[pa.RecordBatch]):
        """Per batch of texts: ids, sizes, marks and checks of all, then values and sizes and marks of the new sets."""
        for held in batched(pairs_of(batches), 1, _CHARACTERS):
            values, counts = shingle_sets((text for _, text in held), self.table)
            marks, checks = set_marks(values, counts, self.apart)
            if len(self.seen) > _SEEN:
                self.seen.clear()
            new = np.zeros(len(counts), bool)
            for i, mark in enumerate(marks.tolist()):
                if counts[i] and mark not in self.seen:
                    self.seen.add(mark)
                    new[i] = True
            yield [i for i, _ in held], counts, marks, checks, values[np.repeat(new, counts)], counts[new], marks[new]


# --- frequent shingles -------------------------------------------------------------------

def _shingle_blobs(bits: int):
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        bucket = (values >> _U(64 - bits)).astype(np.int64)
        rest = (values >> _U(32 - bits)).astype(np.uint32)
        at = np.append(_starts(bucket), len(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([_planes(rest[i:j]) for i, j in zip(at, at[1:])], pa.binary())],
            ["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for *_, values, _, _ in _Classes()(batches):
            held.append(values)
            size += len(values)
            if size >= _HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)
    return run


def _frequent_bits(bits: int, frequent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rest = np.sort(np.concatenate([_of_planes(b, len(b) // 4) for b in frame["blob"]]))
        at = _starts(rest)
        n = np.diff(np.append(at, len(rest)))
        often = n >= frequent
        slots = 1 << (FILTER_BITS - bits)
        if often.sum() > slots // 4:  # a fuller filter would call everything frequent: keep the most frequent
            often &= n >= np.partition(n[often], -(slots // 4))[-(slots // 4)]
        filled = np.zeros(slots, np.uint8)
        filled[rest[at[often]] >> np.uint32(32 - (FILTER_BITS - bits))] = 1
        return pd.DataFrame({"bucket": frame["bucket"].iloc[:1].to_numpy(), "filled": [np.packbits(filled).tobytes()]})
    return run


def frequent_filter(texts: DataFrame, bits: int, frequent: int) -> np.ndarray:
    """Packed bits over the top bits of shingles, set where a frequent one falls: `FILTER_BITS` decides the size."""
    rows = (texts.mapInArrow(_shingle_blobs(bits), "bucket int, blob binary").groupBy("bucket")
            .applyInPandas(_frequent_bits(bits, frequent), "bucket int, filled binary").collect())
    width = (1 << FILTER_BITS - bits) // 8
    filled = np.zeros((1 << bits, width), np.uint8)
    for row in rows:
        filled[row["bucket"]] = np.frombuffer(bytes(row["filled"]), np.uint8)
    return filled.reshape(-1)


def is_frequent(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    place = (values >> _U(64 - FILTER_BITS)).astype(np.int64)
    return (filled[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


# --- keys ----------------------------------------------------------------------------------

_SCAN = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary()), ("key", pa.int64()),
                   ("mark", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("sketch", pa.binary())])
_SCAN_DDL = "kind string, bucket int, blob binary, key long, mark long, check long, n long, doc_id long, sketch binary"


def _scan_rows(kind: str, rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * rows) if f.name == "kind" else columns.get(f.name, None) for f in _SCAN]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, f.type) if a is None else a for a, f in zip(arrays, _SCAN)], schema=_SCAN)


def _key_rows(bits: int, filled, apart: np.ndarray):
    """Rows of four kinds: texts, sets with bit sketches, keys of frequent lanes, and packed other keys by bucket."""
    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, _ in held])
        marks = np.concatenate([m for _, m in held])
        order = np.argsort(keys, kind="stable")
        keys, marks = keys[order], marks[order]
        bucket = (keys >> _U(64 - bits)).astype(np.int64)
        rest = (keys >> _U(32 - bits)).astype(np.uint32)
        at = np.append(_starts(bucket), len(keys))
        blobs = []
        for i, j in zip(at, at[1:]):
            own, place = np.unique(marks[i:j], return_inverse=True)
            # Marks that mostly differ are sent as they are, others once with their places.
            sent = (marks[i:j],) if 2 * len(own) > j - i else (place.astype(np.uint32), own)
            head = np.array([j - i, len(own) if len(sent) > 1 else 0], np.uint32)
            blobs.append(b"".join((head.tobytes(), _planes(rest[i:j]), *(part.tobytes() for part in sent))))
        yield _scan_rows("packed", len(blobs), bucket=pa.array(bucket[at[:-1]].astype(np.int32)), blob=pa.array(blobs, pa.binary()))

    def run(batches):
        held, size = [], 0
        for ids, counts, marks, checks, values, new, own in _Classes(apart)(batches):
            yield _scan_rows("text", len(ids), doc_id=pa.array(ids, pa.int64()), n=pa.array(counts.astype(np.int64)),
                             mark=_signed(marks), check=_signed(checks))
            if not len(new):
                continue
            yield _scan_rows("set", len(new), mark=_signed(own), n=pa.array(new.astype(np.int64)),
                             sketch=pa.array(bit_sketches(values, new), pa.binary()))
            keys, owner, busy = all_keys(values, new, is_frequent(values, filled.value))
            if busy.any():
                yield _scan_rows("frequent", int(busy.sum()), key=_signed(keys[busy]), mark=_signed(own[owner[busy]]))
            held.append((keys[~busy], own[owner[~busy]]))
            size += len(held[-1][0])
            if size >= _HELD:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)
    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, own = np.frombuffer(blob, np.uint32, 2).tolist()
    rest = _of_planes(blob, n, 8)
    if not own:
        return rest, np.frombuffer(blob, _U, n, offset=8 + 4 * n)
    return rest, np.frombuffer(blob, _U, own, offset=8 + 8 * n)[np.frombuffer(blob, np.uint32, n, offset=8 + 4 * n)]


def _bucket_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of holders of a key; for a key of many holders, rows (key, holder) with `many` set."""
    parts = [_unpacked(b) for b in frame["blob"]]
    keys, marks = np.concatenate([k for k, _ in parts]), np.concatenate([m for _, m in parts])
    order = np.lexsort((marks, keys))
    keys, marks = keys[order], marks[order]
    once = _starts(keys, marks)
    keys, marks = keys[once], marks[once].view(np.int64)
    at = _starts(keys)
    size = np.repeat(np.diff(np.append(at, len(keys))), np.diff(np.append(at, len(keys))))
    many = size > LISTED
    name = keys[many].astype(np.int64) + (np.int64(frame["bucket"].iloc[0]) << 32)
    found = [np.stack((name, marks[many]))]
    keys, marks = keys[(size > 1) & ~many], marks[(size > 1) & ~many]
    pairs = []
    for gap in range(1, LISTED):
        same = np.flatnonzero(keys[gap:] == keys[:-gap])
        if not len(same):
            break
        pairs.append(np.stack((marks[same], marks[same + gap])))
    n_many = found[0].shape[1]
    if pairs:
        both = np.concatenate(pairs, axis=1)
        found.append(np.unique(np.stack((both.min(axis=0), both.max(axis=0))), axis=1))
    rows = np.concatenate(found, axis=1)
    return pd.DataFrame({"a": rows[0], "b": rows[1], "many": np.arange(rows.shape[1]) < n_many})


# --- verification --------------------------------------------------------------------------

def _bytes_matrix(column: Iterable[bytes]) -> np.ndarray:
    column = list(column)
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _passing(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sizes and bit sketches allow a link."""
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for _, own in batch.groupby([batch["sa"].str.len(), batch["sb"].str.len()], sort=False).indices.items():
            part = batch.iloc[own]
            bound = least_difference(_bytes_matrix(part["sa"]), _bytes_matrix(part["sb"]))
            n_a, n_b = part["na"].to_numpy(), part["nb"].to_numpy()
            keep[own] = may_link(n_a, n_b, np.maximum(bound, np.abs(n_a - n_b)))
        yield batch.loc[keep, ["a", "b"]]


def _set_contents(apart: np.ndarray):
    """(mark, shingles) of the texts (mark, text) whose set has that mark."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(WordHashes)
        for held in batched(pairs_of(batches), 1, _CHARACTERS):
            values, counts = shingle_sets((text for _, text in held), table)
            marks = set_marks(values, counts, apart)[0].view(np.int64)
            ends = np.cumsum(counts)
            own = [(m, values[e - n:e].tobytes()) for (wanted, _), m, e, n in zip(held, marks.tolist(), ends, counts) if m == wanted]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in own], pa.int64()), pa.array([v for _, v in own], pa.binary())],
                                             ["mark", "shingles"])
    return run


def _linked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for a, b in zip(batch["va"], batch["vb"]):
            a, b = np.frombuffer(a, _U), np.frombuffer(b, _U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


class _Verifier:
    def __init__(self, texts: DataFrame, holders: DataFrame, sketches: DataFrame, apart: np.ndarray):
        self.texts, self.holders, self.sketches, self.apart = texts, holders, sketches, apart
        self.contents: list[DataFrame] = []

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Stored pairs, of distinct candidate pairs (a, b), whose sketches allow a link; other sets' sketches are not shuffled."""
        pairs = stored(pairs, "parity-listed")
        own = stored(pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct(), "parity-marks")
        own = stored(self.sketches.join(counted(own), "mark"), "parity-own")
        side = lambda x: own.select(F.col("mark").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_passing, "a long, b long"), "parity-pairs")

    def __call__(self, passing: DataFrame) -> DataFrame:
        """Stored links (a, b) among distinct stored pairs (a, b) whose sketches allow one."""
        wanted = passing.select(F.col("a").alias("mark")).union(passing.select("b")).distinct()
        wanted = stored(wanted.join(self.holders, "mark"), "parity-wanted")
        texts = self.texts.alias("t").join(counted(wanted).alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")))
        contents = stored(texts.select("w.mark", "t.text").mapInArrow(_set_contents(self.apart), "mark long, shingles binary")
                          .dropDuplicates(["mark"]), "parity-contents")
        self.contents.append(contents)
        both = (passing.join(contents.select(F.col("mark").alias("a"), F.col("shingles").alias("va")), "a")
                .join(contents.select(F.col("mark").alias("b"), F.col("shingles").alias("vb")), "b"))
        return stored(both.mapInPandas(_linked, "a long, b long"), "parity-links")

    def contents_of(self, marks: DataFrame) -> DataFrame:
        """`marks` (mark, ...) with the shingles of those sets that were ever verified: all that have a link."""
        return marks.join(reduce(DataFrame.unionByName, self.contents).dropDuplicates(["mark"]), "mark")


# --- holders of frequent keys ----------------------------------------------------------------

def _key_groups(frequent: DataFrame) -> DataFrame:
    """Stored (key, mark, hub, size): one key for each different set of holders; the hub is one of them."""
    sizes = frequent.groupBy("key").agg(
        F.count("*").alias("size"), F.min("mark").alias("hub"),
        F.bit_xor(F.xxhash64("mark")).alias("_x"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("_y")).where("size > 1")
    chosen = sizes.groupBy("size", "hub", "_x", "_y").agg(F.min("key").alias("key")).select("key", "hub", "size")
    # A key that very many sets hold is dealt to several tasks: each of its rows is found in one part of them.
    part = F.pmod(F.xxhash64("mark", F.lit(2)), F.lit(PARTS)).cast("int")
    parts = chosen.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    return stored(frequent.withColumn("_part", part).join(parts, ["key", "_part"]).drop("_part"), "parity-groups")


_COLUMNS = ("main", "i", "j", "minor", "mark", "comp", "n", "sketch")
#: Bytes of sketches that one step of a block's comparison holds.
_STEP_BYTES = 4_000_000


def _closest(found: np.ndarray, most: int) -> np.ndarray:
    """Of the columns (a, b, bound, more), the `most` of least bound of each a; `more` is set where others were left out."""
    found = found[:, np.lexsort((found[1], found[2], found[0]))]
    at = _starts(found[0])
    n = np.diff(np.append(at, found.shape[1]))
    found[3] |= np.repeat(n > most, n)
    return found[:, np.arange(found.shape[1]) - np.repeat(at, n) < most]


def _block_pairs(minor, mark, comp, n, sketch, most: int) -> np.ndarray:
    """A block's minor rows a with the closest `most` others b of different components that may link: rows (a, b, bound, more)."""
    length = np.array([len(s) for s in sketch])
    found = [np.empty((4, 0), np.int64)]
    for size_a in np.unique(length[minor]):
        mine = np.flatnonzero(minor & (length == size_a))
        for size_b in np.unique(length[~minor]):
            if not size_a <= 4 * size_b <= 16 * size_a:
                continue
            other = np.flatnonzero(~minor & (length == size_b))
            size = min(size_a, size_b)
            x, y = (folded(_bytes_matrix(sketch[own]), size).view(_U) for own in (mine, other))
            step = max(1, _STEP_BYTES // y.nbytes)
            for at in range(0, len(mine), step):
                own = mine[at:at + step]
                bound = np.bitwise_count(x[at:at + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                bound = np.maximum(bound, np.abs(n[own][:, None] - n[other][None]))
                fits = may_link(n[own][:, None], n[other][None], bound) & (comp[own][:, None] != comp[other][None])
                rows, columns = np.nonzero(fits)
                found.append(_closest(np.stack((mark[own[rows]], mark[other[columns]], bound[rows, columns], np.zeros(len(rows), np.int64))), most))
    return _closest(np.concatenate(found, axis=1), most)


def _cross(most: int):
    """Candidates of minor rows within blocks, from rows sorted by block."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            columns = [batch[c].to_numpy() for c in _COLUMNS]
            if rest is not None:
                columns = [np.concatenate(c) for c in zip(rest, columns)]
            at = _starts(*columns[:3])
            for b, e in zip(at, at[1:]):
                yield _candidate_rows(_block_pairs(*[c[b:e] for c in columns[3:]], most))
            rest = [c[at[-1]:] for c in columns] if len(at) else None
        if rest is not None:
            yield _candidate_rows(_block_pairs(*rest[3:], most))
    return run


def _candidate_rows(found: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": found[0], "b": found[1], "bound": found[2], "more": found[3] > 0})


def _cross_pairs(groups: DataFrame, comps: DataFrame, sketches: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Candidate pairs of holders that are in different components, the closest `most` of each outsider; whether it has more.

    Keys whose holders mostly belong to one component are taken together: near copies
    share hundreds of keys, and one comparison of each outsider with the holders does
    for all of them.
    """
    rows = (groups.where("size > 2").join(comps, F.col("mark") == F.col("node"), "left")
            .select("key", "mark", F.coalesce("root", "mark").alias("comp")))
    rows = stored(rows, "parity-holders")
    open_keys = (rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
                 .groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"),
                                     F.sum("n").alias("size")).where("size > most").select("key", "main"))
    rows = rows.join(counted(stored(open_keys, "parity-open-keys")), "key").select("main", "mark", "comp").distinct()
    rows = counted(stored(rows, "parity-open-rows"))  # few as a rule: then the other sets' sketches are not shuffled
    rows = stored(rows.join(sketches, "mark").withColumn("minor", F.col("comp") != F.col("main")), "parity-outsiders")

    def blocks(of, n):  # of the rows that `of` selects
        return F.greatest(F.ceil(F.sum(of) / BLOCK), F.ceil(F.sum(of * n) / BLOCK_BYTES)).cast("int")

    length, minor = F.length("sketch"), F.col("minor").cast("int")
    sizes = rows.groupBy("main").agg(blocks(F.lit(1), length).alias("nb"), blocks(minor, length).alias("nm"))
    rows = rows.join(counted(stored(sizes, "parity-blocks")), "main")
    row_block = F.pmod(F.xxhash64("mark"), F.col("nb")).cast("int")
    minor_block = F.pmod(F.xxhash64("mark", F.lit(1)), F.col("nm")).cast("int")
    columns = list(_COLUMNS)
    all_rows = (rows.withColumn("i", row_block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
                .withColumn("minor", F.lit(False)).select(*columns))
    minors = (rows.where("minor").withColumn("j", minor_block)
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*columns))
    found = (all_rows.unionByName(minors).repartition("main", "i", "j").sortWithinPartitions("main", "i", "j")
             .mapInPandas(_cross(most), "a long, b long, bound long, more boolean"))
    # An outsider has up to `most` candidates in each of its blocks: the closest of them all are kept.
    rank = F.row_number().over(Window.partitionBy("a").orderBy("bound", "b"))
    found = found.groupBy("a", "b", "bound").agg(F.max("more").alias("more")).withColumn("rank", rank)
    found = stored(found.where(F.col("rank") <= most + 1), "parity-candidates")
    left_out = not found.where(F.col("more") | (F.col("rank") > most)).isEmpty()
    pairs = found.where(F.col("rank") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(pairs.distinct(), "parity-closest"), left_out


# --- numbers of links ------------------------------------------------------------------------

#: Shingles whose columns of a block's matrix are held at once.
_STEP_COLUMNS = 4096


def _common(owner: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, sets: int) -> np.ndarray:
    """Numbers of shingles that each of the sets `a` shares with each of `b`; set `owner[k]` holds `values[k]`."""
    _, column, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = n > 1
    kept = shared[column]
    owner, column = owner[kept], (np.cumsum(shared) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, int(shared.sum()), _STEP_COLUMNS):
        begin, end = np.searchsorted(column, (first, first + _STEP_COLUMNS))
        held = np.zeros((sets, int(column[end - 1]) - first + 1), np.float32)
        held[owner[begin:end], column[begin:end] - first] = 1
        both += (held[a] @ held[b].T).astype(np.int64)
    return both


def _block_links(second, mark, shingles) -> pd.DataFrame:
    """Numbers of links of a block's sets: of the first with the second ones, or among all if there are no second ones."""
    n = np.array([len(s) // 8 for s in shingles])
    values = np.frombuffer(b"".join(shingles), _U)
    alone = not second.any()
    a = np.flatnonzero(~second)
    b = a if alone else np.flatnonzero(second)
    both = _common(_owners(n), values, a, b, len(n))
    linked = 100 * both >= 75 * (n[a][:, None] + n[b][None] - both)
    if alone:
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"mark": mark[a], "links": linked.sum(axis=1)})
    return pd.DataFrame({"mark": np.concatenate((mark[a], mark[b])),
                         "links": np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))})


_COUNTED = ("root", "i", "j", "second", "mark", "shingles")


def _count_links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (mark, links) of pairs of blocks, from rows sorted by them."""
    rest = None
    for batch in batches:
        columns = [batch[c].to_numpy() for c in _COUNTED]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        at = _starts(*columns[:3])
        for b, e in zip(at, at[1:]):
            yield _block_links(*[c[b:e] for c in columns[3:]])
        rest = [c[at[-1]:] for c in columns] if len(at) else None
    if rest is not None:
        yield _block_links(*rest[3:])


def _all_degrees(links: DataFrame, comps: DataFrame, groups: DataFrame, sketches: DataFrame, verify: _Verifier) -> DataFrame:
    """Stored (mark, links): the number of sets that each set with a link is linked with."""
    known = stored(links.select(F.col("a").alias("mark")).unionAll(links.select("b"))
                   .groupBy("mark").agg(F.count("*").alias("links")), "parity-known")
    sets = comps.select(F.col("node").alias("mark"), "root")
    hubbed = groups.where("size > 2").select("mark").distinct()
    partial = (sets.join(known, "mark").join(sketches.select("mark", "n"), "mark")
               .join(hubbed.withColumn("hubbed", F.lit(True)), "mark", "left")
               .groupBy("root").agg(F.count("*").alias("size"), F.sum("links").alias("links"), F.sum("n").alias("shingles"),
                                    F.max("hubbed").alias("hubbed"))
               .where("hubbed AND links < size * (size - 1)")
               .select("root", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / COUNT_SHINGLES),
                                          F.least(F.ceil(F.col("size") / COUNT_BLOCK), F.lit(COUNT_BLOCKS))).cast("int").alias("nb")))
    open_sets = stored(sets.join(partial, "root"), "parity-open")
    own, other = F.pmod(F.xxhash64("mark"), F.col("nb")).cast("int"), F.col("other")
    rows = (verify.contents_of(open_sets).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("root", F.least("own", other).alias("i"), F.greatest("own", other).alias("j"),
                    (F.col("own") > other).alias("second"), "mark", "shingles"))
    counted_links = (rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
                     .mapInPandas(_count_links, "mark long, links long").groupBy("mark").agg(F.sum("links").alias("links")))
    return stored(known.join(open_sets, "mark", "left_anti").unionByName(counted_links), "parity-degrees")


def parity_join(documents: DataFrame, frequent: int = FREQUENT, count_links: bool = True) -> DataFrame:
    """Per row of `documents` (doc_id, text): doc_id, n_shingles, component_id, links (of its class to other classes).

    links is the number of other sets with a similarity of 0.75 or more, all of them
    counted; without `count_links` the column is left out.
    component_id is the smallest doc_id reachable by links; rows without words
    link with nothing. Defined results: null texts count as empty; null ids are
    passed over in the smallest id, and stay null where a component has no other;
    rows of one set are linked, whether repeated or not; an empty table gives no rows.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(18, max(8, (4 * partitions - 1).bit_length()))
    filled = spark.sparkContext.broadcast(frequent_filter(texts, bits, frequent))
    apart = np.empty(0, _U)
    for _ in range(3):
        scan = stored(texts.mapInArrow(_key_rows(bits, filled, apart), _SCAN_DDL), "parity-scan")
        rows = scan.where("kind = 'text'").select("doc_id", "n", "mark", "check")
        holders = stored(rows.where("n > 0").groupBy("mark").agg(
            F.min("doc_id").alias("doc_id"), (F.min("check") != F.max("check")).alias("several")), "parity-names")
        # Different sets of one name: some three among 10^10, so another scan tells them apart.
        shared = [r["mark"] for r in holders.where("several").select("mark").collect()]
        if not shared:
            break
        apart = np.union1d(apart, np.array(shared, np.int64).view(_U))
    rows, holders = stored(rows.drop("check"), "parity-rows"), holders.drop("several")
    sketches = stored(scan.where("kind = 'set'").select("mark", "n", "sketch").dropDuplicates(["mark"]), "parity-sketches")
    listed = stored(scan.where("kind = 'packed'").select("bucket", "blob").groupBy("bucket")
                    .applyInPandas(_bucket_pairs, "a long, b long, many boolean"), "parity-keys")
    groups = _key_groups(scan.where("kind = 'frequent'").select("key", "mark")
                         .unionByName(listed.where("many").select(F.col("a").alias("key"), F.col("b").alias("mark"))).distinct())
    release(spark, [p for p in scratch(spark) if "/parity-scan-" in p])  # all that is read of it is stored by now

    verify = _Verifier(texts, holders, sketches, apart)
    hubs = groups.where("mark != hub").select(F.col("hub").alias("a"), F.col("mark").alias("b"))
    links = verify(verify.passing(listed.where("NOT many").select("a", "b").unionByName(hubs).distinct()))
    comps, most, left_out = components(links), CLOSEST, True
    while left_out:
        pairs, left_out = _cross_pairs(groups, comps, sketches, most)
        links = links.unionByName(verify(pairs))  # of sets in different components: none is known so far
        comps, most = components(links), most * MORE
    named = rows.join(comps.withColumnRenamed("node", "mark"), "mark", "left")
    if count_links:
        named = named.join(_all_degrees(links, comps, groups, sketches, verify), "mark", "left")
    named = (named.withColumn("_root", F.when(F.col("n") > 0, F.coalesce("root", "mark"))))
    least = named.where("n > 0").groupBy("_root").agg(F.min("doc_id").alias("_least"))
    counts = [F.coalesce("links", F.lit(0)).cast("long").alias("links")] if count_links else []
    return (named.join(least, "_root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"), *counts))


def op3_parity_join(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return parity_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), count_links=False)
