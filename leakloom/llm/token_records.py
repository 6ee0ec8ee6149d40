"""Token ids as length-delimited binary records with a separate offset index.

File format, little-endian: each record is a frame of the payload's length (8
bytes), the masked CRC-32 of those 8 bytes, the payload, the masked CRC-32 of the
payload. A payload is doc_id (8 bytes, signed), a flag byte (bit 0: doc_id is
null; bit 1: ids take 4 bytes, otherwise 2) and the ids. Files hold consecutive
documents in ascending doc_id order and end near `file_bytes`.

Documents are range-partitioned by doc_id, so each task encodes and writes its own
stretch; nothing is gathered. Every attempt of a task writes files of new names,
and only the attempt that Spark accepts has its files in the index, so lost
executors leave no half-written file that anyone reads. The index, a table of
(file, offset, length, doc_id, n_tokens), allows reads of single records in any
order. Files are opened by pyarrow's file systems (file, hdfs, s3, gs), below the
shared folder.

Defined results: null texts are encoded as empty; every document ends with the end
id, so an empty one has one id; null doc_ids come first; documents that repeat a
doc_id all have records, in order of their texts' hashes; an empty table gives no
files and an empty index.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from leakloom.llm.common import before, kept, longs, on_workers, pairs_of, scratch, stored
from leakloom.llm.hashing import mix
from leakloom.session import work_dir

END_ID = 1
FILE_BYTES = 64_000_000
TABLE_WORDS = 150_000
#: Bytes of texts that are encoded together.
PIECE_BYTES = 2_000_000

_MASK = 0xA282EAD8
_LENGTH, _CRC, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qB")
_NULL_ID, _WIDE = 1, 2
_INDEX = "file string, part int, place int, offset long, length long, doc_id long, n_tokens long"
_RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> bytes:
    """CRC-32, rotated and shifted so that a checksum of data with checksums in it stays meaningful."""
    crc = zlib.crc32(data)
    return _CRC.pack(((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, masked_crc(length), payload, masked_crc(payload)))


def read_frame(stream) -> bytes | None:
    """Next payload; None at the end. Damaged or cut records raise."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != head[8:]:
        raise ValueError("damaged length of a record")
    size = _LENGTH.unpack(head[:8])[0]
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != body[size:]:
        raise ValueError("damaged record")
    return body[:size]


def serialise(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return b"".join((_HEAD.pack(doc_id or 0, (doc_id is None) * _NULL_ID + wide * _WIDE),
                     ids.astype("<u4" if wide else "<u2").tobytes()))


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size)
    return (None if flags & _NULL_ID else doc_id), ids.astype("<u4")


#: Kinds of bytes: ASCII letters (folded) and digits; other visible ASCII; white space.
_ALNUM, _SYMBOL, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_SYMBOL[33:127] = True
_SYMBOL[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
_SPACE[[0x20, *range(9, 14)]] = True
#: First byte of two-byte letters, but for these two second bytes (the signs of multiplication and division).
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)
#: The mark that a folded I does not take up, while I does.
_DOT_ABOVE = "\u0307".encode()
#: Bytes of a word that are compared as numbers, eight at a time; masks of fewer than eight.
_KEYS = 3
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, folded and end to end; where each word begins and ends in them; how many words end with each text.

    A word ends at white space, and between a letter or digit and a mark after it: tokens never reach across.
    """
    line = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    solid = ~_SPACE[line]
    after = _ALNUM[line[:-1]]
    after[1:] |= (line[:-2] == _LATIN) & (line[1:-1] != _SIGNS[0]) & (line[1:-1] != _SIGNS[1])
    parted = after & _SYMBOL[line[1:]]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | parted
    ends[:-1] &= ~solid[1:] | parted
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    stops = np.cumsum([len(t) + 1 for t in texts])
    return line, begins, ends, np.searchsorted(begins, stops)


def _different(line: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different words, and for each word the number of its first place.

    Words are compared as numbers; each of more than 8 * `_KEYS` bytes counts as different.
    """
    size, places = ends - begins, np.arange(len(begins))
    padded = np.concatenate((line, np.zeros(8 * _KEYS, np.uint8)))
    window = np.ndarray((len(line) + 8 * (_KEYS - 1) + 1,), "<u8", padded, strides=(1,))
    keys = [window[begins + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(_KEYS)]
    long = size > 8 * _KEYS
    keys[0][long] = places[long]
    name = size.astype(np.uint64)
    for key in keys:
        name = mix(name + key)
    number = pd.factorize(name)[0]
    first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
    first[number[::-1]] = places[::-1]
    own = first[number]
    for key in (*keys, size):
        if (key != key[own]).any():  # two words of one name: have all apart
            return places, places
    return first, number


class Encoder:
    """The tokenizers library, asked once per word where words are encoded independently.

    That holds if the pre-tokenizer drops white space, keeps runs of letters together
    and marks the ends of words. New words of letters then go to the library in one
    string and are told apart by those marks; what each gave is kept in two
    generations of `TABLE_WORDS` words, and different words are looked up once per piece
    of texts. A-Z is folded first, and marks are parted from the words before them, so
    that there are fewer different words; that needs a tokenizer that does both itself. Any other tokenizer gets whole texts, and so do
    texts that may hold special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        split = json.dumps(shape["pre_tokenizer"])
        suffix = shape["model"].get("end_of_word_suffix")
        self.by_word = (bool(suffix) and '"behavior": "Removed", "invert": true' in split and r"|[\\p{L}]+|" in split
                        and r"|[^\\s\\p{L}\\p{N}]+" in split and '"Lowercase"' in json.dumps(shape["normalizer"])
                        and all(t["content"].startswith("<|") and not any(t[k] for k in ("normalized", "lstrip", "rstrip", "single_word"))
                                for t in shape["added_tokens"]))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.many([(text or "").encode("utf-8", "surrogatepass")])[0].tobytes()

    def many(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        whole = {i for i, t in enumerate(texts) if t and (not self.by_word or b"<|" in t or _DOT_ABOVE in t)}
        line, begins, ends, stops = _words_of([b"" if t is None or i in whole else t for i, t in enumerate(texts)])
        first, number = _different(line, begins, ends)
        data = line.tobytes()
        words = [data[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist())]
        self._learn(set(words))
        found = list(map(self.young.__getitem__, words))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        held, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        # Each word's ids are copied from where they are held.
        own = size[number]
        through = np.concatenate(([0], np.cumsum(own)))
        ids = held[np.repeat(at[number] - through[:-1], own) + np.arange(through[-1])]
        split = through[stops].tolist()
        return [np.frombuffer(self._plain([texts[i].decode("utf-8", "surrogatepass")])[0], "<u4") if i in whole else ids[a:b]
                for i, (a, b) in enumerate(zip([0, *split], split))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        """Have all these words in the young generation."""
        if len(self.young) >= TABLE_WORDS:
            self.old, self.young = self.young, {}
        letters, other = [], []
        for word in words.difference(self.young):
            known = self.old.get(word)
            if known is not None:
                self.young[word] = known
            elif word.isalpha() or not word.isascii() and _latin(word):
                letters.append(word)
            else:
                other.append(word)
        if letters:
            # Letters alone are one piece each, and only its last token ends a word.
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.young.update(zip(letters, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        if other:
            self.young.update(zip(other, self._plain([w.decode("utf-8", "surrogatepass") for w in other])))


def _latin(word: bytes) -> bool:
    """Letters below U+0250 only, whatever their case."""
    text = word.decode("utf-8", "surrogatepass")
    return max(text) < "\u0250" and text.lower().isalpha()


def encoder(path: str) -> Encoder:
    """One encoder per worker process: later tasks find the words of earlier ones."""
    return kept(Encoder, path)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts (UTF-8) of rows, about `PIECE_BYTES` of texts at a time."""
    ids, texts, size = [], [], 0
    encoded = (pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary())], ["doc_id", "text"]) for b in batches)
    for own, text in pairs_of(encoded):
        ids.append(own)
        texts.append(text)
        size += len(text or b"")
        if size >= PIECE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _writer(root: str, tokenizer_path: str, end_id: int | None, file_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], "<u4")
        system, base = pyarrow.fs.FileSystem.from_uri(root)
        stream, place, offset, name, rows = None, -1, 0, "", []
        try:
            for held, texts in _pieces(batches):
                for own, tokens in zip(held, encode.many(texts)):
                    if stream is None:
                        place, offset = place + 1, 0
                        name = f"part-{part:06d}-{place:04d}-{uuid.uuid4().hex}.bin"
                        system.create_dir(base, recursive=True)
                        stream = system.open_output_stream(f"{base}/{name}")
                    ids = np.concatenate((tokens, end))
                    record = frame(serialise(own, ids))
                    stream.write(record)
                    rows.append((name, part, place, offset, len(record), own, len(ids)))
                    offset += len(record)
                    if offset >= file_bytes:
                        stream.close()
                        stream = None
                    if len(rows) >= 10_000:
                        yield _index_rows(rows)
                        rows = []
        finally:
            if stream is not None:
                stream.close()
        if rows:
            yield _index_rows(rows)
    return write


_INDEX_FIELDS = pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("offset", pa.int64()),
                           ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_FIELDS)], schema=_INDEX_FIELDS)


def write_records(documents: DataFrame, tokenizer_path: str, end_id: int | None = END_ID,
                  file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Encode and write all rows (doc_id, text); the files' folder and the stored index."""
    root = work_dir(documents.sparkSession, "token-records")
    scratch(documents.sparkSession).append(root)
    if "://" not in root:
        root = "file://" + root
    ordered = (documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    return root, stored(ordered.mapInArrow(_writer(root, tokenizer_path, end_id, file_bytes), _INDEX), "token-index")


def _record_rows(rows: list[tuple]) -> pd.DataFrame:
    frame_ = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    frame_["doc_id"] = longs(r[0] for r in rows)
    return frame_


def read_back(root: str, index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = index.groupBy("part", "place", "file").agg(F.sum("n_tokens").alias("_n"))
    # One row per file: a running total over them is small.
    files = files.select("file", before([], ["part", "place"], "_n").alias("start"))

    def read(batches):
        system, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, start in zip(batch["file"], batch["start"]):
                rows, start = [], int(start)
                with system.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = parse(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _record_rows(rows)
                            rows = []
                if rows:
                    yield _record_rows(rows)

    return files.repartition(max(1, index.select("file").distinct().count())).mapInPandas(read, _RECORD)


def read_at(root: str, index: DataFrame) -> DataFrame:
    """doc_id and ids of the records in some rows of the index, in whatever order these come."""
    def read(batches):
        system, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, own in batch.groupby("file", sort=False):
                with system.open_input_file(f"{base}/{name}") as file:
                    for offset, length in zip(own["offset"], own["length"]):
                        file.seek(int(offset))
                        doc_id, ids = parse(read_frame(file))
                        yield pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), "ids": [ids.astype(np.int64).tolist()]})

    return index.select("file", "offset", "length").mapInPandas(read, "doc_id long, ids array<long>")


def op5_token_records(spark, sf_dir: str) -> DataFrame:
    on_workers(spark)
    import public_tokenizers

    root, index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                                public_tokenizers.path("word_bpe_49k.json"))
    return read_back(root, index)
