"""Packing along a space-filling curve.

A document's token ids give a hashed vector: every id has fixed pseudo-random coordinates, their mean
projects the document to three dimensions. The Hilbert key of that point orders the documents; after a
range sort by the key (ties by a hash of the id, so that a hot group of copies spreads over partitions)
each partition fills sequences one after the other with its neighbouring documents.

Every sequence holds exactly ``length`` ids. What is left at a partition's end is cut into sequences whose
lengths are powers of two, which need no padding, so no padding is written at all.

Defined results: a null or empty text has the end-of-document id only. Rows with the same or a null doc_id
are packed as rows of their own. An empty table gives no piece. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, mix64, released, text_slices
from .shingles import powers

DIMS, KEY_BITS = 3, 16
#: Distinct pieces of text that a worker remembers before it starts afresh (a table of four times as many slots).
CACHE_PIECES = 700_000


def hilbert_keys(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims), each coordinate below 2**bits; dims * bits <= 62."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's rotations, coarse to fine
        low = (1 << level) - 1
        for d in range(dims):
            turned = ((x[d] >> level) & 1) == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


class PieceTable:
    """Hash of a piece -> its ids, for whole arrays at a time: open addressing with linear probes."""

    def __init__(self, dtype: np.dtype, limit: int = CACHE_PIECES):
        self.limit, self.dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self.mask = (1 << int(4 * self.limit - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0: free
        self.spot = np.zeros(self.mask + 1, np.int32)
        self.start, self.size, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.used = np.zeros(4096, self.dtype), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash (never 0), or -1."""
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes & np.uint64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        hit = held == hashes
        out[hit] = self.spot[slot[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.spot[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New entries for distinct unknown hashes."""
        n = len(hashes)
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum()))
        while self.count + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        entry = np.arange(self.count, self.count + n)
        self.start[entry], self.size[entry] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.count, self.used = self.count + n, self.used + len(flat)
        slot, left = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(n)
        while len(left):
            free = self.keys[slot[left]] == 0
            first = np.unique(slot[left[free]], return_index=True)[1]  # one newcomer a slot
            placed = left[free][first]
            self.keys[slot[placed]], self.spot[slot[placed]] = hashes[placed], entry[placed]
            left = left[~np.isin(left, placed, assume_unique=True)]
            slot[left] = (slot[left] + 1) & self.mask

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the entries in order, and how many each has."""
        size = self.size[entries]
        ends = np.cumsum(size)
        at = np.repeat(self.start[entries] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], size


SPACE, LETTER, DIGIT, OTHER, UNSURE = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """How the vocabulary's split sees lower-cased code points. UNSURE: number, space or form that is not plain here."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c in " \t\n\r\x0b\f":
            out[i] = SPACE
        elif c.isalpha():
            out[i] = LETTER
        elif c.isalnum() or c.isspace():
            out[i] = DIGIT if c.isascii() and c.isdigit() else OTHER if c.isascii() else UNSURE
    out[[ord("İ"), ord("Σ")]] = UNSURE  # their lower case depends on more than themselves
    return out


#: Characters of a text that are split and looked up at a time.
WINDOW = 1 << 20
#: Where a text may be cut, as no piece goes across: at ASCII white space, and between a letter and a common mark of punctuation. (The lower case of a
#: capital I with a dot ends in a sign.)
BREAK = re.compile(r"[ \t\n\r\x0b\f]|(?<=[^\W\d_\u0130])[.,!?;:。，、！？；：]")


def windows(text: str):
    """Stretches of about ``WINDOW`` characters that begin at a ``BREAK`` (or hold one run without any that is longer)."""
    start = 0
    while start < len(text):
        found = BREAK.search(text, start + WINDOW)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


class WordTokenizer:
    """Ids as little-endian integers of ``dtype``. Texts that the library's normaliser would only lower-case
    are split here, for many texts at once, and each distinct piece goes to the library once; other texts
    go to it whole. Pieces are told apart by 64-bit hashes of their code points."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.table = PieceTable(self.dtype)
        numbers = mix64(np.arange(self.size * DIMS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.coordinates = np.ascontiguousarray(((numbers >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(self.size, DIMS).T)

    def plain(self, text: str) -> bool:
        """Whether lower-casing is all that the normaliser does and the split here is the vocabulary's: no special
        token, no composed form, no final sigma or dotted capital I, no numbers or spaces beyond ASCII."""
        if any(s in text for s in self.special):
            return False
        if text.isascii():
            return True
        if not unicodedata.is_normalized("NFC", text):
            return False
        return not (_kinds()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNSURE).any()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Long ones are cut where no piece goes across, so memory is bounded by a window."""
        if all(len(t) <= WINDOW for t in texts):
            return self._encode(texts)
        out = []
        for t in texts:
            parts = [self._encode([w])[0] for w in windows(t)]
            out.append(np.concatenate(parts) if parts else np.zeros(0, self.dtype))
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        mine = []
        for k, t in enumerate(texts):
            if self.plain(t):
                mine.append(k)
            else:
                out[k] = np.array(self.lib.encode(t, add_special_tokens=False).ids, self.dtype)
        if mine:
            for k, ids in zip(mine, self._split_and_look_up([texts[k].lower() for k in mine])):
                out[k] = ids
        return out

    def _split_and_look_up(self, low: list[str]) -> list[np.ndarray]:
        joined = "\n".join(low) + "\n\n\n"
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _kinds()[c]
        solid = kind != SPACE
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        self._contract(c, kind, start)
        first = np.flatnonzero(start)
        last = solid.copy()
        last[:-1] &= ~solid[1:] | start[1:]
        end = np.flatnonzero(last) + 1
        up, down = powers(1 << max(16, int(len(c) - 1).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)])
        hashes = mix64((total[end] - total[first]) * down[first]) | np.uint64(1)
        entries = self._entries(joined, hashes, first, end)
        ids, sizes = self.table.ids_of(entries)
        lengths = np.array([len(t) + 1 for t in low], np.int64)
        pieces = np.searchsorted(first, np.cumsum(lengths))
        ends = np.concatenate([[0], np.cumsum(sizes)])[pieces]
        return np.split(ids, ends[:-1])

    @staticmethod
    def _contract(c: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a run of signs takes s, t, m, d, re, ve or ll from the letters behind it."""
        at = np.flatnonzero(start[:-3] & (c[:-3] == ord("'")) & (kind[1:-2] == LETTER))
        if not len(at):
            return
        one, two = c[at + 1], c[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 2, np.where(long, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        behind = at + size
        start[behind] = kind[behind] != SPACE

    def _entries(self, joined: str, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        entries = self.table.find(hashes)
        unknown = np.flatnonzero(entries < 0)
        if len(unknown):
            fresh, where = np.unique(hashes[unknown], return_index=True)
            if self.table.count + len(fresh) > self.table.limit and self.table.count:
                self.table.clear()
                return self._entries(joined, hashes, first, end)
            pieces = [joined[a:b] for a, b in zip(first[unknown[where]].tolist(), end[unknown[where]].tolist())]
            found = [e.ids for i in range(0, len(pieces), 4096) for e in self.lib.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
            self.table.add(fresh, found)
            entries[unknown] = self.table.find(hashes[unknown])
        return entries


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> WordTokenizer:
    return WordTokenizer(spec)


def _vectors(coder: WordTokenizer, ids: list[bytes]) -> np.ndarray:
    """Mean coordinates of each document's ids; every entry has one id at least."""
    sizes = np.array([len(x) for x in ids], np.int64) // coder.dtype.itemsize
    flat = np.frombuffer(b"".join(ids), coder.dtype)
    out = np.empty((len(ids), DIMS), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in range(DIMS):
        out[:, d] = np.add.reduceat(coder.coordinates[d][flat], starts, dtype=np.float64) / sizes
    return out


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _flush(pieces: list, sizes: list[int], base: int, number: int, out: list) -> int:
    """Cut the open pieces into sequences of the given sizes; append rows to ``out``; next number."""
    room, offset, at = list(sizes), 0, 0
    for doc, start, ids, doc_tokens in pieces:
        used = 0
        while used < len(ids):
            take = min(len(ids) - used, room[at] - offset)
            part = ids[used : used + take]
            out.append((doc, start + used, take, zlib.crc32(part.astype("<u4").tobytes()), doc_tokens, base + number + at, offset))
            used, offset = used + take, offset + take
            if offset == room[at]:
                at, offset = at + 1, 0
    return number + at


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_file: str, length: int = 2048, end_id: int = 1, text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    id_field = docs.schema["doc_id"]
    id_type = id_field.dataType.simpleString()

    def tokenise(batches):
        coder = _tokenizer(shared.value)
        end = np.array([end_id], coder.dtype)
        for batch in batches:
            for part in text_slices(batch):
                ids = [np.append(x, end).tobytes() for x in coder.encode([t or "" for t in part.column("text").to_pylist()])]
                scaled = np.clip((_vectors(coder, ids) + 1) / 2 * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hilbert_keys(scaled)), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    def pack(batches):
        coder = _tokenizer(shared.value)
        base, number, pieces, fill, out = TaskContext.get().partitionId() << 36, 0, [], 0, []
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids, start = np.frombuffer(raw.as_buffer(), coder.dtype), 0
                while start < len(ids):
                    take = min(len(ids) - start, length - fill)
                    pieces.append((doc, start, ids[start : start + take], len(ids)))
                    start, fill = start + take, fill + take
                    if fill == length:
                        number, pieces, fill = _flush(pieces, [length], base, number, out), [], 0
            if len(out) >= 10_000:
                yield _rows(out, batch.column("doc_id").type)
                out = []
        if pieces:
            _flush(pieces, _powers(fill), base, number, out)
        if out:
            yield _rows(out, batch.column("doc_id").type)

    work = Workspace(spark, "packing")
    # The range sort samples its input, so the ids are written once and not computed twice.
    found = docs.select("doc_id", F.col(text_col).alias("text")).mapInArrow(released(tokenise), f"doc_id {id_type}, key long, ids binary")
    tokens = work.write(found.withColumn("place", F.monotonically_increasing_id()), "tokens")
    work.rows = tokens.count()
    # The row's number in the written table is part of the tie, so that copies without an id spread too.
    tie = F.xxhash64("doc_id", F.crc32("ids"), "place")
    ordered = tokens.withColumn("tie", tie).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "place").select("doc_id", "ids")
    return work.fitted(ordered).mapInArrow(released(pack), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _rows(out: list, id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
