"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece exactly one token can come last in a valid encoding. The encoder stores
that token per prefix: appending bytes extends the table exactly, and after an edit only the prefixes
from the edit on are computed anew. A pair of neighbours is valid when undoing its merges in reverse never meets
a moment at which the two parts at the seam would have merged first.

Defined results: a null text encodes as empty (no ids, the hash of no bytes), as does an empty one. Any Unicode text round-trips, whole and of any
length. Repeated rows and ids are encoded row by row, with equal results for equal texts; an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import PieceCache, text_slices

#: Judged pairs that a worker remembers before it starts afresh; bounds its memory.
CACHE_PAIRS = 1_000_000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class PrefixBPE:
    """Encoder over {token bytes: rank}; ranks are the ids and the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._split: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[tuple[int, int], bool] = {}

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; itself twice for a byte; None if merges never make it."""
        if token not in self._split:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 1:
                self._split[token] = (token, token)
            else:
                self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def pair_is_valid(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        if (known := self._pair.get((left, right))) is not None:
            return known
        a, b, good = left, right, True
        until_a, until_b = 1 << 60, 1 << 60  # the ranks at which a and b get merged into something larger
        while True:
            joint = self.ranks.get(self.tokens[a] + self.tokens[b])
            # The left merge comes first among equal ranks, so a seam merge loses to an equal one on its left only.
            if joint is not None and joint < until_a and joint <= until_b:
                good = False
                break
            la, lb = len(self.tokens[a]) > 1, len(self.tokens[b]) > 1
            if not la and not lb:
                break
            if la and (not lb or a > b):
                until_a, a = a, self._parts(a)[1]
            else:
                until_b, b = b, self._parts(b)[0]
        self._pair[left, right] = good
        return good

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Fill ``last[i]`` for the prefixes data[:i], start < i <= len(data); last[0] is -1.

        An automaton over all tokens names those that end at each byte, the longest first.
        """
        del last[start + 1 :]
        base, parts, sizes, valid, pairs = max(0, start - self.longest), self._split, self.sizes, self.pair_is_valid, self._pair
        ready = len(last)  # prefixes that have their token, the empty one included
        for end, token in self.automaton.iter(data[base:].decode("latin-1")):
            i = base + end + 1
            if i < ready:
                continue
            j = i - sizes[token]
            if (parts[token] if token in parts else self._parts(token)) is not None:
                if j:
                    left = last[j]
                    good = pairs.get((left, token))
                    if not (valid(left, token) if good is None else good):
                        continue
                last.append(token)
                ready += 1
        if ready != len(data) + 1:
            raise ValueError("a byte has no token")

    def walk(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= self.sizes[last[i]]
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if not data:
            return []
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, 0)
        return self.walk(last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableEncoding:
    """A piece under edits: its prefix table is kept, and recomputed from an edit on only."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.bpe.extend(self.data, self.last, start)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        self.data = self.data[:start] + new + self.data[stop:]
        self.bpe.extend(self.data, self.last, start)

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class TextEncoder(PieceCache):
    """Whole texts: piece -> its ids as little-endian uint32 bytes, computed when first seen."""

    def __init__(self, bpe: PrefixBPE, pattern: str):
        super().__init__()
        self.bpe, self.find = bpe, regex.compile(pattern).findall

    def make(self, piece: str) -> bytes:
        return array("I", self.bpe.encode_piece(piece.encode("utf-8"))).tobytes()

    def encode(self, text: str) -> bytes:
        self.turn()
        if len(self.bpe._pair) > CACHE_PAIRS:
            self.bpe._pair.clear()
        return b"".join([self[p] for p in self.find(text)])


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> TextEncoder:
    return TextEncoder(PrefixBPE(parse_ranks(raw)), pattern)


def encode_documents(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False, text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids as an array.

    One scan, no shuffle. The rank file is read on the driver and broadcast (a vocabulary, fixed in size).
    """
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches):
        coder = _encoder(shared.value, pattern)
        tokens = coder.bpe.tokens
        for batch in batches:
            for part in text_slices(batch, text_col):
                n, hashes, plain, kept = [], [], [], []
                for text in part.column(text_col).to_pylist():
                    packed = coder.encode(text or "")
                    ids = array("I", packed)
                    n.append(len(ids))
                    hashes.append(hashlib.sha256(packed).hexdigest())
                    plain.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.to_pylist() for x in kept], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text_col).mapInArrow(encode, schema)
