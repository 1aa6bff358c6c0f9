"""Exact dedup by Golomb-coded fingerprint exchange.

1. Every input partition sorts the 64-bit fingerprints of its normalised texts and sends each owner
   (a range of the hash space) its share, Golomb-Rice coded: about 6 bytes a document, no text.
2. Owners decode, find fingerprints that occur twice and answer with bitmaps over their slots.
   The bitmaps together have at most ``max_bitmap_bits`` bits, so their broadcast is bounded; where
   that many slots are too few, more rows become suspects and the result stays the same.
3. A second scan marks the rows whose slot is set. Only these suspects are shuffled with their bytes
   and grouped by the bytes themselves; Spark's partial aggregation folds hot groups before the shuffle.

Defined results: a null text counts as empty; all empty texts are one group. Among rows of equal text
and equal (or null) doc_id exactly one stays. A null doc_id sorts below every other. Extra columns of
the input, whatever their names, are ignored by ``dedup_report`` and carried unchanged by ``drop_exact_duplicates``. An empty table
gives an empty result. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, carried, released, restored, text_slices, with_text

MESSAGE = "src long, owner int, n int, bits int, unary binary, rest binary, twice binary"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8").lower()


def golomb_encode(sorted_values: np.ndarray, base: int, span: int) -> tuple[int, bytes, bytes]:
    """Rice code of the gaps of sorted distinct uint64 values: parameter, unary bits, remainder bits."""
    n = len(sorted_values)
    bits = min(63, max(0, int(math.log2(max(1, span // max(1, n))))))
    gaps = np.diff(sorted_values, prepend=np.uint64(base))
    quotient = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 0
    shifts = np.arange(bits, dtype=np.uint64)
    rest = [np.packbits(((gaps[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes() for i in range(0, n, 65536)]
    return bits, np.packbits(unary).tobytes(), b"".join(rest)


def golomb_decode(n: int, base: int, bits: int, unary: bytes, rest: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    flat, low = np.frombuffer(rest, np.uint8), np.zeros(n, np.uint64)
    step = 65536 * bits // 8
    for k, i in enumerate(range(0, n, 65536)):
        m = min(65536, n - i)
        part = np.unpackbits(flat[k * step : k * step + (m * bits + 7) // 8])[: m * bits].reshape(m, bits).astype(np.uint64)
        low[i : i + m] = (part << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if bits else 0
    gaps = (quotient.astype(np.uint64) << np.uint64(bits)) | low
    return np.uint64(base) + np.cumsum(gaps, dtype=np.uint64)


def _fingerprints(batch: pa.RecordBatch, column: str):
    for part in text_slices(batch, column):
        yield part, [normalise(x) for x in part.column(column).to_pylist()]


def _send(owner_bits: int, column: str):
    def send(batches):
        found = [np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64) for b in batches for _, texts in _fingerprints(b, column)]
        if not found:
            return
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        span = 1 << (64 - owner_bits)
        owner = (values >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(values), np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            bits, unary, rest = golomb_encode(values[a:b], int(owner[a]) * span, span)
            rows.append((TaskContext.get().partitionId(), int(owner[a]), int(b - a), bits, unary, rest, np.packbits(counts[a:b] > 1).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["src", "owner", "n", "bits", "unary", "rest", "twice"])

    return send


def _answer(owner_bits: int, slot_bits: int):
    """What an owner returns: a bitmap over its slots, set where some fingerprint occurs twice."""

    def answer(messages: pa.Table) -> pa.Table:
        owner = messages.column("owner")[0].as_py()
        base = owner << (64 - owner_bits)
        values, twice = [], []
        for m in messages.select(["n", "bits", "unary", "rest", "twice"]).to_pylist():
            values.append(golomb_decode(m["n"], base, m["bits"], m["unary"], m["rest"]))
            twice.append(values[-1][np.unpackbits(np.frombuffer(m["twice"], np.uint8))[: m["n"]] == 1])
        values = np.sort(np.concatenate(values))
        found = np.concatenate([values[1:][values[1:] == values[:-1]], *twice])
        bitmap = np.zeros(1 << (slot_bits - owner_bits), np.uint8)
        bitmap[((found - np.uint64(base)) >> np.uint64(64 - slot_bits)).astype(np.int64)] = 1
        return pa.table({"owner": pa.array([owner], pa.int32()), "bitmap": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    return answer


def duplicate_bitmap(docs: DataFrame, text_col: str = "text", max_bitmap_bits: int = 28) -> tuple[np.ndarray, int]:
    """Bytes of the duplicate bitmap over the hash space and the number of its slots' bits."""
    n = max(1, docs.count())
    slot_bits = min(max_bitmap_bits, max(10, math.ceil(math.log2(16 * n))))
    owner_bits = min(slot_bits - 8, max(0, math.ceil(math.log2(n / 100_000))))
    messages = docs.select(text_col).mapInArrow(released(_send(owner_bits, text_col)), MESSAGE)
    answers = messages.groupBy("owner").applyInArrow(_answer(owner_bits, slot_bits), "owner int, bitmap binary").collect()
    whole = np.zeros((1 << slot_bits) // 8, np.uint8)
    share = len(whole) >> owner_bits
    for a in answers:
        whole[a["owner"] * share : (a["owner"] + 1) * share] = np.frombuffer(a["bitmap"], np.uint8)
    return whole, slot_bits


def mark_suspects(spark: SparkSession, docs: DataFrame, text_col: str = "text", max_bitmap_bits: int = 28, carry: bool = False) -> DataFrame:
    """Per row: doc_id, fp, sha (hex SHA-256 of the normalised text), body (its bytes, null unless suspect).

    With ``carry`` the whole input row stays beside them as the struct ``row``.
    """
    bitmap, slot_bits = duplicate_bitmap(docs, text_col, max_bitmap_bits)
    shared = spark.sparkContext.broadcast(bitmap)
    source = carried(docs).select("row", F.col("row.doc_id").alias("doc_id")) if carry else docs.select("doc_id", F.col(text_col).alias("text"))
    names = ["row", "doc_id"] if carry else ["doc_id"]
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("fp", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("body", T.BinaryType())])

    def mark(batches):
        bits = shared.value
        for batch in batches:
            for part, texts in _fingerprints(with_text(batch, text_col) if carry else batch, "text"):
                fp = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64)
                slot = (fp >> np.uint64(64 - slot_bits)).astype(np.int64)
                hit = (bits[slot >> 3] >> (7 - (slot & 7))) & 1
                extra = [pa.array(fp.view(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([x if h else None for x, h in zip(texts, hit)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra], schema.names)

    return source.mapInArrow(released(mark), schema)


def verify_suspects(suspects: DataFrame) -> DataFrame:
    """Suspects (with a stable uid) and, from groups of equal bytes: keep_id, keep_uid, group_size."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("uid")))
    groups = suspects.groupBy("fp", "body", "sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("fp", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"), "group_size")
    return suspects.drop("body").join(groups, ["fp", "sha"])


def dedup_report(spark: SparkSession, docs: DataFrame, text_col: str = "text", max_bitmap_bits: int = 28) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    work = Workspace(spark, "exact-dedup")
    marked = work.write(mark_suspects(spark, docs, text_col, max_bitmap_bits).withColumn("uid", F.monotonically_increasing_id()), "marked")
    work.rows = marked.count()
    alone = marked.where(F.col("body").isNull()).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    checked = verify_suspects(marked.where(F.col("body").isNotNull())).select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    return work.fitted(alone).unionByName(work.fitted(checked))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, text_col: str = "text", max_bitmap_bits: int = 28) -> DataFrame:
    """The rows that stay, with the input's columns."""
    work = Workspace(spark, "exact-dedup", docs.count())
    marked = mark_suspects(spark, docs, text_col, max_bitmap_bits, carry=True)
    suspects = work.write(marked.where(F.col("body").isNotNull()).withColumn("uid", F.monotonically_increasing_id()), "suspects")
    stay = verify_suspects(suspects).where(F.col("uid") == F.col("keep_uid"))
    return work.fitted(restored(marked.where(F.col("body").isNull()))).unionByName(work.fitted(restored(stay)))
