"""Cross-entropy difference of two matched n-gram language models.

Target and background model share one vocabulary, one order (bigrams) and one smoothing. The target model
counts the documents labelled as good (``labels.quality`` = 1), the background model all others; counts cover
every document. A document's score is the mean over its tokens of (target loss - background loss): the lower,
the more the text looks like the target.

No document is scored by its own counts: those of all documents with its sequence of tokens, itself included, are taken out of both models
before it is scored. So a document scores the same whether it is labelled or not, and copies don't vouch for each other.

Every counted word and bigram is in the models, so they grow with the input and are never gathered in one place.
Documents are cut into chunks of about ``CHUNK`` tokens. A chunk deals its distinct bigrams out to buckets
(by hash, their number in proportion to the input); a bucket adds up what all chunks hold of a bigram and answers each chunk with what
the others have, in the order of the chunk's keys, so no key travels back, and keys travel as gaps between sorted ones. One chunk of each bigram is told that it is the first,
which counts the distinct followers of a context. Numbers of copies travel the same way, under hashes of whole token sequences; words are summed after
that. Then each chunk scores its documents with the whole counts of all that stands in them. Words, bigrams and documents are compared by 64-bit hashes.

Defined results: a null text or one without a token has n_tokens 0 and null losses. Labels that are null or not
0/1 mark nothing. Without any other target document the target model is the prior that both share. A null doc_id
is background. Extra columns are ignored; repeated rows are copies of each other and get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_rows, mix64, released, text_slices

DISCOUNT, PRIOR = 0.75, 2_000.0
#: Tokens of a chunk, and of the input for each bucket; they bound a task's memory.
CHUNK, BUCKET = 2_000_000, 4_000_000
#: Stands for a text's start among the hashes of words; tells hashes of documents from those of bigrams.
START, WHOLE = 0, np.uint64(0x9E3779B97F4A7C15)
#: Chunks in an Arrow batch.
CHUNK_ROWS = 4
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def mark_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and good. Always a shuffle of both sides: the plan is the same at every size. Null ids match nothing and
    are spread by their text."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("__k"), F.lit(False).alias("__none")).distinct().withColumn("good", F.lit(True))
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("__k"), F.col("doc_id").isNull().alias("__none"))
    return keyed.join(good.hint("merge"), ["__k", "__none"], "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def _pack(x: np.ndarray) -> bytes:
    """Integers byte by byte of their width, compressed: counts are mostly small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _chunks(id_type: pa.DataType):
    """Chunks of documents: ids, numbers of tokens, marks, tokens as numbers of the chunk's words, hashes of these."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        ids, good, sizes, held, number, n = [], [], [], [], {}, 0

        def handed():
            found = np.concatenate(held)
            often = np.argsort(-np.bincount(found, minlength=len(number)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.int32)
            rank[often] = np.arange(len(often), dtype=np.int32)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number), np.uint64, len(number))
            marks = np.array(good, bool)
            target = int(np.array(sizes, np.int64)[marks].sum())
            row = [[task << 32 | k], pa.array([ids], pa.list_(id_type)), [_pack(np.array(sizes, np.int64))], [_pack(marks.astype(np.uint8))], [_pack(rank[found])], [hashes[often].tobytes()], [target], [n - target]]
            return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in row], ["chunk", "ids", "sizes", "good", "tokens", "words", "target", "background"])

        for batch in batches:
            for part in text_slices(batch):
                ids += part.column("doc_id").to_pylist()
                good += part.column("good").to_pylist()
                for text in part.column("text").to_pylist():
                    found = tokens(text)
                    for w in found:
                        if w not in number:
                            number[w] = len(number)
                    held.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                    sizes.append(len(found))
                    n += len(found)
                if n > CHUNK:
                    yield handed()
                    ids, good, sizes, held, number, n, k = [], [], [], [], {}, 0, k + 1
        if sizes:
            yield handed()

    return run


class Chunk:
    """A chunk's words and its distinct bigrams in a fixed order; the keys and counts (target, background) of these and then of its distinct documents."""

    def __init__(self, row: dict):
        self.number, self.sizes = row["chunk"], _unpack(row["sizes"], np.int64)
        good = _unpack(row["good"], np.uint8).astype(bool)
        self.words = np.concatenate([np.frombuffer(row["words"], np.uint64), np.array([START], np.uint64)])
        after, width = _unpack(row["tokens"], np.int32).astype(np.int64), len(self.words)
        before = np.concatenate([[width - 1], after[:-1]]) if len(after) else after
        self.full = np.flatnonzero(self.sizes > 0)
        first = (np.cumsum(self.sizes) - self.sizes)[self.full]
        before[first] = width - 1
        pairs, self.spot = np.unique(before * width + after, return_inverse=True)
        self.before, self.after = pairs // width, pairs % width
        place = mix64((np.arange(len(after)) - np.repeat(first, self.sizes[self.full])).astype(np.uint64))
        said = np.add.reduceat(mix64(self.words[after] + place), first) if len(first) else np.zeros(0, np.uint64)
        docs, self.doc = np.unique(mix64(said ^ WHOLE), return_inverse=True)
        self.keys = np.concatenate([mix64(mix64(self.words[self.before]) + self.words[self.after]), docs])
        split = lambda which, good, n: np.stack([np.bincount(which[good], minlength=n), np.bincount(which[~good], minlength=n)])
        self.counts = np.concatenate([split(self.spot, np.repeat(good, self.sizes), len(pairs)), split(self.doc, good[self.full], len(docs))], axis=1)

    def of_pairs(self, found: np.ndarray) -> np.ndarray:
        return found[..., : len(self.before)]

    def copies(self, whole: np.ndarray) -> np.ndarray:
        """Per model and document with a token: documents like it, itself included."""
        return whole[:, len(self.before) :][:, self.doc]

    def by_word(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(which, c, len(self.words)).astype(np.int64) for c in counts])


def _shares(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys in the order of the keys) for buckets that have keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(keys)
    order = order[np.argsort(bucket[order], kind="stable")]
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return ((b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1])


DEALT, ANSWERED = "bucket long, chunk long, keys binary, counts binary", "bucket long, chunk long, answer binary, distinct long"


def _deal(chunk: Chunk, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[dict]:
    return [{"bucket": b, "chunk": chunk.number, "keys": _pack(np.diff(keys[at], prepend=np.uint64(0))), "counts": _pack(counts[:, at])} for b, at in _shares(keys, buckets)]


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _add_up(found: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk what the others add to its counts, and whether it is a key's first."""
    keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in found.column("keys").to_pylist()]
    ends = np.cumsum([len(x) for x in keys])
    counts = np.concatenate([_unpack(c, np.int64).reshape(-1, len(x)) for c, x in zip(found.column("counts").to_pylist(), keys)], axis=1)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    answer = np.zeros((len(counts) + 1, len(every)), np.int64)
    answer[:-1, order] = np.add.reduceat(counts[:, order], at, axis=1)[:, np.cumsum(new) - 1]
    answer[:-1] -= counts
    answer[-1, order[at]] = 1
    answers = [_pack(answer[:, e - len(x) : e]) for e, x in zip(ends, keys)]
    distinct = np.zeros(len(keys), np.int64)
    distinct[0] = len(at)
    out = pa.table([found.column("bucket"), found.column("chunk"), pa.array(answers, pa.binary()), pa.array(distinct)], ["bucket", "chunk", "answer", "distinct"])
    return out


def _whole(keys: np.ndarray, counts: np.ndarray, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all chunks, and which keys this chunk is the first to have."""
    whole, first = counts.copy(), np.zeros(len(keys), bool)
    for b, at in _shares(keys, buckets):
        answer = _unpack(answers[b], np.int64).reshape(-1, len(at))
        whole[:, at] += answer[:-1]
        first[at] = answer[-1].astype(bool)
    return whole, first


def _answers(found: pa.Table, kind: str) -> dict[int, bytes]:
    return {r["bucket"]: r["answer"] for r in found.to_pylist() if r["kind"] == kind}


def _word_counts(chunk: Chunk, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per word, for target and background: its tokens, its uses as a context, and the distinct followers that this
    chunk is the first to have."""
    own, followers = chunk.of_pairs(chunk.counts), chunk.of_pairs((whole > 0) & first)
    return np.concatenate([chunk.by_word(chunk.after, own), chunk.by_word(chunk.before, own), chunk.by_word(chunk.before, followers)])


def _chunk_losses(chunk: Chunk, whole: np.ndarray, words: np.ndarray, size: int, total: np.ndarray) -> np.ndarray:
    """Mean losses (documents, 2) by counts without the document and its copies; NaN without a token.

    Bigrams lose ``DISCOUNT`` of their count to the words' own shares, and these lean on a prior that both models share.
    """
    out = np.full((len(chunk.sizes), 2), np.nan)
    if not len(chunk.full):
        return out
    pairs, copies, sizes = chunk.of_pairs(whole), chunk.copies(whole), chunk.sizes[chunk.full]
    # One entry for each distinct bigram of a document, in the order of documents, contexts and followers.
    found, own = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(chunk.before) + chunk.spot, return_counts=True)
    doc, pair = np.divmod(found, len(chunk.before))
    before, after = chunk.before[pair], chunk.after[pair]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (before[1:] != before[:-1])
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    word = np.unique(doc * len(chunk.words) + after, return_inverse=True)[1]
    own_word = np.bincount(word, own).astype(np.int64)[word]
    left_words = words[:2][:, after] - copies[:, doc] * own_word
    left_total = total[:, None] - copies * sizes
    shared = (left_words.sum(axis=0) + 1.0) / (left_total.sum(axis=0) + size)[doc]
    for m in (0, 1):
        gone = copies[m][doc] * own
        left = pairs[m][pair] - gone
        used = words[2 + m][before] - np.add.reduceat(gone, starts)[run]
        followers = words[4 + m][before] - np.add.reduceat(((left == 0) & (gone > 0)).astype(np.int64), starts)[run]
        uni = (left_words[m] + PRIOR * shared) / (left_total[m] + PRIOR)[doc]
        contexts = np.maximum(used, 1)
        rest = np.where(used > 0, np.clip(DISCOUNT * followers / contexts, 1e-6, 1), 1.0)
        log = np.log(np.maximum(left - DISCOUNT, 0) / contexts + rest * uni)
        out[chunk.full, m] = -np.add.reduceat(own * log, np.searchsorted(doc, np.arange(len(sizes)))) / sizes
    return out


def cross_entropy_difference(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, target_loss, background_loss, score; with every counted word and bigram."""
    work = Workspace(spark, "lm-score")
    marked = mark_good(docs, labels)
    id_type, id_name = marked.limit(0).toArrow().schema.field("doc_id").type, docs.schema["doc_id"].dataType.simpleString()
    chunks = work.write(marked.mapInArrow(released(_chunks(id_type)), f"chunk long, ids array<{id_name}>, sizes binary, good binary, tokens binary, words binary, target long, background long"), "chunks")
    del marked
    spark._jvm.System.gc()  # lets go of the shuffled texts
    total = np.array([x or 0 for x in chunks.agg(F.sum("target"), F.sum("background")).first()], np.int64)
    buckets = int(total.sum()) // BUCKET + 1

    def deal_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                yield from _table(_deal(chunk, chunk.keys, chunk.counts, buckets)).to_batches()

    def deal_words(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            whole, first = _whole(chunk.keys, chunk.counts, _answers(right, "pair"), buckets)
            rows += _deal(chunk, chunk.words, _word_counts(chunk, whole, first), buckets)
        return _table(rows)

    with arrow_rows(spark, CHUNK_ROWS):
        slim = chunks.drop("ids", "target", "background")
        pairs = work.write(slim.mapInArrow(released(deal_pairs), DEALT).groupBy("bucket").applyInArrow(_add_up, ANSWERED), "pair-answers").withColumn("kind", F.lit("pair"))
    spark._jvm.System.gc()
    dealt = slim.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(deal_words, DEALT)
    words = work.write(dealt.groupBy("bucket").applyInArrow(_add_up, ANSWERED), "word-answers").withColumn("kind", F.lit("word"))
    del dealt
    spark._jvm.System.gc()
    # All distinct words but the start.
    size = max(1, int(words.agg(F.sum("distinct")).first()[0] or 1) - 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            whole, first = _whole(chunk.keys, chunk.counts, _answers(right, "pair"), buckets)
            counted, _ = _whole(chunk.words, _word_counts(chunk, whole, first), _answers(right, "word"), buckets)
            loss, none = _chunk_losses(chunk, whole, counted, size, total), chunk.sizes == 0
            columns = [pa.array(x, mask=none) for x in (loss[:, 0], loss[:, 1], loss[:, 0] - loss[:, 1])]
            out.append(pa.table([pa.array(row["ids"], id_type), pa.array(chunk.sizes), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(pairs.unionByName(words).groupBy("chunk")).applyInArrow(score, f"doc_id {id_name}, n_tokens long, target_loss double, background_loss double, score double")
