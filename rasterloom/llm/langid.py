"""Language ID by a linear-chain conditional random field over the words of a text.

Words are runs of letters, lower-cased. A word's features are its affixes (1 to 3 letters at either end),
its character 2- and 3-grams with boundaries, and its identity as a lexicon entry; they index one hashed
weight table. Labels are the languages; transitions between neighbouring words are learned, so text that
switches language inside a document gets a label per word. Training maximises the conditional likelihood
by forward-backward on sequences spliced from documents of different languages.

Inference is exact for texts of any length: words are cut into blocks, each block's transfer matrix is
multiplied out for all blocks at once, documents chain their blocks, and marginals follow in every block.

Defined results: ``lang_pred`` is the label with the largest expected number of words and ``score`` its share;
a null text or one without a letter gives ``und`` and 0. With no labelled row every text is ``und``.
Prediction looks at the text alone; extra columns, whatever their names, are ignored and repeated rows get the same answer; an empty table
gives an empty result. Jobs for fitting run while the query is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HASHES, _first_of_each, held_out, mix64, text_slices, trainable

#: Fitting sample: at most so many documents a language, and pieces of so many words spread evenly over each whole text.
DOCS_PER_LANG, PIECES, PIECE_WORDS = 300, 48, 40
HASH_BITS, BLOCK, SLICE = 18, 128, 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass
class Words:
    """Features of all words of some texts. ``at`` is the first word of each text (and the total)."""

    at: np.ndarray
    first_letter: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def _index(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k, p in enumerate(parts):
        h = h + p.astype(np.uint64) * np.uint64((0xD6E8FEB86659FD93 + 2 * k * 0xA0761D6478BD642F) % (1 << 64) | 1)
    return (mix64(h) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def features(texts: list[str | None]) -> Words:
    joined = "\0" + "\0".join((t or "").replace("\0", " ").lower() for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter = _letters()[c]
    rows = np.flatnonzero(c == 0)
    spot = np.flatnonzero(letter)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    start = np.flatnonzero(first)
    at = np.searchsorted(start, rows)
    if not len(start):
        return Words(at, np.zeros(0, np.int64), np.zeros((0, 2), np.int32), np.zeros((0, 7), np.int32))
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    end = np.flatnonzero(last)
    x = np.where(letter, c, 32)
    gram = np.stack([_index(1, x[spot - 1], x[spot], x[spot + 1]), _index(2, x[spot], x[spot + 1])], axis=1)
    first_letter = np.searchsorted(spot, start)
    inside = (spot - np.repeat(start, np.diff(np.append(first_letter, len(spot))))) & 63
    powers = mix64(np.arange(64, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    identity = np.add.reduceat(x[spot].astype(np.uint64) * powers[inside], first_letter)
    size, none = end - start, np.zeros(len(start), np.uint32)
    at_start = [np.where(k <= size, x[np.minimum(start + k, end)], none) for k in range(3)]
    at_end = [np.where(k <= size, x[np.maximum(end - k, start)], none) for k in range(3)]
    whole = [_index(3, identity)]
    for k in range(1, 4):
        whole += [_index(3 + k, *at_start[:k]), _index(6 + k, *at_end[:k])]
    return Words(at, first_letter, gram, np.stack(whole, axis=1))


def _pieces(text: str, limit: int):
    """A text in stretches of about ``limit`` characters that begin between words."""
    start = 0
    while start < len(text):
        end = min(start + limit, len(text))
        while end < len(text) and (text[end].isalpha() or not text[end].isascii()):
            end += 1
        yield text[start:end]
        start = end


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (2 ** HASH_BITS, labels)
    moves: np.ndarray  # log-weights of label -> next label
    start: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        by_letter = self.weights[w.gram[:, 0]]
        by_letter += self.weights[w.gram[:, 1]]
        out = np.add.reduceat(by_letter, w.first_letter, axis=0)
        for k in range(w.whole.shape[1]):
            out += self.weights[w.whole[:, k]]
        return out

    def read(self, texts: list[str | None], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all words, and each text's first word (and the total). Features are made of about ``limit`` characters at a time;
        a long text is cut between words, which changes no feature of a word."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in (_pieces(t, limit) if t and len(t) > limit else [t])]
        parts, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0
        for k, (i, piece) in enumerate(pieces):
            group.append((i, piece))
            size += len(piece or "")
            if size >= limit or k + 1 == len(pieces):
                w = features([p for _, p in group])
                np.add.at(counts, [i for i, _ in group], np.diff(w.at))
                if len(w.whole):
                    parts.append(self.emissions(w))
                group, size = [], 0
        found = np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)
        return found, np.concatenate([[0], np.cumsum(counts)])

    def marginals(self, emissions: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(label of each word | text) for texts whose words are emissions[at[i]:at[i + 1]]."""
        n, m = emissions.shape
        count = np.diff(at)
        blocks = -(-count // BLOCK)
        head = np.concatenate([[0], np.cumsum(blocks)])
        total = int(head[-1])
        if not total:
            return np.zeros((0, m), np.float32)
        word = np.arange(n)
        text = np.repeat(np.arange(len(count)), count)
        inner = word - at[text]
        cell = (head[text] + inner // BLOCK) * BLOCK + inner % BLOCK
        x = np.ones((total * BLOCK, m), np.float32)
        x[cell] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        live = np.zeros(total * BLOCK, bool)
        live[cell] = True
        x, live = x.reshape(total, BLOCK, m), live.reshape(total, BLOCK)
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        starts = np.zeros(total, bool)
        starts[head[:-1][blocks > 0]] = True
        unit = np.eye(m, dtype=np.float32)

        # Transfer matrix of each block; only texts of several blocks need them.
        enter = np.tile(np.exp(self.start - self.start.max()).astype(np.float32), (total, 1))
        leave = np.ones((total, m), np.float32)
        if (blocks > 1).any():
            through = np.tile(unit, (total, 1, 1))
            for t in range(BLOCK):
                step = (through.reshape(-1, m) @ move).reshape(total, m, m)
                if t == 0:
                    step[starts] = through[starts]
                step *= x[:, t, None, :]
                step /= step.sum(axis=(1, 2), keepdims=True)
                through = np.where(live[:, t, None, None], step, through)
            for k in range(1, int(blocks.max())):
                own = head[:-1][blocks > k] + k
                v = np.einsum("bi,bij->bj", enter[own - 1], through[own - 1])
                enter[own] = v / v.sum(axis=1, keepdims=True)
            for k in range(int(blocks.max()) - 1, 0, -1):
                own = head[:-1][blocks > k] + k
                v = np.einsum("bij,bj->bi", through[own], leave[own])
                leave[own - 1] = v / v.sum(axis=1, keepdims=True)

        forward, a = np.empty_like(x), enter
        for t in range(BLOCK):
            step = a @ move
            if t == 0:
                step[starts] = a[starts]
            step *= x[:, t]
            step /= step.sum(axis=1, keepdims=True)
            a = np.where(live[:, t, None], step, a)
            forward[:, t] = a
        b = leave
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= b
            if t:
                back = (x[:, t] * b) @ move.T
                b = np.where(live[:, t, None], back / back.sum(axis=1, keepdims=True), b)
        out = forward.reshape(-1, m)[cell]
        return out / out.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 8, batch: int = 64, words: int = 64, seed: int = 7) -> Crf:
    """Train on documents labelled as wholes; sequences are spliced so that labels change inside them."""
    labels = sorted(set(langs))
    m, rng = len(labels), np.random.default_rng(seed)
    model = Crf(labels, np.zeros((1 << HASH_BITS, m), np.float32), np.zeros((m, m), np.float32), np.zeros(m, np.float32))
    w = features(texts)
    code = np.array([labels.index(x) for x in langs])
    label = np.repeat(code, np.diff(w.at))
    # Segments of 4 to 40 words of one document; their shuffled concatenation is the training text.
    segments = []
    for a, b in zip(w.at[:-1], w.at[1:]):
        while a < b:
            n = int(rng.integers(4, 41))
            segments.append((a, min(a + n, b)))
            a += n
    if m < 2 or not segments:
        return model
    letters = np.diff(np.append(w.first_letter, len(w.gram)))
    squares = np.full(model.weights.shape, 1e-3, np.float32)
    move_squares, start_squares = np.full((m, m), 1e-3, np.float32), np.full(m, 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        flat = np.concatenate([np.arange(*segments[i]) for i in order])
        usable = len(flat) // words * words
        for chosen in np.array_split(flat[:usable].reshape(-1, words), max(1, usable // words // batch)):
            if not chosen.size:
                continue
            ids = chosen.ravel()
            gram_of = np.repeat(w.first_letter[ids], letters[ids]) + _ramp(letters[ids])
            own = Words(np.arange(0, len(ids) + 1, words), np.concatenate([[0], np.cumsum(letters[ids])[:-1]]), w.gram[gram_of], w.whole[ids])
            e = model.emissions(own).reshape(len(chosen), words, m)
            y = label[ids].reshape(len(chosen), words)
            p, pairs = _pairwise(e, model)
            gap = p.copy()
            np.put_along_axis(gap, y[..., None], np.take_along_axis(gap, y[..., None], 2) - 1, 2)
            gap = gap.reshape(-1, m)
            index = np.concatenate([own.gram[:, 0], own.gram[:, 1], own.whole.ravel()])
            by_letter = np.repeat(np.arange(len(ids)), letters[ids])
            word_of = np.concatenate([by_letter, by_letter, np.repeat(np.arange(len(ids)), own.whole.shape[1])])
            spots, back = np.unique(index, return_inverse=True)
            slope = np.stack([np.bincount(back, gap[word_of, k]) for k in range(m)], axis=1) / len(chosen)
            squares[spots] += slope**2
            model.weights[spots] -= 0.3 * slope / np.sqrt(squares[spots])
            seen = np.zeros((m, m))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            move = (pairs - seen) / len(chosen)
            move_squares += move**2
            model.moves -= (0.3 * move / np.sqrt(move_squares)).astype(np.float32)
            first = gap.reshape(len(chosen), words, m)[:, 0].mean(axis=0)
            start_squares += first**2
            model.start -= (0.3 * first / np.sqrt(start_squares)).astype(np.float32)
    return model


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)


def _pairwise(e: np.ndarray, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on sequences of equal length: word marginals and expected label pairs."""
    x = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
    move = np.exp(model.moves - model.moves.max()).astype(np.float64)
    n, size, m = x.shape
    a, b = np.empty_like(x), np.ones_like(x)
    now = x[:, 0] * np.exp(model.start)
    a[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, size):
        now = (a[:, t - 1] @ move) * x[:, t]
        a[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(size - 1, 0, -1):
        now = (x[:, t] * b[:, t]) @ move.T
        b[:, t - 1] = now / now.sum(axis=1, keepdims=True)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    joint = np.einsum("nti,ntj->ntij", a[:, :-1], x[:, 1:] * b[:, 1:]) * move
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return p, joint.sum(axis=(0, 1))


def spread_pieces(text: str) -> str:
    """``PIECES`` pieces of ``PIECE_WORDS`` words at even distances, the first and the last included; a shorter text as it is."""
    words = LETTERS.findall(text)
    if len(words) <= PIECES * PIECE_WORDS:
        return text
    starts = np.linspace(0, len(words) - PIECE_WORDS, PIECES).astype(int).tolist()
    return " ".join(w for a in starts for w in words[a : a + PIECE_WORDS])


def training_rows(docs: DataFrame, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """The fitting sample: for each language pieces of the trainable documents with the smallest id hashes.

    A threshold per language, from its count, thins the ids before they are ranked or shuffled.
    """
    slim = docs.where(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    # One row a language, the model's own set of labels.
    counts = {r["lang"]: r["count"] for r in slim.groupBy("lang").count().collect()}
    want = per_lang + 6 * per_lang**0.5 + 20
    tops = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(want / n * HASHES) + 1))) if counts else F.create_map(F.lit(""), F.lit(0))
    thin = slim.where(h < tops[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(h, "doc_id")
    chosen = thin.select("doc_id", "lang", F.row_number().over(order).alias("n")).where(F.col("n") <= per_lang).select("doc_id").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                yield part.set_column(1, "text", pa.array([spread_pieces(t or "") for t in part.column("text").to_pylist()], pa.string()))

    found = _first_of_each(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"), chosen)
    return found.mapInArrow(pieces, f"doc_id {kind}, text string, lang string")


def identify(spark: SparkSession, docs: DataFrame, model: Crf) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, n_words, n_switches. One scan, no shuffle."""
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches):
        crf: Crf = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                e, at = crf.read(part.column("text").to_pylist())
                count = np.diff(at)
                pred, score, switches = np.full(len(count), "und", object), np.zeros(len(count)), np.zeros(len(count), np.int64)
                if crf.labels and len(e):
                    p = crf.marginals(e, at)
                    full = np.flatnonzero(count)
                    share = np.add.reduceat(p, at[:-1][full], axis=0, dtype=np.float64) / count[full, None]
                    pred[full] = np.array(crf.labels, object)[share.argmax(axis=1)]
                    score[full] = np.clip(share.max(axis=1), 0, 1)
                    best = p.argmax(axis=1)
                    change = np.append(best[1:] != best[:-1], False).astype(np.int64)
                    change[at[1:][full] - 1] = 0
                    switches[full] = np.add.reduceat(change, at[:-1][full])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(count.astype(np.int64)), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    out = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double, n_words long, n_switches long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def identify_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = training_rows(docs).select("text", "lang").toArrow().to_pydict()
    return identify(spark, docs, fit(rows["text"], rows["lang"]))
