"""Quality classifier by co-training of two views.

View A sees a text's content, view B the page's metadata alone (source, language, declared length). Both are boosted trees with
isotonic calibration. One pass over whole texts writes the content features of all documents. In each of ``ROUNDS`` rounds both views
score every unlabelled trainable document; of those that a view is sure of, ``PER_ROUND`` of each kind, by the order of a hash
drawn from the whole pool, teach the other view as pseudo-labels. In the end the two calibrated probabilities are combined as log-odds around
the prior, calibrated once more, and score all documents.

Jobs for fitting run while the query is built; the driver gets at most ``SAMPLE`` labelled rows and 4 * ``PER_ROUND`` pseudo-labels a round, as dense features.
Defined results: a null or empty text has all-zero content features; null metadata is a value of its own.
With labels of fewer than two kinds every score is the share of label 1 (0.5 without labels). Labels that
are null or not 0/1 teach nothing. A document whose id has a label is not in the pool, nor is one with a null id. Extra columns, whatever their names, are
ignored by ``classify`` and carried by ``keep_by_quality``; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbt
from .common import HASHES, Workspace, carried, held_out, labelled_sample, released, restored, text_slices, trainable, with_text

#: Fitting sample: at most so many labelled rows.
SAMPLE = 6_000
#: Co-training: rounds, how sure a view must be, and how many rows of each kind it passes on in a round.
ROUNDS, SURE, PER_ROUND = 3, 0.95, 300
KEEP_FROM = 0.5

WORD = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[#*$%&|<>]")
PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
META, CONTENT = ("source", "lang", "n_chars"), 14


def content_features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * CONTENT
    chars, words = len(text), WORD.findall(text)
    n, tokens = max(1, len(words)), text.split()
    letters = sum(map(len, words)) or 1
    counts = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:]))
    return [
        math.log1p(len(words)), letters / chars, letters / n, sum(map(str.isupper, text)) / letters,
        sum(len(w) > 1 and w.isupper() for w in words) / n, len(SIGNS.findall(text)) / n, len(PUNCTUATION.findall(text)) / chars,
        text.count("!") / n, text.count("|") / n, sum(map(str.isdigit, text)) / chars,
        len(counts) / math.sqrt(n), max(counts.values(), default=0) / n, sum(v for v in triples.values() if v > 1) / n,
        len(tokens) / n,
    ]


@dataclass
class Rates:
    """Smoothed share of label 1 by value of a metadata column, from the labelled sample."""

    prior: float
    by: dict

    @classmethod
    def fit(cls, values: list, labels: np.ndarray, weight: float = 50.0) -> "Rates":
        prior = float(labels.mean()) if len(labels) else 0.5
        total, good = Counter(values), Counter()
        for v, y in zip(values, labels):
            good[v] += float(y)
        return cls(prior, {v: (good[v] + weight * prior) / (n + weight) for v, n in total.items()})

    def __call__(self, value) -> float:
        return self.by.get(value, self.prior)


def _log_odds(p: np.ndarray | float):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class CoTrained:
    prior: float
    source: Rates
    lang: Rates
    both: Rates
    content: gbt.Boosted | None = None
    meta: gbt.Boosted | None = None
    final: gbt.Isotonic | None = None

    def meta_view(self, rows: dict) -> np.ndarray:
        n = len(rows["n_chars"])
        return np.array([[self.source(s), self.lang(g), self.both((s, g)), math.log1p(max(0, c)) if c is not None else -1.0] for s, g, c in zip(rows["source"], rows["lang"], rows["n_chars"])], np.float64).reshape(n, 4)

    def combined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pa_, pb = self.content.probability(a), self.meta.probability(b)
        return pa_, pb, _log_odds(pa_) + _log_odds(pb) - _log_odds(self.prior)

    def score(self, a: np.ndarray, rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata probabilities of quality."""
        if self.content is None:
            flat = np.full(len(a), self.prior)
            return flat, flat, flat
        pa_, pb, joint = self.combined(a, self.meta_view(rows))
        return np.clip(self.final(joint), 0, 1), pa_, pb


def fit(labelled: dict, surest) -> CoTrained:
    """From rows with x (content features), source, lang, n_chars and label. ``surest(model, taken)`` gives, for models of both views,
    the pool's rows to pass on: (uid, giver, value, x, source, lang, n_chars), without the uids that a view has been taught."""
    y, own_a = np.array(labelled["label"], np.float64), _matrix(labelled["x"])
    model = CoTrained(float(y.mean()) if len(y) else 0.5, *(Rates.fit(v, y) for v in (labelled["source"], labelled["lang"], list(zip(labelled["source"], labelled["lang"])))))
    if len(np.unique(y)) < 2:
        return model
    own = (own_a, model.meta_view(labelled))
    # A fifth of the labelled rows teaches no trees: it calibrates the combination.
    apart = np.random.default_rng(3).random(len(y)) < 0.2
    if len(np.unique(y[~apart])) < 2 or len(np.unique(y[apart])) < 2:
        apart[:] = False
    x, labels, taken = [v[~apart] for v in own], [y[~apart], y[~apart]], [set(), set()]
    learn = lambda: [gbt.fit_calibrated(x[k], labels[k], rounds=40) for k in (0, 1)]
    model.content, model.meta = learn()
    for _ in range(ROUNDS):
        found = sorted(surest(model, taken), key=lambda r: (r["giver"], r["value"], list(r["x"]), str([r[c] for c in META])))
        for taker in (0, 1):
            rows = [r for r in found if r["giver"] != taker]
            if rows:
                columns = {c: [r[c] for r in rows] for c in ("x", *META)}
                more = _matrix(columns["x"]) if taker == 0 else model.meta_view(columns)
                x[taker] = np.concatenate([x[taker], more])
                labels[taker] = np.concatenate([labels[taker], [float(r["value"]) for r in rows]])
                taken[taker] |= {r["uid"] for r in rows}
        model.content, model.meta = learn()
    # Pseudo-labels change a view's mix of labels: calibrate each on given labels only.
    held = apart if apart.any() else np.ones(len(y), bool)
    for k, view in enumerate((model.content, model.meta)):
        view.calibrate = gbt.Isotonic.fit(view.raw(own[k][held]), y[held])
    model.final = gbt.Isotonic.fit(model.combined(own[0][held], own[1][held])[2], y[held])
    return model


def _matrix(x: list) -> np.ndarray:
    return np.array(x, np.float64).reshape(len(x), CONTENT)


def _content(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, CONTENT)


def _meta(batch: pa.RecordBatch) -> dict:
    return {c: batch.column(c).to_pylist() for c in META}


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, n_chars and x, the content features of whole texts. One scan."""
    source = docs.select("doc_id", *META, "text")
    names = ["doc_id", *META]
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                x = [content_features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], schema.names)

    return source.mapInArrow(released(run), schema)


def _surest(pool: DataFrame):
    """For ``fit``: scores the whole pool with both views; per giver and value the sure rows of the lowest hashes."""
    schema = T.StructType([pool.schema["uid"], T.StructField("giver", T.IntegerType()), T.StructField("value", T.IntegerType()), *(pool.schema[c] for c in ("x", *META))])

    def found(model: CoTrained, taken: list[set]) -> list:
        shared = pool.sparkSession.sparkContext.broadcast((model, [np.array(sorted(t), np.int64) for t in taken]))

        def run(batches):
            model, taken = shared.value
            for batch in batches:
                uid = batch.column("uid").to_numpy()
                for giver, p in enumerate((model.content.probability(_content(batch)), model.meta.probability(model.meta_view(_meta(batch))))):
                    free = ~np.isin(uid, taken[1 - giver])
                    for value, sure in ((1, p), (0, 1 - p)):
                        some = batch.filter(pa.array(free & (sure >= SURE)))
                        same = lambda v: pa.array(np.full(some.num_rows, v), pa.int32())
                        yield pa.RecordBatch.from_arrays([some.column("uid"), same(giver), same(value), *(some.column(c) for c in ("x", *META))], schema.names)

        work = Workspace(pool.sparkSession, "co-training")
        sure = work.write(pool.mapInArrow(released(run), schema), "sure")
        h = F.pmod(F.xxhash64("uid"), F.lit(HASHES))
        out = []
        for r in sure.groupBy("giver", "value").count().orderBy("giver", "value").collect():
            # Thinned by a threshold from the count, so that little more than the bound is sorted.
            limit = min(HASHES, int((PER_ROUND + 6 * PER_ROUND**0.5 + 20) / r["count"] * HASHES) + 1)
            out += sure.where((F.col("giver") == r["giver"]) & (F.col("value") == r["value"]) & (h < limit)).orderBy(h, "uid").limit(PER_ROUND).collect()
        work.drop()
        shared.destroy()
        return out

    return found


def train(featured: DataFrame, labels: DataFrame) -> CoTrained:
    """From a written table of features."""
    slim = featured.select("doc_id", *META, "x")
    labelled = labelled_sample(slim, labels, "quality", SAMPLE).orderBy("doc_id").toArrow().to_pydict()
    work = Workspace(featured.sparkSession, "co-training")
    # The pool: trainable documents without a label of their own.
    pool = slim.where(trainable(F.col("doc_id"))).join(labels.where(F.col("quality").isNotNull()).select("doc_id").distinct(), "doc_id", "left_anti")
    pool = work.write(pool.select("x", *META).withColumn("uid", F.monotonically_increasing_id()), "pool")
    model = fit(labelled, _surest(pool))
    work.drop()
    return model


def _scored(featured: DataFrame, model: CoTrained, carry: list[str]) -> DataFrame:
    """The ``carry`` columns and score, content_score, meta_score."""
    shared = featured.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([featured.schema[c] for c in carry] + [T.StructField(c, T.DoubleType()) for c in ("score", "content_score", "meta_score")])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *map(pa.array, shared.value.score(_content(batch), _meta(batch)))], schema.names)

    return featured.select(*dict.fromkeys([*carry, "x", *META])).mapInArrow(released(run), schema)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, content_score, meta_score, kept."""
    featured = Workspace(spark, "quality-classifier").write(with_features(docs), "features")
    scored = _scored(featured, train(featured, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "content_score", "meta_score", (F.col("score") >= KEEP_FROM).alias("kept"))


def keep_by_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with the input's columns. Features are written for training and computed again for the verdict, so
    no text is written."""
    work = Workspace(spark, "quality-classifier")
    shared = spark.sparkContext.broadcast(train(work.write(with_features(docs), "features"), labels))
    work.drop()
    source = carried(docs)

    def run(batches):
        for batch in batches:
            for part in text_slices(with_text(batch)):
                row = part.column("row")
                x = _matrix([content_features(t) for t in part.column("text").to_pylist()])
                score = shared.value.score(x, {c: pc.struct_field(row, c).to_pylist() for c in META})[0]
                yield part.select(["row"]).filter(pa.array(score >= KEEP_FROM))

    return restored(source.mapInArrow(released(run), source.schema))
