"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, how near a second-person pronoun stands to them,
shares of capitals and punctuation, and rates of obfuscation (digits or signs for letters, spaced or
stretched spellings of lexicon words). The lexicon is a short fixed list and the words and word beginnings that the
labelled sample shows to mark toxic documents, so that inflected forms count. Trees and calibration are fitted on a bounded sample
of labelled rows, whose texts are read whole and stay on the executors: the driver gets counts of lexicon candidates and
dense features. Each third of the sample has features by a lexicon learned from the other two.

Jobs for fitting run while the query is built. Defined results: a null or empty text has all-zero features and gets their score. If no label
is known every score is 0.5. Labels that are null or not 0/1 teach nothing. Extra columns, whatever their names, are ignored;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import PieceCache, Workspace, held_out, labelled_sample, released, text_slices

#: Fitting sample: at most so many labelled documents.
SAMPLE = 8_000
TOXIC_FROM = 0.7
#: Lexicon: toxic documents that an entry needs, the least share of toxic ones (lower Wilson bound at Z), lengths of beginnings.
LEAST, SURETY, Z, STEMS, PARTS = 5, 0.4, 1.64, range(4, 10), 3

#: Seed lexicon and second-person pronouns (English, German, French, Spanish).
SEEDS = frozenset("idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting dumb dumbass bastard bitch asshole cretin imbecile vermin filth idiota estúpido imbécil basura dummkopf abschaum trottel connard abruti ordure débile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vos".split())
NEAR = 5

WORD = re.compile(r"[^\W\d_]+")
#: A letter, signs or digits in its place, a letter or digit; the rest of the word stands on either side.
DISGUISED = re.compile(r"[a-zA-Z][0-9@$!*.\-_]+[a-zA-Z0-9]")
MASKED = re.compile(r"[a-zA-Z0-9@$!*.\-_]+")
SPACED = re.compile(r"\b(?:[a-zA-Z][ .\-_*]){2,}[a-zA-Z]\b")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
UNMASK = str.maketrans("013457@$!", "oieastasi", "*.-_ ")

NAMES = ("words", "lexicon", "lexicon_rate", "lexicon_kinds", "stems", "stem_rate", "stem_kinds", "near_you", "near_you_rate", "you_rate", "capitals", "shouted", "punctuation", "exclaimed", "disguised_hits", "disguised_rate", "spaced_hits", "stretched")


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """By code point: 1 upper case, 2 ASCII punctuation, 3 exclamation mark, 4 letter."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 4
        elif 32 < i < 127 and not c.isalnum():
            out[i] = 3 if c == "!" else 2
    return out


@dataclass
class Lexicon:
    words: frozenset[str] = SEEDS
    stems: frozenset[str] = frozenset()

    def kind(self, word: str) -> int:
        """2 for a word of the lexicon, 1 for one that begins with a stem, else 0."""
        return 2 if word in self.words else int(any(word[:k] in self.stems for k in STEMS if k < len(word)))


class Kinds(PieceCache):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def make(self, key: str) -> int:
        return self.lexicon.kind(key)


def features(text: str | None, kinds: Kinds) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    kinds.turn()
    words = WORD.findall(text)
    low = [w.lower() for w in words]
    n, chars = max(1, len(low)), len(text)
    found = np.fromiter(map(kinds.__getitem__, low), np.int8, len(low))
    places = np.flatnonzero(found)
    hit = [low[i] for i in places if found[i] == 2]
    begun = [low[i] for i in places if found[i] == 1]
    near = sum(not SECOND_PERSON.isdisjoint(low[max(0, i - NEAR) : i + NEAR + 1]) for i in places.tolist())
    you = sum(map(SECOND_PERSON.__contains__, low))
    upper, sign, bang, lower = np.bincount(_signs()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=5)[1:].tolist()
    masked = []
    for m in DISGUISED.finditer(text):
        a = m.start()
        while a and text[a - 1].isalnum():
            a -= 1
        masked.append(MASKED.match(text, a)[0].lower() if MASKED.match(text, a) else m[0].lower())
    unmasked = sum(kinds.lexicon.kind(m.translate(UNMASK)) == 2 and m.strip(".-_*!$@") not in kinds.lexicon.words for m in masked)
    spaced = sum(m.lower().translate(UNMASK) in kinds.lexicon.words for m in SPACED.findall(text))
    return [
        math.log1p(len(low)), math.log1p(len(hit)), len(hit) / n, float(len(set(hit))), math.log1p(len(begun)), len(begun) / n, float(len(set(begun))),
        float(near), near / max(1, len(places)), you / n, upper / max(1, upper + lower), sum(len(w) > 1 and w.isupper() for w in words) / n,
        (sign + bang) / chars, bang / chars, float(unmasked), len(masked) / n, float(spaced), sum(1 for _ in STRETCHED.finditer(text)) / n,
    ]


def units(text: str | None) -> dict[str, int]:
    """Distinct words, and beginnings of longer words (marked by ``-``), each with a hash of the word before its first place."""
    out: dict[str, int] = {}
    before = ""
    for word in WORD.findall((text or "").lower()):
        mark = None
        for unit in (word, *(f"{word[:k]}-" for k in STEMS if k < len(word))):
            if unit not in out:
                mark = mark if mark is not None else xxhash.xxh3_64_intdigest(before.encode()) >> 1
                out[unit] = mark
        before = word
    return out


def _bound(k: int, n: int) -> float:
    p = k / n
    return (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def choose_entries(counts: dict[str, tuple[int, int, int]], usual: float) -> Lexicon:
    """From unit -> (documents, toxic ones, different words before it there): units that mark toxic documents. They must follow as many
    different words, so that copies of one toxic document don't teach its vocabulary."""
    good = {u for u, (n, k, before) in counts.items() if k >= LEAST and before >= LEAST and _bound(k, n) > max(SURETY, 2 * usual)}
    return Lexicon(frozenset(u for u in good if u[-1] != "-") | SEEDS, frozenset(u[:-1] for u in good if u[-1] == "-"))


@dataclass
class ToxicityModel:
    lexicon: Lexicon = field(default_factory=Lexicon)
    trees: gbt.Boosted | None = None

    def score(self, texts: list[str | None], kinds: Kinds | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), 0.5)
        kinds = kinds or Kinds(self.lexicon)
        x = np.array([features(t, kinds) for t in texts], np.float64).reshape(len(texts), len(NAMES))
        return np.clip(self.trees.probability(x), 0, 1)


def learn_lexicons(sample: DataFrame) -> tuple[Lexicon, list[Lexicon]]:
    """From label, part and text: the lexicon of all parts, and for each part that of the others."""

    def emit(batches):
        for batch in batches:
            for part in text_slices(batch):
                for text, number in zip(part.column("text").to_pylist(), part.column("part").to_pylist()):
                    found = units(text)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([number] * len(found), pa.int32()), pa.array(found.values(), pa.int64())], ["unit", "part", "before"])

    # Units of enough toxic documents first: their number is bounded by the sample, and all others need not be counted.
    marked = sample.where("label = 1").select("text", "part").mapInArrow(released(emit), "unit string, part int, before long")
    toxic: dict[str, list] = defaultdict(lambda: [[0, set()] for _ in range(PARTS)])
    common = marked.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("k"), F.slice(F.collect_set("before"), 1, LEAST).alias("before"))
    enough = common.groupBy("unit").agg(F.sum("k").alias("all"), F.collect_list(F.struct("part", "k", "before")).alias("each")).where(F.col("all") >= LEAST)
    for row in enough.toLocalIterator():
        for x in row["each"]:
            toxic[row["unit"]][x["part"]] = [x["k"], set(x["before"])]
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(toxic))

    def count(batches):
        counts = np.zeros((len(wanted.value), PARTS), np.int64)
        number = {u: i for i, u in enumerate(sorted(wanted.value))}
        for batch in batches:
            for part in text_slices(batch):
                for text, p in zip(part.column("text").to_pylist(), part.column("part").to_pylist()):
                    counts[[number[u] for u in wanted.value.intersection(units(text))], p] += 1
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(counts[some, p]) for p in range(PARTS))], ["unit", *(f"n{p}" for p in range(PARTS))])

    shape = "unit long, " + ", ".join(f"n{p} long" for p in range(PARTS))
    sums = sample.select("text", "part").mapInArrow(released(count), shape).groupBy("unit").agg(*(F.sum(f"n{p}").alias(f"n{p}") for p in range(PARTS))).collect()
    names = sorted(toxic)
    every = {names[r["unit"]]: [r[f"n{p}"] for p in range(PARTS)] for r in sums}
    rates = {r["part"]: (r["n"], r["y"]) for r in sample.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()}

    def chosen(parts: list[int]) -> Lexicon:
        n, y = (sum(rates.get(p, (0, 0))[i] for p in parts) for i in (0, 1))
        return choose_entries({u: (sum(every[u][p] for p in parts), sum(toxic[u][p][0] for p in parts), len(set().union(*(toxic[u][p][1] for p in parts)))) for u in toxic}, y / max(1, n))

    return chosen(list(range(PARTS))), [chosen([p for p in range(PARTS) if p != k]) for k in range(PARTS)]


def fit(sample: DataFrame) -> ToxicityModel:
    """From a bounded sample of doc_id, text and label, read three times; written by the caller."""
    sample = sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int"))  # copies share a part
    whole, others = learn_lexicons(sample)

    def dense(batches):
        kinds = [Kinds(x) for x in others]
        for batch in batches:
            for part in text_slices(batch):
                x = [features(t, kinds[p]) for t, p in zip(part.column("text").to_pylist(), part.column("part").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(released(dense), f"doc_id {kind}, label int, x array<double>").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return ToxicityModel(whole)
    x = np.array(rows.column("x").to_pylist(), np.float64)
    return ToxicityModel(whole, gbt.fit_calibrated(x, rows.column("label").to_numpy().astype(np.float64)))


def score_documents(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. One scan, no shuffle."""
    shared = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        kinds = Kinds(shared.value.lexicon)
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(part.column("text").to_pylist(), kinds))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(released(score), f"doc_id {id_type}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    work = Workspace(spark, "toxicity", SAMPLE)
    model = fit(work.write(labelled_sample(docs.select("doc_id", "text"), labels, "toxic", SAMPLE), "sample"))
    work.drop()
    return score_documents(spark, docs, model)
