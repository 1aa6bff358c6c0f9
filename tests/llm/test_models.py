"""Learned operators: exact inference against plain loops, held-out accuracy, edge rows, empty tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import gbt, langid, lmscore, quality_classifier, toxicity

from .conftest import prose

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "klmnoé"}


@pytest.fixture(scope="module")
def crf():
    texts, langs = zip(*[(prose(i, 40, a), k) for i in range(12) for k, a in ALPHABETS.items()])
    return langid.fit(list(texts), list(langs), epochs=4)


def test_language_of_words_in_switched_text(crf):
    text = prose(90, 30, ALPHABETS["aa"]) + " " + prose(91, 30, ALPHABETS["cc"])
    w = langid.features([text])
    got = [crf.labels[k] for k in crf.marginals(crf.emissions(w), w.at).argmax(axis=1)]
    assert got == ["aa"] * 30 + ["cc"] * 30
    assert crf.moves.argmax(axis=1).tolist() == [0, 1, 2]  # staying is likeliest


def test_marginals_across_blocks_match_forward_backward(crf):
    rng = np.random.default_rng(0)
    at = np.array([0, 0, 5, 305, 561, 562])
    e = rng.normal(size=(562, 3)).astype(np.float32) * 3
    got = crf.marginals(e, at)
    move = np.exp(crf.moves.astype(float))
    for a, b in zip(at[:-1], at[1:]):
        x = np.exp(e[a:b].astype(float))
        if not len(x):
            continue
        f, g = np.zeros_like(x), np.ones_like(x)
        f[0] = np.exp(crf.start) * x[0] / x[0].sum()
        for t in range(1, len(x)):
            f[t] = (f[t - 1] @ move) * x[t]
            f[t] /= f[t].sum()
        for t in range(len(x) - 1, 0, -1):
            g[t - 1] = move @ (x[t] * g[t])
            g[t - 1] /= g[t - 1].sum()
        p = f * g / (f * g).sum(axis=1, keepdims=True)
        assert np.abs(p - got[a:b]).max() < 1e-4


def test_identify_edges(spark, crf, edge_docs, edge_rows, empty_docs):
    got = langid.identify(spark, edge_docs, crf).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.n_words == 0)
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in r[1] or "") for r in edge_rows)
    assert langid.identify_languages(spark, empty_docs).count() == 0
    nobody = spark.createDataFrame([(1, "text without a known language", None)], "doc_id long, text string, lang string")
    assert langid.identify_languages(spark, nobody).first().lang_pred == "und"


def test_identify_end_to_end(spark):
    rows = [(i, prose(i, 30, a), k) for i, (k, a) in enumerate(list(ALPHABETS.items()) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify_languages(spark, docs).join(docs, "doc_id")
    assert out.where("held_out").count() > 5 and out.where("lang_pred != lang").count() == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = gbt.fit_calibrated(x[:400], y[:400])
    p = model.probability(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.9 and p.min() >= 0 and p.max() <= 1
    iso = gbt.Isotonic.fit(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert (np.diff(iso.values) >= 0).all()
    assert gbt.fit(x, np.ones(600)).probability(x[:3]) == pytest.approx([0.999] * 3, abs=1e-3)


def toxic_rows(n):
    r, rows = random.Random(4), []
    for i in range(n):
        words = prose(i, 40).split()
        if bad := i % 4 == 0:
            for _ in range(4):
                words.insert(r.randint(0, len(words)), r.choice(["zorg", "blarg", "idiot"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity.score_toxicity(spark, docs, labels).join(labels, "doc_id").where("held_out")
    assert out.count() > 100 and out.where("predicted != toxic").count() <= 2
    sample = docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label")).withColumn("part", (F.col("doc_id") % 3).cast("int"))
    whole, others = toxicity.learn_lexicons(sample)
    assert "zorg" in whole.words and len(others) == 3
    for k, found in ((None, whole), (0, others[0]), (2, others[2])):
        assert found == plain_lexicon([r for r in rows if r[0] % 3 != k])


def plain_lexicon(rows):
    n, k, before = Counter(), Counter(), defaultdict(set)
    for _, text, y in rows:
        words = toxicity.WORD.findall(text.lower())
        first = {}
        for i, w in enumerate(words):
            for unit in [w] + [w[:j] + "-" for j in range(4, 10) if j < len(w)]:
                first.setdefault(unit, words[i - 1] if i else "")
        for unit, w in first.items():
            n[unit] += 1
            if y:
                k[unit] += 1
                before[unit].add(w)
    usual = sum(r[2] for r in rows) / len(rows)
    return toxicity.choose_entries({u: (n[u], k[u], len(before[u])) for u in k}, usual)


def test_toxicity_edges(spark, edge_docs, edge_rows, empty_docs, labels):
    got = toxicity.score_toxicity(spark, edge_docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.score_toxicity(spark, empty_docs, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(spark, edge_docs, labels.limit(0)).collect()} == {0.5}
    kinds = toxicity.Kinds(toxicity.Lexicon(frozenset(["idiot"]), frozenset(["blarg"])))
    named = lambda text: dict(zip(toxicity.NAMES, toxicity.features(text, kinds)))
    hidden = named("you are an 1d10t and an i.d.i.o.t")
    assert hidden["disguised_hits"] == 2 and hidden["spaced_hits"] == 1 and hidden["lexicon_kinds"] == 0
    assert named("hey you idiot")["near_you"] == 1 and named("the IDIOT!")["shouted"] == 0.5
    assert named("blargs, Blargen and blarg")["stem_kinds"] == 2 and named("A b! c?")["punctuation"] == pytest.approx(2 / 7)
    assert set(named(None).values()) == {0.0}


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 7] = 1
    model = gbt.fit(x, y, rounds=1, depth=1)
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
    gains = {(f, c): part(x[:, f] <= c) + part(x[:, f] > c) for f in range(3) for c in range(11) if 10 <= (x[:, f] <= c).sum() <= 290}
    best = max(gains, key=gains.get)
    assert best == (int(model.feature[0][0]), model.cut[0][0])
    for side, leaf in ((x[:, best[0]] <= best[1], 0), (x[:, best[0]] > best[1], 1)):
        assert model.leaf[0][leaf] == pytest.approx(0.2 * g[side].sum() / (h[side].sum() + 2.0))


def test_quality_held_out(spark):
    rows = [(i, prose(i, 60) if i % 5 else prose(i, 60).replace(" ", "### "), "en", f"s{i % 3}", 400) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 500, 2)], "doc_id long, quality int")
    out = quality_classifier.classify(spark, docs, labels)
    assert out.where(F.col("kept") != (F.col("doc_id") % 5 > 0)).count() == 0
    kept = quality_classifier.keep_by_quality(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == 400


def test_co_training_by_a_plain_version(spark, monkeypatch):
    r = random.Random(8)
    texts = {i: prose(i, 60) if i % 4 else prose(i, 60).replace(" ", r.choice(["### ", " ", "$$ "])) for i in range(400)}
    rows = [(i, t, "en" if i % 4 else r.choice(["en", "de"]), f"s{i % 3}" if i % 4 else "s9", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = [(i, int(i % 4 > 0)) for i in range(0, 400, 3)]
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    view = lambda some: {"x": [quality_classifier.content_features(x[1]) for x in some], "lang": [x[2] for x in some], "source": [x[3] for x in some], "n_chars": [x[4] for x in some]}
    teach = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    known = [x for x in teach if x[0] in dict(given)]
    pool = [x for x in teach if x[0] not in dict(given)]
    labelled, free = view(known) | {"label": [dict(given)[x[0]] for x in known]}, view(pool)
    rounds = []

    def surest(model, taken):
        found = []
        for giver, p in enumerate((model.content.probability(np.array(free["x"])), model.meta.probability(model.meta_view(free)))):
            for value, sure in ((1, p), (0, 1 - p)):
                found += [{"uid": pool[i][0], "giver": giver, "value": value} | {c: free[c][i] for c in free} for i in range(len(pool)) if sure[i] >= quality_classifier.SURE and pool[i][0] not in taken[1 - giver]]
        rounds.append(len(found))
        return found

    want = quality_classifier.fit(labelled, surest)
    assert rounds[0] > 50 and max(rounds) < quality_classifier.PER_ROUND
    got = {x.doc_id: x.score for x in quality_classifier.classify(spark, docs, labels).collect()}
    some = view(rows)
    assert [got[x[0]] for x in rows] == pytest.approx(want.score(np.array(some["x"]), some)[0].tolist(), abs=1e-9)


def test_quality_edges(spark, edge_docs, edge_rows, empty_docs, labels):
    got = quality_classifier.classify(spark, edge_docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classify(spark, empty_docs, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(spark, edge_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality_classifier.keep_by_quality(spark, edge_docs, labels)
    assert kept.columns == edge_docs.columns and {tuple(map(str, r)) for r in kept.collect()} <= {tuple(map(str, r)) for r in edge_docs.collect()}
    assert quality_classifier.keep_by_quality(spark, empty_docs, labels).count() == 0


def plain_losses(rows):
    """Per (doc_id, text, good) row the losses of both models, counted anew without the row and its copies."""
    said = [tuple(lmscore.tokens(t)) for _, t, _ in rows]
    size = max(1, len({w for s in said for w in s}))
    out = []
    for own in said:
        words, pairs = ([Counter(), Counter()] for _ in range(2))
        for s, (_, _, good) in zip(said, rows):
            if s != own:
                m = 0 if good else 1
                words[m].update(s)
                pairs[m].update(zip((None, *s), s))
        total = [sum(w.values()) for w in words]
        losses = []
        for m in (0, 1):
            used, followers, loss = Counter(), Counter(), 0.0
            for (x, _), n in pairs[m].items():
                used[x] += n
                followers[x] += 1
            for x, y in zip((None, *own), own):
                shared = (words[0][y] + words[1][y] + 1) / (sum(total) + size)
                uni = (words[m][y] + lmscore.PRIOR * shared) / (total[m] + lmscore.PRIOR)
                rest = min(1.0, max(1e-6, lmscore.DISCOUNT * followers[x] / used[x])) if used[x] else 1.0
                loss -= math.log(max(0.0, pairs[m][x, y] - lmscore.DISCOUNT) / max(1, used[x]) + rest * uni)
            losses.append(loss / len(own) if own else None)
        out.append((len(own), *losses))
    return out


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_losses_without_the_document_by_brute_force(spark, edge_docs, edge_rows, empty_docs, labels, monkeypatch, chunk):
    if chunk == 50:
        monkeypatch.setattr(lmscore, "CHUNK", 50)
        monkeypatch.setattr(lmscore, "BUCKET", 500)
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    rows = [(r[0], r[1], r[0] in good) for r in edge_rows]
    key = lambda r: (r[0] is not None, r[0], r[1], r[2] is not None and round(r[2], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.cross_entropy_difference(spark, edge_docs.repartition(3), labels).collect()), key=key)
    want = sorted(((r[0], *x) for r, x in zip(rows, plain_losses(rows))), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2:] == (pytest.approx(w[2], abs=1e-9), pytest.approx(w[3], abs=1e-9)) if w[2] is not None else g[2:] == (None, None)
    assert lmscore.cross_entropy_difference(spark, empty_docs, labels).count() == 0


def test_a_label_does_not_change_the_own_score(spark):
    r = random.Random(3)
    kinds = ["red green blue", "one two three"]
    rows = [(i, " ".join(r.choice(kinds[i % 2].split()) for _ in range(40))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1].upper())]  # copies vouch for nothing either
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda ids: spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    most = [i for i in range(2, 60, 2)]
    score = lambda ids: {x.doc_id: x.score for x in lmscore.cross_entropy_difference(spark, docs, label(ids)).collect()}
    without, alone, copied = score(most), score([*most, 0]), score([*most, 0, 100])
    for i in (0, 100, 101):
        assert without[i] == pytest.approx(alone[i], abs=1e-12) == pytest.approx(copied[i], abs=1e-12)
    assert max(without[i] for i in range(0, 60, 2)) < min(without[i] for i in range(1, 60, 2))


def test_rare_words_count(spark):
    """A word that stands in one other document of each kind moves the score; nothing rare is folded away."""
    rows = [(0, "common words here zyxt"), (1, "common words there zyxt"), (2, "common words there abcd"), (3, "common words here abcd"), (4, "zyxt"), (5, "abcd")]
    got = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")).collect()}
    assert got[4] < got[5]


def test_pieces_are_spread_over_the_whole_text():
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000]}" for i in range(9000))
    words, got = text.split(), langid.spread_pieces(text).split()
    assert len(got) == langid.PIECES * langid.PIECE_WORDS and got[0] == words[0] and got[-1] == words[-1]
    assert langid.spread_pieces("a short text") == "a short text"
