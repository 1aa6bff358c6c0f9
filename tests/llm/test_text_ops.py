"""Encoding, packing, dedup, rules and sharding against brute force, edge rows included."""

import collections
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bpe, exact_dedup, packing, quality_rules, sharding

RANK_FILE, WORD_FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
RANKS = bpe.parse_ranks(open(RANK_FILE, "rb").read())
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.TextEncoder(bpe.PrefixBPE(RANKS), P.PATTERN)
WORDS = packing.WordTokenizer(open(WORD_FILE, encoding="utf-8").read())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sted re\n\t.-=01éèß漢🙂 "), max_size=60))
def test_prefix_bpe_is_tiktoken(text):
    ids = array("I", CODER.encode(text))
    assert list(ids) == TIKTOKEN.encode_ordinary(text)
    assert CODER.bpe.decode(ids).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=8), st.integers(0, 30), st.integers(0, 30))
def test_appends_and_edits_are_exact(data, more, a, b):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    held = bpe.EditableEncoding(CODER.bpe, data)
    held.replace(a, b, more)
    held.append(more)
    whole = data[:a] + more + data[b:] + more
    assert held.data == whole and held.ids() == bpe.EditableEncoding(CODER.bpe, whole).ids()
    assert CODER.bpe.decode(held.ids()) == whole


def test_encode_documents(spark, edge_docs, edge_rows, empty_docs):
    got = bpe.encode_documents(spark, edge_docs, RANK_FILE, P.PATTERN, with_ids=True).collect()
    assert len(got) == len(edge_rows)
    want = collections.Counter()
    for r in edge_rows:
        ids = TIKTOKEN.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), tuple(ids)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bpe.encode_documents(spark, empty_docs, RANK_FILE, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'stdmrevl LE\n\t.1½éÉßΣİ_\x1c\x85日"), max_size=25), max_size=6))
def test_word_tokenizer_is_the_library(texts):
    for t, ids in zip(texts, WORDS.encode(texts)):
        assert ids.tolist() == WORDS.lib.encode(t, add_special_tokens=False).ids


def test_piece_table_survives_overflow():
    small = packing.WordTokenizer(open(WORD_FILE, encoding="utf-8").read())
    small.table = packing.PieceTable(small.dtype, limit=40)
    r = random.Random(0)
    for _ in range(30):
        texts = [" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(25)) for _ in range(3)]
        assert [x.tolist() for x in small.encode(texts)] == [WORDS.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_curve_visits_all_cells_in_steps_of_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_keys(cells, 3)
    order = np.argsort(key)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(spark, edge_docs, edge_rows, empty_docs, length):
    lib = Tokenizer.from_file(WORD_FILE)
    rows = packing.pack_documents(spark, edge_docs, WORD_FILE, length).collect()
    whole = collections.defaultdict(collections.Counter)
    for r in edge_rows:
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        whole[r[0]][ids.tobytes()] += 1
    fills = collections.defaultdict(list)
    for r in rows:
        fills[r.sequence_id].append((r.offset, r.length))
        assert any(len(b) == 4 * r.doc_tokens and zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for b in whole[r.doc_id])
    for pieces in fills.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    assert sum(r.length for r in rows) == sum(n * len(b) // 4 for c in whole.values() for b, n in c.items())
    assert packing.pack_documents(spark, empty_docs, WORD_FILE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**61 - 1), max_size=80), st.integers(0, 7))
def test_golomb_codes_round_trip(values, owner):
    span, base = 1 << 61, owner << 61
    data = np.array(sorted(base + v for v in values), np.uint64)
    bits, unary, rest = exact_dedup.golomb_encode(data, base, span)
    assert exact_dedup.golomb_decode(len(data), base, bits, unary, rest).tolist() == data.tolist()


def test_golomb_codes_of_many():
    data = np.unique(np.random.default_rng(0).integers(0, 2**63, 150_000).astype(np.uint64))
    bits, unary, rest = exact_dedup.golomb_encode(data, 0, 1 << 64)
    assert (exact_dedup.golomb_decode(len(data), 0, bits, unary, rest) == data).all() and len(unary) + len(rest) < 8 * len(data)


@pytest.mark.parametrize("bitmap_bits", [28, 8])
def test_exact_dedup(spark, edge_docs, edge_rows, empty_docs, bitmap_bits):
    got = exact_dedup.dedup_report(spark, edge_docs.repartition(3), max_bitmap_bits=bitmap_bits).collect()
    groups = collections.defaultdict(list)
    for r in edge_rows:
        groups[exact_dedup.normalise(r[1])].append(r[0])
    assert len(got) == len(edge_rows)
    by_hash = collections.defaultdict(list)
    for r in got:
        by_hash[r.text_sha256].append(r)
    for text, ids in groups.items():
        rows = by_hash[hashlib.sha256(text).hexdigest()]
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
        assert all(r.keep_id == best and r.group_size == len(ids) for r in rows)
        assert sum(r.kept for r in rows) == 1 and [r.doc_id for r in rows if r.kept] == [best]
    kept = exact_dedup.drop_exact_duplicates(spark, edge_docs)
    rows = kept.collect()
    assert len(rows) == len(groups) and kept.columns == edge_docs.columns and {tuple(map(str, r)) for r in rows} <= {tuple(map(str, r)) for r in edge_docs.collect()}
    assert exact_dedup.drop_exact_duplicates(spark, empty_docs).count() == 0
    assert exact_dedup.dedup_report(spark, empty_docs).count() == 0


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_counts(spark, edge_docs, edge_rows, empty_docs):
    extra = ["a b c a b c", "a a a a", "x\nx\n\n \nx", "a b c d a b c e b c d", "\x1fa \x85b c", ""]
    more = edge_docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(100 + i, t, "en", "a") for i, t in enumerate(extra)], "doc_id long, text string, lang string, source string"))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(spark, more).collect())
    want = collections.Counter()
    for i, t in [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(extra)]:
        c = brute_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert quality_rules.quality_report(spark, empty_docs).count() == 0


def test_adaptive_thresholds_reject_the_odd_and_keep_the_clean(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 80), "en", "s") for i in range(60)] + [(100 + i, prose(i, 80).replace(" ", "### "), "en", "s") for i in range(6)] + [(200, prose(7, 80), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_report(spark, docs).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(6)) and kept[200]
    again = {r.doc_id for r in quality_rules.keep_by_rules(spark, docs.repartition(5)).collect()}
    assert again == {k for k, v in kept.items() if v}


def test_the_same_rate_is_judged_by_the_spread_of_its_group(spark):
    from tests.llm.conftest import prose

    def signs(text, k):  # k commas more
        words = text.split(" ")
        return " ".join(w + "," if i < k else w for i, w in enumerate(words))

    rows = [(i, signs(prose(i, 90), 1 + i % 2), "en", "narrow") for i in range(200)] + [(1000 + i, signs(prose(i, 90), 2 + 3 * (i % 20)), "de", "wide") for i in range(200)]
    rows += [(500, signs(prose(500, 90), 55), "en", "narrow"), (1500, signs(prose(500, 90), 55), "de", "wide")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_report(spark, docs).collect()}
    assert not kept[500] and kept[1500] and sum(kept.values()) >= 398


def test_rules_carry_rows(spark, edge_docs, empty_docs):
    kept = quality_rules.keep_by_rules(spark, edge_docs)
    assert kept.columns == edge_docs.columns and {tuple(map(str, r)) for r in kept.collect()} <= {tuple(map(str, r)) for r in edge_docs.collect()}
    assert quality_rules.keep_by_rules(spark, empty_docs).count() == 0


def test_sketches_merge_by_adding(spark, edge_docs):
    counted = edge_docs.select("doc_id", "lang", "source", quality_rules.counts(F.col("text")).alias("rule"))
    whole = quality_rules.group_sketches(counted)
    parts = quality_rules.group_sketches(counted.where("doc_id % 2 = 0")).union(quality_rules.group_sketches(counted.where("doc_id % 2 = 1 OR doc_id IS NULL")))
    merged = parts.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in merged.collect()}


def test_shards(spark, edge_docs, empty_docs, tmp_path):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 997)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    less = sharding.fill_table(names[:-1], 997)
    stay = table != 6
    assert (table[stay] == less[stay]).mean() > 0.7
    placed = sharding.place(spark, edge_docs, "doc_id", names, 997)
    rows = placed.select("doc_id", "slot", "shard").collect()
    assert placed.columns == [*edge_docs.columns, "slot", "shard"]
    for r in rows:
        key = b"null" if r.doc_id is None else f"k{r.doc_id}".encode()
        assert r["slot"] == int(hashlib.md5(key).hexdigest()[:15], 16) % 997 and r["shard"] == names[table[r["slot"]]]
    assert len(rows) == edge_docs.count() and sharding.place(spark, empty_docs, "doc_id", names, 997).count() == 0
    sharding.write_shards(spark, edge_docs, "doc_id", names, str(tmp_path / "out"), 997)
    assert spark.read.parquet(str(tmp_path / "out")).drop("shard").count() == edge_docs.count()
    assert sharding.place(spark, placed, "doc_id", names, 997).columns == [*placed.columns, "_slot", "_shard"]
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_windows_change_nothing(monkeypatch):
    from rasterloom.llm import langid, shingles

    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcÉİß'") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (0, 400, 3, 900)] + ["x" * 3000 + " y", " " * 2000, ""]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole, ids = shingles.word_hashes(data, offsets), [x.tolist() for x in WORDS.encode(texts)]
    monkeypatch.setattr(shingles, "WINDOW", 100)
    monkeypatch.setattr(packing, "WINDOW", 50)
    cut = shingles.word_hashes(data, offsets)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert [x.tolist() for x in WORDS.encode(texts)] == ids
    crf = langid.fit(["aa ab ba", "cc dd cd"] * 20, ["x", "y"] * 20, epochs=1)
    (a, at), (b, bt) = crf.read(texts), crf.read(texts, 40)
    assert np.array_equal(a, b) and np.array_equal(at, bt)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abİσΣé'sd.,!?;:。，、！？日本語 \n\u0301½1<|"), max_size=60), st.integers(1, 6))
def test_cuts_change_no_id(text, window):
    before, packing.WINDOW = packing.WINDOW, window
    try:
        assert "".join(packing.windows(text)) == text
        assert WORDS.encode([text])[0].tolist() == WORDS.lib.encode(text, add_special_tokens=False).ids
    finally:
        packing.WINDOW = before


def test_long_pieces_are_not_remembered():
    coder = bpe.TextEncoder(bpe.PrefixBPE(RANKS), P.PATTERN)
    long = "x" * 5000
    assert coder.encode(long) == coder.encode(long) == np.array(TIKTOKEN.encode_ordinary(long), np.uint32).tobytes()
    assert not coder and coder.encode("a b") and max(map(len, coder)) < 3


def test_a_long_text_in_bounded_memory(spark):
    """Each worker handles a text of 8 MB beside others; peak growth of a fresh process stays within 40 bytes a byte."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, public_tokenizers as P
from rasterloom.llm import langid, packing, shingles
text = ("lorem ipsum dolor sit amet consetetur " * 30 + chr(10)) * 7000 if sys.argv[1] != "unspaced" else ("人類社會所有成員。" * 3 + "，天地玄黃！") * 86000
crf = langid.fit(["aa ab ba", "cc dd cd"] * 20, ["x", "y"] * 20, epochs=1)
coder = packing.WordTokenizer(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
coder.encode(["warm up"]); crf.read(["warm up"]); shingles.powers(1 << 20)
kind, before = sys.argv[1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if kind == "lang":
    e, at = crf.read([text]); crf.marginals(e, at)
elif kind in ("pack", "unspaced"):
    coder.encode([text])
else:
    shingles.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 5)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text.encode()))
"""
    for kind in ("lang", "pack", "shingles", "unspaced"):
        out = subprocess.run([sys.executable, "-c", code, kind], capture_output=True, text=True)
        assert out.returncode == 0 and float(out.stdout) < 40, (kind, out.stdout, out.stderr[-400:])
