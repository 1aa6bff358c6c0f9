"""The n-gram Jaccard join and the components against brute force; the pipeline end to end."""

import os
import random
import threading
import re

import pytest

from rasterloom.llm import ngram_join, shingles
from rasterloom.llm.common import Workspace, checkpoint_root, made_by, raw_texts
from rasterloom.llm.components import components

from .conftest import SCHEMA, prose


def brute_sets(texts):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    sets = brute_sets([r[1] for r in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and sets[j] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, docs).collect()), key=str)


def edited(text, n, r):
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(["zz", "yy", "xx"]) + str(r.randrange(5))
    return " ".join(words)


def test_edge_rows(spark, edge_docs, edge_rows, empty_docs):
    rows = [(r[0], r[1]) for r in edge_rows]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, edge_docs).collect()), key=str)
    assert got == brute_components(rows)
    assert ngram_join.jaccard_components(spark, empty_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_all_degrees(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(6):
        base = prose(seed * 100 + g, r.choice([5, 12, 60, 150]))
        rows += [(len(rows) + k, edited(base, r.randrange(0, 6), r)) for k in range(12)]
    assert run(spark, rows) == brute_components(rows)


def test_a_large_group_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 8)  # the long-list path on a small fixture
    r = random.Random(5)
    base, passage = prose(50, 100), prose(51, 60)
    rows = [(k, edited(base, r.randrange(0, 9), r)) for k in range(60)] + [(100 + k, prose(900 + k, 60) + " " + passage) for k in range(30)] + [(200 + k, prose(300 + k, 30)) for k in range(10)]
    r.shuffle(rows)
    assert run(spark, rows) == brute_components(rows)


def test_shingle_sets_match_words():
    import pyarrow as pa

    texts = ["a b c d", "A  B\tc\nd e", "", None, "one two", " x ", "a b c d a b c d a b c d", "é É ß ẞ 日本", "q" * 300, "a\x1cb c\x85d e f"]
    got = shingles.shingle_sets(*raw_texts(pa.array(texts)), 4)
    want = brute_sets(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    name = {k: r.getrandbits(62) for k in range(400)}
    edges = [(k, k + 1) for k in range(150)] + [(200, 200 + k) for k in range(1, 100)] + [(350, 351), (351, 350), (351, 352)]
    frame = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long")
    label = {x.node: x.label for x in components(Workspace(spark, "t"), frame, "t").collect()}
    assert len({label[name[k]] for k in range(151)}) == 1 and len({label[name[200 + k]] for k in range(100)}) == 1
    assert len(set(label.values())) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    rows = []
    for i in range(400):
        text = prose(i, 90)
        rows.append((i, text if i % 10 else text.replace(" ", "### "), "en", f"s{i % 2}", len(text)))
    rows += [(1500, rows[3][1], "en", "s0", 1), (1501, rows[3][1].upper(), "en", "s1", 1), (1502, edited(rows[5][1], 1, r), "en", "s0", 1), (1503, "short", "en", "s0", 5), (1504, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        left.append({x.doc_id for x in docs.select("doc_id").collect()})
    clean = {i for i in range(400) if i % 10}
    assert clean <= left[0] and not set(range(0, 400, 10)) & left[0]
    assert clean <= left[1] and 1503 not in left[1] and 1504 not in left[1]
    assert left[2] == (left[1] - {3, 1500}) and 1501 in left[2]
    assert left[3] == left[2] - {1502}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == left[3]


def test_results_of_a_stage_outlive_each_other(spark, tmp_path):
    """Stages own nothing of what earlier calls returned, in this thread or another."""
    import corpus_pipeline

    rows = [(i, prose(i % 30, 60), "en", f"s{i % 2}", 400) for i in range(60)]
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        first, second = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(40), str(tmp_path))
        assert first.count() >= second.count() > 0 or name == "quality_rules", name
        assert first.count() == stage(spark, docs, str(tmp_path)).count(), name


def test_made_by_sees_its_own_thread_only(spark):
    found, other = [], threading.Thread(target=lambda: Workspace(spark, "other"))
    with made_by() as made:
        own = Workspace(spark, "own")
        other.start()
        other.join()
        with made_by() as inner:
            nested = Workspace(spark, "nested")
        found = list(made)
    assert found == [own] and inner == [nested]
    Workspace(spark, "later")
    assert made == [own]


def test_pipeline_frees_what_it_made(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(i, 60), "en", "s", 400) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    new = set(os.listdir(root)) - before
    assert len(new) == 1 and next(iter(new)).startswith("corpus-pipeline") and [x for x in os.listdir(f"{root}/{next(iter(new))}")] == ["packing"]
    assert packed.count() >= 0


@pytest.mark.parametrize("long", [64, 8])
def test_near_copies_of_the_pipeline_share_80_per_cent_of_five_word_shingles(spark, monkeypatch, long):
    import corpus_pipeline

    monkeypatch.setattr(ngram_join, "LONG", long)
    r = random.Random(7)
    rows = []
    for g in range(3):
        base = prose(700 + g, 100)
        rows += [(len(rows) + k, edited(base, r.randrange(0, 5), r)) for k in range(25)]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.lower().split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(label)
    assert got != {x.doc_id for x in ngram_join.drop_near_duplicates(spark, docs).collect()}


def test_near_copies_are_dropped_by_row(spark):
    base, other, third = prose(1, 90), prose(2, 90), prose(3, 90)
    near = lambda text, k: " ".join([*text.split(" ")[:-1], f"end{k}"])
    rows = [(1, base), (5, near(base, 1)), (5, other), (None, third), (None, near(third, 1)), (None, near(third, 2)), (None, near(base, 2)), (7, near(other, 1)), (7, near(other, 1)), (8, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in ngram_join.drop_near_duplicates(spark, docs).collect()]
    assert len(got) == 5 and {(1, base), (5, other), (8, ""), (None, None)} <= set(got)
    assert sum(x is None and bool(t) and t.startswith(third[:40]) for x, t in got) == 1


def test_near_duplicates_carry_rows(spark, edge_docs, empty_docs):
    kept = ngram_join.drop_near_duplicates(spark, edge_docs)
    assert kept.columns == edge_docs.columns and {tuple(map(str, r)) for r in kept.collect()} <= {tuple(map(str, r)) for r in edge_docs.collect()}
    assert ngram_join.drop_near_duplicates(spark, empty_docs).count() == 0


def test_pipeline_on_edge_rows_and_on_empty_tables(spark, edge_docs, empty_docs, labels, tmp_path):
    import corpus_pipeline

    for name, docs, known in (("edge", edge_docs.drop("label"), labels), ("empty", empty_docs, labels.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        known.write.parquet(str(tmp_path / name / "labels.parquet"))
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "edge")
