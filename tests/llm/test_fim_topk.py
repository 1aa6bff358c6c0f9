"""Fill-in-middle and exact top-k search against brute force, edge rows included."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import fim, topk

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by lists of units."""
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x0b\x0c\r\x1cé漢🙂\x85"), max_size=80), st.integers(1, 5), st.integers(1, 9))
def test_index_finds_every_boundary(text, stride, window):
    data = np.frombuffer(text.encode(), np.uint8)
    units = UNIT.findall(text)
    index = fim.UnitIndex(data, stride, window)
    assert index.n == len(units)
    for i in range(len(units) + 1):
        head = "".join(units[:i])
        assert index.locate(i) == (len(head.encode()), len(head))
    assert len(index.units) <= len(units) // stride + 1 and (np.diff(index.units) == stride).all()


def test_checkpoints_grow_with_units_not_bytes():
    data = np.frombuffer(("x" * 50 + " ") .encode() * 40_000, np.uint8)
    index = fim.UnitIndex(data)
    assert index.n == 40_001 and len(index.units) == 40_001 // fim.STRIDE + 1


def test_fill_in_middle_edges(spark, edge_docs, edge_rows, empty_docs):
    more = [(i, t, None, None, None) for i, t in enumerate(["a <P> b", "<S>", "<M", "   ", "\n", "x", " x", "x ", "日本 語\n🙂 é"] * 12, 100)]
    docs = edge_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored_text(F.col("output"), F.col("form"))).collect()
    want = [(r[0], *plain_version(r[0], r[1]), r[1] or "") for r in [*edge_rows, *more]]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fim_report(empty_docs).count() == 0
    report = fim.fim_report(edge_docs).where(F.col("doc_id") == 8).first()
    assert report.restored_sha256 == hashlib.sha256(edge_rows[10][1].encode()).hexdigest()


def test_other_markers_and_shares(spark):
    docs = spark.createDataFrame([(i, f"aa{i} bb cc dd") for i in range(60)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(docs, 7, 100, 50, marks)
    got = made.withColumn("back", fim.restored_text(F.col("output"), F.col("form"), marks)).join(docs, "doc_id").collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.back == r.text for r in got)


def brute_force(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) by all pairs of usable rows."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in usable]
    out = []
    for q, (query, a) in enumerate(whole):
        if query is None or query % every:
            continue
        found = [(-sum(x * y for x, y in zip(a, b)), i is None, i, n) for n, (i, b) in enumerate(whole) if n != q]
        out += [(query, r, f[2], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0, f[3]))[:k], 1)]
    return out


def check(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, uid string")
    key = lambda r: tuple((x is not None, x) for x in r)
    got = topk.top_products(spark, frame.repartition(3), **more)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_force(rows, **more), key=key)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def vectors(n, dims, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    scale = np.exp(spread * r.normal(size=(n, 1)))
    return (scale * r.normal(size=(n, dims)) * np.linspace(1, 0.1, dims)).astype(np.float32)


def test_top_products_edges(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(160, 6))]
    hot = vectors(1, 6, 5)[0].tolist()
    rows += [(1000 + i, hot) for i in range(90)] + [(50, hot), (50, hot), (None, hot), (None, rows[3][1])]
    rows += [(200, None), (250, [float("nan")] * 6), (300, [1.0, None] + [0.0] * 4), (350, [float("inf")] + [0.0] * 5), (400, []), (450, [0.0] * 6), (500, [2.0, -1.0]), (550, [1.0] * 9)]
    rows += [(-50, [-3.0] * 6)]
    check(spark, rows)
    check(spark, rows, k=1)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(50, [1.0]), (51, [2.0])], [(1, [1.0]), (2, [2.0])], [(50, None)], [(50, []), (100, [])]])
def test_top_products_of_few_rows(spark, rows):
    check(spark, rows)


def test_blocks_and_streams_of_any_size(spark, monkeypatch):
    """Workers get the sizes through closures or defaults of the driver, so small ones exercise many blocks."""
    rows = [(10 * i, v.tolist()) for i, v in enumerate(vectors(400, 12, 3))]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * 12 * 25)
    check(spark, rows, every=20)


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.uniform(-1, 1, 4) * 2.0**e]) for i, e in enumerate([21] * 60 + [0] * 60)]
    check(spark, rows, every=10)
    with pytest.raises(ValueError, match="components"):
        check(spark, [(50, [1.0] * 5000), (51, [1.0, 1.0])])
    with pytest.raises(Exception, match="squared length"):
        check(spark, [(50, [1e30, 0.0]), (51, [1.0, 1.0])])


def test_bounds_spare_most_pairs():
    """On vectors of unlike lengths with a few strong directions most pairs are ended by bounds; the result is that of all pairs."""
    x = np.floor(256 * vectors(6000, 32, 2).astype(float) * np.geomspace(1, 0.02, 32)).astype(np.int64)
    x = x[np.argsort(-np.square(x).sum(axis=1), kind="stable")]
    ids = np.arange(len(x))
    whole = topk.Block(ids, np.ones(len(x), bool), ids, x)
    gram = x.T.astype(float) @ x
    basis, weights, _ = np.linalg.svd(gram, hermitian=True)
    share = np.cumsum(weights) / weights.sum()
    cuts = sorted({int(np.searchsorted(share, c)) + 1 for c in topk.CUTS} - {32})
    queries = topk.QueryBlock(whole.where(ids % 50 == 0), basis, cuts, 5)
    for i in range(0, len(x), 500):
        queries.meet(whole.where(slice(i, i + 500)))
    assert queries.pairs == 120 * 6000 and queries.scored < 0.15 * queries.pairs
    for row, q in enumerate(ids[ids % 50 == 0]):
        scores = x @ x[q]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert list(zip(-queries.scores[row], queries.ids[row])) == best
