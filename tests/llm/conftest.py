import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators return or use.
CLASH = ", kept boolean, score double, label int, part long, token long, node long, ids string"
INNER = ("row", "rule", "fence", "fp", "sha", "body", "uid", "keep_uid", "x", "l", "s", "slice", "prefix", "__fp", "__uid", "__body", "__rule", "__kept", "__score", "__slot", "__shard", "base_failed", "a.b")
CLASH += "".join(f", `{c}` string" for c in INNER)


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(words)]
    return ". ".join(" ".join(out[i : i + 9]).capitalize() for i in range(0, words, 9))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, odd characters."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", None), (4, base + " extra tail", None, "b"),
        (5, "", "en", "a"), (6, None, "en", "a"), (None, "only text here", None, None), (None, None, None, None), (7, " \n\t ", "de", "a"),
        (8, prose(2, 9000), "de", "hot"), (9, "İΣ'LL it's ½ Ⅷ é <|endoftext|> 日本語 🙂  x \x1c y", "fr", "b"), (10, "one two three", "fr", "b"),
        (11, "### *** $$$ " * 40, "en", "a"), (12, "12345 !!! 678", "en", "a"), (13, base.replace("a", "A", 3), "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture()
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, True, 0.5, 1, 7, 7, 7, "x", *INNER) for r in edge_rows], SCHEMA + CLASH)


@pytest.fixture()
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 14)] + [(1, 1, 0), (None, 1, 1), (2, None, None), (99, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
