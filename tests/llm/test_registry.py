"""Registration of the training-data queries, and their SQL on the smallest driver tables."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from rasterloom.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(__spark_entry__.queries())
    found = [int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))]
    assert found == list(range(1, 13)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    a, b = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b) and (a == b).all().all()


def test_sharding_sql_holds_the_table():
    assert oracles.sharding(["a", "b"]).count(",") > 65_000


def test_the_table_of_the_sharding_sql_by_whole_permutations():
    """Filled anew: every shard's order of preference as a list, and rounds of turns over sets of free slots."""
    size, names = 65537, queries.SHARDS
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "little")
    wishes = [iter((number(n, "offset") + (1 + number(n, "step") % (size - 1)) * np.arange(size, dtype=object)) % size) for n in names]
    owner: dict[int, int] = {}
    turn = 0
    while len(owner) < size:
        slot = next(w for w in wishes[turn % len(names)] if w not in owner)
        owner[slot] = turn % len(names)
        turn += 1
    listed = re.findall(r"\[([0-9, ]+)\]\[slot", oracles.sharding(names))[0]
    assert [int(x) for x in listed.split(", ")] == [owner[i] for i in range(size)]
