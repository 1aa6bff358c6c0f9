"""Quantiles from histograms against Spark's percentile, bit for bit."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import order_stats


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else struct.pack(">d", x)


def both_ways(frame, keys, wanted):
    got = order_stats.quantiles(frame, keys, wanted, count="n").collect()
    want = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.percentile(F.col(c).cast("double") + 0.0, p).alias(name) for c, named in wanted.items() for name, p in named.items())).collect()
    shown = lambda rows: {tuple(r[k] for k in keys): (r["n"], *(bits(r[name]) for named in wanted.values() for name in named)) for r in rows}
    assert len(got) == len(want) and shown(got) == shown(want)


def values(kind, r, n):
    draw = {
        "normal": lambda: r.gauss(0, 1), "wide": lambda: r.choice((-1, 1)) * math.exp(r.uniform(-700, 700)), "narrow": lambda: 100 + r.random() * 1e-9, "ties": lambda: float(r.randint(-3, 3)),
        "odd": lambda: r.choice((0.0, -0.0, float("inf"), -float("inf"), float("nan"), 5e-324, -5e-324, 1.7e308, None, 1.0)), "nulls": lambda: None,
    }[kind]
    return [draw() for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    out = [(kind, size, v, w) for kind in ("normal", "wide", "narrow", "ties", "odd", "nulls") for size in (1, 2, 3, 10, 401) for v, w in zip(values(kind, r, size), values("normal", r, size))]
    out += [(None, 7, v, v) for v in values("normal", r, 20)]
    return spark.createDataFrame(out, "kind string, size int, v double, w double").repartition(6).cache()


def test_groups_of_every_kind(rows):
    both_ways(rows, ["kind", "size"], {"v": {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}, "w": {"w82": 0.82, "w65": 0.65}})


def test_one_hot_group_and_no_keys(rows, spark):
    hot = spark.range(30_000).select(F.lit("hot").alias("kind"), ((F.xxhash64("id") % 1_000_003) / 997).alias("v"))
    both_ways(hot.unionByName(rows.select("kind", "v")), ["kind"], {"v": {"mid": 0.5, "p95": 0.95}})
    both_ways(hot.select("v"), [], {"v": {"mid": 0.5}})


def test_no_rows(rows, spark):
    none = rows.where("false")
    assert order_stats.quantiles(none, ["kind"], {"v": {"mid": 0.5}}).count() == 0
    assert order_stats.quantiles(none, [], {"v": {"mid": 0.5}}).collect()[0]["mid"] is None


def test_buckets_keep_the_order(spark):
    r = random.Random(1)
    found = sorted(v for v in values("wide", r, 3000) + values("narrow", r, 500) + values("odd", r, 50) if v is not None and not math.isnan(v))
    frame = spark.createDataFrame([(v,) for v in found], "v double").select(order_stats.log_bucket(F.col("v")).alias("b"))
    seen = [x.b for x in frame.collect()]
    assert seen == sorted(seen) and max(map(abs, seen)) == 300_000


def test_a_hot_group_is_counted_before_the_shuffle(spark):
    """Shuffled rows follow the buckets, not the rows; of the second reading only the rank's own bucket is shuffled."""
    hot = spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("k"), (F.rand(7) * 100).alias("v")).checkpoint()
    found = order_stats.quantiles(hot, ["k"], {"v": {"mid": 0.5}})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0] and "partial_count" in plan
    buckets = hot.select(order_stats.log_bucket(F.col("v")).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 0.01 * 200_000
