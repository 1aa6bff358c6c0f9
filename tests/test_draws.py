"""Draws with replacement, samples per group, ranks of groups."""

import math

from pyspark.sql import functions as F

from rasterloom.operators import splits


def test_draws_are_exact_in_number_and_follow_the_weights(spark):
    weights = {i: w for i, w in enumerate([1.0, 2.0, 0.0, None, float("nan"), -3.0, 5.0, 0.5, 1e-12] + [0.01] * 50)}
    frame = spark.createDataFrame(list(weights.items()), "id long, w double")
    n, clean = 30_000, {i: w for i, w in weights.items() if w and w > 0}
    got = splits.weighted_draws(frame, "w", "id", n, 7)
    assert got.columns == ["draw", "id", "w"]
    found = got.collect()
    assert sorted(r.draw for r in found) == list(range(n))
    seen = {}
    for r in found:
        seen[r.id] = seen.get(r.id, 0) + 1
    whole = sum(clean.values())
    assert set(seen) <= set(clean)
    for i, w in clean.items():
        p = w / whole
        assert abs(seen.get(i, 0) - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1
    again = splits.weighted_draws(frame.repartition(7), "w", "id", n, 7)
    assert {(r.draw, r.id) for r in again.collect()} == {(r.draw, r.id) for r in found}
    assert {(r.draw, r.id) for r in splits.weighted_draws(frame, "w", "id", n, 8).collect()} != {(r.draw, r.id) for r in found}


def test_draws_of_copies_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1.0)] * 30 + [(2, 1.0)], "id long, w double")
    got = splits.weighted_draws(frame, "w", "id", 3100, 1).groupBy("id").count().collect()
    assert sum(r["count"] for r in got) == 3100 and 40 < {r.id: r["count"] for r in got}[2] < 170
    assert splits.weighted_draws(frame.limit(0), "w", "id", 10, 1).count() == 0 and splits.weighted_draws(frame, "w", "id", 0, 1).count() == 0


def test_sample_each_is_uniform_and_independent_of_partitions(spark):
    frame = spark.range(4000).select("id", F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"))
    got = splits.sample_each(frame, "g", "id", 20, 3)
    sizes = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert sizes["hot"] == 20 and all(v == 20 for v in sizes.values())
    chosen = {r.id for r in got.collect()}
    assert chosen == {r.id for r in splits.sample_each(frame.repartition(9), "g", "id", 20, 3).collect()} and chosen != {r.id for r in splits.sample_each(frame, "g", "id", 20, 4).collect()}
    mean = sum(i for seed in range(12) for i in (r.id for r in splits.sample_each(frame.where("g = 'hot'"), "g", "id", 20, seed).collect())) / 240
    assert abs(mean - 1500) < 5 * 866 / math.sqrt(240)
    few = splits.sample_each(frame.where("id < 5"), "g", "id", 20, 3)
    assert few.count() == 5


def test_hold_out_by_ranks(spark):
    frame = spark.range(500).select(F.concat(F.lit("g"), (F.col("id") % 37).cast("string")).alias("g"))
    held = splits.hold_out_groups(frame, "g", 0.15)
    groups = held.groupBy("g").agg(F.count_distinct("is_validation").alias("k"), F.first("is_validation").alias("v")).collect()
    assert all(r.k == 1 for r in groups) and sum(r.v for r in groups) == round(0.15 * 37)
    first = sorted((r.g for r in groups), key=lambda g: __import__("hashlib").md5(g.encode()).hexdigest())[: round(0.15 * 37)]
    assert {r.g for r in groups if r.v} == set(first)
    assert sum(r.is_validation for r in splits.hold_out_groups(spark.createDataFrame([("a",)], "g string"), "g").collect()) == 1
