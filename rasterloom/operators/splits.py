"""Group-wise splits (a group is never on two sides), draws and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranked(frame: DataFrame, group: str) -> DataFrame:
    """Distinct groups, the position of each in the order of the MD5 of its text (portable across engines), and the number of all.

    Positions are global ranks computed from per-bucket counts, so no task sees all groups.
    """
    groups = frame.where(F.col(group).isNotNull()).select(group).distinct().withColumn("__h", F.md5(F.col(group).cast("string").cast("binary")))
    groups = groups.withColumn("__b", F.substring("__h", 1, 3))
    sizes = groups.groupBy("__b").count()  # at most 4096 rows
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("count").over(Window.partitionBy(F.lit(1)))).drop("count")
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", group)) - 1
    return groups.join(F.broadcast(before), "__b").select(group, at.alias("__at"), "__all")


def splits_of_groups(frame: DataFrame, group: str, test_share: float = 0.1, folds: int = 5) -> DataFrame:
    """(group, split) for each distinct group: the first share of groups in the order of a hash is ``test``, the rest go
    round-robin to ``fold0`` .."""
    cut = F.bround(F.col("__all") * test_share).cast("long")
    named = F.when(F.col("__at") < cut, F.lit("test")).otherwise(F.concat(F.lit("fold"), ((F.col("__at") - cut) % folds).cast("string")))
    return _ranked(frame, group).select(group, named.alias("split"))


def group_split(frame: DataFrame, group: str, test_share: float = 0.1, folds: int = 5) -> DataFrame:
    """``frame`` with ``split`` as ``splits_of_groups`` has it."""
    return frame.join(splits_of_groups(frame, group, test_share, folds), group, "left")


def seeded_group_split(frame: DataFrame, group: str, seed: int = 42, test_share: float = 0.1, folds: int = 5) -> DataFrame:
    """The same with NumPy's seeded shuffle of the sorted distinct groups, for parity with runs that used it.
    The distinct groups come to the driver: for catalogues of bounded size."""
    found = np.array(sorted(r[0] for r in frame.where(F.col(group).isNotNull()).select(group).distinct().collect()))
    np.random.default_rng(seed).shuffle(found)
    n = int(round(len(found) * test_share))
    rows = [(g, "test" if i < n else f"fold{(i - n) % folds}") for i, g in enumerate(found.tolist())]
    kind = frame.schema[group].dataType.simpleString()
    return frame.join(frame.sparkSession.createDataFrame(rows, f"{group} {kind}, split string"), group, "left")


def hold_out_groups(frame: DataFrame, group: str, share: float = 0.15) -> DataFrame:
    """``frame`` with boolean ``is_validation``: max(1, round(share * n)) groups, first by hash."""
    held = F.greatest(F.lit(1), F.bround(F.col("__all") * share).cast("long"))
    chosen = _ranked(frame, group).where(F.col("__at") < held).select(group, F.lit(True).alias("is_validation"))
    return frame.join(chosen, group, "left").withColumn("is_validation", F.coalesce("is_validation", F.lit(False)))


def select_splits(frame: DataFrame, validation_fold: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, test) by the ``split`` column; rows without a split are in none."""
    fold = f"fold{validation_fold}"
    return frame.where(~F.col("split").isin("test", fold)), frame.where(F.col("split") == fold), frame.where("split = 'test'")


def split_counts(frame: DataFrame, group: str) -> DataFrame:
    return frame.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"))


def split_leaks(frame: DataFrame, group: str) -> DataFrame:
    """One row: the largest number of splits that a group occurs in (1 if nothing leaks)."""
    return frame.groupBy(group).agg(F.count_distinct("split").alias("k")).agg(F.max("k").alias("max_splits"))


def sampling_weight(n_real: int, n_simulated: int, simulated_share: float = 0.3) -> float:
    """Weight of a simulated row so that simulated rows hold the given share of draws."""
    return simulated_share * n_real / ((1 - simulated_share) * n_simulated) if n_simulated else 1.0


def _md5(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


#: First digits of an MD5 that make a bucket, and so the number of buckets.
_DIGITS, _BUCKETS = 3, 4096


def weighted_draws(frame: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement, each with chance its weight over the sum of weights; ``draw`` numbers them from 0.

    Rows lie on a line in the order of an MD5 of seed and key, each as long as its weight; draw i falls on a point that an MD5 of seed and i
    names, and takes the row that it falls on. The line is cut into buckets by the first digits, whose lengths are added up first; then rows
    and points of a bucket are sorted together and each point takes the row that ends next. The same draws come out whatever the
    partitioning. A missing, NaN or negative weight is none; without any weight nothing is drawn.
    """
    clean = F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = frame.select(F.struct("*").alias("row"), clean.alias("w"), _md5(seed, key).alias("h")).where("w > 0").withColumn("bucket", F.substring("h", 1, _DIGITS))
    # The row as text tells rows of equal keys apart; rows equal in all columns may change places.
    upto = F.sum("w").over(Window.partitionBy("bucket").orderBy("h", F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto)
    line, along = placed.groupBy("bucket").agg(F.max("upto").alias("size")), Window.orderBy("bucket")  # a row for each bucket
    line = line.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.coalesce(F.lag("end").over(along), F.lit(0.0)))
    line = line.withColumn("whole", F.max("end").over(Window.partitionBy(F.lit(1))))
    # As many equal cells as buckets: a bucket is copied to the cells that it meets, some two on average.
    cell = lambda c: F.least(F.floor(c / F.col("whole") * _BUCKETS), F.lit(_BUCKETS - 1))
    line = line.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    share = F.conv(F.substring(_md5(seed, "draw"), 1, 13), 16, 10).cast("double") / float(1 << 52)
    points = frame.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("share", share).withColumn("cell", F.least(F.floor(F.col("share") * _BUCKETS), F.lit(_BUCKETS - 1)))
    near = points.withColumn("cell", F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1))))).join(F.broadcast(line), "cell")  # rounding may move a point by a cell
    at = F.col("share") * F.col("whole")
    points = near.where((at >= F.col("start")) & (at < F.col("end"))).select("draw", "bucket", F.least(at - F.col("start"), F.col("size")).alias("upto")).distinct()
    points = points.withColumn("row", F.lit(None).cast(placed.schema["row"].dataType))
    both = points.unionByName(placed.select(F.lit(None).cast("long").alias("draw"), "bucket", "upto", "row"))
    # Rows are looked at from the far end: the last one seen is the first that ends at or beyond the point.
    order = Window.partitionBy("bucket").orderBy(F.desc("upto"), F.col("draw").isNotNull(), F.desc("draw")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("row", F.last("row", True).over(order)).where("draw IS NOT NULL")
    return found.select("draw", "row.*")


def sample_each(frame: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each group without replacement: those whose MD5 of seed and key is least.

    Each task keeps its own k least before the shuffle, and keeping the least of two samples is again a sample, so a hot group needs no
    more than others; the choice is the same whatever the partitioning.
    """
    order = Window.partitionBy(group).orderBy(_md5(seed, key), key)
    return frame.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k).drop("__rank")
