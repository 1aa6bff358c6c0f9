"""Exact quantiles per group from mergeable histograms; no buffer grows with a group.

1. Values are counted in log-spaced buckets (``PER_OCTAVE`` to a factor of two), each with its least and largest value. The counts
   add up before the shuffle, so a hot group is spread over all tasks that read it.
2. Running counts tell which buckets hold the wanted ranks: two at most for each quantile. Only rows of these are read again, and
   counted by value.
3. Such a bucket is cut into ``PARTS`` equal parts between its least and largest value; the part that holds a rank is ordered by
   value, and the rank is read off. Neighbouring ranks may lie in different buckets.

Results are those of Spark's ``percentile`` (linear between two ranks, NaN above every number), save that zero has no sign. Nulls are left out;
a group of nulls has NULL quantiles. Null keys are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets to a factor of two, and parts that a bucket is cut into.
PER_OCTAVE, PARTS = 128, 4096
#: Bucket numbers: more than any finite double has on either side, then infinity, NaN and null.
_MIDDLE, _INFINITE, _NAN, _NULL = 140_000, 300_000, 300_001, 300_002


def log_bucket(value: Column) -> Column:
    """A number that never falls as the value rises. Logarithm, product and floor keep the order of doubles."""
    size = F.abs(value)
    finite = (F.floor(F.log2(size) * PER_OCTAVE) + _MIDDLE).cast("int")
    number = F.when(value == 0, F.lit(0)).when(size == float("inf"), F.lit(_INFINITE)).otherwise(finite)
    return F.when(value.isNull(), F.lit(_NULL)).when(F.isnan(value), F.lit(_NAN)).otherwise(F.when(value < 0, -number).otherwise(number))


def _part(value: Column, low: Column, high: Column) -> Column:
    """Of ``PARTS`` equal parts between ``low`` and ``high`` the one that holds the value; 0 where there is nothing to cut."""
    share = F.try_divide(value - low, high - low) * PARTS
    return F.coalesce(F.when(F.isnan(share), F.lit(0)).otherwise(F.least(F.floor(share), F.lit(PARTS - 1))).cast("int"), F.lit(0))


def _position(p: float) -> Column:
    return (F.col("__n") - 1).cast("double") * F.lit(float(p))


def _ranks(quantiles: list[float]) -> Column:
    """0-based ranks on both sides of each quantile's position."""
    both = [f(_position(p)).cast("long") for p in quantiles for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*both))


def _holding(counted: DataFrame, by: list[str], order: str, ranks: Column, base: Column) -> DataFrame:
    """Rows whose run of ranks holds a wanted one: ``__from`` (first rank) and ``__wanted``; ``base`` is the rank at which a group begins.
    Of a group of nulls, which has no ranks, the one row stays."""
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + base
    found = counted.withColumn("__ranks", ranks).withColumn("__upto", upto).withColumn("__from", F.col("__upto") - F.col("__c"))
    inside = F.filter("__ranks", lambda r: (r >= F.col("__from")) & (r < F.col("__upto")))
    return found.withColumn("__wanted", inside).where((F.size("__wanted") > 0) | F.col("__n").isNull()).drop("__ranks", "__upto")


def _joined(frame: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on keys that may be null; ``other``'s further columns come along."""
    named = other.withColumnsRenamed({c: f"{c}__o" for c in by})
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}__o`")) for c in by]
    return frame.join(named, on).drop(*(f"{c}__o" for c in by))


def quantiles(frame: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], count: str | None = None) -> DataFrame:
    """Keys and quantiles: ``wanted`` gives for each value column the names and shares, as in ``{"x": {"median": 0.5}}``.

    With ``count`` the number of rows, nulls included, stands under that name. Without keys the result is one row.
    """
    columns = list(wanted)
    values = F.array(*(F.struct(F.lit(i).alias("i"), (F.col(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)))
    long = frame.select(*keys, F.explode(values).alias("__x")).select(*keys, F.col("__x.i").alias("__i"), F.col("__x.v").alias("__v"))
    long = long.withColumn("__b", log_bucket(F.col("__v")))
    by = [*keys, "__i"]

    counted = long.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    whole = Window.partitionBy(*by)
    counted = counted.withColumn("__rows", F.sum("__c").over(whole)).withColumn("__n", F.sum(F.when(F.col("__b") != _NULL, F.col("__c"))).over(whole))
    ranks = [_ranks(list(wanted[c].values())) for c in columns]
    of_column = F.when(F.col("__i") == 0, ranks[0])
    for i, r in enumerate(ranks[1:], 1):
        of_column = of_column.when(F.col("__i") == i, r)

    # Nulls stand last in the order and have no rank.
    held = _holding(counted, by, "__b", F.coalesce(of_column, F.array().cast("array<bigint>")), F.lit(0))
    held = held.select(*by, "__b", "__low", "__high", F.struct("__from", "__n", "__rows", "__wanted").alias("__s"))
    numbers = _joined(long, held, [*by, "__b"]).withColumn("__p", _part(F.col("__v"), F.col("__low"), F.col("__high")))
    # Both uses below read the same columns, so that the shuffle is made once.
    numbers = numbers.groupBy(*by, "__b", "__p", "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__s").alias("__s"))

    parts = numbers.groupBy(*by, "__b", "__p").agg(F.sum("__c").alias("__c"), F.first("__s").alias("__s")).withColumn("__n", F.col("__s.__n"))
    parts = _holding(parts, [*by, "__b"], "__p", F.col("__s.__wanted"), F.col("__s.__from")).select(*by, "__b", "__p", F.struct("__from", "__wanted").alias("__t"))
    values = _joined(numbers, parts, [*by, "__b", "__p"]).withColumns({"__n": F.col("__s.__n"), "__rows": F.col("__s.__rows")})
    values = _holding(values, [*by, "__b", "__p"], "__v", F.col("__t.__wanted"), F.col("__t.__from"))

    out = [F.max(F.when(F.col("__i") == 0, F.col("__rows"))).alias(count)] if count else []
    for i, c in enumerate(columns):
        for name, p in wanted[c].items():
            at = _position(p)
            side = lambda rank, i=i: F.max(F.when((F.col("__i") == i) & F.array_contains("__wanted", rank.cast("long")), F.col("__v")))
            low, high = side(F.floor(at)), side(F.ceil(at))
            place = F.max(F.when(F.col("__i") == i, at))
            between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
            out.append(F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise(between).alias(name))
    return values.groupBy(*keys).agg(*out)
