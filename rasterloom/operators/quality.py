"""Row filters with the missing-value rules of the domain: scalar NaN is normalised to NULL first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import visible_median
from .order_stats import quantiles


def nan_to_null(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in columns})


def strict_rule(q1: str = "q1", q2: str = "q2", q3: str = "q3", q4: str = "q4") -> Column:
    """q1 in [0.9, 1.1], |q2| < 5, q3 > 80, q4 > 95; a missing value fails."""
    return F.coalesce(F.col(q1).between(0.9, 1.1) & (F.abs(q2) < 5) & (F.col(q3) > 80) & (F.col(q4) > 95), F.lit(False))


def inverted_rule(q1: str = "q1", q2: str = "q2", q3: str = "q3", q4: str = "q4") -> Column:
    """As the strict rule, but q1 outside [0.9, 1.1]; a missing q1 passes, other missing values fail."""
    rest = F.coalesce((F.abs(q2) < 5) & (F.col(q3) > 80) & (F.col(q4) > 95), F.lit(False))
    return rest & ~F.coalesce(F.col(q1).between(0.9, 1.1), F.lit(False))


def strict_quality(frame: DataFrame, **names: str) -> DataFrame:
    return nan_to_null(frame, *(names or {c: c for c in ("q1", "q2", "q3", "q4")}).values()).where(strict_rule(**names))


def inverted_quality(frame: DataFrame, **names: str) -> DataFrame:
    return nan_to_null(frame, *(names or {c: c for c in ("q1", "q2", "q3", "q4")}).values()).where(inverted_rule(**names))


def above_visible_floor(frame: DataFrame, bands: str, floor: float = 0.008) -> DataFrame:
    """Drops rows whose visible median is at or below the floor; rows without one are kept."""
    return frame.where(~F.coalesce(F.nanvl(visible_median(F.col(bands)), F.lit(None).cast("double")) <= floor, F.lit(False)))


def pass_rates(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: the number of rows, and per rule the share that passes."""
    return frame.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(r, F.lit(False)).cast("double")).alias(k) for k, r in rules.items()))


def zscore_gate(level: Column, ratio: Column, reference: tuple[float, float, float, float], threshold: float = 0.5) -> Column:
    """Both z-scores strictly above the threshold; missing values fail."""
    m1, s1, m2, s2 = reference
    z = lambda x, m, s: F.when(F.isnan(x), None).otherwise((x - m) / (s + 1e-9))
    return F.coalesce((z(level, m1, s1) > threshold) & (z(ratio, m2, s2) > threshold), F.lit(False))


def zscore_reference(frame: DataFrame, level: Column, ratio: Column) -> DataFrame:
    """One row: mean and population deviation of both, over values that are not missing."""
    clean = lambda x: F.when(F.isnan(x), None).otherwise(x)
    return frame.agg(F.avg(clean(level)).alias("mean_level"), F.stddev_pop(clean(level)).alias("std_level"), F.avg(clean(ratio)).alias("mean_ratio"), F.stddev_pop(clean(ratio)).alias("std_ratio"))


def percentile_gate(frame: DataFrame, group: str, gates: dict[str, float], least: int = 5) -> DataFrame:
    """Rows at or above the group's exact percentile in every gated column, in groups of ``least`` rows or more.

    Percentiles come from histograms per group, added up before the shuffle, and are joined back.
    """
    limits = quantiles(frame, [group], {c: {f"__{c}": p} for c, p in gates.items()}, count="__rows_of_group").where(F.col("__rows_of_group") >= least)
    out = frame.join(limits, group)
    for c in gates:
        out = out.where(F.col(c) >= F.col(f"__{c}"))
    return out.select(frame.columns)


def terrain_class(ridge: Column, plain: Column) -> Column:
    """Four classes from two flags; missing flags count as unset."""
    r, p = F.coalesce(ridge.cast("int") == 1, F.lit(False)), F.coalesce(plain.cast("int") == 1, F.lit(False))
    return F.when(r & p, "LRM+smooth").when(r, "LRM").when(p, "smooth_plains").otherwise("other")
