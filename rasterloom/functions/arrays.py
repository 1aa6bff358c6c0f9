"""Array-valued column expressions. Missing elements are NaN and keep their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def literal_array(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, computed once per row however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def is_finite(x: Column) -> Column:
    """False for NaN, infinities and NULL."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def diff(a: Column) -> Column:
    """First difference; one element shorter."""
    n = F.size(a)
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mix(a: Column, b: Column, share: Column | float) -> Column:
    """share * a + (1 - share) * b."""
    return F.zip_with(a, b, lambda x, y: x * share + y * (1 - share))


def finite_values(a: Column) -> Column:
    return F.filter(a, is_finite)


def nan_mean(a: Column) -> Column:
    """NaN without a finite element."""
    return bind(finite_values(a), lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(F.lit(NAN)))


def nan_median(a: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        low = F.get(v, F.floor((n - 1) / 2).cast("int"))
        high = F.get(v, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2).otherwise(F.lit(NAN))

    return bind(F.array_sort(finite_values(a)), middle)


def all_finite(a: Column) -> Column:
    """True if every element is finite; NULL arrays are not."""
    return F.coalesce(F.forall(a, is_finite), F.lit(False))


def is_valid_pixel(bands: Column, nodata_below: float = -1e30) -> Column:
    """All bands finite and above the nodata threshold."""
    return F.coalesce(F.forall(bands, lambda x: is_finite(x) & (x > nodata_below)), F.lit(False))


def nodata_to_nan(bands: Column, nodata_below: float = -1e30) -> Column:
    return F.transform(bands, lambda x: F.when(x <= nodata_below, F.lit(NAN)).otherwise(x))


def gather(a: Column, indexes: list[int]) -> Column:
    """Elements at 0-based positions."""
    return F.array(*(F.get(a, F.lit(k)) for k in indexes))


def common_support(a: Column, b: Column) -> tuple[Column, Column]:
    """Both arrays with NaN wherever either is missing."""
    mask = lambda x, y: F.when(is_finite(x) & is_finite(y), x).otherwise(F.lit(NAN))
    return F.zip_with(a, b, mask), F.zip_with(b, a, mask)


def arg_nearest(a: Column, target: float) -> Column:
    """0-based position of the element nearest to ``target``; the first on ties."""
    gap = F.transform(a, lambda x: F.abs(x - target))
    return (F.array_position(gap, F.array_min(gap)) - 1).cast("int")


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """NaN unless the denominator is positive."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(NAN))


def clipped_ratio(top: Column, bottom: Column, least: float = 1e-6) -> Column:
    return top / F.greatest(bottom, F.lit(least))


def low_rank(coefficients: list[Column], modes: list[list[float]], gain: Column) -> Column:
    """gain * sum of coefficient times mode, one value per band."""
    rows = [F.array(*(F.lit(float(m[k])) for m in modes)) for k in range(len(modes[0]))]
    vector = F.array(*(c.cast("double") for c in coefficients))
    return bind(vector, lambda c: F.transform(F.array(*rows), lambda b: gain * dot(b, c)))
