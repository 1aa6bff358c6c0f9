"""Named checks as rows (name, ok, detail), and stage counts against expected ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(frame: DataFrame, name: str, ok: Column, detail: Column | None = None) -> DataFrame:
    """One row from aggregate expressions; an undefined condition fails."""
    shown = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    return frame.agg(F.coalesce(ok, F.lit(False)).alias("ok"), shown.alias("detail")).select(F.lit(name).alias("name"), "ok", "detail")


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def has_columns(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    missing = sorted(set(names) - set(frame.columns))
    return frame.sparkSession.createDataFrame([(label, not missing, ", ".join(missing))], "name string, ok boolean, detail string")


def in_range(frame: DataFrame, column: str, low: float, high: float, label: str) -> DataFrame:
    outside = F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(True)))
    return check(frame, label, outside == 0, outside)


def unique_key(frame: DataFrame, key: str, label: str) -> DataFrame:
    repeated = frame.groupBy(key).count().where("count > 1")
    return check(repeated, label, F.count(F.lit(1)) == 0, F.count(F.lit(1)))


def log_log_slope(frame: DataFrame, x: str, y: str) -> DataFrame:
    ok = (F.col(x) > 0) & (F.col(y) > 0)
    return frame.where(ok).agg(F.regr_slope(F.log(y), F.log(x)).alias("slope"))


def against_expected(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(stage, n, expected, ok) for every expected stage; a stage that is absent fails."""
    rows = counts.sparkSession.createDataFrame(sorted(expected.items()), "stage string, expected long")
    return rows.join(counts, "stage", "left").select("stage", "n", "expected", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("ok"))
