"""Table scans: CSV and TSV sidecars, list-literal spectra, catalogues, Parquet and JSON.

All go through Spark's readers, so any store that Spark reaches will do; columns are pruned by ``select``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import parse_list
from . import schemas


def _csv(spark: SparkSession, path: str, schema: str | None, sep: str = ",", **options: str) -> DataFrame:
    """By header names: the declared columns, in any order in the file, cast leniently (unreadable cells are NULL)."""
    raw = spark.read.options(header=True, sep=sep, inferSchema=False, **options).csv(path)
    if schema is None:
        return raw
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    missing = [f.name for f in wanted if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted))


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _csv(spark, path, schema)


def spectra(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Spectra with ``waves`` and ``photom_iof`` parsed to arrays (NULL if unreadable); other columns are kept as text."""
    raw = _csv(spark, path, None)
    found = raw.withColumn("waves", parse_list(F.col("waves"))).withColumn("photom_iof", parse_list(F.col("photom_iof")))
    found = found.withColumn("ref_id", F.col("ref_id").try_cast("long"))
    return found if rows is None else found.limit(rows)


def readable_spectra(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): arrays of equal length with two points or more, at least one value finite."""
    fine = F.col("waves").isNotNull() & F.col("photom_iof").isNotNull() & (F.size("waves") == F.size("photom_iof")) & (F.size("waves") >= 2) & F.exists("photom_iof", lambda x: ~F.isnan(x))
    fine = F.coalesce(fine, F.lit(False))
    return frame.where(fine), frame.where(~fine)


def only_ids(frame: DataFrame, ids: DataFrame, key: str = "ref_id") -> DataFrame:
    """Semi-join before any costly parsing."""
    return frame.join(ids.select(key).distinct(), key, "left_semi")


def not_yet_done(wanted: DataFrame, done: DataFrame, key: str = "ref_id") -> DataFrame:
    """Resume: ids that are wanted and neither written nor rejected before."""
    return wanted.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def disk_catalogue(spark: SparkSession, path: str, above: int = 2) -> DataFrame:
    """(lon, lat, area) of a tab-separated catalogue with lines above the header; rows with a gap are dropped.

    Only the header comes to the driver. The lines above it are told by their content, so a catalogue of any size is read in parallel.
    """
    lines = spark.read.text(path)
    head = [r[0] for r in lines.limit(above + 1).collect()]
    if len(head) <= above:
        raise ValueError(f"{path} has no header below {above} lines")
    names = [c.strip().strip('"') for c in head[above].split("\t")]
    missing = [c for c in schemas.DISKS if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    cells = F.split("value", "\t")
    at = lambda c: F.trim(F.regexp_replace(F.get(cells, names.index(c)), '"', "")).try_cast("double")
    found = lines.where(~F.col("value").isin(head)).select(*(at(c).alias(n) for c, n in schemas.DISKS.items()))
    return found.where(F.expr(" AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in schemas.DISKS.values())))


def group_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Group centres; the three columns are required, rows without an id are dropped."""
    raw = _csv(spark, path, None, sep="\t")
    missing = sorted(set(schemas.GROUPS) - set(raw.columns))
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.where(F.col("Group_id").isNotNull()).select(F.col("Group_id").try_cast("double").cast("long").alias("group_id"), F.col("Central_long").try_cast("double").alias("clon"), F.col("Central_lat").try_cast("double").alias("clat"))


def polygon_catalogue(spark: SparkSession, path: str, column: str | None = None, seps: tuple[str, ...] = schemas.CATALOGUE_SEPS) -> DataFrame:
    """The WKT column (named ``wkt``) of a latin-1 catalogue: the named column, or the one that holds polygons.

    The separator is the one that cuts the file into a table with such a column.
    """
    for sep in seps:
        raw = _csv(spark, path, None, sep=sep, encoding="ISO-8859-1", quote='"')
        names = [column] if column else raw.columns
        first = raw.limit(20).collect()
        for name in names:
            if name in raw.columns and any(str(r[name] or "").lstrip().upper().startswith(schemas.WKT_KINDS) for r in first):
                return raw.select(F.col(f"`{name}`").alias("wkt"))
    raise ValueError(f"{path} has no column of polygons")


def newest_variant(spark: SparkSession, folder: str, pattern: str) -> str:
    """The file of a folder that matches a glob pattern (see ``schemas.VARIANTS``), the first by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.min("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no file {pattern} in {folder}")
    return found


def calibration(spark: SparkSession, path: str) -> tuple[list[dict], float]:
    """Per-band calibration rows in file order (eight) and the mean inter-band correlation; refuses tables without it."""
    raw = _csv(spark, path, None)
    missing = [c for c in schemas.CALIBRATION if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; build it again with the calibration diagnostics")
    rows = [{c: float(r[c]) for c in schemas.CALIBRATION} for r in raw.select(*schemas.CALIBRATION).collect()]
    return rows, sum(r["resid_corr_mean"] for r in rows) / len(rows)


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def document(spark: SparkSession, path: str) -> dict:
    """A JSON report or configuration."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


