"""Pixels as rows: cells of polygons, zonal means, gates on disks, windows and samples.

A polygon is runs of cells along rows, as many as its outline asks for; runs are united per row, and pixels meet them by an equi-join on row and
stretch of columns. The whole grid is never made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.window import Window

from ..functions import geo
from ..functions import polygon as P
from ..functions.arrays import is_finite, is_valid_pixel
from ..grid import NODATA_BELOW, PIXEL_M, RADIUS_KM, RADIUS_M
from ..plans.lineage import cut, tasks
from .order_stats import quantiles

RUNS = "array<struct<row:int,first:int,last:int>>"
#: Columns of a stretch by which runs meet pixels; rows of a ring that are worked out together.
STRETCH, BAND = 64, 1024


def window_cells(ring: np.ndarray, transform: tuple, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """All grid cells of a ring's bounding box."""
    a, _, c, _, e, f = transform
    cols, rows = np.sort((ring[:, 0] - c) / a), np.sort((ring[:, 1] - f) / e)
    c0, c1 = max(0, math.floor(cols[0])), min(width - 1, math.floor(cols[-1]))
    r0, r1 = max(0, math.floor(rows[0])), min(height - 1, math.floor(rows[-1]))
    if c1 < c0 or r1 < r0:
        return np.zeros(0, int), np.zeros(0, int)
    rr, cc = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
    return rr.ravel(), cc.ravel()


def covered(ring: np.ndarray, transform: tuple, width: int, height: int, all_touched: bool, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose centre is in the ring (or within ``margin`` of it), or, if ``all_touched``, that share a point with it."""
    a, _, c, _, e, f = transform
    grown = ring if margin <= 0 else np.concatenate([ring - margin, ring + margin])
    rr, cc = window_cells(grown, transform, width, height)
    if not len(rr):
        return rr, cc
    if all_touched:
        x0, x1 = np.sort([cc * a + c, (cc + 1) * a + c], axis=0)
        y0, y1 = np.sort([rr * e + f, (rr + 1) * e + f], axis=0)
        hit = P.touches_box(ring, x0, y0, x1, y1)
    else:
        hit = P.inside_or_near(ring, (cc + 0.5) * a + c, (rr + 0.5) * e + f, margin)
    return rr[hit], cc[hit]


def runs_of_ring(ring: np.ndarray, transform: tuple, width: int, height: int, all_touched: bool, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of ``covered`` as runs (row, first, last) that neither overlap nor adjoin: as many as the outline asks for, whatever the area."""
    a, _, c, _, e, f = transform
    if a <= 0 or margin > 0:  # by cells: a dilated outline has no crossings to read off
        rr, cc = covered(ring, transform, width, height, all_touched, margin)
        return P.merged_runs(rr.astype(np.int64), cc.astype(np.int64), cc.astype(np.int64), width)
    edges, sides = np.sort((ring[:, 1] - f) / e), np.sort((ring[:, 0] - c) / a)
    rows = np.arange(max(0, math.floor(edges[0])), min(height - 1, math.floor(edges[-1])) + 1)
    left, right = max(0, math.floor(sides[0])), min(width - 1, math.floor(sides[-1]))
    found = []
    for i in range(0, len(rows), BAND):
        part = rows[i : i + BAND]
        if all_touched:
            line, first, last = P.touched_runs(ring, part, transform, width)
        else:
            line, first, last = P.crossing_runs(ring, (part + 0.5) * e + f, lambda k: (k + 0.5) * a + c, lambda x: np.ceil((x - c) / a - 0.5), width)
        first, last = np.maximum(first, left), np.minimum(last, right)
        some = first <= last
        found.append((part[line[some]], first[some], last[some]))
    return P.merged_runs(*(np.concatenate(x) for x in zip(*found)), width) if found else (rows, rows, rows)


def runs_of(ring: Column, transform: tuple, width: int, height: int, all_touched: bool = False, margin: float = 0.0) -> Column:
    """Array of (row, first, last) of the cells that a projected ring covers. The two rules are kept apart on purpose:
    zonal means take every touched cell, rasterisation the cells whose centre is inside."""

    @arrow_udf(RUNS)
    def run(rings: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(rings.offsets, np.int64))
        size = np.where(np.asarray(rings.is_null()), 0, size)
        points = rings.flatten()
        xy = np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], axis=1)
        found, at = [], np.cumsum(size) - size
        for i, n in zip(at, size):
            found.append(runs_of_ring(xy[i : i + n], transform, width, height, all_touched, margin) if n >= 3 else (np.zeros(0, np.int64),) * 3)
        offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
        columns = [pa.array(np.concatenate([x[k] for x in found] or [np.zeros(0)]).astype(np.int32)) for k in range(3)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["row", "first", "last"]))

    return run(ring)


def united_runs(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, first, last) in which no cell stands twice: runs of a row are laid end to end and those that meet made one."""
    order = Window.partitionBy(*keys, "row").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("__new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    numbered = begun.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "row", "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")


def rasterise(polygons: DataFrame, ring: str, transform: tuple, width: int, height: int, margin: float = 0.0) -> DataFrame:
    """Distinct (row, col) whose centre lies in any ring (or within ``margin``): the union is made of runs, cells come last."""
    runs = polygons.select(F.explode(runs_of(F.col(ring), transform, width, height, False, margin)).alias("p")).select("p.*")
    return united_runs(runs).select("row", F.explode(F.sequence("first", "last")).alias("col"))


def rasterise_windows(polygons: DataFrame, ring: str, transform: tuple, width: int, height: int, *keep: str) -> DataFrame:
    """The same by Catalyst expressions alone, for small rings: cells of the box, then the even-odd rule.
    With columns to keep, cells are distinct per their values."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    (ra, ca), (rb, cb) = (geo.cell_of(f(xs), g(ys), transform) for f, g in ((F.array_min, F.array_max), (F.array_max, F.array_min)))
    span = lambda u, v, top: F.sequence(F.greatest(F.least(u, v), F.lit(0)), F.least(F.greatest(u, v), F.lit(top - 1)))
    boxed = polygons.where((F.greatest(ra, rb) >= 0) & (F.least(ra, rb) < height) & (F.greatest(ca, cb) >= 0) & (F.least(ca, cb) < width))
    cells = boxed.withColumn("row", F.explode(span(ra, rb, height))).withColumn("col", F.explode(span(ca, cb, width)))
    x, y = geo.cell_centre(F.col("row"), F.col("col"), transform)
    return cells.where(geo.contains(F.col(ring), x, y)).select(*keep, "row", "col").distinct()


def zonal_mean(polygons: DataFrame, key: str, ring: str, pixels: DataFrame, bands: str, transform: tuple, width: int, height: int) -> DataFrame:
    """Per key the mean of every band over the touched pixels, missing values apart; NaN where a band has none.

    A footprint of several rings counts a pixel once. Keys that touch no pixel are absent.
    """
    runs = united_runs(polygons.select(key, F.explode(runs_of(F.col(ring), transform, width, height, all_touched=True)).alias("p")).select(key, "p.*"), key)
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    runs = runs.withColumn("__stretch", F.explode(F.sequence(stretch("first"), stretch("last"))))
    met = runs.join(pixels.select("row", "col", bands).withColumn("__stretch", stretch("col")), ["row", "__stretch"]).where(F.col("col").between(F.col("first"), F.col("last")))
    values = met.select(key, F.posexplode(bands).alias("band", "v"))
    ok = is_finite(F.col("v")) & (F.col("v") > NODATA_BELOW)
    means = values.groupBy(key, "band").agg(F.avg(F.when(ok, F.col("v").cast("double"))).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda x: F.coalesce(x["m"], F.lit(float("nan")))).alias(bands))


def sample_points(points: DataFrame, lon: str, lat: str, pixels: DataFrame, transform: tuple) -> DataFrame:
    """``points`` with row, col and the pixel's columns (NULL outside the grid)."""
    x, y = geo.project(F.col(lon), F.col(lat))
    row, col = geo.cell_of(x, y, transform)
    return points.withColumn("row", row).withColumn("col", col).join(pixels, ["row", "col"], "left")


def flag_points(points: DataFrame, lon: str, lat: str, mask: DataFrame, transform: tuple, name: str) -> DataFrame:
    """``points`` with a boolean: its cell is in the mask table."""
    x, y = geo.project(F.col(lon), F.col(lat))
    row, col = geo.cell_of(x, y, transform)
    lit = mask.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.lit(True).alias(name)).distinct()
    return points.join(lit, (row == F.col("__r")) & (col == F.col("__c")), "left").drop("__r", "__c").withColumn(name, F.coalesce(name, F.lit(False)))


def candidates_of_disks(pixels: DataFrame, centres: DataFrame, radius: str) -> DataFrame:
    """Pixels beside the disks (crow, ccol, radius in pixels) whose boxes their cells meet."""
    level = F.ceil(F.log2(F.greatest(F.col(radius).cast("double"), F.lit(1.0)))).cast("int")
    sized = centres.where(F.col(radius) >= 0).withColumn("__class", level)
    classes = sorted(r[0] for r in sized.select("__class").distinct().collect())  # a class for each doubling
    if not classes:
        return pixels.crossJoin(sized.limit(0))
    edge = F.pow(F.lit(2.0), F.greatest(F.col("__class") - 3, F.lit(0)))
    cells = lambda c: F.sequence(F.floor((F.col(c) - F.col(radius)) / edge), F.floor((F.col(c) + F.col(radius)) / edge))
    spread = sized.withColumn("__r", F.explode(cells("crow"))).withColumn("__c", F.explode(cells("ccol")))
    placed = pixels.withColumn("__class", F.explode(F.array(*map(F.lit, classes)))).withColumn("__r", F.floor(F.col("row") / edge)).withColumn("__c", F.floor(F.col("col") / edge))
    # The cells are many times the centres that Spark knows the size of, so they are not for a broadcast.
    return placed.join(spread.hint("merge"), ["__class", "__r", "__c"])


def bright_blue_disk(pixels: DataFrame, centres: DataFrame, key: str, radius: str, bright: float, blue: float, least: int = 5, whole_window: bool = True, clip: bool = False) -> DataFrame:
    """(key, row, col) of pixels in a pixel disk around each centre (crow, ccol, radius in pixels) that reach the
    disk's percentiles of brightness and of the blue ratio. Disks with fewer than ``least`` usable pixels give none.

    Disks are in classes of radius, each twice as wide as the one before; a class has a grid of cells an eighth to a quarter of the radius wide. A disk is
    copied to the cells of its box, a pixel stands in one cell of each class at hand, and the join is on class and cell, so a disk meets few pixels
    outside its box (``candidates_of_disks``), wherever it lies.
    """
    top, bottom = F.get("bands", 0).cast("double"), F.get("bands", 4).cast("double")
    usable = is_valid_pixel(F.slice("bands", 1, 8)) if whole_window else is_finite(bottom) & (bottom > NODATA_BELOW)
    blue_ratio = top / F.greatest(bottom, F.lit(1e-6)) if clip else F.when(bottom > 0, top / bottom)
    lit = pixels.where(usable).select("row", "col", bottom.alias("__bright"), blue_ratio.alias("__blue")).where(F.col("__blue").isNotNull())
    near = candidates_of_disks(lit, centres.select(key, "crow", "ccol", radius), radius)
    near = near.where(F.hypot(F.col("row") - F.col("crow"), F.col("col") - F.col("ccol")) <= F.col(radius))
    near = cut(near.select(key, "row", "col", "__bright", "__blue"))  # read three times below
    limits = quantiles(near, [key], {"__bright": {"__lb": bright / 100}, "__blue": {"__lc": blue / 100}}, count="__rows_of_disk").where(F.col("__rows_of_disk") >= least)
    return near.join(limits, key).where((F.col("__bright") >= F.col("__lb")) & (F.col("__blue") >= F.col("__lc"))).select(key, "row", "col")


def rows_sample(pixels: DataFrame, height: int, n_rows: int = 48, seed: int = 42) -> DataFrame:
    """Pixels of ``n_rows`` rows drawn without replacement by NumPy's seeded generator (a sampling operator)."""
    chosen = np.random.default_rng(seed).choice(height, size=min(n_rows, height), replace=False)
    return pixels.where(F.col("row").isin([int(r) for r in chosen]))


def window_grid(height: int, width: int, n: int, size: int) -> list[tuple[int, int]]:
    """Upper left corners of windows spread evenly over the grid."""
    rows = np.unique(np.linspace(0, max(height - size, 0), n).astype(int))
    cols = np.unique(np.linspace(0, max(width - size, 0), n).astype(int))
    return [(int(r), int(c)) for r in rows for c in cols]


def in_windows(pixels: DataFrame, corners: list[tuple[int, int]], size: int) -> DataFrame:
    """Pixels of evenly spread windows, by a broadcast table of the windows' rows and columns (few, chosen by the caller)."""
    spark = pixels.sparkSession
    rows = spark.createDataFrame(sorted({(r + k,) for r, _ in corners for k in range(size)}), "row int")
    cols = spark.createDataFrame(sorted({(c + k,) for _, c in corners for k in range(size)}), "col int")
    return pixels.join(rows, "row", "left_semi").join(cols, "col", "left_semi")


def decimate(pixels: DataFrame, factor: int = 16) -> DataFrame:
    return pixels.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0))


def around(pixels: DataFrame, lon: float, lat: float, half_deg: float, transform: tuple) -> DataFrame:
    """The square window of +-half_deg around a point, as a range predicate on row and col."""
    a, _, c, _, e, f = transform
    xs = [math.radians(lon + s * half_deg) * RADIUS_M for s in (-1, 1)]
    ys = [math.radians(lat + s * half_deg) * RADIUS_M for s in (-1, 1)]
    cols, rows = sorted(math.floor((x - c) / a) for x in xs), sorted(math.floor((y - f) / e) for y in ys)
    return pixels.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def footprint_rings(wkt: Column) -> Column:
    """Projected rings of a footprint with longitudes 0-360; NULL if any ring spans over 180 degrees or the
    whole is wider than half the planet."""
    rings = geo.wkt_rings(wkt)
    flat = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((F.radians(geo.wrap_half_open(p["x"])) * RADIUS_M).alias("x"), (F.radians(p["y"]) * RADIUS_M).alias("y"))))
    wide = F.exists(rings, lambda r: geo.lon_span(r) > 180)
    xs = F.flatten(F.transform(flat, lambda r: F.transform(r, lambda p: p["x"])))
    return F.when(~wide & (F.size(rings) > 0) & ((F.size(rings) == 1) | (F.array_max(xs) - F.array_min(xs) <= math.pi * RADIUS_M)), flat)


def disk_pixels(radius_km: float) -> float:
    return radius_km / (PIXEL_M / 1000)


def seam_pieces(ring: Column) -> Column:
    """A lon/lat ring cut at +-180 degrees into pieces inside [-180, 180] x [-90, 90]."""

    @pandas_udf("array<array<struct<x:double,y:double>>>")
    def run(rings: pd.Series) -> pd.Series:
        cut = [P.split_seam(np.array([(p["x"], p["y"]) for p in r], float)) if r is not None and len(r) >= 3 else [] for r in rings]
        return pd.Series([[[{"x": float(x), "y": float(y)} for x, y in piece] for piece in pieces] for pieces in cut], dtype=object)

    return run(ring)


def repaired_batch(rings: pa.Array) -> pa.Array:
    """``P.repaired`` of each ring; equal rings of a batch are repaired once."""
    size = np.diff(np.asarray(rings.offsets, np.int64))
    size = np.where(np.asarray(rings.is_null()), 0, size)
    points = rings.flatten()
    xy = np.stack([points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], axis=1)
    seen: dict[bytes, np.ndarray | None] = {}
    found = []
    for i, n in zip(np.cumsum(size) - size, size):
        name = xy[i : i + n].tobytes()
        if name not in seen:
            seen[name] = P.repaired(xy[i : i + n]) if n >= 3 else None
        found.append(seen[name])
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate([x for x in found if x is not None] or [np.zeros((0, 2))])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]), mask=pa.array([x is None for x in found]))


def repaired_ring(ring: Column) -> Column:
    """The ring of the one polygon that a ring stands for, NULL where it stands for none or for several."""

    @arrow_udf("array<struct<x:double,y:double>>")
    def run(rings: pa.Array) -> pa.Array:
        return repaired_batch(rings)

    return run(ring)


def clean_catalogue(rows: DataFrame, wkt: str, max_area_km2: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Rings of a polygon catalogue that are usable, and one row of counts.

    Longitudes above 180 lose 360. Rings that then span over 180 degrees are dropped; those that touch or cross themselves are repaired if that gives one
    polygon and dropped otherwise; so are those that exceed the area. A small file of texts is much work, so its rings are dealt out; they are
    repaired once and kept in a checkpoint for both results.
    """
    rings = rows.where(F.col(wkt).isNotNull()).select(F.explode(geo.wkt_rings(F.col(wkt))).alias("ring")).where(F.size("ring") >= 3).repartition(tasks(rows))
    turned = rings.select(F.transform("ring", lambda p: F.struct(geo.wrap_above_180(p["x"]).alias("x"), p["y"].alias("y"))).alias("ring"))
    turned = turned.withColumn("seam", geo.lon_span(F.col("ring")) > 180).withColumn("ring", repaired_ring(F.col("ring")))
    state = F.when(F.col("seam"), "seam").when(F.col("ring").isNull(), "degenerate").when(geo.ring_area_km2(F.col("ring")) > max_area_km2, "oversized").otherwise("kept")
    marked = cut(turned.withColumn("state", state).drop("seam"))
    counts = marked.agg(F.count(F.lit(1)).alias("n_raw"), *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("seam", "degenerate", "oversized", "kept")))
    return marked.where("state = 'kept'").select("ring"), counts


def spatial_selection(disks: DataFrame, polygons: DataFrame, transform: tuple, width: int, height: int, margin: float = 1.5, floor_km: float = 3.0, buffer_km: float = 1.0) -> DataFrame:
    """(row, col) inside a catalogue disk (lon, lat, area) or a polygon ring dilated by the buffer in degrees."""
    project = lambda r: F.transform(r, lambda p: F.struct((F.radians(p["x"]) * RADIUS_M).alias("x"), (F.radians(p["y"]) * RADIUS_M).alias("y")))
    round_ = disks.select(F.explode(seam_pieces(geo.geodesic_disk(F.col("lon"), F.col("lat"), geo.disk_radius_km(F.col("area"), margin, floor_km)))).alias("ring")).select(project("ring").alias("ring"))
    flat = polygons.select(F.explode(seam_pieces(F.col("ring"))).alias("ring")).select(project("ring").alias("ring"))
    grow = math.radians(buffer_km / (RADIUS_KM * math.pi / 180)) * RADIUS_M
    return rasterise(round_, "ring", transform, width, height).union(rasterise(flat, "ring", transform, width, height, grow)).distinct()
