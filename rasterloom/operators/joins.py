"""Joins of the domain, on shuffles or checked broadcasts that Spark picks by size.

Distance joins use chords: points become cubes of the unit sphere's bounding box, so neighbours within a
chord are in adjacent cubes. That gives an equi-join without special cases at the poles or at +-180 degrees.
Where a point wants one answer (its nearest centre, whether any covers it), the cubes' rows meet in blocks in NumPy, and only
the answer leaves the task: the pairs of a dense place are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..grid import RADIUS_KM
from ..plans.lineage import cut, tasks

#: Points and centres of a cube that one task meets at once, and cells of a matrix of chords.
BLOCK, CELLS = 16_384, 1 << 20


def semi(frame: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return frame.join(ids, on, "left_semi")


def anti(frame: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return frame.join(ids, on, "left_anti")


def mark(frame: DataFrame, ids: DataFrame, on: str, name: str) -> DataFrame:
    """``frame`` with a boolean column that tells whether the key occurs in ``ids``."""
    seen = ids.select(on).where(F.col(on).isNotNull()).distinct().withColumn(name, F.lit(True))
    return frame.join(seen, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def left_attributes(frame: DataFrame, attributes: DataFrame, on: str | list[str]) -> DataFrame:
    return frame.join(attributes, on, "left")


def chain(frame: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Inner joins of several tables on one key, which share one partitioning."""
    for o in others:
        frame = frame.join(o, on)
    return frame


def first_groups(frame: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """Rows of the ``n`` groups that come first by their smallest position."""
    firsts = frame.groupBy(group).agg(F.min(position).alias("__at")).orderBy("__at", group).limit(n).select(group)
    return frame.join(firsts, group, "left_semi")


def in_key_order(keys: DataFrame, frame: DataFrame, key: str, position: str) -> DataFrame:
    """``frame``'s rows in the order of a key list with explicit positions."""
    return keys.join(frame, key).orderBy(position)


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def _cubes(frame: DataFrame, lon: str, lat: str, edge: float | Column, spread: bool) -> DataFrame:
    """``frame`` with a cube key; with ``spread`` once for each of the 27 cubes around a point."""
    at = [F.floor(c / edge).cast("long") for c in _unit(F.col(lon), F.col(lat))]
    steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    if spread:
        for k in range(3):
            frame = frame.withColumn(f"__s{k}", steps)
        at = [a + F.col(f"__s{k}") for k, a in enumerate(at)]
    return frame.withColumn("__cube", F.struct(*(a.alias(f"c{k}") for k, a in enumerate(at)))).drop("__s0", "__s1", "__s2")


def within_distance(points: DataFrame, centres: DataFrame, radius_km: float, point=("lon", "lat"), centre=("clon", "clat"), planet_km: float = RADIUS_KM) -> DataFrame:
    """All (point, centre) rows at most ``radius_km`` apart, with ``distance_km``; a point may match several centres."""
    chord = 2 * math.sin(min(radius_km / (2 * planet_km), math.pi / 2))
    edge = max(chord, 1e-6) * (1 + 1e-9)
    named = lambda frame, at, n: frame.withColumns({f"__{n}{k}": c for k, c in enumerate(_unit(*map(F.col, at)))})
    left = _cubes(named(points, point, "p"), *point, edge, spread=False).repartition(tasks(points), "__cube")
    near = left.join(_cubes(named(centres, centre, "q"), *centre, edge, spread=True).hint("merge"), "__cube").drop("__cube")
    # Sums of squares rule most candidates out before there is trigonometry.
    gap = sum((F.pow(F.col(f"__p{k}") - F.col(f"__q{k}"), 2) for k in range(1, 3)), F.pow(F.col("__p0") - F.col("__q0"), 2))
    near = near.where(gap <= chord * chord * (1 + 1e-9) + 1e-14).drop(*(f"__{n}{k}" for n in "pq" for k in range(3)))
    return near.withColumn("distance_km", haversine_km(*map(F.col, (*centre, *point)), planet_km)).where(F.col("distance_km") <= radius_km)


def nearest_within(points: DataFrame, centres: DataFrame, radius_km: float, key: str, centre_key: str, **names) -> DataFrame:
    """Per point key its nearest centre within the radius: (key, centre_key, distance_km). Ties go to the smaller centre key."""
    candidate = {"candidate": names.pop("centre")} if "centre" in names else {}
    return nearest(points, centres, key, centre_key, within_km=radius_km, **candidate, **names)


def _unit_rows(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


def _great_circle(lon1, lat1, lon2, lat2, planet_km: float) -> np.ndarray:
    """``haversine_km`` of arrays."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * planet_km * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _arrays(table: pa.Table, names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names.split()]


def _met(points: DataFrame, centres: DataFrame, edge: float, run, schema: str) -> DataFrame:
    """``run`` on blocks of (k, lon, lat) and of (k, lon, lat, radius) that stand in the same or in adjacent cubes."""
    n, by = tasks(points), ["__cube", "__qb", "__rb"]
    left, right = _cubes(points, "lon", "lat", edge, spread=False), _cubes(centres, "lon", "lat", edge, spread=True)
    blocks = lambda frame, name: frame.groupBy("__cube").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    loads = blocks(left, "__qn").join(blocks(right, "__rn"), "__cube")
    dealt = lambda name: F.pmod(F.xxhash64("k"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = left.join(loads, "__cube").withColumn("__qb", dealt("__qn")).withColumn("__rb", every("__rn")).drop("__qn", "__rn")
    right = right.join(loads, "__cube").withColumn("__rb", dealt("__rn")).withColumn("__qb", every("__qn")).drop("__qn", "__rn")
    return left.repartition(n, *by).groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by)).applyInArrow(run, schema)


def _nearest_of_block(kind: pa.DataType, other: pa.DataType, planet_km: float):
    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if points.num_rows and centres.num_rows:
            centres = centres.sort_by("k")  # ties go to the smaller key
            (qlon, qlat), (rlon, rlat) = _arrays(points, "lon lat"), _arrays(centres, "lon lat")
            q, r = _unit_rows(qlon, qlat), _unit_rows(rlon, rlat)
            size = max(1, CELLS // len(r))
            for a in range(0, len(q), size):
                near = 2 - 2 * (q[a : a + size] @ r.T)
                # Products are good to 1e-14; what is no farther than that is measured.
                i, j = np.nonzero(near <= near.min(axis=1)[:, None] + 1e-14 * 4)
                d = _great_circle(rlon[j], rlat[j], qlon[a + i], qlat[a + i], planet_km)
                order = np.lexsort((j, d, i))
                first = order[np.r_[True, np.diff(i[order]) != 0]]
                for o, x in zip(found, (a + i[first], j[first], d[first]), strict=True):
                    o.append(x)
        at, to, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        keys = points["k"].take(pa.array(at)) if len(at) else pa.array([], kind)
        others = centres["k"].take(pa.array(to)) if len(to) else pa.array([], other)
        return pa.table({"k": keys, "c": others, "d": pa.array(d, pa.float64())})

    return run


def _covered_of_block(kind: pa.DataType, planet_km: float):
    def run(points: pa.Table, centres: pa.Table) -> pa.Table:
        hit = np.zeros(points.num_rows, bool)
        if points.num_rows and centres.num_rows:
            (qlon, qlat), (rlon, rlat, radius) = _arrays(points, "lon lat"), _arrays(centres, "lon lat radius")
            q, r = _unit_rows(qlon, qlat), _unit_rows(rlon, rlat)
            chord = 2 * np.sin(np.minimum(radius / (2 * planet_km), math.pi / 2))
            limit, left = chord * chord, np.arange(len(q))
            step = 64  # a few centres settle most points of a dense place
            for b in range(0, len(r), step):
                part = slice(b, b + step)
                settled = []
                for a in range(0, len(left), CELLS // step):
                    own = left[a : a + CELLS // step]
                    near = 2 - 2 * (q[own] @ r[part].T) - limit[part]
                    close = np.abs(near) <= 1e-9 * limit[part] + 1e-13
                    inside = (near < 0) & ~close
                    i, j = np.nonzero(close & ~inside.any(axis=1)[:, None])
                    inside[i, j] = _great_circle(rlon[b + j], rlat[b + j], qlon[own[i]], qlat[own[i]], planet_km) <= radius[b + j]
                    settled.append(inside.any(axis=1))
                done = np.concatenate(settled)
                hit[left[done]] = True
                left = left[~done]
                if not len(left):
                    break
        return pa.table({"k": points["k"].filter(pa.array(hit)) if hit.any() else pa.array([], kind)})

    return run


def _arrow(frame: DataFrame, column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = frame.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _placed(frame: DataFrame, key: str, at: tuple[str, str], *more: Column) -> DataFrame:
    usable = frame.where(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull() & ~F.isnan(at[0]) & ~F.isnan(at[1]))
    return usable.select(F.col(key).alias("k"), F.col(at[0]).cast("double").alias("lon"), F.col(at[1]).cast("double").alias("lat"), *more)


def outside_all(points: DataFrame, centres: DataFrame, key: str, point=("lon", "lat"), centre=("clon", "clat"), radius: str = "radius_km", planet_km: float = RADIUS_KM) -> DataFrame:
    """Points that lie farther than each centre's own radius from it.

    Centres are in classes of radius, each twice as wide as the one before, so that a wide one does not widen the cubes of all. The widest
    class comes first, and only points that it leaves open meet the next.
    """
    width = F.ceil(F.log2(F.greatest(F.col(radius), F.lit(1.0)))).cast("int")
    sized = centres.where(F.col(radius) >= 0).withColumn("__class", width)
    classes = sorted((r[0] for r in sized.select("__class").distinct().collect()), reverse=True)  # at most some fifteen
    name, kind = _arrow(points, key)
    todo, hits = _placed(points, key, point), []
    for w in classes:
        edge = max(2 * math.sin(min(min(2.0**w, math.pi * planet_km) / (2 * planet_km), math.pi / 2)), 1e-6) * (1 + 1e-9)
        own = _placed(sized.where(F.col("__class") == w).withColumn("__k", F.xxhash64(*centre, radius)), "__k", centre, F.col(radius).cast("double").alias("radius")).distinct()
        hits.append(cut(_met(todo, own, edge, _covered_of_block(kind, planet_km), f"k {name}").distinct()))
        todo = cut(todo.join(hits[-1], "k", "left_anti"))
    for h in hits:
        points = points.join(h.select(F.col("k").alias(key)), key, "left_anti")
    return points


def nearest(points: DataFrame, candidates: DataFrame, key: str, candidate_key: str, point=("lon", "lat"), candidate=("clon", "clat"), planet_km: float = RADIUS_KM, first_edge: float | None = None, within_km: float | None = None) -> DataFrame:
    """Per point key the nearest candidate anywhere, or within a distance: (key, candidate_key, distance_km); ties go to the smaller candidate key.

    Cubes start near the candidates' typical spacing and grow fourfold for the points that are still open; a
    match is final once its chord is within the cube's edge. Empty candidates give an empty result.
    """
    n = candidates.count()
    (name, kind), (other_name, other) = _arrow(points, key), _arrow(candidates, candidate_key)
    found = [points.select(F.col(key).alias("k"), F.lit(None).cast(other_name).alias("c"), F.lit(None).cast("double").alias("d")).limit(0)]
    top = 2.0 if within_km is None else min(2.0, max(2 * math.sin(min(within_km / (2 * planet_km), math.pi / 2)), 1e-6) * (1 + 1e-9))
    edge, todo, centres = min(top, first_edge or 4 * math.sqrt(4 * math.pi / max(n, 1))), _placed(points, key, point), _placed(candidates, candidate_key, candidate)
    while n:
        last = edge >= top
        limit = within_km if last and within_km is not None else math.inf if last else 2 * planet_km * math.asin(min(1.0, edge / 2))
        best = _met(todo, centres, edge, _nearest_of_block(kind, other, planet_km), f"k {name}, c {other_name}, d double")
        best = best.groupBy("k").agg(F.min(F.struct("d", "c")).alias("b"))
        found.append(cut(best.where(F.col("b.d") <= limit).select("k", F.col("b.c").alias("c"), F.col("b.d").alias("d"))))
        if last:
            break
        todo = cut(todo.join(found[-1], "k", "left_anti"))
        if todo.isEmpty():
            break
        edge = min(top, edge * 4)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole.select(F.col("k").alias(key), F.col("c").alias(candidate_key), F.col("d").alias("distance_km"))
