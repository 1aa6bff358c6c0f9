"""Exact k nearest neighbours of vectors through an index of balls, and the audits built on them.

1. ``PIVOTS`` reference rows at most (the first by a hash of their id, the root of their number) are centres; every reference row lies in
   the ball of its nearest centre. Centres, radii and sizes of the balls are a bounded table that all tasks hold.
2. A query first meets the nearest balls that hold enough rows, which gives it a k-th distance.
3. By the triangle inequality a ball is of no use if the query's distance to its centre less its radius exceeds that k-th distance. The query
   meets the balls that remain.

Neighbouring balls are one block of rows, a large ball (or one vector that very many rows share) is several; queries are blocks by their
nearest balls. A row is copied once for each block that it meets, not for each ball, and a task holds two blocks of ``BLOCK_BYTES`` at most. There
matrix products in single precision, taken from the middle of some balls, name the candidates within their error, and distances in doubles decide. Of
equal reference vectors a task keeps the k + 1 smallest ids. Where no ball can be left out, as for vectors without any structure, the distances are
as many as the product of the sides. Null vectors and those with a component that is null or not finite are nobody's neighbours and have none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import all_finite, is_finite
from ..functions.spectral import angle_deg
from ..plans.lineage import cut, tasks
from .metrics import pearson
from .order_stats import quantiles

#: A block has this many rows at least, where there are so many, and this many bytes at most, as doubles.
BLOCK, BLOCK_BYTES = 2_000, 32 << 20
PIVOTS = 4_096
#: Queries that meet a stretch of neighbouring balls at once, and rows of a stretch, if that isn't one ball.
TILE, STRETCH = 512, 1_024
#: Room for rounding when bounds are compared, relative to the distances at hand.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Good to about 1e-8 of the lengths; bounds leave room for that."""
    squares = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def _blur(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """What a distance of ``_distances`` may be off by: the root of what cancels."""
    return np.sqrt(SLACK * ((x**2).sum(axis=1) + (centres**2).sum(axis=1).max(initial=0)))[:, None] * 0.1


@dataclass
class BallIndex:
    """``rows``: (neighbour, rv, ball), written once. By ball: centre, radius and number of rows."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _chained(centres: np.ndarray) -> np.ndarray:
    """The centres in an order where each is followed by the nearest that is left."""
    left, at, order = np.ones(len(centres), bool), 0, []
    for _ in range(len(centres)):
        order.append(at)
        left[at] = False
        at = int(np.where(left, ((centres - centres[at]) ** 2).sum(axis=1), np.inf).argmin())
    return centres[order]


def _element(frame: DataFrame, vector: str) -> str:
    """Vectors stay in single precision where they are given so."""
    return "array<float>" if dict(frame.dtypes)[vector] == "array<float>" else "array<double>"


def _usable(frame: DataFrame, key: str, vector: str, names: tuple[str, str]) -> DataFrame:
    there = frame.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(all_finite(F.col(vector)))
    return there.select(F.col(key).cast("long").alias(names[0]), F.col(vector).cast(_element(frame, vector)).alias(names[1]))


def _placed(centres):
    """Adds each row's ball and how far from its centre it lies at most."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = _matrix(part.column("rv"))
                far = _distances(x, centres.value)
                ball = far.argmin(axis=1)
                reach = far[np.arange(len(x)), ball] + _blur(x, centres.value)[:, 0]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball.astype(np.int32)), pa.array(reach)], ["neighbour", "rv", "ball", "reach"])

    return run


def build_index(reference: DataFrame, key: str, vector: str) -> BallIndex | None:
    """The index of a reference table; None without a usable row."""
    vectors = _usable(reference, key, vector, ("neighbour", "rv"))
    n = vectors.count()
    if not n:
        return None
    chosen = vectors.orderBy(F.xxhash64("neighbour"), "neighbour").limit(min(PIVOTS, math.ceil(math.sqrt(n)))).collect()
    centres = _chained(np.unique(np.array([r["rv"] for r in chosen], np.float64), axis=0))
    shared = reference.sparkSession.sparkContext.broadcast(centres)
    rows = cut(vectors.mapInArrow(_placed(shared), f"neighbour long, rv {_element(reference, vector)}, ball int, reach double"))
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("ball").agg(F.max("reach").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each centre
        radius[r["ball"]], sizes[r["ball"]] = r["far"], r["n"]
    return BallIndex(rows.drop("reach"), centres, radius, sizes)


def _blocks(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each ball the first of its blocks and their number, and the number of all blocks: neighbouring balls share one, a large ball has several."""
    first, count, at, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > block:
            at, held = at + 1, 0
        first[i], count[i] = at, max(1, math.ceil(n / block))
        at, held = (at + count[i], 0) if n > block else (at, held + n)
    return first, count, int(at + (held > 0))


def _lists(mask: np.ndarray) -> pa.ListArray:
    """For each row of a table of booleans the columns that hold."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, mask.sum(axis=1).cumsum()).astype(np.int32)), pa.array(np.nonzero(mask)[1].astype(np.int32)))


def _marked(lists: pa.Array, width: int) -> np.ndarray:
    """The same backwards."""
    mask = np.zeros((len(lists), width), bool)
    mask[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)] = True
    return mask


def _of_use(far: np.ndarray, radius: np.ndarray, blur: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a ball may hold a row within the bound."""
    return far - radius - blur <= bound[:, None] * (1 + SLACK)


def _homes(shared, k: int):
    """For queries (query, qv) the nearest balls with more than k rows together, nearest first, and a distance beyond which nothing is of use."""

    def run(batches):
        centres, radius, sizes = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                x = _matrix(part.column("qv"))
                far, blur = _distances(x, centres), _blur(x, centres)
                order = np.argsort(far, axis=1, kind="stable")
                enough = 1 + (np.cumsum(sizes[order], axis=1) < k + 1).sum(axis=1)
                balls = [o[:n].tolist() for o, n in zip(order, enough)]
                # all rows of a ball lie within its centre's distance and its radius
                reach = far + radius
                outer = np.argsort(reach, axis=1)
                at = (np.cumsum(sizes[outer], axis=1) < k + 1).sum(axis=1)
                last = np.take_along_axis(reach, np.take_along_axis(outer, np.minimum(at, len(centres) - 1)[:, None], axis=1), axis=1)[:, 0]
                bounds = np.where(at < len(centres), last + blur[:, 0], np.inf)
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("qv"), pa.array(bounds), pa.array(balls, pa.list_(pa.int32()))], ["query", "qv", "bound", "balls"])

    return run


def _further(shared, lies=None):
    """For queries (query, qv, kth, met) the balls that may hold a row nearer than ``kth``, but those they have met.

    With ``lies``, which says what blocks a ball is in, the balls met stay and the blocks of the others stand beside them.
    """

    def run(batches):
        centres, radius, _ = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, TILE):
                part = batch.slice(i, TILE)
                x = _matrix(part.column("qv"))
                kth = part.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                bound = np.where(np.isfinite(kth), kth, np.inf)
                useful = _of_use(_distances(x, centres), radius, _blur(x, centres), bound) & ~_marked(part.column("met"), len(centres))
                common = [part.column("query"), part.column("qv"), pa.array(bound)]
                if lies is None:
                    yield pa.RecordBatch.from_arrays([*common, _lists(useful)], ["query", "qv", "bound", "balls"])
                else:
                    yield pa.RecordBatch.from_arrays([*common, part.column("met"), _lists(useful.astype(np.float32) @ lies.value > 0)], ["query", "qv", "bound", "balls", "blocks"])

    return run


def _places(numbers: np.ndarray) -> np.ndarray:
    """Of sorted numbers each one's place among its equals, from 0."""
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    return np.arange(len(numbers)) - np.repeat(starts, np.diff(starts, append=len(numbers)))


def _first_of_equals(rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of rows, but of equal ones only the first ``most``."""
    raw = np.ascontiguousarray(rows)
    same = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1])))[:, 0], return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    return np.sort(order[_places(same[order]) < most])


class _Tile:
    """Some queries and their candidates so far: squares of distances lie between ``low`` and ``high``, and beyond ``limit`` nothing is of use."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int, drop_same: bool) -> None:
        self.queries, self.ids, self.k, self.drop_same = queries, ids, k, drop_same
        self.limit = (bound * (1 + SLACK)) ** 2
        self.query, self.ref, self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def meet(self, asked: np.ndarray, refs: dict) -> None:
        """Some balls' rows, as lengths from their middle; ``asked`` says who asks which of the balls."""
        mine = np.flatnonzero(asked.any(axis=1))
        if not len(mine):
            return
        x = self.queries[mine] - refs["middle"]
        lengths = (x**2).sum(axis=1)
        scale = (x.shape[1] + 16) * (lengths + refs["far"])
        kind = np.float32 if scale.mean() * 2.0**-23 <= 0.01 * self.limit[mine].mean() else np.float64
        slack = scale * float(np.finfo(kind).eps)
        rough = (-2 * x).astype(kind) @ refs[kind].T
        rough += refs["squares"].astype(kind)
        near = rough <= (self.limit[mine] + slack - lengths).astype(kind)[:, None]
        n = np.count_nonzero(near)
        if n > 4 * (self.k + 1) * len(mine) and rough.shape[1] > self.k and asked.all():  # one of the k + 1 may be the query itself
            self.limit[mine] = np.minimum(self.limit[mine], np.partition(rough, self.k, axis=1)[:, self.k] + lengths + slack)
            near = rough <= (self.limit[mine] + slack - lengths).astype(kind)[:, None]
        elif not n:
            return
        i, j = np.divmod(np.flatnonzero(near), rough.shape[1])
        wanted = asked[mine[i], refs["ball"][j]]
        if self.drop_same:
            wanted &= self.ids[mine[i]] != refs["ids"][j]
        i, j = i[wanted], j[wanted]
        square = rough[i, j] + lengths[i]
        query, low, high = np.append(self.query, mine[i]), np.append(self.low, square - slack[i]), np.append(self.high, square + slack[i])
        ref = np.append(self.ref, refs["at"][j])
        order = np.lexsort((high, query))
        query, ref, low, high = query[order], ref[order], low[order], high[order]
        kth = np.flatnonzero(_places(query) == self.k - 1)
        self.limit[query[kth]] = np.minimum(self.limit[query[kth]], high[kth])
        kept = low <= self.limit[query]
        self.query, self.ref, self.low, self.high = query[kept], ref[kept], low[kept], high[kept]

    def best(self, rows: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, neighbour and distance of the k nearest candidates, ties by the smaller id."""
        exact = [np.sqrt(((rows[self.ref[a : a + 8192]] - self.queries[self.query[a : a + 8192]]) ** 2).sum(axis=1)) for a in range(0, len(self.ref), 8192)]
        exact = np.concatenate(exact) if exact else np.zeros(0)
        order = np.lexsort((ids[self.ref], exact, self.query))
        query, ref, exact = self.query[order], self.ref[order], exact[order]
        kept = (_places(query) < self.k) & (exact <= bound[query] * (1 + SLACK))
        return self.ids[query[kept]], ids[ref[kept]], exact[kept]


def _best_of_blocks(shared, k: int, drop_same: bool, again: bool):
    """The best k of a block of queries among a block of rows: of the balls listed or, ``again``, of those that are of use and not listed."""

    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and refs.num_rows:
            centres, radius, _ = shared.value
            refs = refs.take(np.argsort(refs["neighbour"].to_numpy()))
            refs = refs.take(_first_of_equals(_matrix(refs["rv"]), k + 1))
            rows, rid, ball = _matrix(refs["rv"]), refs["neighbour"].to_numpy(), refs["ball"].to_numpy()
            here, ball = np.unique(ball, return_inverse=True)
            shares = []
            for balls in np.split(np.arange(len(here)), np.flatnonzero(np.diff(np.cumsum(np.bincount(ball)) // STRETCH)) + 1):
                at = np.flatnonzero((ball >= balls[0]) & (ball <= balls[-1]))
                middle = centres[here[balls]].mean(axis=0)
                y = rows[at] - middle
                squares = (y**2).sum(axis=1)
                shares.append({"balls": balls, "middle": middle, "at": at, "ids": rid[at], "ball": ball[at] - balls[0], np.float64: y, np.float32: y.astype(np.float32), "squares": squares, "far": squares.max()})
            q, qid, bound = _matrix(queries["qv"]), queries["query"].to_numpy(), queries["bound"].to_numpy()
            far = _distances(q, centres[here])
            order, listed = np.argsort(far.argmin(axis=1), kind="stable"), queries["balls"].combine_chunks()
            for a in range(0, len(q), TILE):
                part = order[a : a + TILE]
                asked = _marked(listed.take(pa.array(part)), len(centres))[:, here]
                if again:
                    asked = ~asked & _of_use(far[part], radius[here], _blur(q[part], centres), bound[part])
                tile = _Tile(q[part], qid[part], bound[part], k, drop_same)
                away = far[part].mean(axis=0)
                for share in sorted(shares, key=lambda s: away[s["balls"]].min()):
                    tile.meet(asked[:, share["balls"]], share)
                found.append(tile.best(rows, rid, bound[part]))
        return pa.table(dict(zip(("query", "neighbour", "distance"), (pa.array(np.concatenate(x)) for x in zip(*found)))))

    return run


def _met(asked: DataFrame, index: BallIndex, shared, plan: tuple[np.ndarray, np.ndarray, int], loads: tuple[np.ndarray, np.ndarray, int], k: int, drop_same: bool, again: bool) -> DataFrame:
    """(query, neighbour, distance) of the blocks asked, the best k of each pair of blocks. ``asked`` has (query, qv, bound, balls, blocks)."""
    spark = asked.sparkSession
    dealt = lambda frame, key, ball, p, name: frame.join(F.broadcast(_table(spark, p)), ball == F.col("__ball")).withColumn(name, (F.col("__first") + F.pmod(F.xxhash64(key), F.col("__count"))).cast("int")).drop("__ball", "__first", "__count")
    left = dealt(asked, "query", F.col("home"), loads, "qb").withColumn("rb", F.explode("blocks")).select("query", "qv", "bound", "balls", "qb", "rb")
    pairs = F.broadcast(left.select(F.col("qb").alias("to"), "rb").distinct())  # a row for each pair of blocks at most
    right = dealt(index.rows, "neighbour", F.col("ball"), plan, "rb").join(pairs, "rb").select("neighbour", "rv", "ball", F.col("to").alias("qb"), "rb")
    n = max(tasks(asked), min(PIVOTS, 4 * plan[2] * loads[2]))
    left, right = (x.repartition(n, "qb", "rb").groupBy("qb", "rb") for x in (left, right))
    return left.cogroup(right).applyInArrow(_best_of_blocks(shared, k, drop_same, again), "query long, neighbour long, distance double")


def _table(spark, plan: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    return spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(*plan[:2]))], "__ball int, __first int, __count int")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: BallIndex, key: str, vector: str, k: int, drop_same: bool = True, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The neighbours, and the two rounds of asking: (query, qv, bound, balls). ``block`` is the number of rows in a block."""
    spark, element = queries.sparkSession, _element(queries, vector)
    shared = spark.sparkContext.broadcast((index.centres, index.radius, index.sizes))
    home = cut(_usable(queries, key, vector, ("query", "qv")).mapInArrow(_homes(shared, k), f"query long, qv {element}, bound double, balls array<int>"))
    asking = np.zeros(len(index.centres), np.int64)
    for r in home.groupBy(F.get("balls", 0).alias("ball")).count().collect():  # a row for each centre at most
        asking[r["ball"]] = r["count"]
    if block is None:
        fair = math.sqrt(asking.sum() * index.sizes.sum() / (4 * spark.sparkContext.defaultParallelism))
        block = min(max(BLOCK, math.ceil(fair)), max(1, BLOCK_BYTES // (8 * index.centres.shape[1])))
    plan, loads = _blocks(index.sizes, block), _blocks(asking, block)
    lies = np.zeros((len(index.centres), plan[2]), np.float32)
    for ball, (a, n) in enumerate(zip(*plan[:2])):
        lies[ball, a : a + n] = index.sizes[ball] > 0
    places = spark.sparkContext.broadcast(lies)

    blocks = _table(spark, plan).select(F.collect_list(F.struct("__ball", F.sequence("__first", F.col("__first") + F.col("__count") - 1))).alias("x"))
    at = F.map_from_entries("x")
    asked = home.crossJoin(F.broadcast(blocks.select(at.alias("__at")))).withColumn("blocks", F.array_distinct(F.flatten(F.transform("balls", lambda b: F.col("__at")[b])))).drop("__at")
    near = cut(_first(_met(asked.withColumn("home", F.get("balls", 0)), index, shared, plan, loads, k, drop_same, False), k))

    kth = near.where(F.col("rank") == k).select("query", F.col("distance").alias("kth"))
    open_ = home.join(kth, "query", "left").select("query", "qv", "kth", F.col("balls").alias("met"))
    asked = open_.mapInArrow(_further(shared, places), f"query long, qv {element}, bound double, balls array<int>, blocks array<int>")
    beyond = _met(asked.withColumn("home", F.get("balls", 0)), index, shared, plan, loads, k, drop_same, True)
    further = open_.mapInArrow(_further(shared), f"query long, qv {element}, bound double, balls array<int>").where(F.size("balls") > 0)
    return _first(near.drop("rank").unionByName(beyond), k), home, further


def neighbours(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int, drop_same: bool = True, block: int | None = None) -> DataFrame:
    """(query, neighbour, distance, rank) with rank 1..k by Euclidean distance, ties by the smaller id. The result is written once.

    With ``drop_same`` a row is never its own neighbour: it is left out by id, not as the nearest.
    """
    index = build_index(reference, key, vector)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query long, neighbour long, distance double, rank int")
    return cut(search(queries, index, key, vector, k, drop_same, block)[0])


def _spectra_of(near: DataFrame, spectra: DataFrame, key: str, spectrum: str) -> DataFrame:
    """(query, ys): the neighbours' spectra of each query, whole, so that one row is moved for each neighbour and not one for each band."""
    named = spectra.select(F.col(key).alias("neighbour"), F.col(spectrum).cast("array<double>").alias("y"))
    return near.select("query", "neighbour").join(named, "neighbour").groupBy("query").agg(F.collect_list("y").alias("ys"))


def _cells(ys: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Finite values of lists of spectra, the cell (row, band) of each, and the number of bands to a row."""
    spectra = ys.flatten()
    row, sizes = np.repeat(np.arange(len(ys)), ys.value_lengths().to_numpy(zero_copy_only=False)), spectra.value_lengths().to_numpy(zero_copy_only=False)
    values = spectra.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    width = int(sizes.max(initial=1))
    band = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = np.isfinite(values)
    return values[use], (np.repeat(row, sizes) * width + band)[use], width


def _spread(batches):
    """Sum of the cells' population variances and number of cells."""
    for batch in batches:
        values, cell, width = _cells(batch.column("ys"))
        n = np.bincount(cell, minlength=batch.num_rows * width)
        mean = np.bincount(cell, values, len(n)) / np.maximum(n, 1)
        squares = np.bincount(cell, (values - mean[cell]) ** 2, len(n))
        yield pa.RecordBatch.from_arrays([pa.array([float((squares / np.maximum(n, 1)).sum())]), pa.array([int((n > 0).sum())])], ["total", "cells"])


def _centroids(batches):
    """Adds ``c``: the mean of each band's finite values, NaN where there are none."""
    for batch in batches:
        values, cell, width = _cells(batch.column("ys"))
        n = np.bincount(cell, minlength=batch.num_rows * width)
        mean = np.where(n > 0, np.bincount(cell, values, len(n)) / np.maximum(n, 1), np.nan)
        c = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(mean))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("ys"), c], ["query", "ys", "c"])


def variance_floor(near: DataFrame, spectra: DataFrame, key: str, spectrum: str) -> DataFrame:
    """One row: mean over (query, band) of the population variance of the neighbours' finite values."""
    parts = _spectra_of(near, spectra, key, spectrum).mapInArrow(_spread, "total double, cells long")
    return parts.agg(F.try_divide(F.sum("total"), F.sum("cells")).alias("floor"))


def angle_floor(near: DataFrame, spectra: DataFrame, key: str, spectrum: str) -> DataFrame:
    """One row: median over queries of the mean angle between the neighbours' spectra and their centroid."""
    kind = dict(near.dtypes)["query"]
    centred = _spectra_of(near, spectra, key, spectrum).mapInArrow(_centroids, f"query {kind}, ys array<array<double>>, c array<double>")
    angles = centred.select("query", "c", F.explode("ys").alias("y")).groupBy("query").agg(F.avg(angle_deg(F.col("y"), F.col("c"))).alias("a"))
    return quantiles(cut(angles.select("a")), [], {"a": {"angle_floor": 0.5}})


def reliability(near: DataFrame, params: DataFrame, key: str, target: str, predicted: str) -> DataFrame:
    """Per ``param`` of a long table (key, param, target, predicted): correlation with the nearest neighbour's
    target, its root as a ceiling, the model's correlation, and the share of the ceiling reached."""
    first = near.where("rank = 1").select(F.col("query").alias(key), "neighbour")
    other = params.select(F.col(key).alias("neighbour"), "param", F.col(target).alias("__near"))
    both = params.join(first, key).join(other, ["neighbour", "param"])
    out = both.groupBy("param").agg(pearson(F.col(target), F.col("__near")).alias("reliability"), pearson(F.col(target), F.col(predicted)).alias("model_r"))
    cap = F.when(F.col("reliability") > 0, F.sqrt("reliability"))
    return out.withColumn("ceiling", cap).withColumn("frac_of_ceiling", F.col("model_r") / F.col("ceiling"))
