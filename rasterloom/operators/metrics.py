"""Evaluation aggregates. Values missing on either side of a pair are left out; undefined results are NULL."""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import grid as G
from ..functions import spectral as S
from ..functions.arrays import all_finite, is_finite
from ..plans.lineage import cut
from .order_stats import quantiles


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    ok = is_finite(a) & is_finite(b)
    return F.when(ok, a), F.when(ok, b)


def pearson(a: Column, b: Column, eps: float = G.EPS_METRIC) -> Column:
    """Correlation; NULL with fewer than two pairs or a deviation below ``eps``."""
    x, y = _pair(a, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    defined = (F.count(x) >= 2) & (F.stddev_pop(x) >= eps) & (F.stddev_pop(y) >= eps)
    return F.when(defined, F.try_divide(F.covar_pop(x, y), spread))


def ols_slope(a: Column, b: Column) -> Column:
    """Slope of b on a; NULL with fewer than three pairs or a constant a."""
    x, y = _pair(a, b)
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0), F.try_divide(F.covar_pop(x, y), F.var_pop(x)))


def concordance(a: Column, b: Column) -> Column:
    """Lin's coefficient; NULL with fewer than three pairs or no spread at all."""
    x, y = _pair(a, b)
    whole = F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)
    return F.when((F.count(x) >= 3) & (whole > 0), F.try_divide(2 * F.covar_pop(x, y), whole))


def bands_long(frame: DataFrame, keys: list[str], target: str, predicted: str) -> DataFrame:
    """(keys, band, target, predicted) with a 0-based band."""
    both = F.arrays_zip(F.col(target).alias("t"), F.col(predicted).alias("p"))
    return frame.select(*keys, F.posexplode(both).alias("band", "v")).select(*keys, "band", F.col("v.t").alias("target"), F.col("v.p").alias("predicted"))


def per_band(long: DataFrame, *keys: str) -> DataFrame:
    """Correlation, slope, concordance and mean bias of predicted against target, per band."""
    t, p = F.col("target"), F.col("predicted")
    ok = is_finite(t) & is_finite(p)
    return long.groupBy(*keys, "band").agg(pearson(t, p).alias("pearson_r"), ols_slope(t, p).alias("slope"), concordance(t, p).alias("ccc"), F.avg(F.when(ok, p - t)).alias("bias"))


def parameters_long(frame: DataFrame, key: str, target: str, predicted: str, names: list[str] | None = None) -> DataFrame:
    """(key, param, target, predicted) of the spectral parameters of both sides."""
    t, p = S.parameters(F.col(target)), S.parameters(F.col(predicted))
    rows = F.array(*(F.struct(F.lit(n).alias("param"), t[n].alias("target"), p[n].alias("predicted")) for n in (names or list(t))))
    return frame.select(key, F.explode(rows).alias("r")).select(key, "r.param", "r.target", "r.predicted")


def parameter_fidelity(params: DataFrame) -> DataFrame:
    """Per parameter: correlation, slope, concordance, median bias, its ratio to the median target, that median."""
    t, p = F.col("target"), F.col("predicted")
    ok = is_finite(t) & is_finite(p)
    middle = quantiles(params.select("param", F.when(ok, p - t).alias("gap"), F.when(ok, t).alias("t")), ["param"], {"gap": {"bias": 0.5}, "t": {"median_target": 0.5}})
    out = params.groupBy("param").agg(pearson(t, p).alias("pearson_r"), ols_slope(t, p).alias("slope"), concordance(t, p).alias("ccc")).join(middle, "param")
    return out.withColumn("rel_bias", F.when(F.col("median_target") != 0, F.col("bias") / F.col("median_target")))


def key_score(fidelity: DataFrame, metric: str = "pearson_r", names=G.KEY_PARAMETERS) -> DataFrame:
    """Mean of a metric over the key parameters, undefined ones counting as zero."""
    if metric not in ("pearson_r", "ccc", "slope"):
        raise ValueError(f"unknown metric {metric!r}")
    kept = fidelity.where(F.col("param").isin(*names))
    return kept.agg((F.sum(F.coalesce(metric, F.lit(0.0))) / len(names)).alias("key_score"))


def cell_errors(long: DataFrame, *keys: str, least_target: float = 1e-6) -> DataFrame:
    """RMSE, MAE and MRAE over all finite (row, band) cells."""
    t, p = F.col("target"), F.col("predicted")
    ok = is_finite(t) & is_finite(p)
    gap = F.abs(p - t)
    return long.groupBy(*keys).agg(
        F.sqrt(F.avg(F.when(ok, gap * gap))).alias("rmse"),
        F.avg(F.when(ok, gap)).alias("mae"),
        F.avg(F.when(ok & (F.abs(t) > least_target), F.try_divide(gap, F.abs(t)))).alias("mrae"),
    )


def row_mse(target: Column, predicted: Column) -> Column:
    """Mean squared error of one row over its finite bands; NULL without any."""
    squares = F.filter(F.zip_with(target, predicted, lambda t, p: (p - t) * (p - t)), is_finite)
    return F.try_divide(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x), F.size(squares))


def global_mse(long: DataFrame) -> DataFrame:
    """Mean over all cells; not the mean of the rows' means, which weighs gappy rows more."""
    gap = F.col("predicted") - F.col("target")
    return long.agg(F.avg(F.when(is_finite(gap), gap * gap)).alias("global_mse"))


def mean_row_mse(frame: DataFrame, target: str, predicted: str) -> DataFrame:
    return frame.agg(F.avg(row_mse(F.col(target), F.col(predicted))).alias("mean_row_mse"))


def metric_panel(frame: DataFrame, key: str, target: str, predicted: str) -> DataFrame:
    """One row of ten scalars: cell errors, angles, divergence and the three key scores."""
    t, p = F.col(target), F.col(predicted)
    shape = frame.select(S.angle_deg(p, t).alias("sam"), S.gradient_angle_deg(p, t).alias("sga"), S.information_divergence(p, t).alias("sid"))
    middle = quantiles(shape, [], {"sam": {"sam_median": 0.5}, "sga": {"sga_median": 0.5}})
    shape = shape.agg(F.avg("sam").alias("sam_mean"), F.avg("sid").alias("sid_mean"))
    fidelity = parameter_fidelity(parameters_long(frame, key, target, predicted, list(G.KEY_PARAMETERS)))
    scores = fidelity.agg(*((F.sum(F.coalesce(m, F.lit(0.0))) / len(G.KEY_PARAMETERS)).alias(n) for m, n in (("pearson_r", "r_key_balanced"), ("ccc", "ccc_key_balanced"), ("slope", "slope_key_balanced"))))
    # Each side is one row.
    return cell_errors(bands_long(frame, [], target, predicted)).join(middle, how="cross").join(shape, how="cross").join(scores, how="cross")


def group_angles(frame: DataFrame, group: str, angle: str = "sam") -> DataFrame:
    """Count, median and exact 95th percentile per group."""
    return quantiles(frame, [group], {angle: {"sam_median": 0.5, "sam_p95": 0.95}}, count="n")


def median_of_medians(per_group: DataFrame, column: str = "sam_median") -> DataFrame:
    return quantiles(per_group, [], {column: {"median_of_medians": 0.5, "p95_of_medians": 0.95}})


def second_difference_noise(frame: DataFrame, spectrum: str) -> DataFrame:
    """Per band: share of finite values, and the deviation of the second difference centred there (NULL at the ends)."""
    bands = frame.select(F.posexplode(spectrum).alias("band", "y")).groupBy("band").agg(F.avg(is_finite(F.col("y")).cast("double")).alias("coverage"))
    bent = frame.select(F.posexplode(S.second_difference(F.col(spectrum))).alias("k", "d")).where(is_finite(F.col("d")))
    return bands.join(bent.groupBy((F.col("k") + 1).alias("band")).agg(F.stddev_pop("d").alias("hf_noise")), "band", "left")


def affine_calibration(long: DataFrame, *keys: str) -> DataFrame:
    """Per group of (x, y): n, correlation, fit y = slope x + offset, residual deviation and its share, means, their ratio."""
    x, y = _pair(F.col("x"), F.col("y"))
    fitted = long.groupBy(*keys).agg(F.count(x).alias("n"), pearson(F.col("x"), F.col("y")).alias("corr"), ols_slope(F.col("x"), F.col("y")).alias("slope"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_pop(x).alias("__vx"), F.var_pop(y).alias("__vy"), F.avg(F.abs(y)).alias("__ay"))
    left = F.sqrt(F.greatest(F.col("__vy") - F.col("slope") * F.col("slope") * F.col("__vx"), F.lit(0.0)))
    out = fitted.withColumn("offset", F.col("mean_y") - F.col("slope") * F.col("mean_x")).withColumn("resid_std", left)
    return out.withColumn("resid_rel", F.try_divide("resid_std", "__ay")).withColumn("mean_ratio", F.try_divide("mean_y", "mean_x")).drop("__vx", "__vy", "__ay")


def correlation_matrix(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns over rows complete in all of them, in one pass."""
    kept = frame.where(F.expr(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns)))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = kept.agg(*(pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def gram_matrix(frame: DataFrame, vector: str) -> DataFrame:
    """(i, j, value) of the sum of outer products over complete rows, upper triangle: one matrix product a task, added up in Spark."""

    def products(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    full = frame.where(all_finite(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    return full.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def spectral_basis(frame: DataFrame, vector: str, rank: int = 2) -> tuple[list[list[float]], dict]:
    """Leading right singular vectors (not centred) of the complete rows, from the Gram matrix, and a report.

    The matrix has the size of the grid squared, so it may come to the driver.
    """
    rows = gram_matrix(frame, vector).collect()
    size = 1 + max((r["j"] for r in rows), default=-1)
    gram = np.zeros((size, size))
    for r in rows:
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["value"]
    values, vectors = np.linalg.eigh(gram) if size else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(values)[::-1]
    share = np.clip(values[order], 0, None) / max(np.clip(values, 0, None).sum(), 1e-300)
    modes = vectors[:, order[:rank]].T
    modes = modes * np.where(np.take_along_axis(modes, np.abs(modes).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0) if size else modes
    norm = frame.where(all_finite(F.col(vector))).select(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    found = norm.agg(F.count("n").alias("n"), F.median("n").alias("m")).first()
    return modes.tolist(), {"n_rows_total": frame.count(), "n_rows_used": found["n"], "explained_variance_ratio": share[: max(rank, 5)].tolist(), "cumulative_at_rank": float(share[:rank].sum()), "median_residual_norm": found["m"]}


def contrast(value: Column, inside: Column) -> Column:
    """Ratio of the medians of finite values inside and outside."""
    ok = is_finite(value)
    return F.try_divide(F.median(F.when(ok & inside, value)), F.median(F.when(ok & ~inside, value)))


def _sides(tried: DataFrame, keys: list[str], inside: str, values: dict[str, Column]) -> DataFrame:
    """Medians of finite values inside and outside, as <name>_in and <name>_out per key."""
    cells = tried.select(*keys, F.col(inside).alias("__inside"), *(F.when(is_finite(v), v).alias(n) for n, v in values.items()))
    middle = quantiles(cells, [*keys, "__inside"], {n: {f"{n}_m": 0.5} for n in values})
    return middle.groupBy(*keys).agg(*(F.max(F.when(F.col("__inside") == side, F.col(f"{n}_m"))).alias(f"{n}_{name}") for n in values for side, name in ((True, "in"), (False, "out"))))


#: Rows of a block of the scale search, and parts (a power of two) that a stretch of values is cut into.
SCALE_BLOCK, SCALE_PARTS = 65_536, 128
_SIGN = np.uint64(1 << 63)
_LAST_KEY = np.uint64(2**64 - 1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >= _SIGN, ~bits, bits | _SIGN)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= _SIGN, keys ^ _SIGN, ~keys).view(np.float64)


def _shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits to drop so that a stretch of keys falls into ``SCALE_PARTS`` parts at most."""
    wide, bits = high - low, np.zeros(len(low), np.uint64)
    while (more := (wide >> bits) >= SCALE_PARTS).any():
        bits += more.astype(np.uint64)
    return bits


def _first_stretches(step: float, last: int):
    """For each group the stretch of keys that holds all values at a scale, on both sides, from the ends of what they are made of."""

    def run(batches):
        s = np.arange(last + 1) * step
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (r[a] + s * r[b] + sign * 1e-9 * (abs(r[a]) + s * abs(r[b])) for a, b, sign in (("a0", "b0", -1), ("a1", "b1", 1)))
                top = np.finfo(float).max
                low, high = (_ordered(np.clip(np.nan_to_num(x, nan=e, posinf=top, neginf=-top), -top, top)).view(np.int64) for x, e in ((low, -top), (high, top)))
                yield pa.RecordBatch.from_pylist([{"__g": r["__g"], "target": r["target"], "k": list(range(last + 1)), "low": np.tile(low, 2).tolist(), "high": np.tile(high, 2).tolist(), "b": None}], batch_schema(batch))

    def batch_schema(batch):
        longs = pa.list_(pa.int64())
        best = pa.struct([("s", pa.float64()), ("c", pa.float64())])
        return pa.schema([("__g", batch.schema.field("__g").type), ("target", pa.float64()), ("k", pa.list_(pa.int32())), ("low", longs), ("high", longs), ("b", best)])

    return run


def _counted(step: float):
    """Of a block of rows, counts of the values below (-1), in each part of, and above (``SCALE_PARTS``) the stretch of every open scale and side."""

    def run(rows: pa.Table, state: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if rows.num_rows and state.num_rows:
            ks = state["k"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            low, high = (state[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("low", "high"))
            shifts = _shift(low, high)
            inside = rows["inside"].to_numpy()
            columns = [rows[c].to_numpy() for c in ("anchor", "residual", "gate", "n")]
            for side in (0, 1):
                anchor, residual, gate, n = (c[inside == (side == 0)] for c in columns)
                for j, k in enumerate(ks):
                    at = side * len(ks) + j
                    v = anchor + (k * step) * gate * residual
                    fine = np.isfinite(v)
                    keys, weight = (_ordered(v), n) if fine.all() else (_ordered(v[fine]), n[fine])
                    under, over = keys < low[at], keys > high[at]
                    part = ((keys - low[at]) >> shifts[at]).astype(np.int64)
                    part[under], part[over] = -1, SCALE_PARTS
                    counts = np.bincount(part + 1, weights=weight, minlength=SCALE_PARTS + 2)
                    least, most = np.full(SCALE_PARTS + 2, _LAST_KEY), np.zeros(SCALE_PARTS + 2, np.uint64)
                    np.minimum.at(least, part + 1, keys)
                    np.maximum.at(most, part + 1, keys)
                    held = np.flatnonzero(counts)
                    for o, x in zip(out, (np.full(len(held), side), np.full(len(held), k), held - 1, counts[held], (least[held] ^ _SIGN).view(np.int64), (most[held] ^ _SIGN).view(np.int64)), strict=True):
                        o.append(x)
        joined = [np.concatenate(o) if o else np.zeros(0) for o in out]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        data = {"__g": pa.array([state["__g"][0].as_py()] * len(joined[0]), state.schema.field("__g").type)} if state.num_rows else {"__g": pa.array([], rows.schema.field("__g").type)}
        return pa.table(data | {c: pa.array(x.astype(np.int64)).cast(t) for c, x, t in zip(("side", "k", "part", "n", "least", "most"), joined, kinds, strict=True)})

    return run


def _narrowed(step: float):
    """A group's stretches after a count: those of the parts that hold the middle ranks. Scales that can't be the nearest are let go; with all medians known, ``b`` is the best."""

    def run(state: pa.Table, counts: pa.Table) -> pa.Table:
        target = state["target"][0].as_py()
        side, ks, part, n = (counts[c].to_numpy() for c in ("side", "k", "part", "n"))
        least, most = (counts[c].to_numpy().view(np.uint64) ^ _SIGN for c in ("least", "most"))
        order = np.lexsort((part, ks, side))
        side, ks, n, least, most = (x[order] for x in (side, ks, n, least, most))
        known: dict[int, list] = {}
        starts = np.flatnonzero(np.r_[True, (np.diff(ks) != 0) | (np.diff(side) != 0)]) if len(ks) else []
        for a, z in zip(starts, [*starts[1:], len(ks)], strict=True):
            upto = np.cumsum(n[a:z])
            first, second = (a + int(np.searchsorted(upto, r, side="right")) for r in ((upto[-1] - 1) // 2, upto[-1] // 2))
            # In two parts the ranks are the last of the one and the first of the other.
            low, high = (least[first], most[first]) if first == second else (most[first], least[second])
            known.setdefault(int(ks[a]), [None, None])[side[a]] = (low, high, first != second or low == high)
        open_ = []
        for k, (i, o) in sorted(known.items()):
            if i is None or o is None:
                continue
            (il, ih), (ol, oh) = (_doubles(np.array(x[:2], np.uint64)) for x in (i, o))
            done = i[2] and o[2]
            if done:
                middle_in, middle_out = (a if a == b else 0.5 * a + 0.5 * b for a, b in ((il, ih), (ol, oh)))
                if not middle_out:
                    continue
                c = middle_in / middle_out
                near = far = abs(c - target)
            elif ol > 0:
                c0, c1 = (il / oh if il >= 0 else il / ol), (ih / ol if ih >= 0 else ih / oh)
                near, far, c = max(c0 - target, target - c1, 0.0), max(abs(c0 - target), abs(c1 - target)), None
            else:
                near, far, c = 0.0, math.inf, None
            open_.append((near, far, k, c, i, o))
        # Bounds leave room for rounding; medians that are known are compared as they are.
        bound = min((x[1] if x[3] is not None else x[1] * (1 + 1e-9) + 1e-12 for x in open_), default=math.inf)
        open_ = [x for x in open_ if (x[0] if x[3] is not None else x[0] * (1 - 1e-9) - 1e-12) <= bound]
        all_known, best = all(x[3] is not None for x in open_), None
        if all_known:
            least_gap = min(open_, key=lambda x: (x[0], x[2]), default=None)
            best = {"s": float(least_gap[2] * step) if least_gap else None, "c": float(least_gap[3]) if least_gap else None}
            open_ = []
        edge = lambda which: np.array([x[4 + s][which] for s in (0, 1) for x in open_], np.uint64).view(np.int64).tolist()
        return pa.Table.from_pylist([{"__g": state["__g"][0].as_py(), "target": target, "k": [x[2] for x in open_], "low": edge(0), "high": edge(1), "b": best}], state.schema)

    return run


def scale_star(frame: DataFrame, group: str, measured: str, anchor: str, residual: str, gate: str, inside: str, top: float = 2.0, step: float = 0.005, least: int = 5, block: int = SCALE_BLOCK) -> DataFrame:
    """Per group the grid scale at which contrast(anchor + scale * gate * residual) is nearest to the measured one.

    Ties go to the smaller scale; groups with fewer than ``least`` rows on a side are left out.

    All groups and all scales are searched together. Equal rows are one row with a weight, dealt out in blocks. A pass counts each scale's values in
    ``SCALE_PARTS`` parts of the stretch that holds its median, block by block; the part with the middle ranks is the next
    stretch. The keys are the bits of the doubles, so ten passes are the most there can be. Stretches bound a contrast: scales that can't
    come as near as another are let go. The result is that of the whole grid.
    """
    rows = frame.where(F.col(group).isNotNull() & F.col(inside).isNotNull()).select(F.col(group).alias("__g"), F.col(inside).alias("inside"), *(F.col(c).cast("double").alias(n) for n, c in (("measured", measured), ("anchor", anchor), ("residual", residual), ("gate", gate))))
    target = _sides(rows, ["__g"], "inside", {"m": F.col("measured")}).select("__g", F.try_divide("m_in", "m_out").alias("target"))
    moved = F.col("gate") * F.col("residual")
    ok = is_finite(F.col("anchor")) & is_finite(F.col("gate")) & is_finite(F.col("residual"))
    ends = [f(F.when(ok, x)).alias(f"{n}{i}") for n, x in (("a", F.col("anchor")), ("b", moved)) for i, f in enumerate((F.min, F.max))]
    sizes = rows.groupBy("__g").agg(F.count_if("inside").alias("i"), F.count_if(~F.col("inside")).alias("o"), *ends).where((F.col("i") >= least) & (F.col("o") >= least) & F.col("a0").isNotNull())
    last = int(math.floor(top / step + 1e-9))
    kind = frame.schema[group].dataType.simpleString()
    shape = f"__g {kind}, target double, k array<int>, low array<bigint>, high array<bigint>, b struct<s:double,c:double>"
    state = cut(sizes.join(target.where("target is not null"), "__g").mapInArrow(_first_stretches(step, last), shape))
    values = ["anchor", "residual", "gate"]
    unique = rows.where(ok).join(state.select("__g"), "__g", "left_semi").groupBy("__g", "inside", *values).agg(F.count(F.lit(1)).alias("n"))
    unique = cut(unique)
    blocks = unique.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__of"))
    blocks = cut(blocks)
    dealt = unique.join(blocks, "__g").withColumn("__block", F.pmod(F.xxhash64("inside", *values), F.col("__of")).cast("int")).drop("__of")
    # Few bytes are much work here, so partitions are not left to be merged by their size.
    tasks, by = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["__g", "__block"]
    done = state.where("false")
    while not state.isEmpty():
        asked = state.join(blocks, "__g").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__of") - 1))).drop("__of")
        open_rows = dealt.join(state.select("__g"), "__g", "left_semi")
        found = open_rows.repartition(tasks, *by).groupBy(*by).cogroup(asked.repartition(tasks, *by).groupBy(*by)).applyInArrow(_counted(step), f"__g {kind}, side int, k int, part int, n bigint, least bigint, most bigint")
        # The top bit of the keys is turned here, so that Spark's signed order is theirs.
        found = found.groupBy("__g", "side", "k", "part").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        state = cut(state.groupBy("__g").cogroup(found.groupBy("__g")).applyInArrow(_narrowed(step), shape))
        done = done.unionByName(state.where("b is not null"))
        state = state.where("b is null")
    return done.where("b.s is not null").select(F.col("__g").alias(group), F.col("b.s").alias("s_star"), F.col("b.c").alias("contrast"), "target")


def leave_one_out(stars: DataFrame, group: str) -> DataFrame:
    """Per group (one row each) the median scale of the others, read off one sorted list of all groups' scales.

    Without the value at one place of the list the middle ones are at most a place further on. The list is a number for each group, of which there are few.
    """
    known = stars.where(F.col("s_star").isNotNull()).agg(F.array_sort(F.collect_list(F.struct("s_star", F.col(group).alias("g")))).alias("all"))
    both = stars.crossJoin(F.broadcast(known))  # one row
    own = F.array_position("all", F.struct("s_star", F.col(group).alias("g")))  # from 1; 0 if this group has no scale
    left = F.size("all") - F.when(own > 0, 1).otherwise(0)
    at = lambda k: F.get("all", (k + F.when((own > 0) & (k >= own - 1), 1).otherwise(0)).cast("int"))["s_star"]
    low, high = at(F.floor((left - 1) / 2)), at(F.floor(left / 2))
    return both.select(group, F.when(left > 0, (low + high) / 2).alias("s_from_others"))


def merge_report(path: str, fresh: dict, guard: str = "mse", tolerance: float = 1e-12) -> dict:
    """Merge into a JSON report, refusing when a stored ``guard`` differs by more than the relative tolerance."""
    file = Path(path)
    held = json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
    if guard in held and guard in fresh and abs(held[guard] - fresh[guard]) > tolerance * abs(held[guard]):
        raise ValueError(f"{guard} drifted from {held[guard]!r} to {fresh[guard]!r}; the report was not touched")
    merged = held | fresh
    file.write_text(json.dumps(merged, indent=2), encoding="utf-8")
    return merged


def compare_arrays(a: DataFrame, b: DataFrame, key: str, value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: rows matched, largest absolute difference, and whether all are close (NaN equals NaN)."""
    x, y = F.col("v.x"), F.col("v.y")
    both = a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key)
    cells = both.select(F.explode(F.arrays_zip(F.col("__a").alias("x"), F.col("__b").alias("y"))).alias("v"))
    same = (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= atol + rtol * F.abs(y))
    parts = cells.agg(F.max(F.when(F.isnan(x) & F.isnan(y), 0.0).otherwise(F.abs(x - y))).alias("max_abs_diff"), F.every(F.coalesce(same, F.lit(False))).alias("all_close"))
    return both.agg(F.count(F.lit(1)).alias("n")).join(parts, how="cross")
