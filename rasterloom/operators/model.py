"""Per-pixel perceptrons on DataFrames: weights are broadcast (a fixed, small set), rows go through in Arrow batches."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import is_valid_pixel
from ..grid import EPS_TRAINING
from ..plans.lineage import cut
from .splits import weighted_draws

# Coefficients of a rational approximation of erf (largest error 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + ERF_P * np.abs(x))
    series = t * np.polyval(ERF[::-1], t)
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    """The exact form x * Phi(x)."""
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


@dataclass
class Perceptron:
    """Dense layers; ``layers`` holds (weights (in, out), bias). The activation stands between layers."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    activation: str = "gelu"
    meta: dict = field(default_factory=dict)
    dropout: float = 0.0  # share of hidden values left out while training

    @classmethod
    def fresh(cls, sizes: list[int], activation: str = "gelu", seed: int = 42) -> "Perceptron":
        rng = np.random.default_rng(seed)
        shape = list(zip(sizes[:-1], sizes[1:]))
        return cls([(rng.uniform(-1, 1, (a, b)) / math.sqrt(a), rng.uniform(-1, 1, b) / math.sqrt(a)) for a, b in shape], activation)

    @classmethod
    def load(cls, path: str, prefix: str = "") -> "Perceptron":
        """From an .npz with w0, b0, w1, ... (as ``save`` writes), or an .npz or JSON file of named arrays, see ``from_state``."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                return cls.from_state({k: np.array(v) for k, v in json.load(f).items()}, prefix)
        held = np.load(path, allow_pickle=False)
        if "w0" not in held.files:
            return cls.from_state({k: held[k] for k in held.files}, prefix)
        n = sum(k.startswith("w") for k in held.files)
        meta = json.loads(str(held["meta"])) if "meta" in held.files else {}
        return cls([(held[f"w{k}"], held[f"b{k}"]) for k in range(n)], meta.get("activation", "gelu"), meta)

    @classmethod
    def from_state(cls, arrays: dict[str, np.ndarray], prefix: str = "", activation: str = "gelu") -> "Perceptron":
        """From named arrays ``<prefix><number>.weight`` (out, in) and ``.bias``, dense layers in the order of their numbers."""
        found = {int(m[1]) for k in arrays if (m := re.fullmatch(re.escape(prefix) + r"(?:\w+\.)*?(\d+)\.weight", k))}
        if not found:
            raise ValueError(f"no dense layer under {prefix!r}")
        name = next(k for k in arrays if re.fullmatch(re.escape(prefix) + r"(?:\w+\.)*?\d+\.weight", k)).rsplit(".", 2)[0] + "." if not prefix else prefix
        name = "" if name and f"{name}{min(found)}.weight" not in arrays else name
        return cls([(np.asarray(arrays[f"{name}{k}.weight"]).T, np.asarray(arrays[f"{name}{k}.bias"])) for k in sorted(found)], activation)

    def save(self, path: str) -> None:
        arrays = {f"{n}{k}": v for k, layer in enumerate(self.layers) for n, v in zip("wb", layer)}
        np.savez(path, **arrays, meta=np.array(json.dumps(self.meta | {"activation": self.activation})))

    def _act(self, x: np.ndarray) -> np.ndarray:
        return gelu(x) if self.activation == "gelu" else np.maximum(x, 0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if k + 1 < len(self.layers):
                x = self._act(x)
        return x

    def gradients(self, x: np.ndarray, slope_of, rng: np.random.Generator | None = None) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Loss and parameter gradients; ``slope_of(output)`` gives (loss, d loss / d output). Dropout acts with ``rng`` only."""
        inputs, sums, kept = [x], [], []
        for k, (w, b) in enumerate(self.layers):
            sums.append(inputs[-1] @ w + b)
            hidden = k + 1 < len(self.layers)
            kept.append((rng.random(sums[-1].shape) >= self.dropout) / (1 - self.dropout) if hidden and rng is not None and self.dropout else 1.0)
            inputs.append(self._act(sums[-1]) * kept[-1] if hidden else sums[-1])
        loss, back = slope_of(inputs[-1])
        out = []
        for k in range(len(self.layers) - 1, -1, -1):
            if k + 1 < len(self.layers):
                back = back * kept[k] * (gelu_slope(sums[k]) if self.activation == "gelu" else (sums[k] > 0))
            out.append((inputs[k].T @ back, back.sum(axis=0)))
            back = back @ self.layers[k][0].T
        return loss, out[::-1]


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without NULLs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def apply_model(frame: DataFrame, model: Perceptron, inputs: str, output: str, valid: str | None = None, double: bool = False) -> DataFrame:
    """``frame`` with the model's output array; NULL where the inputs are NULL or the ``valid`` column is not true.
    With ``double`` inputs and outputs are doubles, for results that are added up.

    Narrow: scan, mask and model stay in one stage.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*frame.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType() if double else T.FloatType()))])
    kind = np.float64 if double else np.float32

    def run(batches):
        net = shared.value
        for batch in batches:
            column = batch.column(inputs)
            use = np.array(column.is_valid())
            if valid is not None:
                use &= batch.column(valid).fill_null(False).to_numpy(zero_copy_only=False)
            found = net(as_matrix(column.filter(pa.array(use))).astype(kind)).astype(kind) if use.any() else np.zeros((0, 1), kind)
            offsets = np.concatenate([[0], np.cumsum(use * found.shape[1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~use, False)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, output])

    return frame.mapInArrow(run, schema)


def predict_pixels(pixels: DataFrame, model: Perceptron, count_mean: float, count_std: float, bands: str = "bands", output: str = "spectrum", with_count: bool = True) -> DataFrame:
    """(row, col, spectrum): the eight bands, and the standardised image count, of every pixel that is valid in
    all model inputs; NULL elsewhere. A pixel whose only missing band is the count is invalid too."""
    n = 9 if with_count else 8
    raw = F.slice(F.col(bands), 1, n)
    scaled = F.concat(F.slice(F.col(bands).cast("array<double>"), 1, 8), F.array((F.get(bands, 8).cast("double") - count_mean) / count_std)) if with_count else raw
    ready = pixels.select("row", "col", F.when(is_valid_pixel(raw), scaled.cast("array<float>")).alias("__x"))
    return apply_model(ready, model, "__x", output).drop("__x")


def masked_mse(predicted: np.ndarray, target: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Sum of squares and number of cells with a target, and the slope of the sum; zero if all are masked."""
    ok = ~np.isnan(target)
    gap = np.where(ok, predicted - np.where(ok, target, 0), 0)
    return float((gap * gap).sum()), int(ok.sum()), 2 * gap


def _rows(batch: pa.RecordBatch, inputs: str, target: str, weight: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.ones(batch.num_rows) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False)
    return as_matrix(batch.column(inputs)).astype(np.float64), as_matrix(batch.column(target)).astype(np.float64), w


def _weighted_mse(y: np.ndarray, w: np.ndarray, seen: list):
    root = np.sqrt(w)[:, None]

    def slope_of(out):
        loss, n, slope = masked_mse(out * root, y * root)
        seen[0], seen[1] = seen[0] + loss, seen[1] + n
        return loss, slope * root

    return slope_of


def _batch_gradients(shared, inputs: str, target: str, weight: str | None, seed: int | None, slopes: bool):
    """One vector a task: loss, cells and (if asked for) the gradient, so that one job adds up all."""

    def run(batches):
        net, seen, sums = shared.value, [0.0, 0], None
        rng = None if seed is None else np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = _rows(batch, inputs, target, weight)
            if not slopes:
                _weighted_mse(y, w, seen)(net(x))
                continue
            _, grads = net.gradients(x, _weighted_mse(y, w, seen), rng)
            flat = np.concatenate([v.ravel() for pair in grads for v in pair])
            sums = flat if sums is None else sums + flat
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[seen[0], seen[1]], sums if sums is not None else []])])], ["part"])

    return run


def _full_gradient(frame: DataFrame, shared, inputs: str, target: str, weight: str | None, seed: int | None = None, slopes: bool = True) -> tuple[float, np.ndarray | None]:
    """Mean loss and its gradient: one partial sum a task, added up element by element in one Spark job."""
    partial = frame.mapInArrow(_batch_gradients(shared, inputs, target, weight, seed, slopes), "part array<double>")
    table = partial.select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(max(2, table.num_rows))
    flat[table.column("k").to_numpy()] = table.column("v").to_numpy()
    if not flat[1]:
        return 0.0, None
    return flat[0] / flat[1], flat[2:] / flat[1]


class Adam:
    def __init__(self, flat: np.ndarray, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros_like(flat), np.zeros_like(flat)

    def step(self, flat: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * slope, 0.999 * self.v + 0.001 * slope**2
        return flat - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _flat(model: Perceptron) -> np.ndarray:
    return np.concatenate([v.ravel() for pair in model.layers for v in pair]).astype(np.float64)


def _unflat(model: Perceptron, flat: np.ndarray) -> Perceptron:
    shapes = [v.shape for pair in model.layers for v in pair]
    cut = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    parts = [c.reshape(s) for c, s in zip(cut, shapes)]
    return Perceptron(list(zip(parts[::2], parts[1::2])), model.activation, model.meta, model.dropout)


def _synchronous_epoch(frame: DataFrame, model: Perceptron, state: tuple, inputs: str, target: str, weight: str | None, n_batches: int, seed: int) -> tuple[float, np.ndarray, tuple]:
    """One epoch of mini-batches over the whole cluster: in every step the tasks sum the gradient of one batch, and one step is taken.

    Which batch a row is in follows from a hash of seed and row, so weights don't depend on the partitioning (but for rounding and
    dropout). A step is a job of few tasks over the rows of its batch, which the cached epoch finds by their number; a lost task is run again
    alone. (Steps inside one barrier stage were tried: each exchange between its tasks takes Spark a second.)
    """
    share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), inputs, target), 11).cast("double") / float(1 << 53)
    dealt = frame.withColumn("__batch", F.floor(share * n_batches)).sortWithinPartitions("__batch").persist(StorageLevel.MEMORY_AND_DISK)
    net, adam, seen = model, Adam(_flat(model), state[0]), np.zeros(2)
    _, adam.t, adam.m, adam.v = state
    for number in range(n_batches):
        shared = frame.sparkSession.sparkContext.broadcast(net)
        parts = dealt.where(F.col("__batch") == number).mapInArrow(_batch_gradients(shared, inputs, target, weight, seed + number if model.dropout else None, True), "part array<double>").collect()
        shared.destroy()
        found = [np.array(p[0]) for p in parts if len(p[0]) > 2]  # a vector of the model's size from each of few tasks
        if found:
            total = np.sum(found, axis=0)
            seen += total[:2]
            if total[1]:
                net = _unflat(model, adam.step(_flat(net), total[2:] / total[1]))
    dealt.unpersist()
    return seen[0] / max(seen[1], 1), _flat(net), (state[0], adam.t, adam.m, adam.v)


#: Rows of a batch for each task.
ROWS_A_TASK = 128
STATE = "epoch int, rate double, steps int, best double, stale int, weights array<double>, mean array<double>, square array<double>, best_weights array<double>, losses array<double>"


def _last_state(spark, folder: str | None):
    """What the last whole epoch left, or None. A file appears when its write has ended, so half an epoch is not seen."""
    if folder is None:
        return None
    try:
        return spark.read.schema(STATE).parquet(folder).orderBy(F.desc("epoch")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def train(frame: DataFrame, model: Perceptron, inputs: str = "x", target: str = "y", weight: str | None = None, validation: DataFrame | None = None, epochs: int = 100, rate: float = 1e-3, patience: int = 15, plateau: int = 5, factor: float = 0.5, batch_size: int | None = None, seed: int = 42, drawn: bool = False, state: str | None = None) -> tuple[Perceptron, list[float]]:
    """Adam on gradients summed over the cluster: of all rows, or with ``batch_size`` of batches of about so many, each step summed over the cluster.

    ``weight`` scales a row's loss; with ``drawn`` each epoch instead draws as many rows as there are, with replacement, by weight.
    The rate is multiplied by ``factor`` after ``plateau`` epochs without progress on the validation loss (training loss without one);
    training stops after ``patience``. Returns the best weights and the losses. NaN targets are masked; masked rows teach nothing.
    With ``state``, a folder that driver and executors share, every epoch is kept there and a run that was stopped goes on after its last one.
    """
    spark = frame.sparkSession
    flat = _flat(model)
    adam = Adam(flat, rate)
    best, best_flat, stale, losses, begun = math.inf, flat, 0, [], 0
    if (held := _last_state(spark, state)) is not None:
        flat, best_flat, adam.m, adam.v = (np.array(held[c]) for c in ("weights", "best_weights", "mean", "square"))
        adam.rate, adam.t, best, stale, losses, begun = held["rate"], held["steps"], held["best"], held["stale"], list(held["losses"]), held["epoch"]
    n_rows = frame.count() if batch_size or drawn else 0
    if batch_size:
        tasks = min(spark.sparkContext.defaultParallelism, max(1, batch_size // ROWS_A_TASK))
        n_batches = max(1, round(n_rows / batch_size))
    if drawn:
        keyed = frame.select(inputs, target, weight).withColumn("__key", F.xxhash64(inputs, target))
    elif batch_size:
        frame = cut(frame.repartition(tasks))  # dealt out once
    for t in range(begun + 1, epochs + 1):
        if stale >= patience:
            break
        slope, shared, now, scale = None, spark.sparkContext.broadcast(_unflat(model, flat)), frame, weight
        if drawn:
            now, scale = weighted_draws(keyed, weight, "__key", n_rows, seed + t).select(inputs, target), None
            now = now.repartition(tasks) if batch_size else now
        if batch_size:
            loss, after, left = _synchronous_epoch(now, _unflat(model, flat), (adam.rate, adam.t, adam.m, adam.v), inputs, target, scale, n_batches, seed + t)
            if validation is not None:
                shared = spark.sparkContext.broadcast(_unflat(model, after))
            flat, (_, adam.t, adam.m, adam.v) = after, left
        else:
            loss, slope = _full_gradient(now, shared, inputs, target, scale, seed + t if model.dropout else None)
        seen = loss if validation is None else _full_gradient(validation, shared, inputs, target, None, slopes=False)[0]
        shared.unpersist()
        losses.append(seen)
        if seen < best - 1e-12:
            best, best_flat, stale = seen, flat, 0
        else:
            stale += 1
            if stale % plateau == 0:
                adam.rate *= factor
        done = stale >= patience or not (batch_size or slope is not None)
        if not batch_size and not done:
            flat = adam.step(flat, slope)
        if state is not None:
            row = (t, float(adam.rate), adam.t, float(best), patience if done else stale, flat.tolist(), adam.m.tolist(), adam.v.tolist(), best_flat.tolist(), [float(x) for x in losses])
            spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{state}/run={t}")
        if done:
            break
    return _unflat(model, best_flat), losses


def fit_standardiser(frame: DataFrame, column: str) -> tuple[float, float]:
    """Mean and population deviation plus 1e-8 of a column's finite values, rounded to four-byte floats."""
    from ..functions.arrays import is_finite

    x = F.when(is_finite(F.col(column).cast("double")), F.col(column).cast("double"))
    mean, std = frame.agg(F.avg(x), F.stddev_pop(x)).first()
    return float(np.float32(mean or 0.0)), float(np.float32(np.float32(std or 0.0) + np.float32(1e-8)))


def training_angle(predicted, target):
    """The angle that training reports: like the metric, with the smaller guard of the norms."""
    from ..functions.spectral import angle_deg

    return angle_deg(predicted, target, EPS_TRAINING)


def train_correction(real: DataFrame, simulated: DataFrame, modes: np.ndarray, group: str, hidden: int = 32, simulated_share: float = 0.3, held_share: float = 0.15, seed: int = 42, **options) -> tuple["LowRankCorrection", list[float], float]:
    """Coefficient network over fixed modes from residual rows (x, residual) of two kinds; (correction, losses, weight of a simulated row).

    Simulated rows get the weight at which they hold ``simulated_share`` of the draws: every epoch draws as many rows as there are, with replacement.
    A share of their groups is held out and, with the real rows of ``is_validation`` if there is such a column, is the validation set.
    """
    from .splits import hold_out_groups, sampling_weight

    marked = hold_out_groups(simulated, group, held_share)
    own = real if "is_validation" in real.columns else real.withColumn("is_validation", F.lit(False))
    n_real, n_simulated = own.where("NOT is_validation").count(), marked.where("NOT is_validation").count()
    weight = sampling_weight(n_real, n_simulated, simulated_share)
    rows = own.select("x", "residual", "is_validation", F.lit(1.0).alias("weight")).unionByName(marked.select("x", "residual", "is_validation", F.lit(weight).alias("weight")))
    ready = coefficient_targets(rows, "residual", modes)
    first = ready.select(F.size("x")).first()
    net = Perceptron.fresh([first[0] if first else 9, hidden, len(modes)], seed=seed)
    net, losses = train(ready.where("NOT is_validation"), net, weight="weight", drawn=True, validation=ready.where("is_validation"), seed=seed, **options)
    return LowRankCorrection(net, np.asarray(modes)), losses, weight


@dataclass
class LowRankCorrection:
    """Coefficients of an input times fixed modes: r(x) = c(x) . modes."""

    coefficients: Perceptron
    modes: np.ndarray  # (rank, bands)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.coefficients(x) @ self.modes


@dataclass
class CorrectedModel:
    """A frozen base plus a correction of any kind, scaled by a strength per row."""

    base: Perceptron
    correction: object

    def __call__(self, x: np.ndarray, strength: np.ndarray | float = 1.0) -> np.ndarray:
        return self.base(x) + np.reshape(strength, (-1, 1)) * self.correction(x)


def coefficient_targets(residuals: DataFrame, vector: str, modes: np.ndarray, output: str = "y") -> DataFrame:
    """Residual spectra as coordinates on orthonormal modes; training the coefficients on these minimises the
    masked error of the correction over complete rows. Incomplete rows become NaN (masked)."""
    from ..functions.arrays import all_finite, dot, literal_array

    nan = F.array(*(F.lit(float("nan")) for _ in modes))
    return residuals.withColumn(output, F.when(all_finite(F.col(vector)), F.array(*(dot(F.col(vector), literal_array(m)) for m in modes))).otherwise(nan))


def mode_agreement(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Absolute cosines of corresponding modes."""
    return [float(abs(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y))) for x, y in zip(a, b)]


def compare_models(frame: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """One row over all cells of two prediction columns: correlation, median absolute values, largest and root mean square difference."""
    from .metrics import pearson
    from .order_stats import quantiles

    cells = frame.select(key, F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("v")).select(F.col("v.a").cast("double").alias("a"), F.col("v.b").cast("double").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    middle = quantiles(cells.select(F.abs("a").alias("a"), F.abs("b").alias("b")), [], {"a": {"median_abs_a": 0.5}, "b": {"median_abs_b": 0.5}})
    rest = cells.agg(pearson(F.col("a"), F.col("b")).alias("correlation"), F.max(gap).alias("max_abs_diff"), F.sqrt(F.avg(gap * gap)).alias("rms_diff"))
    return rest.join(middle, how="cross")  # one row each
