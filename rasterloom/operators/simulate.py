"""Simulated pairs: pure spectra and mixtures with their nearest background, with keyed noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import grid as G
from ..functions import resample
from ..functions.arrays import all_finite, mix
from ..functions.spectral import synthesise_bands
from .joins import nearest

#: Shares of the spectrum in the mixtures; arm 0 is pure.
SHARES = (1 / 3, 2 / 3)


def arms(frame: DataFrame, own: dict[str, str], background: dict[str, str], shares=SHARES) -> DataFrame:
    """``frame`` once per arm: arm 0 keeps the own arrays, arm k mixes share_k of them with the background's.

    ``own`` maps output names to the own columns, ``background`` the same names to the background columns.
    """
    share = F.element_at(F.array(F.lit(1.0), *(F.lit(float(s)) for s in shares)), F.col("arm") + 1)
    spread = frame.withColumn("arm", F.explode(F.sequence(F.lit(0), F.lit(len(shares))))).withColumn("share", share)
    mixed = {n: F.when(F.col("arm") == 0, F.col(c)).otherwise(mix(F.col(c), F.col(background[n]), F.col("share"))) for n, c in own.items()}
    return spread.withColumns(mixed)


def simulate_pairs(pool: DataFrame, backgrounds: DataFrame, calibration: list[dict], correlation: float, seed: int = 4242) -> DataFrame:
    """(ref_id, arm, mdis_iof, mdis_image_count, target) of three arms per pool row; rows with a missing band drop out.

    ``pool`` has ref_id, lon, lat, naive, target, mdis_image_count; ``backgrounds`` has bg_id, blon, blat, bg_naive, bg_target.
    ``calibration`` holds slope, offset and resid_std for every band, in order.
    """
    near = nearest(pool, backgrounds, "ref_id", "bg_id", candidate=("blon", "blat")).drop("distance_km")
    paired = pool.join(near, "ref_id").join(backgrounds.select("bg_id", "bg_naive", "bg_target"), "bg_id")
    three = arms(paired, {"y_naive": "naive", "y_target": "target"}, {"y_naive": "bg_naive", "y_target": "bg_target"})
    noisy = three.withColumn("__noise", resample.keyed_noise(F.col("ref_id"), F.col("arm"), len(calibration), seed)).withColumn("__syn", synthesise_bands(F.col("y_naive"), G.BANDS))
    bands = resample.simulated_bands(F.col("__syn"), F.col("__noise"), [c["slope"] for c in calibration], [c["offset"] for c in calibration], [c["resid_std"] for c in calibration], correlation)
    out = noisy.select("ref_id", "arm", bands.alias("mdis_iof"), "mdis_image_count", F.col("y_target").alias("target"))
    return out.where(all_finite(F.col("mdis_iof")))
