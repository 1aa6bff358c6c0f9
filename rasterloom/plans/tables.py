"""The driver's tables in the roles of the domain's: vectors as spectra, keys as coordinates, events as pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import grid as G


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_spectrum(vector: Column) -> Column:
    """231 positive reflectances from a vector, repeated along the grid."""
    n = F.size(vector)
    return F.transform(F.sequence(F.lit(0), F.lit(G.GRID_SIZE - 1)), lambda k: F.abs(F.get(vector, k % n).cast("double")) * 0.02 + 0.05)


def pairs(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(vec_id, label, target, predicted): each vector and the next one by id."""
    vectors = read(spark, sf_dir, "embeddings")
    value = wide_spectrum(F.col("embedding")) if wide else F.col("embedding").cast("array<double>")
    target = vectors.select("vec_id", "label", value.alias("target"))
    predicted = vectors.select((F.col("vec_id") - 1).alias("vec_id"), value.alias("predicted"))
    return target.join(predicted, "vec_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", (key * 137.508 % 360.0 - 180.0).alias("lon"), (key * 61.803 % 160.0 - 80.0).alias("lat"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", (key * 97.11 % 360.0 - 180.0).alias("clon"), (key * 31.7 % 150.0 - 75.0).alias("clat"), (F.lit(20.0) + key % 7 * 40.0).alias("radius_km"))


#: Pixels of the generated grid: 100 columns.
WIDTH = 100


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value, spectrum of three bands) from the unique event ids."""
    e = F.col("event_id")
    value = F.col("value")
    return read(spark, sf_dir, "events").select(F.floor(e / WIDTH).cast("int").alias("row"), (e % WIDTH).cast("int").alias("col"), "value", F.array(value, value * 2, F.lit(0.5)).alias("spectrum"))


#: Spectral modes of the generated layer.
MODES = [[1.0, 0.5, 0.25], [0.1, 0.2, -0.3]]
#: Pixels of the layer have a larger value.
LAYER_FROM = 95.0


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the generated grid."""
    return read(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / WIDTH) + 1).first()[0]


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: the pixels of high value."""
    e = F.col("event_id")
    chosen = read(spark, sf_dir, "events").where(F.col("value") > LAYER_FROM)
    return chosen.select(F.floor(e / WIDTH).cast("int").alias("row"), (e % WIDTH).cast("int").alias("col"), F.lit(0.5).cast("float").alias("g"), (F.col("value") / 10).alias("c0"), (e % 5 / 10).alias("c1"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, ring): a four-sided ring on the generated grid for every nation."""
    x, y = F.col("n_nationkey") * 37 % 80, F.col("n_nationkey") * 53 % 80
    corners = ((0.3, 0.2), (7.6, 1.1), (5.2, 9.4), (1.0, 6.3))
    ring = F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in corners))
    return read(spark, sf_dir, "nation").select("n_nationkey", ring.alias("ring"))


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with four quality columns; q1 is missing on every third line number."""
    q1 = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount") * 3 + 0.85)
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", q1.alias("q1"), (F.col("l_quantity") - 25).alias("q2"), (F.col("l_tax") * 400 + 70).alias("q3"), (F.col("l_suppkey") % 10 + 90).cast("double").alias("q4"))
