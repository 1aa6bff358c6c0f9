"""Rasters as rows (row, col, bands): a Python Data Source that reads row ranges, and sinks.

``spark.read.format("rasterloom_raster").option("path", ...)`` makes one partition per block of rows; the options
``rowfrom`` and ``rowto`` prune blocks before they are read. They are options, not pushed filters, because a reader's
pushed state outlives the query and would narrow later uses of the same DataFrame. The file must lie where every
executor can open it.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.lineage import shared_folder
from . import tiff


class RowBlock(InputPartition):
    def __init__(self, row: int, height: int):
        self.row, self.height = row, height


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rowblock", 256))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        self.low = int(options.get("rowfrom", 0))
        self.high = int(options["rowto"]) if options.get("rowto") else None

    def partitions(self):
        with open(self.path, "rb") as file:
            height = tiff.read_info(file).height
        high = height if self.high is None else min(self.high, height)
        first = self.low // self.step * self.step
        return [RowBlock(max(r, self.low), min(r + self.step, high) - max(r, self.low)) for r in range(first, max(high, first), self.step) if min(r + self.step, high) > max(r, self.low)] or [RowBlock(0, 0)]

    def read(self, partition):
        if not partition.height:
            return
        with open(self.path, "rb") as file:
            info = tiff.read_info(file)
            for r in range(partition.row, partition.row + partition.height, 16):
                h = min(16, partition.row + partition.height - r)
                data = tiff.read_window(file, info, r, 0, h, info.width, self.bands).astype(np.float32)
                n = data.shape[0]
                values = data.transpose(1, 2, 0).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n, dtype=np.int32)), pa.array(values))
                rows, cols = np.repeat(np.arange(r, r + h, dtype=np.int32), info.width), np.tile(np.arange(info.width, dtype=np.int32), h)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), lists], ["row", "col", "bands"])


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return "rasterloom_raster"

    def schema(self):
        return "row int, col int, bands array<float>"

    def reader(self, schema):
        return RasterReader(self.options)


def read_raster(spark: SparkSession, path: str, bands: list[int] | None = None, row_block: int = 256, rows: tuple[int, int] | None = None) -> DataFrame:
    """The pixels of a raster, of 1-based bands and of rows[0] <= row < rows[1] if given."""
    spark.dataSource.register(RasterSource)
    options = {"path": path, "rowblock": str(row_block)}
    if bands:
        options["bands"] = ",".join(map(str, bands))
    if rows:
        options |= {"rowfrom": str(max(0, rows[0])), "rowto": str(max(0, rows[1]))}
    return spark.read.format("rasterloom_raster").options(**options).load()


def read_window(spark: SparkSession, path: str, row: int, col: int, height: int, width: int, bands: list[int] | None = None) -> DataFrame:
    frame = read_raster(spark, path, bands, rows=(row, row + height))
    return frame.where((F.col("col") >= col) & (F.col("col") < col + width))


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata; no pixel is read."""
    with open(path, "rb") as file:
        i = tiff.read_info(file)
    row = (path, i.width, i.height, i.count, i.dtype, list(i.transform), list(i.bounds), i.nodata, list(i.block))
    return spark.createDataFrame([row], "path string, width int, height int, count int, dtype string, transform array<double>, bounds array<double>, nodata double, block_shape array<int>")


def write_tiles(pixels: DataFrame, path: str, rows: int = 256) -> None:
    """The primary sink: Parquet by tile row, zstd, sorted within, so that row ranges prune files and row groups."""
    tiled = pixels.withColumn("tile_row", F.floor(F.col("row") / rows).cast("int"))
    tiled.repartition("tile_row").sortWithinPartitions("row", "col").write.option("compression", "zstd").partitionBy("tile_row").mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str, row_from: int | None = None, row_to: int | None = None, rows: int = 256) -> DataFrame:
    """Pixels of a tile dataset; a row range also prunes the partitions."""
    frame = spark.read.parquet(path)
    if row_from is not None:
        frame = frame.where((F.col("tile_row") >= row_from // rows) & (F.col("row") >= row_from))
    if row_to is not None:
        frame = frame.where((F.col("tile_row") <= (row_to - 1) // rows) & (F.col("row") < row_to))
    return frame.drop("tile_row")


def _dense(table: pa.Table, column: str, row: int, col: int, shape: tuple[int, int], bands: int, kind: np.dtype, blank: float) -> np.ndarray:
    """(rows, cols, bands) of the pixels of one tile; absent and NULL ones hold ``blank``."""
    kept = table.filter(pc.is_valid(table[column]))
    out = np.full((*shape, bands), blank, kind)
    if len(kept):
        values = kept[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(kept), bands)
        out[kept["row"].to_numpy() - row, kept["col"].to_numpy() - col] = values
    return out


def write_geotiffs(pixels: DataFrame, folder: str, width: int, transform: tuple, column: str = "spectrum", nodata: float = -3.4028226550889045e38, labels: list[str] | None = None, rows: int = 16) -> DataFrame:
    """One GeoTIFF per strip of ``rows`` rows into a folder that all executors share; (path, row, height) of the files.

    Pixels that are absent or NULL hold the nodata value in all bands. A task holds one strip.
    """
    a, b, c, d, e, f = transform

    def write_one(key, table):
        top = key[0].as_py() * rows
        height = int(table["row"].to_numpy().max()) - top + 1
        seen = pc.list_value_length(table[column]).drop_null()
        bands = seen[0].as_py() if len(seen) else 1
        data = _dense(table, column, top, 0, (height, width), bands, np.dtype(np.float32), nodata).transpose(2, 0, 1)
        path = f"{folder}/rows_{top:06d}.tif"
        tiff.write(path, data, (a, b, c, d, e, f + e * top), nodata, labels, tile=(16, 512))
        return pa.table({"path": [path], "row": pa.array([top], pa.int32()), "height": pa.array([height], pa.int32())})

    return pixels.withColumn("strip", F.floor(F.col("row") / rows).cast("int")).groupBy("strip").applyInArrow(write_one, "path string, row int, height int")


def write_mosaic(pixels: DataFrame, path: str, width: int, height: int, bands: int, transform: tuple, column: str = "spectrum", dtype: str = "f4", nodata: float | None = -3.4028226550889045e38, labels: list[str] | None = None, tile: tuple[int, int] = (128, 256)) -> int:
    """One GeoTIFF of all pixels; the number of tiles with data. The path is on a file system that driver and executors share.

    Executors build and compress tiles into a table; the driver reads their sizes, lays the file out and writes its directory; executors
    then put their tiles in place. No tile passes through the driver, and a task that is run again puts the same bytes in the same
    place. The file is made beside ``path`` and takes its name when it is whole, so a run that fails leaves what was there before.
    Absent and NULL pixels hold the nodata value in all bands; three bands are tagged as RGB; files are BigTIFF at any size.
    """
    across, kind = -(-width // tile[1]), np.dtype(dtype)
    blank = 0 if nodata is None else nodata

    def encode(key, table):
        number = key[0].as_py()
        block = _dense(table, column, number // across * tile[0], number % across * tile[1], tile, bands, kind, blank)
        return pa.table({"tile": pa.array([number], pa.int64()), "data": pa.array([tiff.encode_block(block.astype(kind.newbyteorder("<")))], pa.binary())})

    spark, path = pixels.sparkSession, os.path.abspath(path)
    folder, made = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.part"
    inside = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    number = (F.floor(F.col("row") / tile[0]) * across + F.floor(F.col("col") / tile[1])).cast("long")
    encoded = inside.select("row", "col", column, number.alias("tile")).groupBy("tile").applyInArrow(encode, "tile long, data binary")
    try:
        encoded.withColumn("size", F.octet_length("data")).write.option("compression", "uncompressed").parquet(folder)
        tiles = spark.read.schema("tile long, data binary, size int").parquet(folder)
        sizes = tiles.select("tile", "size").toArrow().sort_by("tile")  # numbers only, as the file's directory holds them
        with tiff.Writer(made, width, height, bands, kind.str, transform, nodata, labels, tile) as out:
            places = spark.sparkContext.broadcast(out.reserve(list(zip(sizes["tile"].to_pylist(), sizes["size"].to_pylist()))))

        def put(batches):
            n = 0
            with open(made, "r+b") as file:
                for batch in batches:
                    for number, data in zip(batch.column("tile").to_pylist(), batch.column("data")):
                        file.seek(places.value[number])
                        file.write(data.as_buffer())
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        found = tiles.select("tile", "data").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
        if found != sizes.num_rows:
            raise RuntimeError(f"{found} of {sizes.num_rows} tiles were put in place")
        os.replace(made, path)
        return found
    finally:
        if os.path.exists(made):
            os.remove(made)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_mask(mask: DataFrame, path: str, width: int, height: int, transform: tuple, value: str | None = None, description: str = "selection") -> int:
    """A single band: 1 where (row, col) is in the mask, or its ``value`` column as a float; 0 elsewhere."""
    if value is None:
        cells = mask.select("row", "col").distinct().withColumn("v", F.array(F.lit(1).cast("tinyint")))
        return write_mosaic(cells, path, width, height, 1, transform, "v", "u1", None, [description])
    return write_mosaic(mask.select("row", "col", F.array(F.col(value).cast("float")).alias("v")), path, width, height, 1, transform, "v", "f4", None, [description])


def extract_bands(pixels: DataFrame, path: str, bands: list[int], labels: list[str], width: int, height: int, transform: tuple, column: str = "spectrum") -> int:
    """A GeoTIFF of 1-based bands in the given order with their labels; refuses bands out of range."""
    if any(not 1 <= b <= len(labels) for b in bands):
        raise IndexError(f"bands must lie in 1..{len(labels)}")
    chosen = F.array(*(F.get(column, b - 1) for b in bands))
    picked = pixels.select("row", "col", F.when(F.col(column).isNotNull(), chosen).alias("v"))
    return write_mosaic(picked, path, width, height, len(bands), transform, "v", labels=[labels[b - 1] for b in bands])
