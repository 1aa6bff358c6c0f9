"""Table sinks."""

from __future__ import annotations

import json
import os
import shutil
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(frame: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Zstd Parquet. With a partition column only the partitions at hand are replaced, which makes a rerun idempotent."""
    writer = frame.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def consolidate(spark: SparkSession, source: str, target: str, files: int) -> int:
    """Few larger files from a dataset of many; returns the number of rows."""
    frame = spark.read.parquet(source)
    frame.coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target).count()


def csv(frame: DataFrame, path: str) -> None:
    """With a header; array columns are written as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in frame.dtypes]
    frame.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def report(frame: DataFrame, path: str) -> dict:
    """A one-row frame as a JSON document on the driver."""
    row = frame.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a report is made of exactly one row")
    found = row[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(found, f, indent=2, default=str)
    return found


def basis(spark: SparkSession, modes: list[list[float]], wavelengths: list[float], path: str) -> None:
    """One row per wavelength: wavelength_nm, b0, b1, ..."""
    rows = [(w, *(float(m[k]) for m in modes)) for k, w in enumerate(wavelengths)]
    names = ", ".join(["wavelength_nm double", *(f"b{k} float" for k in range(len(modes)))])
    spark.createDataFrame(rows, names).coalesce(1).write.mode("overwrite").parquet(path)


def band_subset(pixels: DataFrame, indexes: list[int], n_bands: int, column: str = "spectrum") -> DataFrame:
    """``pixels`` with 0-based bands picked in the given order; refuses indexes out of range."""
    if any(not 0 <= k < n_bands for k in indexes):
        raise IndexError(f"band indexes must lie in 0..{n_bands - 1}")
    return pixels.withColumn(column, F.transform(F.array(*map(F.lit, indexes)), lambda k: F.get(F.col(column), k)))


def basis_npz(path: str, modes: list[list[float]], wavelengths: list[float], report: dict | None = None) -> None:
    """The same as an .npz with B (bands, rank), wavelength_nm and the report's arrays and numbers."""
    np.savez(path, B=np.array(modes, np.float32).T, wavelength_nm=np.array(wavelengths), **{k: np.array(v) for k, v in (report or {}).items()})


def copy_file(source: str, target: str, reuse: bool = False, slack: float = 1.02) -> bool:
    """A byte copy; False if a target of the same size is reused. Refuses when the volume has no room for ``slack`` times the size."""
    size = os.path.getsize(source)
    if reuse and os.path.exists(target) and os.path.getsize(target) == size:
        return False
    free = shutil.disk_usage(os.path.dirname(os.path.abspath(target))).free
    if free < size * slack:
        raise OSError(f"{free} bytes are free for a copy of {size}")
    shutil.copyfile(source, target)
    return True


def png(path: str, image: np.ndarray) -> None:
    """(rows, cols) grey or (rows, cols, 3) colour values of 0-255 as a PNG."""
    image = np.ascontiguousarray(image, np.uint8)
    rows, cols = image.shape[:2]
    lines = np.concatenate([np.zeros((rows, 1), np.uint8), image.reshape(rows, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", cols, rows, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def line_chart(path: str, x: list[float], series: dict[str, list[float]], size: tuple[int, int] = (480, 800)) -> None:
    """Curves over one axis as a plain PNG: a frame and one colour a series; missing values leave gaps."""
    rows, cols = size
    image = np.full((rows, cols, 3), 255, np.uint8)
    image[[0, -1], :], image[:, [0, -1]] = 0, 0
    every = np.array([v for y in series.values() for v in y], float)
    low, high = (np.nanmin(every), np.nanmax(every)) if np.isfinite(every).any() else (0.0, 1.0)
    at = np.linspace(min(x), max(x), cols * 4)
    for k, y in enumerate(series.values()):
        colour = np.array([(40, 80, 160), (200, 90, 30), (40, 130, 60), (120, 60, 140), (110, 110, 110)][k % 5], np.uint8)
        found = np.interp(at, x, np.array(y, float))
        ok = np.isfinite(found)
        r = ((high - found[ok]) / max(high - low, 1e-300) * (rows - 9) + 4).astype(int)
        c = ((at[ok] - at[0]) / max(at[-1] - at[0], 1e-300) * (cols - 9) + 4).astype(int)
        image[r, c] = image[r + 1, c] = colour
    png(path, image)


def write_json(path: str, document: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, ensure_ascii=False, default=str)
