"""Sharding by a permutation-filled lookup table.

Each shard ranks the slots of a table of prime size by its own permutation (offset and step hashed from
its name); shards take turns claiming their next free slot until the table is full, so shares differ by
at most one slot and losing a shard moves little else. The table has a fixed number of rows, hence a
proven bound, and its broadcast join places each row in constant time without a shuffle.

Defined results: a null key hashes as an empty string with a separate mark; ties and repeated keys get the
same shard; an empty input gives an empty result. Extra columns are carried unchanged; the two new ones give way to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried

#: Prime; at least a hundred slots for each shard keep the shares within one per cent.
TABLE_SIZE = 65537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "little")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Index of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than there are slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    table, left = np.full(size, -1, np.int32), size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5 modulo the table's size."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def _placed(spark: SparkSession, frame: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """row, slot and shard; one broadcast of ``size`` rows."""
    owner = fill_table(shards, size)
    lookup = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    return carried(frame).withColumn("slot", slot_of(F.col("row").getField(key), size)).join(F.broadcast(lookup), "slot")


def _free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it as long as the frame has a column of that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place(spark: SparkSession, frame: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``frame`` with ``slot`` and ``shard`` appended; where it has such a column, the new one begins with an underscore."""
    slot, shard = (_free(n, frame.columns) for n in ("slot", "shard"))
    return _placed(spark, frame, key, shards, size).select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard))


def write_shards(spark: SparkSession, frame: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE) -> None:
    """One folder per shard, named as ``place`` names the column; each task appends to the folders of its rows, so no shard meets in one task."""
    folder = _free("shard", frame.columns)
    _placed(spark, frame, key, shards, size).select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).mode("overwrite").parquet(path)
