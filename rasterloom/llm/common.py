"""Helpers shared by the training-data operators: tables, shared work folders, Arrow text slices."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time; bounds a Python worker's memory.
SLICE_BYTES = 2 << 20
#: Files of an intermediate table: one for so many input rows, and the least number that it may be cut down to.
ROWS_A_FILE, LEAST_FILES = 8_192, 6
#: Executors collect their garbage after so many tables of a long operator.
TRIM_AFTER = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is configured a local one is set for a local master (tests); a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = chosen.get() if chosen.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = os.path.join(tempfile.gettempdir(), "rasterloom-checkpoint")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """Intermediate tables under the session's shared checkpoint folder.

    A written table cuts lineage and survives lost executors. ``drop`` frees one early; what the
    returned DataFrame still reads stays for the owner of the folder to clean.

    With ``rows``, the number of rows that tables are in proportion to, no table gets more files than one for each
    ``ROWS_A_FILE`` of them (``LEAST_FILES`` at least): small inputs don't become thousands of tiny files.
    """

    def __init__(self, spark: SparkSession, label: str, rows: int | None = None):
        self.spark, self.rows, self.written = spark, rows, 0
        self.name = f"{label}-{uuid.uuid4().hex}"
        self.root = f"{checkpoint_root(spark)}/{self.name}"
        if (made := _made.get()) is not None:
            made.append(self)

    def fitted(self, frame: DataFrame) -> DataFrame:
        """``frame`` in as many partitions as files are allowed; no shuffle, and no change where it has fewer."""
        return frame if self.rows is None else frame.coalesce(max(LEAST_FILES, self.rows // ROWS_A_FILE))

    def write(self, frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        self.fitted(frame).write.option("compression", codec).mode("overwrite").parquet(path)
        self.written += 1
        if self.written % TRIM_AFTER == 0:
            trim_executors(self.spark)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str = "") -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def keep_only(self, *names: str) -> None:
        """Frees all tables but these."""
        path, files = self._path()
        for held in files.listStatus(path) if files.exists(path) else []:
            if held.getPath().getName() not in names:
                files.delete(held.getPath(), True)


#: Of this thread of control, the list that takes note of every new workspace.
_made: ContextVar[list[Workspace] | None] = ContextVar("made", default=None)


@contextmanager
def made_by():
    """The workspaces that the caller's own thread makes inside. They are the caller's: it drops them when what was made from them has
    been written and is no longer read."""
    made: list[Workspace] = []
    before = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(before)


def carried(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name among them can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"))


def restored(frame: DataFrame) -> DataFrame:
    return frame.select("row.*")


def with_text(batch: pa.RecordBatch, column: str = "text") -> pa.RecordBatch:
    """A batch of carried rows with their texts beside them."""
    return pa.RecordBatch.from_arrays([*batch.columns, pc.struct_field(batch.column("row"), column)], [*batch.schema.names, "text"])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside: for wide rows, whose batches would be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Hands freed memory back to the system: Python workers outlive their tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trim_executors(spark: SparkSession) -> None:
    """Has executors collect their garbage, upon which the JVM hands free heap back: else what each stage leaves adds up beside the
    memory of Python workers. A few small tasks on every executor (one task where a local master is the only JVM); nothing is computed again."""
    n = 1 if spark.sparkContext.master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def released(run):
    """An Arrow batch function that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Rows that may teach: a known id outside the held-out fold."""
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Row slices of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw_texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array and its row offsets; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; input and output uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longer pieces are worked out anew each time, so a cache is bounded in bytes as well.
LONGEST_PIECE = 256


class PieceCache(dict):
    """Remembers what is used: two generations of at most about ``limit`` entries of ``LONGEST_PIECE`` characters; the older one is let go."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit, self.older = limit, {}

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.older = self.copy()
            self.clear()

    def known(self, key) -> bool:
        return key in self or key in self.older

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_PIECE:
            self[key] = value
        return value

    def make(self, key):
        raise KeyError(key)


HASHES = 1 << 31


def lowest_hashes(ids: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows of distinct ``doc_id`` with the smallest id hashes.

    A threshold on the hash, set from the count, leaves little more than the bound before anything is
    sorted, however many tasks there are. Should a rare draw leave fewer, the threshold is doubled until it does not.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    total = ids.count()
    limit = int((bound + 6 * bound**0.5 + 20) / max(1, total) * HASHES) + 1
    while limit < HASHES and ids.where(h < limit).count() < min(bound, total):
        limit *= 2
    return ids.where(h < min(HASHES, limit)).orderBy(h, "doc_id").limit(bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` trainable documents with a 0/1 label, in the order of a hash of their id. Fitting alone uses it. Labels given twice count as their largest value. Columns: those of ``docs`` and ``label``.
    """
    given = labels.where(F.col(label_col).isin(0, 1) & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    return _first_of_each(docs, lowest_hashes(given, bound))


def _first_of_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen ids (a bounded number, so broadcast); one row for an id that is repeated."""
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(chosen), "doc_id")
    extra = [c for c in chosen.columns if c != "doc_id"]
    best = found.groupBy("doc_id").agg(F.min(F.struct(*rest, *extra)).alias("__row"))
    return best.select("doc_id", *(F.col(f"__row.{c}").alias(c) for c in [*rest, *extra]))
