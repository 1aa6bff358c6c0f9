"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

1. Vectors become integers, are range-sorted by descending length and packed into blocks, one row each.
2. The Gram matrix of all vectors, summed in the cluster (dimensions squared, whatever the rows), gives the rotation of their SVD: the
   first rotated components hold most of the squared lengths.
3. Query blocks (at most ``QUERY_BYTES`` of vectors) meet streams of vector blocks, longest first. |q||x| below the query's k-th score so
   far ends a block for that query. Else the partial inner product of the leading components plus the product of the two residual
   lengths (Cauchy-Schwarz) bounds each score; components are added in steps, and pairs whose bound falls below the k-th score go.
   Bounds are compared with room for rounding; what is left is scored with the integers, so results are exact.
4. The best k of each stream are merged for each query. The number of streams depends on the cores and not on the rows.

Vector blocks are copied once for each query block, that is once for ``QUERY_BYTES`` of queries; a task holds one query block and one
vector block at a time. Equal vectors lie in as many blocks as they fill, so a hot vector spreads.

Defined results: null vectors and those that hold a null or non-finite component take no part. Vectors of different lengths are compared
as if padded with zeros; an empty vector scores 0 with all. Every row is a query or a candidate of its own: of repeated ids each row is
answered, with the others among its candidates. A null vec_id is no query; as a candidate it comes last among ties. Extra columns are
ignored. An empty table, and a table of one row, give an empty result. A squared length beyond 2^62 raises an error, as scores need not fit a long; so does
a vector of more than ``MOST_DIMS`` components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, arrow_rows, mix64, released

#: Bytes of a query block's vectors and of a vector block's, at 8 bytes a component; most vectors of a block.
QUERY_BYTES, BLOCK_BYTES, BLOCK_ROWS = 64 << 20, 1 << 20, 2048
#: Shares of the squared length after which bounds are taken.
CUTS = (0.25, 0.5, 0.7, 0.85)
#: Queries that are compared to a vector block at once; share of pairs from which on the rest are scored one by one.
TILE, FEW = 512, 1 / 16
LARGEST = 1 << 62
#: Most components of a vector; bounds what is broadcast (their square, at 8 bytes).
MOST_DIMS = 4096
NONE = np.iinfo(np.int64).min

BLOCK = "top double, n int, width int, ids binary, known binary, uids binary, vectors binary"


def _matrix(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lists`` as floats, padded with zeros, and which rows are whole and finite."""
    size = np.diff(np.asarray(lists.offsets, np.int64))
    if lists.null_count:
        size = np.where(np.asarray(lists.is_null()), 0, size)
    whole = np.zeros((len(lists), dims))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), size)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    whole[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    usable = np.isfinite(whole).all(axis=1)
    return whole, usable & ~np.asarray(lists.is_null()) if lists.null_count else usable


def _width(vectors: np.ndarray) -> int:
    """Bytes that hold each component."""
    most = int(np.abs(vectors).max(initial=0))
    return 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8


def _quantise(column: str, dims: int, scale: float):
    """Per usable row: vec_id, norm2, width and the integer components."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, BLOCK_ROWS) for i in range(0, batch.num_rows, BLOCK_ROWS)):
                values, usable = _matrix(part.column(column), dims)
                floors = np.floor(scale * values[usable])
                if (np.square(floors).sum(axis=1) > LARGEST).any():
                    raise ValueError("a vector's squared length exceeds 2^62")
                vectors = floors.astype(np.int64)
                width = _width(vectors)
                raw = vectors.astype(f"<i{width}")
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").filter(pa.array(usable)).cast(pa.int64()), pa.array(np.square(vectors).sum(axis=1)), pa.array(np.full(len(raw), width, np.int32)), pa.array([x.tobytes() for x in raw], pa.binary())],
                    ["vec_id", "norm2", "width", "vector"],
                )

    return run


class Block:
    """Vectors with ids, as packed in one row; ``cut`` and ``of`` are the two directions."""

    def __init__(self, ids, known, uids, vectors):
        self.ids, self.known, self.uids, self.vectors = ids, known, uids, vectors

    def __len__(self):
        return len(self.ids)

    def row(self) -> tuple:
        width = _width(self.vectors)
        top = math.sqrt(float(np.square(self.vectors.astype(np.float64)).sum(axis=1).max()))
        return top, len(self), width, self.ids.astype("<i8").tobytes(), self.known.astype(np.uint8).tobytes(), self.uids.astype("<i8").tobytes(), self.vectors.astype(f"<i{width}").tobytes()

    @classmethod
    def of(cls, row: dict, dims: int) -> Block:
        vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(row["n"], dims)
        return cls(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], np.uint8).astype(bool), np.frombuffer(row["uids"], "<i8"), vectors)

    def where(self, mask) -> Block:
        return Block(self.ids[mask], self.known[mask], self.uids[mask], self.vectors[mask])

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        return cls(*(np.concatenate([getattr(b, k) for b in blocks]) for k in ("ids", "known", "uids", "vectors")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_BLOCK_FIELDS = [("top", pa.float64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("uids", pa.binary()), ("vectors", pa.binary())]


def _pack(dims: int, size: int):
    """Blocks of ``size`` rows that follow each other in the sort, numbered by partition and place."""
    schema = pa.schema([("block", pa.int64()), *_BLOCK_FIELDS])

    def blocks(batches):
        held: list[Block] = []
        for batch in batches:
            ids = batch.column("vec_id")
            width = batch.column("width").to_numpy(zero_copy_only=False)
            raw = batch.column("vector").to_pylist()
            vectors = np.zeros((len(raw), dims), np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                vectors[at] = np.frombuffer(b"".join([raw[i] for i in at]), f"<i{w}").reshape(len(at), dims)
            held.append(Block(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("uid").to_numpy(), vectors))
            if sum(map(len, held)) >= size:
                whole = Block.joined(held)
                full = len(whole) // size * size
                yield from (whole.where(slice(i, i + size)) for i in range(0, full, size))
                held = [whole.where(slice(full, None))]
        if sum(map(len, held)):
            yield Block.joined(held)

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for i, block in enumerate(blocks(batches)):
            yield _batch([(base + i, *block.row())], schema)

    return run


def _gram(dims: int):
    """Of each task, the rows of the sum of x x^T."""

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            for row in batch.to_pylist():
                x = Block.of(row, dims).vectors.astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "sums"])

    return run


def _added(part: pa.Table) -> pa.Table:
    whole = sum(np.frombuffer(x) for x in part.column("sums").to_pylist())
    return pa.table({"i": part.column("i").slice(0, 1).cast(pa.int32()), "sums": pa.array([whole.tobytes()], pa.binary())})


def rotation(blocks: DataFrame, dims: int) -> tuple[np.ndarray, list[int]]:
    """The right singular vectors of all vectors (columns, largest first) and the component counts at which bounds are taken."""
    rows = blocks.select("n", "width", "ids", "known", "uids", "vectors").mapInArrow(released(_gram(dims)), "i int, sums binary").groupBy("i").applyInArrow(_added, "i int, sums binary").collect()
    gram = np.stack([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.i)])
    basis, weights, _ = np.linalg.svd(gram, hermitian=True)
    share = np.cumsum(weights) / max(weights.sum(), 1e-300)
    cuts = {min(dims, int(np.searchsorted(share, c)) + 1) for c in CUTS}
    return basis, sorted(cuts - {dims})


class QueryBlock:
    """Queries with their best k so far."""

    def __init__(self, block: Block, basis: np.ndarray, cuts: list[int], k: int):
        self.block, self.basis, self.cuts, self.k = block, basis, cuts, k
        self.rotated, self.norms, self.rest = self._rotate(block.vectors)
        shape = (len(block), k)
        self.scores, self.ids, self.uids, self.known = np.full(shape, NONE), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.kth = np.full(len(block), -np.inf)
        self.pairs = self.scored = 0

    def _rotate(self, vectors: np.ndarray):
        """Rotated vectors, their lengths, and the lengths of what follows each cut."""
        rotated = np.empty(vectors.shape, np.float32)
        norms, rest = np.empty(len(vectors)), np.empty((len(self.cuts), len(vectors)), np.float32)
        for i in range(0, len(vectors), BLOCK_ROWS):
            part = vectors[i : i + BLOCK_ROWS].astype(np.float64) @ self.basis
            tail = np.cumsum(np.square(part)[:, ::-1], axis=1)[:, ::-1]
            norms[i : i + BLOCK_ROWS] = np.sqrt(tail[:, 0])
            for j, c in enumerate(self.cuts):
                rest[j, i : i + BLOCK_ROWS] = np.sqrt(tail[:, c])
            rotated[i : i + BLOCK_ROWS] = part
        return rotated, norms, rest

    def meet(self, other: Block) -> None:
        """Brings in a block of candidates, longest first."""
        rotated, norms, rest = self._rotate(other.vectors)
        slack = (self.basis.shape[0] + 16) * 2.0**-22  # float32 sums and roots, relative to |q||x|
        self.pairs += len(self.block) * len(other)
        alive = np.flatnonzero(self.norms * norms.max() * (1 + slack) >= self.kth)
        for i in range(0, len(alive), TILE):
            tile = alive[i : i + TILE]
            # no candidate shorter than this reaches any k-th score of the tile
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.min(np.where(self.norms[tile] > 0, self.kth[tile] / (self.norms[tile] * (1 + slack)), -np.inf))
            m = np.flatnonzero(norms >= least)
            if len(m):
                self._tile(tile, other.where(m), rotated[m], norms[m], rest[:, m], slack)

    def _tile(self, tile, other: Block, rotated, norms, rest, slack) -> None:
        room = (self.kth[tile] - slack * self.norms[tile] * norms.max()).astype(np.float32)
        room = np.nextafter(room, np.float32(-np.inf))[:, None]
        query, at = self.rotated[tile], 0
        part = np.zeros((len(tile), len(other)), np.float32)
        for j, cut in enumerate(self.cuts if np.isfinite(room).any() else []):
            part += query[:, at:cut] @ rotated[:, at:cut].T
            at = cut
            left = part + self.rest[j, tile][:, None] * rest[j][None, :] >= room
            if np.count_nonzero(left) <= FEW * left.size:
                return self._one_by_one(tile, other, *np.nonzero(left))
        exact = self._products(self.block.vectors[tile], other.vectors)
        self.scored += exact.size
        take = min(self.k + 1, exact.shape[1])  # one more than k: a query may meet itself
        least = np.partition(exact, exact.shape[1] - take, axis=1)[:, exact.shape[1] - take]
        least = np.maximum(least.astype(np.float64), self.kth[tile])
        rows, columns = np.nonzero(exact >= least[:, None])
        self._merge(tile[rows], exact[rows, columns].astype(np.int64), other.where(columns))

    def _one_by_one(self, tile, other: Block, rows, columns) -> None:
        step = max(1, (8 << 20) // (8 * self.basis.shape[0]))
        self.scored += len(rows)
        for i in range(0, len(rows), step):
            r, c = tile[rows[i : i + step]], columns[i : i + step]
            self._merge(r, np.einsum("ij,ij->i", self.block.vectors[r].astype(np.int64), other.vectors[c].astype(np.int64)), other.where(c))

    def _products(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Exact inner products: as doubles where every partial sum is below 2^53, else as integers."""
        longest = max(float(np.square(x.astype(np.float64)).sum(axis=1).max()) for x in (queries, vectors))
        kind = np.float64 if longest < 1 << 52 else np.int64
        return queries.astype(kind) @ vectors.astype(kind).T

    def _merge(self, rows, scores, found: Block) -> None:
        keep = (found.uids != self.block.uids[rows]) & (scores >= self.kth[rows])
        rows, scores, found = rows[keep], scores[keep], found.where(keep)
        if not len(rows):
            return
        touched = np.unique(rows)
        held = self.scores[touched] != NONE
        rows = np.concatenate([np.repeat(touched, held.sum(axis=1)), rows])
        scores = np.concatenate([self.scores[touched][held], scores])
        ids, known, uids = (np.concatenate([mine[touched][held], new]) for mine, new in ((self.ids, found.ids), (self.known, found.known), (self.uids, found.uids)))
        order = np.lexsort((uids, ids, ~known, -scores, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rows, rank = order[rank < self.k], rows[rank < self.k], rank[rank < self.k]
        self.scores[rows, rank], self.ids[rows, rank], self.known[rows, rank], self.uids[rows, rank] = scores[order], ids[order], known[order], uids[order]
        last = self.scores[touched, -1]
        self.kth[touched] = np.where(last == NONE, -np.inf, last)

    def best(self) -> pa.RecordBatch:
        rows, rank = np.nonzero(self.scores != NONE)
        ids = pa.array(self.ids[rows, rank], mask=~self.known[rows, rank])
        return pa.RecordBatch.from_arrays([pa.array(self.block.uids[rows]), pa.array(self.block.ids[rows]), ids, pa.array(self.uids[rows, rank]), pa.array(self.scores[rows, rank])], names=["query_uid", "query_id", "vec_id", "uid", "score"])


def _queries(dims: int, every: int, blocks: int):
    """Of each vector block, its queries, dealt to query blocks."""
    schema = pa.schema([("qb", pa.int32()), *_BLOCK_FIELDS])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row, dims)
                block = block.where(block.known & (block.ids % every == 0))
                to = (mix64(block.uids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
                rows = [(int(q), *block.where(to == q).row()) for q in np.unique(to)]
                if rows:
                    yield _batch(rows, schema)

    return run


def _search(dims: int, shared, k: int):
    """Streams sorted by (qb, stream, kind, longest first): of each, the query block and then the candidates."""

    def run(batches):
        basis, cuts = shared.value
        now, parts, queries = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (key := (row["qb"], row["stream"])) != now:
                    if queries is not None:
                        yield queries.best()
                    now, parts, queries = key, [], None
                block = Block.of(row, dims)
                if row["kind"] == 0:
                    parts.append(block)
                    continue
                if queries is None and parts:
                    queries, parts = QueryBlock(Block.joined(parts), basis, cuts, k), []
                if queries is not None:
                    queries.meet(block)
        if queries is not None:
            yield queries.best()

    return run


def top_products(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose vec_id ``every`` divides, the k largest inner products with other rows, of components
    floor(scale * x); ties to the smaller vec_id."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    size = source.agg(F.max(F.size("embedding")).alias("dims"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"), F.count(F.lit(1)).alias("rows")).first()
    dims, cores = max(1, size.dims or 0), spark.sparkContext.defaultParallelism
    if dims > MOST_DIMS:
        raise ValueError(f"a vector has {dims} components, more than {MOST_DIMS}")
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
    query_blocks = max(1, -(-size.queries * 8 * dims // QUERY_BYTES))
    streams = max(1, min(-(-2 * cores // query_blocks), size.rows // rows + 1))

    work = Workspace(spark, "top-products")
    whole = source.mapInArrow(released(_quantise("embedding", dims, scale)), "vec_id long, norm2 long, width int, vector binary").withColumn("uid", F.monotonically_increasing_id())
    ordered = whole.repartitionByRange(max(2 * cores, size.rows // (64 * rows)), F.desc("norm2"), "vec_id", "uid").sortWithinPartitions(F.desc("norm2"), "vec_id", "uid")
    blocks = work.write(ordered.mapInArrow(released(_pack(dims, rows)), f"block long, {BLOCK}"), "blocks")

    with arrow_rows(spark, 8):
        shared = spark.sparkContext.broadcast(rotation(blocks, dims))
        columns = ["qb", "stream", "kind", "block", *(n for n, _ in _BLOCK_FIELDS)]
        asked = work.write(blocks.select(*(n for n, _ in _BLOCK_FIELDS)).mapInArrow(released(_queries(dims, every, query_blocks)), f"qb int, {BLOCK}"), "queries")
        asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("stream"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block")).select(*columns)
        met = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(1).alias("kind"))
        # consecutive blocks go to different streams, so that each sees all lengths
        met = met.withColumn("stream", ((F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))) % streams).cast("int")).select(*columns)
        dealt = asked.unionByName(met).repartitionById(query_blocks * streams, F.col("qb") * streams + F.col("stream")).sortWithinPartitions("qb", "stream", "kind", F.desc("top"), "block")
        best = work.write(dealt.mapInArrow(released(_search(dims, shared, k)), "query_uid long, query_id long, vec_id long, uid long, score long"), "best")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
