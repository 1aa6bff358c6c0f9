"""N-gram Jaccard self-join by multiple-global-order filtering.

Two documents link when 100 * |intersection| >= percent * |union| of their sets of shingles of so many words (85 and 4
unless a caller says otherwise). Under any one global order of tokens, sets that similar share at least ``depth``
tokens in prefixes of n - ceil(percent * n / 100) + ``depth`` tokens. The join asks for that under several orders and verifies only pairs that pass all of them:

1. A hashed counter of fixed size holds all shingles' counts; the first order is rare tokens first (by that
   counter, then by hash), so passages that many documents share stay out of prefixes. Whatever the
   counter's noise, the order is the same for all documents and the result is exact.
2. Prefix tokens are dealt out by token; tokens of one document only fall away. All pairs of a list across components are
   counted; those that share enough prefix tokens under the first order, then under the others (hash orders inside
   frequency classes), are verified on whole sets.
3. A list longer than ``LONG`` is mostly a group of near copies, whose pairs would be too many. A pivot, the document found in most
   long lists, bounds them further: two documents close to it differ from each other as their differences from it do, so
   of a list's pairs only those remain whose short difference sets share tokens of their own prefixes. Pairs with
   the pivot and pairs that remain must pass every order like all others before they are verified.

Nodes are set fingerprints, so copies are one node. Nothing is capped: long lists that stay apart are paired
like short ones. Only the counters (fixed size) are broadcast.

Defined results: a null or empty text, or one of white space only, has n_shingles 0 and is linked with
nothing; its component is its own doc_id. A null doc_id takes its component's smallest known id, null if there is none. Repeated
rows are linked by equal sets. Extra columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, arrow_rows, carried, mix64, raw_texts, released, restored, text_slices
from .components import components
from .shingles import shingle_sets

#: Width of shingles and similarity of the registered query.
WORDS, PERCENT = 4, 85
#: Shared prefix tokens asked for under each order (fewer for sets too small for it).
DEPTH = 8
#: Counters for the order of tokens and for membership of fingerprints: fixed sizes, so bounded broadcasts.
COUNTER_BITS, MEMBER_BITS = 22, 24
#: Lists beyond this length are first compared to a pivot; a document is close to it from so many per cent on.
LONG, KIN = 64, 50
SLICE_BITS = 16
#: Rows of an Arrow batch that holds two whole sets a row, and text bytes hashed at a time.
WIDE_ROWS, TEXT_BYTES = 500, 1 << 20
#: Further orders: salts of the hashes that order tokens inside a frequency class.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _counter_rows(counts: np.ndarray) -> pa.RecordBatch:
    parts = counts.reshape(-1, 1 << SLICE_BITS)
    full = [i for i in range(len(parts)) if parts[i].any()]
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(parts[i].tobytes()) for i in full], pa.binary())], ["slice", "counts"])


def _merge_counters(kind: type, join: np.ufunc):
    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                one = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
                total[i] = join(total[i], one) if i in total else one
        pack = zstandard.ZstdCompressor(level=1).compress
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([pack(v.tobytes()) for v in total.values()], pa.binary())], ["slice", "counts"])

    return merge


def hashed_counter(frame: DataFrame, hashes_of, bits: int, member: bool = False) -> np.ndarray:
    """Counts of 64-bit hashes by their top ``bits`` bits, over all rows; ``hashes_of(batch)`` yields arrays.

    With ``member`` 1 where any hash fell, in a byte each. Partitions send compressed slices; streaming sums (in
    two rounds for counts, which all input partitions send) keep memory at one counter a task.
    """
    kind, merge = (np.uint8, _merge_counters(np.uint8, np.maximum)) if member else (np.uint32, _merge_counters(np.uint32, np.add))

    def count(batches):
        counts = np.zeros(1 << bits, kind)
        for batch in batches:
            for h in hashes_of(batch):
                spots = (h >> np.uint64(64 - bits)).astype(np.int64)
                if member:
                    counts[spots] = 1
                else:
                    spots, n = np.unique(spots, return_counts=True)
                    counts[spots] += n.astype(kind)
        yield _counter_rows(counts)

    some = frame.mapInArrow(released(count), "slice int, counts binary")
    if not member:
        salted = some.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
        some = salted.repartition("slice", "salt").select("slice", "counts").mapInArrow(merge, "slice int, counts binary")
    whole = np.zeros((1 << (bits - SLICE_BITS), 1 << SLICE_BITS), kind)
    for row in some.repartition("slice").mapInArrow(merge, "slice int, counts binary").collect():
        whole[row["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), kind)
    return whole.ravel()


def _sets_of(batch: pa.RecordBatch, words: int):
    for part in text_slices(batch, "text", TEXT_BYTES):
        yield part, shingle_sets(*raw_texts(part.column("text")), words)


def _token_hashes(words: int):
    def run(batch: pa.RecordBatch):
        for _, sets in _sets_of(batch, words):
            yield np.concatenate(sets)

    return run


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, order: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n = len(tokens)
    need = least_overlap(n, percent)
    return tokens[np.argsort(order, kind="stable")[: n - need + min(DEPTH, need)]]


def _fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def asked(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """Prefix tokens that linked sets of these sizes share under every order."""
    need = F.ceil(F.least(n_a, n_b) * percent / 100)
    return F.least(F.lit(DEPTH), need)


def close_sizes(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _first_prefixes(counter, words: int, percent: int):
    """Per row: doc_id, node, n and the first order's prefix (null for a node seen before in the batch)."""

    def run(batches):
        counts = counter.value
        for batch in batches:
            for part, sets in _sets_of(batch, words):
                nodes, seen, prefixes = [], set(), []
                for tokens in sets:
                    node = _fingerprint(tokens) if len(tokens) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        prefixes.append(None)
                        continue
                    seen.add(node)
                    order = counts[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    prefixes.append(prefix(tokens, order, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "node", "n", "prefix"])

    return run


def _shared(batches):
    """From rows sorted by token and node: those of tokens with two nodes or more, each once.

    Streams; of a list only its first row is held, until a second node shows that it is shared.
    """
    token, node, held = None, 0, None  # the last row's token and node; a list's first row not yet handed on
    for batch in batches:
        t, d, n = (batch.column(c).to_numpy() for c in ("token", "node", "n"))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        new[0] = token is None or t[0] != token or d[0] != node
        token, node, last = t[-1], d[-1], token
        rows = np.stack([t[new], d[new], n[new]])
        if not rows.shape[1]:
            continue
        goes_on = last is not None and rows[0, 0] == last
        if goes_on and held is not None:
            rows, held = np.concatenate([held, rows], axis=1), None
        same = np.zeros(rows.shape[1] + 1, bool)  # same[i]: rows i - 1 and i are of one list
        same[1:-1] = rows[0, 1:] == rows[0, :-1]
        keep = same[1:] | same[:-1]
        if goes_on:
            keep[0] = True
        if not keep[-1]:
            held = rows[:, -1:]
        elif rows.shape[1]:
            held = None
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, keep]], ["token", "node", "n"])


def _member_hashes(batch: pa.RecordBatch):
    yield batch.column("node").to_numpy().view(np.uint64)


def _order(tokens: np.ndarray, counts: np.ndarray, salt: int | None) -> np.ndarray:
    """Keys of one global order: rare tokens first, or (with a salt) a hash inside classes of frequency."""
    seen = counts[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    if salt is None:
        return seen
    grade = np.log2(seen.astype(np.float32) + 1).astype(np.uint64)
    return (grade << np.uint64(58)) | (mix64(tokens ^ np.uint64(salt)) >> np.uint64(6))


def _passes(pairs: DataFrame, orders: tuple[str, ...], percent: int) -> Column:
    """Whether both sides share enough prefix tokens under every one of the orders."""
    out = F.lit(True)
    for o in orders:
        out = out & (F.size(F.array_intersect(f"{o}_a", f"{o}_b")) >= asked(F.col("n_a"), F.col("n_b"), percent))
    return out


def _fetch_sets(work: Workspace, docs: DataFrame, wanted: DataFrame, counter, name: str, words: int, percent: int, salts: tuple = ORDERS) -> DataFrame:
    """node, n, its set as bytes and its prefixes (``order_1``, ...) under the orders of these salts, for the wanted nodes.

    The wanted nodes reach the scan as a membership table of fixed size; no text is shuffled.
    """
    members = work.spark.sparkContext.broadcast(np.packbits(hashed_counter(wanted, _member_hashes, MEMBER_BITS, member=True)))

    def run(batches):
        bits, counts = members.value, counter.value
        for batch in batches:
            for _, sets in _sets_of(batch, words):
                rows = {}
                for tokens in sets:
                    if len(tokens):
                        node = _fingerprint(tokens)
                        slot = (node & ((1 << 64) - 1)) >> (64 - MEMBER_BITS)
                        if node not in rows and bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                            rows[node] = tokens
                if rows:
                    prefixes = [pa.array([prefix(x, _order(x, counts, salt), percent).view(np.int64) for x in rows.values()], pa.list_(pa.int64())) for salt in salts]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([len(x) for x in rows.values()], pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary()), *prefixes], ["node", "n", "tokens", *orders])

    orders = [f"order_{i + 1}" for i in range(len(salts))]
    found = docs.select("text").mapInArrow(released(run), "node long, n long, tokens binary" + "".join(f", {o} array<long>" for o in orders))
    found = found.join(wanted, "node", "left_semi")
    return work.write(found.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "tokens", *orders))), name)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _links(work: Workspace, docs: DataFrame, pairs: DataFrame, counter, name: str, words: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that pass the further orders and then the exact comparison."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _fetch_sets(work, docs, work.write(wanted, f"{name}-wanted"), counter, f"{name}-sets", words, percent)
    side = lambda x, *cols: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    filtered = pairs.join(side("a", "n", "order_1", "order_2"), "a").join(side("b", "n", "order_1", "order_2"), "b")
    filtered = work.write(filtered.where(_passes(filtered, ("order_1", "order_2"), percent)).select("a", "b"), f"{name}-filtered")
    whole = filtered.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").select("a", "b", "tokens_a", "tokens_b")
    with arrow_rows(work.spark, WIDE_ROWS):
        found = work.write(whole.mapInArrow(released(_verify(percent)), "a long, b long"), f"{name}-links")
    work.drop(f"{name}-sets")
    return found


def _difference_rows(percent: int):
    """From pivot pairs with both sets: the class of the document and its difference set from the pivot.

    Classes: N linked to the pivot (of the pairs that pass all orders), F not linked but at least ``KIN`` per cent similar; strangers fall away.
    """

    def run(batches):
        for batch in batches:
            kinds, deltas = [], []
            for raw_p, raw_x, passes in zip(batch.column("tokens_a"), batch.column("tokens_b"), batch.column("passes").to_pylist()):
                p, x = np.frombuffer(raw_p.as_buffer(), np.uint64), np.frombuffer(raw_x.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, x]))
                twice = np.zeros(len(both), bool)
                twice[1:] = both[1:] == both[:-1]
                common = int(twice.sum())
                union = len(both) - common
                kin = 100 * common >= KIN * union
                kinds.append(("N" if passes and 100 * common >= percent * union else "F") if kin else None)
                twice[:-1] |= twice[1:]
                deltas.append(both[~twice].view(np.int64) if kin else None)
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "n_a", "n_b")] + [pa.array(kinds, pa.string()), pa.array(deltas, pa.list_(pa.int64()))], ["pivot", "node", "n_p", "n", "kind", "delta"])
            yield out.filter(out.column("kind").is_valid())

    return run


def _difference_prefixes(work: Workspace, close: DataFrame, percent: int) -> DataFrame:
    """(pivot, node, kind, cls, near, far): classes of the difference sets' tokens that stand in their prefixes.

    With |A| for sizes, q = 100 + percent and r = 100 - percent, sets x and y link iff q |x ^ y| <= r (|x| + |y|), and x ^ y is the difference of their
    differences X and Y from the pivot p. That bounds |X & Y| from below: if either is not linked to p, a document
    needs |X & Y| > (q |X| + r (|p| - |x|)) / 2q against an unlinked one (``far``), and an unlinked one needs
    |X & Y| >= |X| - r (|x| + |y|) / q with |y| <= 100 |x| / percent against a linked one (``near``). Tokens that occur in
    the same documents around a pivot form a class, which counts with its size; rare classes come first.
    """
    tokens = close.select("pivot", "node", "kind", "n", "n_p", F.size("delta").alias("size"), F.explode("delta").alias("token"))
    where = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
    # Written, so that the join below has a plain shuffle on either side, whose hot partitions Spark can split.
    where = work.write(where.select("pivot", "token", "c", F.xxhash64("c", "x", "y").alias("cls")), "classes")
    classes = tokens.join(where, ["pivot", "token"]).groupBy("pivot", "node", "kind", "n", "n_p", "size", "c", "cls").agg(F.count(F.lit(1)).alias("w"))
    before = F.sum("w").over(Window.partitionBy("pivot", "node").orderBy("c", "cls").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    q, r = 100 + percent, 100 - percent
    far = F.greatest(F.lit(1), F.floor((q * F.col("size") + r * (F.col("n_p") - F.col("n"))) / (2 * q)) + 1)
    near = F.greatest(F.lit(1), F.ceil((q * F.col("size") - r * (F.col("n") + F.floor(100 * F.col("n") / percent))) / q))
    placed = classes.withColumn("before", before)
    kept = placed.select("pivot", "node", "kind", "cls", (F.col("before") <= F.col("size") - near).alias("near"), (F.col("before") <= F.col("size") - far).alias("far"))
    return work.write(kept.where("far OR (near AND kind = 'F')"), "prefixes")


def _near_groups(work: Workspace, docs: DataFrame, shared: DataFrame, counter, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Links inside the long lists among documents close to the same pivot; the lists' pivots; who is close or linked
    to which pivot."""
    # Written, so that the join has a plain shuffle on either side, whose hot partitions Spark can split.
    size = work.write(shared.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LONG).select("token"), "long-tokens")
    rows = work.write(shared.join(size, "token", "left_semi"), "long")
    if rows.isEmpty():
        return None
    degree = rows.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    pivots = work.write(rows.join(degree, "node").groupBy("token").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot")), "pivots")
    pairs = work.write(rows.join(pivots, "token").where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pivot-pairs")
    wanted = work.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pivot-wanted")
    sets = _fetch_sets(work, docs, wanted, counter, "pivot-sets", words, percent, (None, *ORDERS))
    orders = ("order_1", "order_2", "order_3")
    side = lambda x, *cols: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *cols)))
    whole = pairs.join(side("a", "tokens", *orders), "a").join(side("b", "tokens", *orders), "b")
    whole = whole.select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b", _passes(whole, orders, percent).alias("passes"))
    with arrow_rows(work.spark, WIDE_ROWS):
        close = work.write(whole.mapInArrow(released(_difference_rows(percent)), "pivot long, node long, n_p long, n long, kind string, delta array<long>"), "close")
    to_pivot = close.where("kind = 'N'").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    prefixes = _difference_prefixes(work, close, percent)
    spread = lambda kind, column, name: prefixes.where((F.col("kind") == kind) & F.col(column)).select("pivot", F.col("node").alias(name), "cls")
    far = spread("F", "far", "a").join(spread("F", "far", "b"), ["pivot", "cls"]).where("a < b").select("pivot", "a", "b")
    mixed = spread("F", "near", "a").join(spread("N", "far", "b"), ["pivot", "cls"]).select("pivot", "a", "b")
    met = work.write(far.union(mixed).distinct(), "met")
    met = met.join(side("a", *orders), "a").join(side("b", *orders), "b")
    met = met.where(_passes(met, orders, percent)).select("pivot", "a", "b")
    side = lambda x: close.select("pivot", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("delta").alias(f"delta_{x}"))
    both = met.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"])
    apart = F.size("delta_a") + F.size("delta_b") - 2 * F.size(F.array_intersect("delta_a", "delta_b"))
    links = both.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b")
    kin = work.write(close.select("pivot", "node", (F.col("kind") == "N").alias("linked")), "kin")
    found = work.write(to_pivot.union(links), "near-links")
    work.drop("pivot-sets")
    return found, pivots, kin


def jaccard_components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id. ``percent`` is over ``KIN``, so that linked documents are close to one pivot."""
    if not KIN < percent <= 100:
        raise ValueError(f"percent must be over {KIN} and at most 100, not {percent}")
    work = Workspace(spark, "ngram-join")
    slim = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counter = spark.sparkContext.broadcast(hashed_counter(slim.select("text"), _token_hashes(words), COUNTER_BITS))

    rows = work.write(slim.mapInArrow(released(_first_prefixes(counter, words, percent)), f"doc_id {id_type}, node long, n long, prefix array<long>"), "rows")
    work.rows = rows.count()
    tokens = rows.where(F.col("prefix").isNotNull()).select("node", "n", F.explode("prefix").alias("token"))
    lists = tokens.select("token", "node", "n").repartition("token").sortWithinPartitions("token", "node").mapInArrow(released(_shared), "token long, node long, n long")
    shared = work.write(lists, "shared")

    links, near = [], _near_groups(work, slim, shared, counter, words, percent)
    if near is None:
        placed = shared.select("token", "node", "n", F.col("node").alias("part"), F.lit(False).alias("kin"))
    else:
        links.append(near[0])
        united = near[2].where("linked").groupBy("node").agg(F.min("pivot").alias("part"))
        close = near[2].select("pivot", "node").union(near[1].select("pivot", F.col("pivot").alias("node"))).distinct().withColumn("close", F.lit(True))
        placed = shared.join(near[1], "token", "left").join(close, ["pivot", "node"], "left").join(work.write(united, "united"), "node", "left")
        placed = work.write(placed.select("token", "node", "n", F.coalesce("part", "node").alias("part"), F.coalesce("close", F.lit(False)).alias("kin")), "placed")

    # All other pairs of a list across components, counted over lists. Two documents close to the list's pivot
    # (``kin``) have been compared already, so one side is always a stranger to it.
    side = lambda x: placed.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "part", "kin")))
    once = F.col("kin_b") | (F.col("node_a") < F.col("node_b"))
    met = side("a").where("NOT kin_a").join(side("b"), "token").where(once & (F.col("node_a") != F.col("node_b")) & (F.col("part_a") != F.col("part_b")) & close_sizes(F.col("n_a"), F.col("n_b"), percent))
    met = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), F.least("n_a", "n_b").alias("n"))
    enough = met.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= asked(F.col("n"), F.col("n"), percent))
    pairs = work.write(enough.select("a", "b"), "pairs")
    if not pairs.isEmpty():
        links.append(_links(work, slim, pairs, counter, "pair", words, percent))

    members = rows.select("doc_id", "node", "n")
    if links:
        every = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        grouped = members.join(components(work, every, "all"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        grouped = members.withColumn("label", F.col("node"))
    # Written for the same reason: a component may hold a third of all rows.
    least = work.write(grouped.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    work.keep_only("rows", "all-labels", "least")  # what the result still reads
    linked = grouped.where(F.col("label").isNotNull()).join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = grouped.where(F.col("label").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return work.fitted(linked).unionByName(work.fitted(alone))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (null ids last, equal ones by the row's number).

    Rows are joined by their number, so repeated and null ids stand for their own texts. Columns as in the input.
    """
    work = Workspace(spark, "ngram-drop")
    rows = work.write(carried(docs).withColumn("uid", F.monotonically_increasing_id()), "rows")  # written, so that numbers are stable
    work.rows = rows.count()
    report = jaccard_components(spark, rows.select(F.col("uid").alias("doc_id"), F.col("row.text").alias("text")), words, percent)
    moved = work.write(report.where("doc_id != component_id").select(F.col("doc_id").alias("uid"), "component_id"), "moved")
    members = moved.unionByName(moved.select(F.col("component_id").alias("uid"), "component_id").distinct())
    known = rows.select("uid", F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"))
    best = members.join(known, "uid").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "uid")).alias("best"))
    gone = work.write(members.select("uid").join(best.select("best.uid"), "uid", "left_anti"), "gone")
    return work.fitted(restored(rows.join(gone, "uid", "left_anti")))
