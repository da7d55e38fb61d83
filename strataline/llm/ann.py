"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the unit vectors on a few random orthogonal directions,
shifts the grid by an offset of its own and orders all vectors along a Hilbert
curve through it.  Spark range-partitions and sorts the keys and packs runs of
neighbours, with a byte for each component, into blocks; ranks follow from a
count for each partition.

A query is looked up on the `probes` curves on which its projection is longest:
there its surroundings are emptiest and a window of ranks holds most of what
is near.  Windows of all probes are scanned on the bytes, the `keep` best of
their union go on, and each of those is scored once, exactly, in double
precision and in the order of components.

A window is a stated share of the rows, so a query meets probes * share of a
table, repeats included, and fewer where windows overlap.  For vectors without
structure (the nearest of 50,000 random directions in 64 dimensions has a
cosine near 0.5) no order of the space does with much less; for clustered
vectors a small share is enough.

Equal vectors are one point of the index with its k + 1 least ids, so a group
of copies, however large, is one row and its ties are still broken exactly.

Defined cases: a null id, and a vector that is null, empty, zero, of another
length than the commonest, or with null or non-finite components, takes no
part, as query or candidate; with fewer candidates than k all are returned; an
empty table gives an empty result; an id with several vectors is found by each
of them.  Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.llm.common import need
from strataline.session import Scratch


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of cells (points x axes, numbers of `bits` bits), as unsigned 64 bits.

    From the highest bit down, each axis's bit either flips the first axis's
    lower bits or swaps them with its own; Gray decoding over the axes and
    interleaving the bits give the position.
    """
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            on = (x[:, i] >> b & 1).astype(bool)
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | (x[:, i] >> b & 1).astype(np.uint64)
    return key


def frames(dims: int, curves: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each curve's directions (dims x axes) and shift of the grid, as a share of its width."""
    rng = np.random.default_rng(seed)
    return [(np.linalg.qr(rng.normal(size=(dims, min(axes, dims))))[0], rng.uniform(-0.06, 0.06, min(axes, dims))) for _ in range(curves)]


def curve_keys(unit: np.ndarray, frame: tuple[np.ndarray, np.ndarray], bits: int = 10) -> np.ndarray:
    turn, shift = frame
    place = np.clip(unit @ turn * np.sqrt(unit.shape[1]) / 8 + 0.5 + shift, 0, 1 - 1e-9)
    return hilbert((place * (1 << bits)).astype(np.int64), bits)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of doubles, summed in the order of components."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda total, z: total + z)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def points(rows: DataFrame, keep_ids: int) -> DataFrame:
    """vector, node (its least id), ids (its least keep_ids ids), asked (whether any of its ids is a query)."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = rows.select("id", "vector").distinct().withColumn("nth", rank).where(F.col("nth") <= keep_ids)
    ids = least.groupBy("vector").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.where("is_query").select("vector").distinct().withColumn("asked", F.lit(True))
    return ids.join(asked, "vector", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def codes_of(unit: np.ndarray) -> np.ndarray:
    """A signed byte for each component, in units of the vector's largest one."""
    return np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)


def packed(batches: Iterator[pa.RecordBatch], block: int, dims: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (curve, node, asked, code) in runs of up to `block` rows of one curve: a row for each run."""
    from pyspark import TaskContext

    part, seen, held = TaskContext.get().partitionId(), {}, []

    def run(rows: list[tuple]) -> pa.RecordBatch:
        c = rows[0][0]
        node, asked, code = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3))
        first = seen.get(c, 0)
        seen[c] = first + len(node)
        return pa.RecordBatch.from_pydict({"curve": pa.array([c], pa.int32()), "part": pa.array([part], pa.int32()), "nth": [first], "n": [len(node)], "nodes": [node.astype("<i8").tobytes()], "asked": [asked.astype(np.uint8).tobytes()], "codes": [code.tobytes()]})

    for batch in batches:
        c = batch.column("curve").to_numpy()
        cols = batch.column("node").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, dims)
        at = 0
        while at < len(c):
            if held and held[0][0] != c[at]:
                yield run(held)
                held = []
            end = min(at + block - sum(len(r[1]) for r in held), int(np.searchsorted(c, c[at], side="right")))
            held.append((int(c[at]), *(x[at:end] for x in cols)))
            at = end
            if sum(len(r[1]) for r in held) == block:
                yield run(held)
                held = []
    if held:
        yield run(held)


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = 24, probes: int = 12, share: float = 0.06, axes: int = 6, keep: int = 32, least: int = 256, block: int = 1024, seed: int = 11) -> DataFrame:
    """query_id, rank, <id_col>, score: the k nearest found by cosine for each row where is_query holds.

    share is the part of all rows that a query's window spans on a curve; it
    reaches `least` ranks to each side at any size.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    told = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = told.where(F.col("id").isNotNull() & usable(F.col("vector")))
    common = good.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    dims = common[0].dims
    good = good.where(F.size("vector") == dims)
    nodes = scratch.save(points(good, k + 1), "points")
    reach = max(int(np.ceil(share * nodes.count() / 2)), least)
    turns = frames(dims, curves, axes, seed)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            code = pa.array([x.tobytes() for x in codes_of(unit)], pa.binary())
            length = np.stack([np.linalg.norm(unit @ turn, axis=1) for turn, _ in turns], axis=1)
            chosen = np.argsort(np.argsort(-length, axis=1, kind="stable"), axis=1, kind="stable") < probes
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for c, frame in enumerate(turns):
                key = curve_keys(unit, frame).view(np.int64)
                yield pa.RecordBatch.from_pydict({"curve": pa.array(np.full(len(v), c, np.int32)), "key": key, "node": batch.column("node"), "asked": pa.array(asked & chosen[:, c]), "code": code})

    keyed = nodes.select("node", "vector", "asked").mapInArrow(order, "curve int, key long, node long, asked boolean, code binary")
    lined = keyed.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node").select("curve", "node", "asked", "code")
    runs = scratch.save(lined.mapInArrow(lambda batches: packed(batches, block, dims), "curve int, part int, nth long, n long, nodes binary, asked binary, codes binary"), "runs")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ahead = runs.groupBy("curve", "part").agg(F.sum("n").alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = runs.join(ahead, ["curve", "part"]).withColumn("first", F.col("nth") + F.col("ahead"))

    def only_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                on = np.flatnonzero(np.frombuffer(row["asked"], np.uint8))
                if len(on):
                    code, rank = np.frombuffer(row["codes"], np.int8).reshape(-1, dims)[on], row["first"] + on
                    yield pa.RecordBatch.from_pydict({"curve": pa.array([row["curve"]], pa.int32()), "lo": [int(rank[0]) - reach], "hi": [int(rank[-1]) + reach], "q_nodes": [np.frombuffer(row["nodes"], "<i8")[on].tobytes()], "q_ranks": [rank.astype("<i8").tobytes()], "q_codes": [code.tobytes()]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of one group of queries come one after another; its best so far are kept, and given when it ends
        held, q_node, best, score = None, None, None, None

        def given() -> pa.RecordBatch:
            met = score.ravel() > -2
            return pa.RecordBatch.from_pydict({"q_node": np.repeat(q_node, best.shape[1])[met], "node": best.ravel()[met], "near": score.ravel()[met]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held != (row["curve"], row["q_ranks"]):
                    if held:
                        yield given()
                    held, q_node = (row["curve"], row["q_ranks"]), np.frombuffer(row["q_nodes"], "<i8")
                    best, score = np.zeros((len(q_node), 0), np.int64), np.zeros((len(q_node), 0), np.float32)
                q, x = (np.frombuffer(row[c], np.int8).reshape(-1, dims).astype(np.float32) for c in ("q_codes", "codes"))
                q_rank, node = (np.frombuffer(row[c], "<i8") for c in ("q_ranks", "nodes"))
                s = q @ x.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                s[np.abs(q_rank[:, None] - (row["first"] + np.arange(len(node)))) > reach] = -2
                score, best = np.concatenate([score, s], axis=1), np.concatenate([best, np.broadcast_to(node, s.shape)], axis=1)
                top = np.lexsort((best, -score), axis=1)[:, :keep]
                score, best = np.take_along_axis(score, top, 1), np.take_along_axis(best, top, 1)
        if held:
            yield given()

    asks = placed.select("curve", "first", "nodes", "asked", "codes").mapInArrow(only_asked, "curve int, lo long, hi long, q_nodes binary, q_ranks binary, q_codes binary")
    wide_cell = max(4 * reach, block)  # a window lies in one or two of these, so a query's finds are given once or twice a curve
    cells = lambda lo, hi: F.explode(F.sequence(F.expr(f"greatest({lo}, 0) div {wide_cell}"), F.expr(f"({hi}) div {wide_cell}")))
    wide = asks.withColumn("cell", cells("lo", "hi"))
    spread = placed.select("curve", "first", "n", "nodes", "codes").withColumn("cell", cells("first", "first + n - 1"))
    once = F.expr(f"first <= hi and first + n > lo and cell = greatest(first, lo, 0) div {wide_cell}")
    pairs = wide.join(spread, ["curve", "cell"]).where(once).select("curve", "q_nodes", "q_ranks", "q_codes", "nodes", "codes", "first")
    found = scratch.save(pairs.mapInArrow(compare, "q_node long, node long, near float"), "found")
    nth = F.row_number().over(Window.partitionBy("q_node").orderBy(F.desc("near"), "node"))
    near = found.groupBy("q_node", "node").agg(F.max("near").alias("near")).withColumn("nth", nth).where(F.col("nth") <= keep)
    vectors = near.join(nodes.select("node", "vector"), "node").join(nodes.select(F.col("node").alias("q_node"), F.col("vector").alias("asked_vector")), "q_node")
    best = vectors.select("q_node", "node", cosine(F.col("asked_vector"), F.col("vector")).alias("score"))
    ids = best.join(nodes.select("node", "ids"), "node").select("q_node", "score", F.explode("ids").alias("id"))
    least = F.row_number().over(Window.partitionBy("q_node").orderBy(F.desc("score"), "id"))
    ids = ids.withColumn("nth", least).where(F.col("nth") <= k + 1).drop("nth")
    asked_by = good.where("is_query").select("id", "vector").distinct().join(nodes.where("asked").select("vector", F.col("node").alias("q_node")), "vector").select(F.col("id").alias("query_id"), "q_node")
    each = asked_by.join(ids, "q_node").where("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
