"""Searches over sparse clouds: points(pid, idx, val), queries(qid, idx, val); absent entries are 0.

Nothing is made dense over all dimensions. An Arrow batch is compressed rows (row starts, indices, values).
A block of queries is a matrix over the dimensions that occur in it; the points' entries in those
dimensions meet its rows, and what lies outside them counts by the points' norms. So the work is entries
times queries of a block, and memory is bounded by slices of both, whatever the number of dimensions.

Defined cases: a null idx or val takes no part; an empty vector is 0 everywhere; indices may be in any order,
but one that occurs twice in a vector, is null, or has no value is an error, as is a null value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.metrics import COSINE_FLOOR, SPARSE
from orrery.operators.knn import chosen_of

#: Queries of a block, and entries of its matrix; numbers that a slice of points meets it in.
QUERY_BLOCK, BLOCK_NUMBERS, MEETING_NUMBERS = 512, 4_000_000, 4_000_000


@dataclass(frozen=True)
class Rows:
    """Sparse vectors end to end: row i has the entries starts[i] to starts[i + 1], by rising index."""

    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def take(self, first: int, last: int) -> Rows:
        a, b = self.starts[first], self.starts[last]
        return Rows(self.starts[first : last + 1] - a, self.index[a:b], self.value[a:b])

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Sums of entries' figures (entries, or entries x columns) by row."""
        total = np.zeros((len(self), *each.shape[1:]))
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            total[filled] = np.add.reduceat(each, self.starts[filled], axis=0)
        return total


def rows_of(index: pa.Array, value: pa.Array) -> Rows:
    """Two list columns without null lists as rows."""
    lengths, values = np.diff(index.offsets.to_numpy()), np.diff(value.offsets.to_numpy())
    at, x = index.flatten(), value.flatten()
    if (lengths != values).any() or at.null_count or x.null_count:
        raise ValueError("a sparse vector needs a value for each index")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    at, x = at.to_numpy(zero_copy_only=False).astype(np.int64), x.to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((at, owner))
    at, x = at[order], x[order]
    if ((np.diff(at) == 0) & (np.diff(owner) == 0)).any():
        raise ValueError("an index occurs twice in a sparse vector")
    return Rows(starts, at, x)


@dataclass(frozen=True)
class Block:
    """Queries as a matrix: dims, the dimensions that occur, rising; rows, queries x dims."""

    ids: np.ndarray
    dims: np.ndarray
    rows: np.ndarray

    def spots(self, index: np.ndarray) -> np.ndarray:
        """Each index's column; -1 for those that no query has."""
        if not len(self.dims):
            return np.full(len(index), -1)
        at = np.minimum(np.searchsorted(self.dims, index), len(self.dims) - 1)
        return np.where(self.dims[at] == index, at, -1)


def block_of(ids: np.ndarray, queries: Rows) -> Block:
    dims = np.unique(queries.index)
    rows = np.zeros((len(queries), len(dims)))
    rows[queries.owner(), np.searchsorted(dims, queries.index)] = queries.value
    return Block(ids, dims, rows)


def near_of(metric: str, block: Block, points: Rows) -> tuple[np.ndarray, float]:
    """Queries x points distances, and twice what they may be off by."""
    spots = block.spots(points.index)
    inside = spots >= 0
    starts = np.concatenate([[0], np.cumsum(np.bincount(points.owner()[inside], minlength=len(points)))])
    shared = Rows(starts, spots[inside], points.value[inside])
    wide = max(1, MEETING_NUMBERS // max(1, len(shared.index)))
    near = np.empty((len(block.ids), len(points)))
    if metric in ("l2", "cosine"):
        own, theirs = points.sums(points.value**2), (block.rows**2).sum(axis=1)
        for i in range(0, len(block.ids), wide):
            dot = shared.sums(block.rows[i : i + wide, shared.index].T * shared.value[:, None]).T
            if metric == "l2":
                near[i : i + wide] = np.sqrt(np.maximum(own + theirs[i : i + wide, None] - 2 * dot, 0.0))
            else:
                near[i : i + wide] = 1 - dot / np.maximum(np.sqrt(own) * np.sqrt(theirs[i : i + wide, None]), COSINE_FLOOR)
        longest = float(np.sqrt(max(own.max(initial=0.0), theirs.max(initial=0.0))))
        return near, 1e-9 + (4e-7 * longest if metric == "l2" else 0.0)
    own, theirs = points.sums(np.abs(points.value)), np.abs(block.rows).sum(axis=1)
    for i in range(0, len(block.ids), wide):
        q = block.rows[i : i + wide, shared.index].T
        saved = np.abs(q - shared.value[:, None]) - np.abs(q) - np.abs(shared.value)[:, None]
        near[i : i + wide] = np.maximum(own + theirs[i : i + wide, None] + shared.sums(saved).T, 0.0)
    longest = float(max(own.max(initial=0.0), theirs.max(initial=0.0)))
    if metric == "l1":
        return near, 1e-9 + 1e-12 * longest
    return np.sqrt(near), 1e-9 + 2e-6 * float(np.sqrt(longest))


def measured(metric: str, block: Block, points: Rows, i: int, some: np.ndarray) -> np.ndarray:
    """Distances of query i to some points, without cancellation: over the query's dimensions by
    difference, and outside them by the points' entries."""
    lengths = points.starts[some + 1] - points.starts[some]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(points.starts[some] - starts[:-1], lengths) + np.arange(starts[-1])
    spots, value = block.spots(points.index[at]), points.value[at]
    owner = np.repeat(np.arange(len(some)), lengths)
    mine = np.flatnonzero(block.rows[i])
    place = np.full(len(block.dims), -1)
    place[mine] = np.arange(len(mine))
    to = np.where(spots >= 0, place[spots] if len(place) else -1, -1)
    q, wide, out = block.rows[i, mine], max(1, MEETING_NUMBERS // max(1, len(mine))), np.empty(len(some))
    for first in range(0, len(some), wide):
        last = min(first + wide, len(some))
        here = slice(starts[first], starts[last])
        met, x, row = to[here] >= 0, value[here], owner[here] - first
        theirs = np.zeros((last - first, len(mine)))
        theirs[row[met], to[here][met]] = x[met]
        rest = np.bincount(row[~met], x[~met] ** 2 if metric in ("l2", "cosine") else np.abs(x[~met]), last - first)
        if metric == "l2":
            out[first:last] = np.sqrt(((theirs - q) ** 2).sum(axis=1) + rest)
        elif metric == "cosine":
            norms = np.sqrt((theirs**2).sum(axis=1) + rest) * np.sqrt((q * q).sum())
            out[first:last] = 1 - (theirs * q).sum(axis=1) / np.maximum(norms, COSINE_FLOOR)
        else:
            out[first:last] = np.abs(theirs - q).sum(axis=1) + rest
    return np.sqrt(out) if metric == "l1_sqrt" else out


def blocks_of(queries: DataFrame) -> Iterator[Block]:
    """The stated query set in blocks of bounded size: few enough queries that their matrix fits."""
    chosen = queries.select(F.col("qid").cast("long").alias("qid"), "idx", "val").where("idx is not null and val is not null")
    n, entries = chosen.agg(F.count("*"), F.coalesce(F.sum(F.size("idx")), F.lit(0))).first()
    # A block of b queries with e entries each has at most b * b * e numbers.
    least = max(1.0, entries / max(1, n))
    size = int(max(1, min(QUERY_BLOCK, (BLOCK_NUMBERS / least) ** 0.5)))
    parts = -(-n // size)
    for i in range(parts):
        part = chosen.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) if parts > 1 else chosen
        table = part.orderBy("qid").toArrow().combine_chunks()
        ids = table.column("qid").to_numpy()
        if len(ids):
            rows = rows_of(*[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("idx"), table.column("val"))])
            # Hashing may deal a block more, or longer, queries than the mean; it is then cut further.
            first = 0
            while first < len(rows):
                last = first + 1
                while last < len(rows) and (last + 1 - first) * (rows.starts[last + 1] - rows.starts[first]) <= BLOCK_NUMBERS:
                    last += 1
                yield block_of(ids[first:last], rows.take(first, last))
                first = last


def pieces(rows: Rows, queries: int) -> Iterator[tuple[int, int]]:
    """Ranges of points whose distances to the queries, and whose entries, are a bounded meeting; a longer
    vector is one by itself."""
    first = 0
    while first < len(rows):
        last = int(np.searchsorted(rows.starts, rows.starts[first] + MEETING_NUMBERS, side="right")) - 1
        last = max(first + 1, min(last, first + max(1, MEETING_NUMBERS // max(1, queries)), len(rows)))
        yield first, last
        first = last


def _found(points: DataFrame, queries: DataFrame, metric: str, k: int, radius: float | None) -> DataFrame:
    if metric not in SPARSE:
        raise ValueError(f"no sparse metric {metric}")
    spark = points.sparkSession
    chosen = points.select(F.col("pid").cast("long").alias("pid"), "idx", "val").where("idx is not null and val is not null")
    parts = []
    for held in blocks_of(queries):
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                pids, rows = batch.column(0).to_numpy(zero_copy_only=False), rows_of(batch.column(1), batch.column(2))
                for first, last in pieces(rows, len(block.ids)):
                    some = rows.take(first, last)
                    near, loose = near_of(metric, block, some)
                    yield chosen_of(near, loose, lambda i, b, some=some: measured(metric, block, some, i, b), block.ids, pids[first:last], k, radius)

        parts.append(chosen.mapInArrow(run, "qid long, pid long, dist double"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "qid long, pid long, dist double")


def sparse_knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, rk, pid, dist: the k nearest sparse points of each query, ties by pid. Metrics: l2, l1, l1_sqrt,
    cosine."""
    order = Window.partitionBy("qid").orderBy("dist", "pid")
    return _found(points, queries, metric, k, None).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "rk", "pid", "dist")


def sparse_within(points: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """qid, pid, dist of the sparse points closer than radius (strictly)."""
    return _found(points, queries, metric, 0, radius).where(F.col("dist") < radius)


def sparse_assign(points: DataFrame, centers: DataFrame, metric: str = "l2") -> DataFrame:
    """pid, center, dist: each sparse point's nearest center (cid, idx, val); ties go to the smaller cid. The
    choice is made in the batch: one row a point and block of centers."""
    if metric not in SPARSE:
        raise ValueError(f"no sparse metric {metric}")
    spark = points.sparkSession
    chosen = points.select(F.col("pid").cast("long").alias("pid"), "idx", "val").where("idx is not null and val is not null")
    parts = []
    for held in blocks_of(centers.select(F.col("cid").alias("qid"), "idx", "val")):
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                pids, rows = batch.column(0).to_numpy(zero_copy_only=False), rows_of(batch.column(1), batch.column(2))
                for first, last in pieces(rows, len(block.ids)):
                    some = rows.take(first, last)
                    near, loose = near_of(metric, block, some)
                    likely = near <= near.min(axis=0) + loose
                    best, owner = np.full(len(some), np.inf), np.zeros(len(some), np.int64)
                    for i in np.lexsort((block.ids,)):
                        spots = np.flatnonzero(likely[i])
                        exact = measured(metric, block, some, i, spots)
                        nearer = exact < best[spots]
                        best[spots[nearer]], owner[spots[nearer]] = exact[nearer], block.ids[i]
                    yield pa.RecordBatch.from_arrays([pa.array(pids[first:last]), pa.array(owner), pa.array(best)], names=["pid", "center", "dist"])

        parts.append(chosen.mapInArrow(run, "pid long, center long, dist double"))
    if not parts:
        return spark.createDataFrame([], "pid long, center long, dist double")
    best = reduce(DataFrame.unionByName, parts).groupBy("pid").agg(F.min(F.struct("dist", "center")).alias("best"))
    return best.select("pid", "best.center", "best.dist")
