"""Centroid clustering by sort-means.

Vectors become integers, floor(256 x), so that every sum and distance is exact. A round goes over all
vectors once. For each centroid the others are ordered by their distance from it. A vector first
measures the centroid that it was assigned to; then it scans the others in that one's order and stops
at the first that lies strictly beyond twice its current distance, since none from there on can be as
near (one at exactly twice the distance may tie). In a task the vectors of a former centroid are sorted by
their distance, so that each step of the scan measures those that still go on, as one product.

What a round sends around are the centroids (k times dim numbers) and their sums from each task. The
assignments are a table in the shared folder; that of the round before is deleted.

Defined cases: vectors of another length, null ones and those with a null or non-finite component are
left out. Every other row counts, also one that repeats or has a null id; a null id never names a
first centroid unless there are fewer than k others. Rows of one id are ordered by their vectors. With
fewer vectors than k there are as many centroids. Ties in distance go to the smaller number, so of equal
centroids the first has all; empty ones stay where they are. Components beyond 2**18 raise an error. An
empty table gives an empty result; columns other than vec_id and vec are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import forget, kept
from orrery.llm.hard_negatives import integers, usable

ROUNDS, CENTROIDS, DIM = 5, 40, 64
STATE = "vec_id long, vec binary, cluster int, distance long"


def vectors(points: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, vec (integers) of the vectors of dim usable components."""
    whole = points.where((F.size("vec") == dim) & usable(F.col("vec")))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("vec")).alias("vec"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of `seed:vec_id`."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.select(name.alias("name"), "vec").orderBy(F.asc_nulls_last("name"), "vec").limit(k).collect()
    return np.array([r.vec for r in drawn], np.int64)


def nearest(vecs: np.ndarray, before: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its centroid and squared distance, scanned from the centroid it had before."""
    apart = ((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    norms = (centers * centers).sum(axis=1)
    cluster, best = before.copy(), np.empty(len(vecs), np.int64)
    for own in np.unique(before):
        at = np.flatnonzero(before == own)
        here = vecs[at]
        squares = (here * here).sum(axis=1)
        now = squares - 2 * (here @ centers[own]) + norms[own]
        far = np.argsort(-now, kind="stable")  # the farthest scan longest
        at, here, squares, now = at[far], here[far], squares[far], now[far]
        least, which, reach = now.copy(), np.full(len(at), own), -4 * now
        for other in order[own]:
            if other == own:
                continue
            go = np.searchsorted(reach, -apart[own, other], side="right")  # twice the distance, as squares: not beyond
            if not go:
                break
            d = squares[:go] - 2 * (here[:go] @ centers[other]) + norms[other]
            nearer = (d < least[:go]) | ((d == least[:go]) & (other < which[:go]))
            least[:go][nearer], which[:go][nearer] = d[nearer], other
        cluster[at], best[at] = which, least
    return cluster, best


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim).astype(np.int64)


def assigned(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """STATE rows, from rows of (vec_id, vec, cluster) or, in the first round, (vec_id, vec)."""
    sent, dim, first = rows.sparkSession.sparkContext.broadcast(centers), centers.shape[1], "cluster" not in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if first:
                vecs = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dim)
                packed, before = pa.array([v.tobytes() for v in vecs.astype(np.int32)], pa.binary()), np.zeros(len(vecs), np.int64)
            else:
                packed = batch.column(1)
                vecs, before = unpacked(packed, dim), batch.column(2).to_numpy().astype(np.int64)
            cluster, best = nearest(vecs, before, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(cluster.astype(np.int32)), pa.array(best)], names=["vec_id", "vec", "cluster", "distance"])

    return rows.select(*[c for c in ("vec_id", "vec", "cluster") if c in rows.columns]).mapInArrow(run, STATE)


def moved(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters stay. Each task adds up its own rows."""
    k, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster, vecs = batch.column(1).to_numpy(), unpacked(batch.column(0), dim)
            counts += np.bincount(cluster, minlength=k)
            for own in np.unique(cluster):
                sums[own] += vecs[cluster == own].sum(axis=0)
        some = np.flatnonzero(counts)
        flat = [np.repeat(some, dim), np.tile(np.arange(dim), len(some)), np.repeat(counts[some], dim), sums[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat], names=["cluster", "pos", "n", "total"])

    parts = state.select("vec", "cluster").mapInArrow(run, "cluster long, pos long, n long, total long")
    totals = parts.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centers.copy()
    for r in totals.collect():  # k times dim rows
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out


def cluster(points: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """vec_id, vec (32-bit integers), cluster, distance (squared) after the last round, and the centroids."""
    rows = kept(vectors(points, dim), "vectors")
    centers = first_centroids(rows, k, seed)
    if not len(centers):
        return rows.sparkSession.createDataFrame([], STATE), np.zeros((0, dim), np.int64)
    state = kept(assigned(rows, centers), "assigned")
    forget(rows)
    for _ in range(rounds):
        centers = moved(state, centers)
        before, state = state, kept(assigned(state, centers), "assigned")
        forget(before)
    return state, centers


def report(state: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    spark = state.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centers.tolist())]
    known = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(known, "cluster")
    whole = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))  # one row
    return state.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
