"""Nearest neighbours of a stated query set among all points.

Queries are sent out in blocks of at most QUERY_BLOCK; every block is one pass over the points, in
which each Arrow batch keeps its own k best of each query. What is shuffled is k rows for a query and
batch; the last choice is a window over them. Ties go to the smaller pid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import metrics

QUERY_BLOCK = 512


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK, *extra: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The queries, block by block, as ids, rows and extra number columns; each fits a fixed bound."""
    chosen = queries.select(F.col("qid").cast("long").alias("qid"), metrics.doubles(F.col("vec")).alias("vec"), *[F.col(c).cast("double").alias(c) for c in extra]).where("vec is not null")
    n = -(-chosen.count() // block)
    for i in range(n):
        part = chosen.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) if n > 1 else chosen
        rows = part.orderBy("qid").collect()
        if rows:
            yield np.array([r.qid for r in rows], np.int64), np.array([r.vec for r in rows], np.float64), *[np.array([r[c] for r in rows]) for c in extra]


def best_of(metric: str, qids: np.ndarray, q: np.ndarray, pids: np.ndarray, vecs: np.ndarray, k: int, radius: float | None = None) -> pa.RecordBatch:
    """qid, pid, dist: of the points of a batch each query's k best, or all within a radius."""
    near, loose = metrics.pairwise(metric, q, vecs), 2 * metrics.slack(q, vecs)
    return chosen_of(near, loose, lambda i, rows: metrics.rows_to_point(metric, vecs[rows], q[i]), qids, pids, k, radius)


def chosen_of(near: np.ndarray, loose: float, measure: Callable[[int, np.ndarray], np.ndarray], qids: np.ndarray, pids: np.ndarray, k: int, radius: float | None) -> pa.RecordBatch:
    """What best_of gives, of near distances (queries x points, off by at most half of `loose`) and a
    function that measures a query's distance to some points."""
    if radius is not None:
        a, b = np.nonzero(near <= radius + loose)
    else:
        n = min(k, len(pids))
        edge = np.partition(near, n - 1, axis=1)[:, n - 1]
        # What ties with the last one kept, whatever its place in the batch, is measured too.
        a, b = np.nonzero(near <= edge[:, None] + loose)
    exact = np.empty(len(a))
    ends = np.searchsorted(a, np.arange(len(qids) + 1))
    for i in range(len(qids)):
        if ends[i + 1] > ends[i]:
            exact[ends[i] : ends[i + 1]] = measure(i, b[ends[i] : ends[i + 1]])
    if radius is None:
        order = np.lexsort((pids[b], exact, a))
        first = (np.arange(len(a)) - ends[a[order]]) < k
        a, b, exact = a[order][first], b[order][first], exact[order][first]
    return pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(pids[b].astype(np.int64)), pa.array(exact)], names=["qid", "pid", "dist"])


def _best(points: DataFrame, ids: np.ndarray, rows: np.ndarray, k: int, metric: str, radius: float | None) -> DataFrame:
    held = points.sparkSession.sparkContext.broadcast((ids, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = held.value
        for batch in batches:
            if batch.num_rows:
                yield best_of(metric, qids, q, batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)), k, radius)

    chosen = points.select(F.col("pid").cast("long").alias("pid"), "vec").where("vec is not null")
    return chosen.mapInArrow(run, "qid long, pid long, dist double")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, rk, pid, dist: the k nearest points (pid, vec) of each query (qid, vec), in order. A query
    that is itself a point finds itself. Fewer points than k give fewer rows."""
    parts = [_best(points, ids, rows, k, metric, None) for ids, rows in query_blocks(queries)]
    if not parts:
        return points.sparkSession.createDataFrame([], "qid long, rk int, pid long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "pid")
    return reduce(DataFrame.unionByName, parts).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "rk", "pid", "dist")


def within(points: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """qid, pid, dist of the points closer than radius (strictly)."""
    parts = [_best(points, ids, rows, 0, metric, radius) for ids, rows in query_blocks(queries)]
    if not parts:
        return points.sparkSession.createDataFrame([], "qid long, pid long, dist double")
    return reduce(DataFrame.unionByName, parts).where(F.col("dist") < radius)


def layer_best(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, layer, rk, pid, dist: the k nearest points of each layer (points: pid, layer, vec). Each batch
    keeps its own k best of a query and layer."""
    spark, parts = points.sparkSession, []
    chosen = points.select(F.col("pid").cast("long").alias("pid"), F.col("layer").cast("long").alias("layer"), "vec").where("vec is not null")
    for held in query_blocks(queries):
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            for batch in batches:
                pids, layers, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
                for layer in np.unique(layers):
                    best = best_of(metric, qids, q, pids[layers == layer], vecs[layers == layer], k)
                    yield pa.RecordBatch.from_arrays([best.column(0), pa.array(np.full(best.num_rows, layer)), best.column(1), best.column(2)], names=["qid", "layer", "pid", "dist"])

        parts.append(chosen.mapInArrow(run, "qid long, layer long, pid long, dist double"))
    if not parts:
        return spark.createDataFrame([], "qid long, layer long, rk int, pid long, dist double")
    order = Window.partitionBy("qid", "layer").orderBy("dist", "pid")
    return reduce(DataFrame.unionByName, parts).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "layer", "rk", "pid", "dist")


def assign(points: DataFrame, centers: DataFrame, metric: str = "l2", nested: int | None = None) -> DataFrame:
    """pid, center, dist: each point's nearest center (cid, vec). Equal distances go to the smaller
    cid, and to `nested` only if nothing else is as near. The choice is made in the batch: one row a
    point and block of centers."""
    spark, parts = points.sparkSession, []
    chosen = points.select(F.col("pid").cast("long").alias("pid"), "vec").where("vec is not null")
    for held in query_blocks(centers.select(F.col("cid").alias("qid"), "vec")):
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cids, c = sent.value
            order = np.lexsort((cids, cids == nested))
            cids, c = cids[order], c[order]
            for batch in batches:
                pids, vecs = batch.column(0).to_numpy(), matrix(batch.column(1))
                if not len(pids):
                    continue
                near = metrics.pairwise(metric, c, vecs)
                best, owner = np.full(len(pids), np.inf), np.zeros(len(pids), np.int64)
                likely = near <= near.min(axis=0) + 1e-6
                for i in np.flatnonzero(likely.any(axis=1)):
                    spots = np.flatnonzero(likely[i])
                    exact = metrics.rows_to_point(metric, vecs[spots], c[i])
                    nearer = exact < best[spots]
                    best[spots[nearer]], owner[spots[nearer]] = exact[nearer], cids[i]
                yield pa.RecordBatch.from_arrays([pa.array(pids), pa.array(owner), pa.array(best)], names=["pid", "center", "dist"])

        parts.append(chosen.mapInArrow(run, "pid long, center long, dist double"))
    if len(parts) < 2:
        return parts[0] if parts else spark.createDataFrame([], "pid long, center long, dist double")
    place = F.struct("dist", (F.col("center") == F.lit(nested if nested is not None else -1)).alias("last"), "center")
    best = reduce(DataFrame.unionByName, parts).groupBy("pid").agg(F.min(place).alias("best"))
    return best.select("pid", "best.center", "best.dist")


def first_cover(points: DataFrame, centers: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """pid, center, dist: the first center, by `ord`, that covers the point (dist < radius)."""
    near = within(points, centers.select(F.col("cid").alias("qid"), "vec"), radius, metric).join(centers.select(F.col("cid").alias("qid"), "ord"), "qid")
    return near.groupBy("pid").agg(F.min(F.struct("ord", "qid", "dist")).alias("best")).select("pid", F.col("best.qid").alias("center"), F.col("best.dist").alias("dist"))
