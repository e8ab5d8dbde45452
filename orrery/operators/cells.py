"""Neighbours of a table of queries, by cells.

Points lie in cells: balls with a center and a radius, under a hierarchy of nodes that are balls too (of
a cover tree, or one layer of pivots). A batch of queries walks the hierarchy, of bounded size, by
itself: it leaves out every node that lies beyond a query's bound, and tightens the bound by the
nodes that hold k points. First each query meets the points of one near cell; that gives its k-th
distance, and in a second walk it opens the other cells in reach of it. Queries are never collected.

Cells and queries meet in parts: neighbouring cells form groups, whose points are dealt into parts and
whose queries into blocks, and each part meets each block in a task of its own, which tells by itself which
of the part's cells a query opens. So no cell, however full or however often asked, ends up in one task;
and parts and blocks grow with the tables, up to what a task may hold, so that what is shuffled
grows with the input and not with the pairs of a query and a cell. Of points that are equal only the k smallest
pids can be neighbours, so the rest of a large group of copies is left out at first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators.knn import best_of, chosen_of, knn, matrix
from orrery.sources.tables import settled

#: Points of a cell, about; points of a part and queries of a block, at least. All points make about GROUPS parts
#: and all queries GROUPS blocks, of PART_NUMBERS numbers at most.
CELL_POINTS, QUERY_BLOCK = 4096, 4096
GROUPS, PART_NUMBERS = 8, 8_000_000
#: Numbers that the hierarchy sent to every task may hold.
ROUTE_NUMBERS = 4_000_000
#: Equal points beyond so many (and k) are left out before the search.
COPIES = 64
MEMBERS = "pid long, vec array<double>, cell long"


@dataclass(frozen=True)
class Routes:
    """A hierarchy as arrays. Entry i is a ball (vec, radius, n points) under node `under`; it leads to the
    node `into`, or, where that is -1, is the cell `cell`. Node 0 is the root."""

    vec: np.ndarray
    radius: np.ndarray
    n: np.ndarray
    under: np.ndarray
    into: np.ndarray
    cell: np.ndarray

    def below(self) -> dict[int, np.ndarray]:
        order = np.argsort(self.under, kind="stable")
        nodes, first = np.unique(self.under[order], return_index=True)
        return dict(zip(nodes.tolist(), np.split(order, first[1:]), strict=True))


def held(dist: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """For each query the least distance within which balls with k points lie wholly."""
    far = dist + radius
    order = np.argsort(far, axis=1, kind="stable")
    enough = np.cumsum(n[order], axis=1) >= k
    first = enough.argmax(axis=1)
    bound = np.take_along_axis(far, np.take_along_axis(order, first[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), bound, np.inf)


def nearest_cell(routes: Routes, below: dict, metric: str, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query a cell near it, found by going to the nearest ball on each level, and a bound of its
    k-th distance."""
    cell, bound = np.full(len(q), -1), np.full(len(q), np.inf)
    level = [(0, np.arange(len(q)))]
    while level:
        deeper: dict[int, list[np.ndarray]] = {}
        for node, at in level:
            own = below[node]
            dist = metrics.pairwise(metric, q[at], routes.vec[own])
            bound[at] = np.minimum(bound[at], held(dist, routes.radius[own], routes.n[own], k))
            best = own[dist.argmin(axis=1)]
            ends = routes.into[best] < 0
            cell[at[ends]] = routes.cell[best[ends]]
            for into in np.unique(routes.into[best[~ends]]):
                deeper.setdefault(int(into), []).append(at[routes.into[best] == into])
        level = [(node, np.concatenate(parts)) for node, parts in deeper.items()]
    return cell, bound


def open_cells(routes: Routes, below: dict, metric: str, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) for every cell that may hold a point within the query's bound; the bound tightens
    on the way."""
    bound, found = bound.copy(), []
    level = [(0, np.arange(len(q)))]
    while level:
        deeper: dict[int, list[np.ndarray]] = {}
        for node, at in level:
            own = below[node]
            dist = metrics.pairwise(metric, q[at], routes.vec[own])
            bound[at] = np.minimum(bound[at], held(dist, routes.radius[own], routes.n[own], k))
            loose = 2 * metrics.slack(q[at], routes.vec[own])
            a, b = np.nonzero(dist - routes.radius[own] <= bound[at][:, None] + loose)
            into = routes.into[own[b]]
            found.append((at[a[into < 0]], routes.cell[own[b[into < 0]]]))
            for node_ in np.unique(into[into >= 0]):
                deeper.setdefault(int(node_), []).append(at[a[into == node_]])
        level = [(node, np.concatenate(parts)) for node, parts in deeper.items()]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def cell_groups(routes: Routes, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cells, their entries in routes, and the group of each: neighbouring cells, of about so many points that
    GROUPS of them are all, or of CELL_POINTS at least and PART_NUMBERS numbers at most."""
    at = np.flatnonzero(routes.into < 0)
    n = routes.n[at]
    seeds = routes.vec[at[:: -(-len(at) // GROUPS)]]
    near = np.concatenate([metrics.pairwise(metric, routes.vec[at[i : i + 4096]], seeds).argmin(axis=1) for i in range(0, len(at), 4096)])
    order = np.argsort(near, kind="stable")
    at, n = at[order], n[order]
    return routes.cell[at], at, (np.cumsum(n) - n) // share(int(n.sum()), CELL_POINTS, routes.vec.shape[1])


def share(total: int, least: int, dim: int) -> int:
    """Rows of one of GROUPS parts of `total`, within bounds."""
    return max(least, min(-(-total // GROUPS), PART_NUMBERS // max(1, dim)))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def near_in(metric: str, q: np.ndarray, bound: np.ndarray, pids: np.ndarray, vecs: np.ndarray, k: int) -> Found:
    """Place in q, pid, distance: of some points each query's k best within its bound; others may come along."""
    near, loose = metrics.pairwise(metric, q, vecs), 2 * metrics.slack(q, vecs)
    within, places = near <= bound[:, None] + loose, np.arange(len(q))
    if within.sum() > 4 * k * len(q):
        found = best_of(metric, places, q, pids, vecs, k)
    else:
        found = chosen_of(np.where(within, 0.0, np.inf), 0.0, lambda i, rows: metrics.rows_to_point(metric, vecs[rows], q[i]), places, pids, k, 0.0)
    return tuple(c.to_numpy() for c in found.columns)


def k_best(found: list[Found], k: int) -> tuple[Found, np.ndarray]:
    """Of what was found each query's k best, in order; and the rows that are a k-th one."""
    a, pids, dist = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((pids, dist, a))
    a = a[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    order, keep = order[rank < k], rank < k
    return (a[keep], pids[order], dist[order]), np.flatnonzero(rank[keep] == k - 1)


def meet(asked: DataFrame, n_asked: int, members: DataFrame, groups: DataFrame, sent, k: int, metric: str, home: bool) -> DataFrame:
    """qid, pid, dist: each query's (qid, vec, cell, bound, group) k best of what it opens in each part of the group: its
    own cell (home), or the others in reach of its bound. n_asked: number of queries. groups: cell, group, n; its
    rows are as many as the hierarchy's cells, which is bounded. Vectors are copied once for each part and block
    that they meet, and of these there are about GROUPS, until they hold PART_NUMBERS."""
    dim = sent.value.vec.shape[1]
    load = asked.groupBy("group").agg(F.count("*").alias("queries"))
    block = share(n_asked, QUERY_BLOCK, dim)
    sizes = groups.groupBy("group").agg(F.sum("n").alias("n"))
    part = share(int(sent.value.n[sent.value.into < 0].sum()), CELL_POINTS, dim)
    # Cells are cut into groups where a share is full, so that a group has less than two of them, if no cell is larger.
    shape = F.broadcast(load.join(sizes, "group").select("group", F.ceil(F.col("n") / (2 * part)).alias("parts"), F.ceil(F.col("queries") / block).alias("blocks")))

    def dealt(key: str, into: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(into)).alias(into.removesuffix("s"))

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(count.removesuffix("s"))

    q = asked.join(shape, "group").select("qid", "vec", "cell", "bound", "group", "parts", dealt("qid", "blocks")).select("qid", "vec", "cell", "bound", "group", each("parts"), "block")
    p = members.join(F.broadcast(groups.select("cell", "group")), "cell").join(shape, "group").select("pid", "vec", "cell", "group", dealt("pid", "parts"), "blocks").select("pid", "vec", "cell", F.col("group").alias("meeting"), "part", each("blocks"))
    keys = ["part", "block"]

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        out = [none]
        if queries.num_rows and points.num_rows:
            routes = sent.value
            ends = np.flatnonzero(routes.into < 0)
            entry = dict(zip(routes.cell[ends].tolist(), ends.tolist(), strict=True))
            qids, own, bound, pids, cell = (t.column(c).to_numpy() for t, c in ((queries, "qid"), (queries, "cell"), (queries, "bound"), (points, "pid"), (points, "cell")))
            rows, vecs = (matrix(t.column("vec").combine_chunks()) for t in (queries, points))
            order = np.argsort(cell, kind="stable")
            names, first = np.unique(cell[order], return_index=True)
            balls, spots = np.array([entry[c] for c in names.tolist()]), np.split(order, first[1:])
            for i in range(0, len(rows), 512):
                some, limit, best = rows[i : i + 512], bound[i : i + 512].copy(), none
                far = metrics.pairwise(metric, some, routes.vec[balls]) - routes.radius[balls] - 2 * metrics.slack(some, routes.vec[balls])
                for at, c in enumerate(names.tolist()):
                    is_own = own[i : i + 512] == c
                    opens = np.flatnonzero(is_own if home else ~is_own & (far[:, at] <= limit))
                    for j in range(0, len(spots[at]) if len(opens) else 0, 4 * CELL_POINTS):
                        these = spots[at][j : j + 4 * CELL_POINTS]
                        a, near, dist = near_in(metric, some[opens], limit[opens], pids[these], vecs[these], k)
                        best, full = k_best([best, (opens[a], near, dist)], k)
                        limit[best[0][full]] = np.minimum(limit[best[0][full]], best[2][full])
                out.append((qids[i + best[0]], *best[1:]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], ["qid", "pid", "dist"])

    return q.groupBy("group", *keys).cogroup(p.groupBy("meeting", *keys)).applyInArrow(run, "qid long, pid long, dist double")


def search(routes: Routes, members: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """qid, rk, pid, dist: the exact k nearest members (pid, vec, cell) of each query (qid, vec). A null
    query gives nothing; qid names a query."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(routes)
    names, entries, of = cell_groups(routes, metric)
    groups = spark.createDataFrame(list(zip(names.tolist(), of.tolist(), routes.n[entries].tolist(), strict=True)), "cell long, group long, n long")
    sent_groups = spark.sparkContext.broadcast((np.sort(names), of[np.argsort(names)]))
    chosen = queries.select(F.col("qid").cast("long").alias("qid"), metrics.doubles(F.col("vec")).alias("vec")).where("vec is not null")
    columns = "qid long, vec array<double>, cell long, bound double"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = sent.value.below()
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1))
                cell, bound = nearest_cell(sent.value, below, metric, rows, k)
                bound = bound + 2 * metrics.slack(rows, sent.value.vec)  # the walk's figures are rounded
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(bound)], names=["qid", "vec", "cell", "bound"])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, (sorted_cells, group_of) = sent.value.below(), sent_groups.value
        for batch in batches:
            if batch.num_rows:
                a, cell = open_cells(sent.value, below, metric, matrix(batch.column(1)), batch.column(3).to_numpy(), k)
                fresh = cell != batch.column(2).to_numpy()[a]
                group = group_of[np.searchsorted(sorted_cells, cell[fresh])]
                a, group = np.unique(np.stack([a[fresh], group]), axis=1)
                asks, first = np.unique(a, return_index=True)
                offsets = pa.array(np.append(first, len(a)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(asks)).columns, pa.ListArray.from_arrays(offsets, pa.array(group))], names=["qid", "vec", "cell", "bound", "groups"])

    order = Window.partitionBy("qid").orderBy("dist", "pid")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)

    first = settled(chosen.mapInArrow(start, columns), "first-cells")
    n_asked = first.count()
    at_home = first.join(F.broadcast(groups.select("cell", "group")), "cell")
    near = settled(ranked(meet(at_home, n_asked, members, groups, sent, k, metric, True)), "near")
    kth = near.where(F.col("rk") == k).select("qid", F.col("dist").alias("kth"))
    bounded = first.join(kth, "qid", "left").select("qid", "vec", "cell", F.least("bound", "kth").alias("bound"))
    more = settled(bounded.mapInArrow(further, f"{columns}, groups array<long>"), "open-cells")
    if more.isEmpty():
        return near.select("qid", "rk", "pid", "dist")
    far = meet(more.select("qid", "vec", "cell", "bound", F.explode("groups").alias("group")), n_asked, members, groups, sent, k, metric, False)
    return ranked(near.drop("rk").unionByName(far)).select("qid", "rk", "pid", "dist")


def without_copies(points: DataFrame, k: int) -> DataFrame:
    """Points less those that cannot be among the k nearest of anything, as k equal ones of smaller pids are
    there: of large groups of equal points only."""
    names = [F.xxhash64(F.lit(i), "vec").alias(f"h{i}") for i in (1, 2)]
    rows = points.select("pid", metrics.doubles(F.col("vec")).alias("vec")).where("vec is not null").select("*", *names)
    groups = settled(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > max(k, COPIES)).select("h1", "h2"), "copied")
    n = groups.count()
    if not n:
        return rows.drop("h1", "h2")
    marked = F.broadcast(groups) if n * 2 <= ROUTE_NUMBERS else groups
    first = Window.partitionBy("h1", "h2").orderBy("pid")
    kept = rows.join(marked, ["h1", "h2"], "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    return rows.join(marked, ["h1", "h2"], "left_anti").unionByName(kept).drop("h1", "h2")


def pivot_routes(points: DataFrame, metric: str, cell_points: int = CELL_POINTS) -> tuple[Routes, DataFrame]:
    """One layer of pivots, about one for cell_points points and no more than fit, drawn by hash; and the
    members of their cells, each point with its nearest pivot."""
    n = points.count()
    dim = len(points.first().vec)
    most = max(1, min(ROUTE_NUMBERS // max(1, dim), -(-n // cell_points)))
    drawn = points.where(F.pmod(F.xxhash64(F.lit(11), "pid"), F.lit(max(1, n // (2 * most)))) == 0)
    pivots = np.array([r.vec for r in drawn.orderBy(F.xxhash64(F.lit(12), "pid"), "pid").limit(most).collect()], np.float64)
    sent = points.sparkSession.sparkContext.broadcast(pivots if len(pivots) else np.zeros((1, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                vecs = matrix(part.column(1))
                cell = metrics.pairwise(metric, vecs, sent.value).argmin(axis=1)
                dist = np.empty(len(vecs))
                for c in np.unique(cell):
                    dist[cell == c] = metrics.rows_to_point(metric, vecs[cell == c], sent.value[c])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell), pa.array(dist)], names=["pid", "vec", "cell", "dist"])

    members = settled(points.select(F.col("pid").cast("long").alias("pid"), "vec").mapInArrow(run, f"{MEMBERS}, dist double"), "members")
    balls = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).orderBy("cell").collect()  # a row for each pivot
    cells = np.array([b.cell for b in balls])
    zero = np.zeros(len(cells), np.int64)
    routes = Routes(sent.value[cells], np.array([b.radius for b in balls]), np.array([b.n for b in balls]), zero, zero - 1, cells)
    return routes, members.select("pid", "vec", "cell")


def sizes_of(spark, routes: Routes) -> DataFrame:
    own = routes.into < 0
    return spark.createDataFrame(list(zip(routes.cell[own].tolist(), routes.n[own].tolist(), strict=True)), "cell long, n long")


def knn_join(points: DataFrame, queries: DataFrame, k: int, metric: str = "l2", cell_points: int = CELL_POINTS) -> DataFrame:
    """qid, rk, pid, dist: the exact k nearest points (pid, vec) of each row of a table of queries (qid, vec),
    which may be as large as the points. The metric must keep the triangle inequality; for cosine,
    which does not, the queries are sent out in blocks instead."""
    if metric == "cosine":
        return knn(points, queries, k, metric)
    cloud = settled(without_copies(points, k), "points")
    if cloud.isEmpty():
        return points.sparkSession.createDataFrame([], "qid long, rk int, pid long, dist double")
    routes, members = pivot_routes(cloud, metric, cell_points)
    return search(routes, members, queries, k, metric)
