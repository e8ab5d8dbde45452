"""Cover trees: hierarchies of balls over a point cloud, built level by level as DataFrames.

The tree is its path table: for every point the nodes it falls under, from the root to where it
rests. Nodes, edges, resting places and all aggregates are groupings of it.

A node (scale s, center c) holds points closer than base ** s to c. Its split draws uncovered points
as centers until everything is covered. The draw follows one hash order of the points, so a tree
depends on the points and the seed alone. Nodes of more than `group_points` points are split by Spark
(centers from a growing beginning of the order each round, all points measured in parallel); smaller
ones are finished, subtree and all, in one task each. Both give the same tree.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from orrery.functions import metrics
from orrery.operators.knn import matrix
from orrery.sources.tables import forget, settled

#: Points of a large node from which the first round draws its centers, about; each round takes GROWTH times
#: as many, up to PREFIX_NUMBERS numbers (or LAST_BATCH points).
FIRST_BATCH, GROWTH, PREFIX_NUMBERS = 1024, 8, 2_000_000
#: Centers that points are measured against at a time, and children of a block whose distances are checked.
LAST_BATCH, SIBLINGS = 512, 1024
#: Numbers that a broadcast table of nodes or centers may hold; beyond, a node's points are dealt into parts,
#: which meet its centers in blocks of so many numbers, and lines about nodes are copied so many times.
BROADCAST_NUMBERS, PART_POINTS, BLOCK_NUMBERS, COPIES = 4_000_000, 4096, 4_000_000, 64
PATH = "array<struct<scale:int,center:bigint,dist:double>>"


@dataclass(frozen=True)
class TreeParams:
    """scale_base: ratio of ball sizes between levels. leaf_cutoff: nodes of at most so many points are
    leaves. min_res_index: nodes of smaller scale are leaves. use_singletons: splits of one point stay
    with the parent. partition_type: "nearest" or "first" (the first center that covers)."""

    scale_base: float = 2.0
    leaf_cutoff: int = 1
    min_res_index: int = -10
    use_singletons: bool = True
    partition_type: str = "nearest"
    rng_seed: int = 0
    metric: str = "l2"
    group_points: int = 20_000

    def __post_init__(self) -> None:
        if self.partition_type not in ("nearest", "first"):
            raise ValueError("partition_type is nearest or first")
        if self.scale_base <= 1:
            raise ValueError("scale_base must be over 1")


def next_scale(params: TreeParams, scale: int, radius: float) -> int:
    """One scale down at least, down to what the radius needs, never past the smallest scale by more
    than one."""
    tight = math.ceil(math.log(radius) / math.log(params.scale_base)) if radius > 0 else params.min_res_index
    return min(scale - 1, max(tight, params.min_res_index))


def is_leaf(params: TreeParams, scale: int, n: int) -> bool:
    return n <= params.leaf_cutoff or scale < params.min_res_index


class Subtree:
    """One node's points, split down to its leaves. Memory is a few numbers a point and level."""

    def __init__(self, params: TreeParams, pids: np.ndarray, rows: np.ndarray, order: np.ndarray):
        self.params, self.pids, self.rows = params, pids, rows
        self.rank = np.empty(len(pids), np.int64)
        self.rank[np.lexsort((pids, order))] = np.arange(len(pids))
        self.paths: list[list[tuple[int, int, float]]] = [[] for _ in pids]

    def split(self, center: int, members: np.ndarray, dist: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """For each member its center (a row), and the distance to it."""
        nearest = self.params.partition_type == "nearest"
        owner, best = np.full(len(members), -1), np.full(len(members), np.inf)
        covered = dist < radius
        if not nearest:
            owner[covered], best[covered] = center, dist[covered]
        by_rank = np.argsort(self.rank[members])
        at = 0
        while True:
            while at < len(by_rank) and covered[by_rank[at]]:
                at += 1
            if at == len(by_rank):
                break
            drawn = members[by_rank[at]]
            d = metrics.rows_to_point(self.params.metric, self.rows[members], self.rows[drawn])
            d[by_rank[at]] = 0.0
            takes = d < best if nearest else ~covered & (d < radius)
            owner[takes], best[takes] = drawn, d[takes]
            covered |= d < radius
            covered[by_rank[at]] = True
        if nearest:
            back = dist < best
            owner[back], best[back] = center, dist[back]
        return owner, best

    def grow(self, scale: int, center: int, members: np.ndarray, dist: np.ndarray) -> None:
        stack = [(scale, center, members, dist)]
        while stack:
            scale, center, members, dist = stack.pop()
            name = int(self.pids[center])
            for m, d in zip(members.tolist(), dist.tolist(), strict=True):
                self.paths[m].append((scale, name, d))
            if is_leaf(self.params, scale, len(members)):
                continue
            below = next_scale(self.params, scale, float(dist.max()))
            owner, best = self.split(center, members, dist, self.params.scale_base**below)
            groups = {int(c): np.flatnonzero(owner == c) for c in np.unique(owner)}
            kept = {c: g for c, g in groups.items() if c == center or len(g) > 1 or not self.params.use_singletons}
            if len(kept) == 1 and len(kept.get(center, ())) == 1:
                continue  # nothing but the center's own node would be new
            stack += [(below, c, members[g], best[g]) for c, g in kept.items()]


@dataclass(frozen=True)
class CoverTree:
    """points: pid, vec, and any other columns. paths: pid, depth, scale, center, dist."""

    params: TreeParams
    points: DataFrame
    paths: DataFrame
    laid: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def kept(self, name: str, make: Callable):
        """What `make` gives, made once for this tree."""
        if name not in self.laid:
            self.laid[name] = make()
        return self.laid[name]

    def nodes(self) -> DataFrame:
        """scale, center, parent_scale, parent_center, depth, coverage_count, radius, n_singletons,
        is_leaf. The root's parent is null."""
        last = F.col("next_center").isNull()
        return self.steps().groupBy("scale", "center").agg(
            F.first("parent_scale").alias("parent_scale"), F.first("parent_center").alias("parent_center"), F.min("depth").alias("depth"),
            F.count("*").alias("coverage_count"), F.max("dist").alias("radius"),
            F.sum((last & (F.col("pid") != F.col("center"))).cast("long")).alias("n_singletons"), F.min(last).alias("is_leaf"),
        )

    def steps(self) -> DataFrame:
        """paths with the node before and after, null at the ends."""
        by = Window.partitionBy("pid").orderBy("depth")
        near = {f"parent_{c}": F.lag(c).over(by) for c in ("scale", "center")} | {f"next_{c}": F.lead(c).over(by) for c in ("scale", "center")}
        return self.paths.withColumns(near)

    def edges(self) -> DataFrame:
        """scale, center, child_scale, child_center, nested, n: one row a child, with its coverage."""
        went = self.steps().where("next_center is not null")
        return went.groupBy("scale", "center", F.col("next_scale").alias("child_scale"), F.col("next_center").alias("child_center")).agg(F.count("*").alias("n")).withColumn("nested", F.col("child_center") == F.col("center"))

    def final_address(self) -> DataFrame:
        """pid, scale, center, dist: the node where each point rests."""
        return self.steps().where("next_center is null").select("pid", "scale", "center", "dist")

    def singletons(self) -> DataFrame:
        return self.final_address().where("pid != center")

    def root(self) -> DataFrame:
        return self.nodes().where("parent_center is null")

    def layers(self) -> DataFrame:
        """scale, n_nodes, n_points."""
        return self.nodes().groupBy("scale").agg(F.count("*").alias("n_nodes"), F.sum("coverage_count").alias("n_points"))

    def scale_range(self) -> DataFrame:
        return self.paths.agg(F.min("scale").alias("bottom_scale"), F.max("scale").alias("top_scale"))

    def known_path(self, pids: DataFrame) -> DataFrame:
        """pid, depth, scale, center, dist of indexed points; a pid that is not in the tree gives one row
        with null depth."""
        return pids.select("pid").distinct().join(self.paths, "pid", "left")

    def centers(self) -> DataFrame:
        """scale, center, vec of every node."""
        where = self.points.select(F.col("pid").alias("center"), "vec")
        return self.paths.select("scale", "center").distinct().join(where, "center").select("scale", "center", "vec")

    def write(self, path: str) -> None:
        """Points, paths and parameters as a new version under one folder; paths are partitioned by
        scale, so a level is read alone. A version is named by one file, written last, so readers see
        the version before or this one, and never a mix."""
        spark, version = self.points.sparkSession, f"v{time.time_ns():020d}"
        self.points.write.parquet(f"{path}/{version}/points")
        self.paths.write.partitionBy("scale").parquet(f"{path}/{version}/paths")
        params = spark.createDataFrame([(version, *asdict(self.params).values())], ["version", *asdict(self.params)])
        params.coalesce(1).write.mode("append").json(f"{path}/published")

    @staticmethod
    def read(spark, path: str) -> CoverTree:
        """The version published last."""
        kinds = {f: type(v) for f, v in asdict(TreeParams()).items()}
        row = spark.read.json(f"{path}/published").orderBy(F.desc("version")).first()
        params = TreeParams(**{f: kind(row[f]) for f, kind in kinds.items()})
        paths = spark.read.parquet(f"{path}/{row.version}/paths").select("pid", "depth", "scale", "center", "dist")
        return CoverTree(params, spark.read.parquet(f"{path}/{row.version}/points"), paths)


def hash_order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pid")


def root_of(points: DataFrame, params: TreeParams) -> tuple[int, list[float], float]:
    """The last pid, its vector, and the distance of the farthest point."""
    top = points.orderBy(F.desc("pid")).limit(1).first()
    if top is None:
        raise ValueError("a tree needs a point")
    here = F.array(*[F.lit(float(x)) for x in top.vec])
    far = points.agg(F.max(metrics.COLUMNS[params.metric](F.col("vec"), here))).first()[0]
    return top.pid, [float(x) for x in top.vec], float(far)


def build(points: DataFrame, params: TreeParams | None = None) -> CoverTree:
    """points: pid (unique, not null) and vec (equally long, not null); other columns are kept along."""
    params = params or TreeParams()
    cloud = points.select(F.col("pid").cast("long").alias("pid"), metrics.doubles(F.col("vec")).alias("vec"), hash_order(params.rng_seed).alias("ord"))
    pid, vec, far = root_of(cloud, params)
    scale = math.ceil(math.log(far) / math.log(params.scale_base)) if far > 0 else params.min_res_index - 1
    dist = F.when(F.col("pid") == pid, 0.0).otherwise(metrics.COLUMNS[params.metric](F.col("vec"), F.array(*[F.lit(x) for x in vec])))
    front = cloud.withColumns({"scale": F.lit(scale), "center": F.lit(pid).cast("long"), "dist": dist})
    front = front.withColumn("path", F.array(F.struct("scale", "center", "dist")).cast(PATH))
    done = []
    while True:
        sizes = front.groupBy("scale", "center").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
        sizes = settled(sizes.where(F.col("n") > params.group_points), "large-sizes")
        front = with_facts(front, sizes, ["scale", "center"], "left")
        done.append(finished(front.where("n is null"), params))
        large = front.where("n is not null")
        leaf = (F.col("n") <= params.leaf_cutoff) | (F.col("scale") < params.min_res_index)
        done.append(large.where(leaf).select("pid", "path"))
        open_nodes = settled(large.where(~leaf), "large-nodes")
        if open_nodes.isEmpty():
            break
        front, rest = split_large(open_nodes, params)
        done.append(rest)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    paths = rows.select("pid", F.posexplode("path").alias("depth", "p")).select("pid", "depth", "p.scale", "p.center", "p.dist")
    return CoverTree(params, points, settled(paths, "paths"))


def finished(front: DataFrame, params: TreeParams) -> DataFrame:
    """pid, path of the points of nodes that a task can hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pids = rows["pid"].to_numpy()
        tree = Subtree(params, pids, np.array(rows["vec"].tolist(), np.float64), rows["ord"].to_numpy())
        center = int(np.flatnonzero(pids == rows["center"].iloc[0])[0])
        tree.grow(int(rows["scale"].iloc[0]), center, np.arange(len(pids)), rows["dist"].to_numpy(np.float64))
        above = [[(p["scale"], p["center"], p["dist"]) for p in path[:-1]] for path in rows["path"]]
        paths = [[dict(zip(("scale", "center", "dist"), p, strict=True)) for p in [*a, *b]] for a, b in zip(above, tree.paths, strict=True)]
        return pd.DataFrame({"pid": pids, "path": paths})

    columns = ["pid", "vec", "ord", "scale", "center", "dist", "path"]
    return front.select(*columns).groupBy("scale", "center").applyInPandas(run, f"pid long, path {PATH}")


def bounded(rows: DataFrame, numbers: int) -> DataFrame:
    """A settled table marked for broadcast if its rows, of so many numbers each, are few enough."""
    return F.broadcast(rows) if rows.count() * numbers <= BROADCAST_NUMBERS else rows


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (with pid) joined with a settled table of one line a key: sent out if it is small enough. Beyond,
    lines are copied and rows dealt out, as one key may have most of the rows."""
    if facts.count() * 4 <= BROADCAST_NUMBERS:
        return rows.join(F.broadcast(facts), keys, how)
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash("pid"), F.lit(COPIES))).join(copies, [*keys, "_salt"], how).drop("_salt")


def claimed(params: TreeParams, first: bool, pids: np.ndarray, rows: np.ndarray, reach: float, cids: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the place of its center among `centers`, which stand in hash order, and the distance: the
    first within reach, or else the nearest. -1 and infinity where there is none."""
    owner, best = np.full(len(pids), -1), np.full(len(pids), np.inf)
    for a in range(0, len(cids), LAST_BATCH):
        some = centers[a : a + LAST_BATCH]
        near, loose = metrics.pairwise(params.metric, some, rows), 2 * metrics.slack(some, rows)
        own = cids[a : a + LAST_BATCH, None] == pids[None, :]
        likely = own | ((near < reach + loose) & (owner < 0) if first else near <= np.minimum(near.min(axis=0), best) + loose)
        for i in np.flatnonzero(likely.any(axis=1)):
            spots = np.flatnonzero(likely[i])
            d = metrics.rows_to_point(params.metric, rows[spots], some[i])
            d[own[i, spots]] = 0.0
            takes = (owner[spots] < 0) & (d < reach) if first else d < best[spots]
            owner[spots[takes]], best[spots[takes]] = a + i, d[takes]
    return owner, best


def claims(state: DataFrame, drawn: DataFrame, params: TreeParams, first: bool, width: int) -> DataFrame:
    """state (pid, vec, scale, center, n, reach, ...) with cid and cdist: the drawn center of its node that has
    each point, or null. Centers (scale, center, n, cid, ord, cvec) are sent out if they are few enough, and no
    point moves. Beyond, each node's points are dealt into parts, which meet its centers block by block."""
    total = drawn.count()
    if total * (3 + width) <= BROADCAST_NUMBERS:
        sets: dict[tuple[int, int], list] = {}
        for r in drawn.orderBy("ord", "cid").collect():  # counted above
            sets.setdefault((r.scale, r.center), []).append((r.cid, r.cvec))
        held = {node: (np.array([c for c, _ in own], np.int64), np.array([v for _, v in own], np.float64)) for node, own in sets.items()}
        sent = state.sparkSession.sparkContext.broadcast(held)
        places, names = [state.columns.index(c) for c in ("pid", "vec", "scale", "center", "reach")], [*state.columns, "cid", "cdist"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, PART_POINTS):
                    batch = whole.slice(i, PART_POINTS)
                    pids, vecs, scale, center, reach = (batch.column(at) for at in places)
                    pids, scale, center, reach = (c.to_numpy(zero_copy_only=False) for c in (pids, scale, center, reach))
                    rows, cid, cdist = matrix(vecs), np.full(len(pids), -1, np.int64), np.full(len(pids), np.inf)
                    for node in set(zip(scale.tolist(), center.tolist(), strict=True)) & sent.value.keys():
                        here = np.flatnonzero((scale == node[0]) & (center == node[1]))
                        cids, cvecs = sent.value[node]
                        owner, best = claimed(params, first, pids[here], rows[here], float(reach[here[0]]), cids, cvecs)
                        cid[here], cdist[here] = np.where(owner < 0, -1, cids[owner]), best
                    none = ~np.isfinite(cdist)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, mask=none), pa.array(cdist, mask=none)], names=names)

        return state.mapInArrow(run, StructType([*state.schema.fields, StructField("cid", LongType()), StructField("cdist", DoubleType())]))

    most = drawn.groupBy("scale", "center").count().agg(F.max("count")).first()[0]
    blocks = -(-most * (3 + width) // BLOCK_NUMBERS)
    parts, keys = F.ceil(F.col("n") / PART_POINTS), ["scale", "center", "part", "block"]
    points = state.withColumns({"part": F.pmod(F.xxhash64("pid"), parts), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).select("pid", "vec", "reach", *keys)
    dealt = drawn.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "block": F.pmod(F.hash("cid"), F.lit(blocks))})

    def meet(here: pa.Table, centers: pa.Table) -> pa.Table:
        names = ["pid", "cdist", "ord", "cid"]
        if not here.num_rows or not centers.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64())], names)
        centers = centers.sort_by([("ord", "ascending"), ("cid", "ascending")])
        pids, cids, order = here.column("pid").to_numpy(), centers.column("cid").to_numpy(), centers.column("ord").to_numpy()
        rows, cvecs = (matrix(t.combine_chunks()) for t in (here.column("vec"), centers.column("cvec")))
        owner, best = claimed(params, first, pids, rows, float(here.column("reach")[0].as_py()), cids, cvecs)
        has = owner >= 0
        return pa.table([pids[has], best[has], order[owner[has]], cids[owner[has]]], names)

    found = points.groupBy(*keys).cogroup(dealt.select("cid", "ord", "cvec", *keys).groupBy(*keys)).applyInArrow(meet, "pid long, cdist double, ord long, cid long")
    choice = F.min(F.struct("ord", "cid", "cdist") if first else F.struct("cdist", "ord", "cid")).alias("c")
    return state.join(found.groupBy("pid").agg(choice).select("pid", "c.cid", "c.cdist"), "pid", "left").select(*state.columns, "cid", "cdist")


def net(metric: str, vecs: np.ndarray, reach: float) -> list[int]:
    """Rows that no picked row before is nearer to than reach. Rows are picked in blocks, and those of a block are
    held against all later rows at once; only pairs that rounding leaves open are measured one by one."""
    left, picked = np.arange(len(vecs)), []
    while len(left):
        block, left, fresh = left[:LAST_BATCH], left[LAST_BATCH:], []
        while len(block):
            fresh.append(int(block[0]))
            block = block[1:][~(metrics.rows_to_point(metric, vecs[block[1:]], vecs[block[0]]) < reach)]
        picked += fresh
        open_parts = [left[:0]]
        for i in range(0, len(left), PART_POINTS):
            part = left[i : i + PART_POINTS]
            near, loose = metrics.pairwise(metric, vecs[fresh], vecs[part]), 2 * metrics.slack(vecs[fresh], vecs[part])
            covered = (near < reach - loose).any(axis=0)
            unsure = (np.abs(near - reach) <= loose) & ~covered
            for a in np.flatnonzero(unsure.any(axis=1)):
                spots = np.flatnonzero(unsure[a])
                covered[spots] |= metrics.rows_to_point(metric, vecs[part[spots]], vecs[fresh[a]]) < reach
            open_parts.append(part[~covered])
        left = np.concatenate(open_parts)
    return picked


def drawn_centers(open_points: DataFrame, params: TreeParams, width: int) -> DataFrame:
    """scale, center, n, cid, ord, cvec: the centers of every large node. open_points: pid, vec, ord, scale,
    center, n, reach of the points that the node's own center leaves uncovered.

    In hash order a point is a center if no center before covers it. The first uncovered points of a node,
    whatever their number, tell its next centers by themselves. As the order is a hash, the points under a
    threshold are such a beginning: about `size` of them, with no sorting. Each round thins the beginnings,
    one task a node, and only points that are still uncovered are kept for the next."""

    def draw(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["ord", "pid"])
        vecs, reach = np.array(batch["vec"].tolist(), np.float64), float(batch["reach"].iloc[0])
        return batch.iloc[net(params.metric, vecs, reach)][["scale", "center", "n", "pid", "ord", "vec"]].rename(columns={"pid": "cid", "vec": "cvec"})

    columns, node = ["pid", "vec", "ord", "scale", "center", "n", "reach"], ["scale", "center"]
    uncovered, rounds = settled(open_points.select(*columns), "uncovered"), []
    size, most = FIRST_BATCH, max(LAST_BATCH, PREFIX_NUMBERS // width)
    while True:
        left = settled(uncovered.groupBy(*node).agg(F.count("*").alias("left"), F.min("ord").alias("least")), "left")
        if left.isEmpty():
            break
        share = F.least(F.lit(1.0), F.lit(float(size)) / F.col("left"))
        upto = F.col("least").cast("double") + (F.lit(2.0**63) - F.col("least").cast("double")) * share
        head = with_facts(uncovered, left, node).where((F.col("ord").cast("double") <= upto) | (F.col("ord") == F.col("least")))
        drawn = settled(head.select(*columns).groupBy(*node).applyInPandas(draw, "scale int, center long, n long, cid long, ord long, cvec array<double>"), "centers")
        rounds.append(drawn)
        before, uncovered = uncovered, settled(claims(uncovered, drawn, params, True, width).where("cid is null").select(*columns), "uncovered")
        forget(before, left)
        size = min(GROWTH * size, most)
    forget(uncovered, left)
    if not rounds:
        return settled(uncovered.limit(0).select("scale", "center", "n", F.col("pid").alias("cid"), "ord", F.col("vec").alias("cvec")), "centers")
    return reduce(DataFrame.unionByName, rounds)


def split_large(rows: DataFrame, params: TreeParams) -> tuple[DataFrame, DataFrame]:
    """The next level's rows, and (pid, path) of the points that rest here: centers first, then one pass in
    which every point finds the one it goes to. Vectors and paths are written once a level."""
    nearest, base = params.partition_type == "nearest", F.lit(params.scale_base)
    tight = F.when(F.col("radius") > 0, F.ceil(F.log(F.col("radius")) / math.log(params.scale_base)).cast("int")).otherwise(params.min_res_index)
    state = rows.withColumn("below", F.least(F.col("scale") - 1, F.greatest(tight, F.lit(params.min_res_index))))
    state = state.withColumn("reach", F.pow(base, F.col("below")))
    width = state.select(F.size("vec")).first()[0]
    drawn = drawn_centers(state.where(F.col("dist") >= F.col("reach")), params, width)
    state = settled(claims(state, drawn, params, not nearest, width), "split")

    nested = F.col("cid").isNull() | (F.col("dist") < (F.col("cdist") if nearest else F.col("reach")))
    state = state.withColumns({"child": F.when(nested, F.col("center")).otherwise(F.col("cid")), "child_dist": F.when(nested, F.col("dist")).otherwise(F.col("cdist"))})
    kids = state.groupBy("scale", "center", "child").agg(F.count("*").alias("size")).withColumn("own", F.col("child") == F.col("center"))
    kids = kids.withColumn("keep", F.col("own") | (F.col("size") > 1) | F.lit(not params.use_singletons))
    by = Window.partitionBy("scale", "center")
    only = (F.sum(F.col("keep").cast("int")).over(by) == 1) & (F.max(F.when(F.col("own"), F.col("size"))).over(by) == 1)
    kids = settled(kids.withColumn("keep", F.col("keep") & ~only).select("scale", "center", "child", "keep"), "kids")
    state = with_facts(state, kids, ["scale", "center", "child"])
    step = F.struct(F.col("below").alias("scale"), F.col("child").alias("center"), F.col("child_dist").alias("dist"))
    deeper = state.where("keep").select("pid", "vec", "ord", F.col("below").alias("scale"), F.col("child").alias("center"), F.col("child_dist").alias("dist"), F.concat("path", F.array(step)).cast(PATH).alias("path"))
    return settled(deeper, "front"), state.where(~F.col("keep")).select("pid", "path")


def close_siblings(tree: CoverTree) -> DataFrame:
    """scale, center, close: how many pairs of a node's children are nearer than their scale allows. Children
    are dealt into blocks, and each pair of blocks is counted in a task of its own, so neither pairs nor all
    children of a node are ever gathered."""
    params = tree.params
    vecs = tree.centers().select(F.col("scale").alias("child_scale"), F.col("center").alias("child_center"), metrics.doubles(F.col("vec")).alias("vec"))
    edges = tree.edges()
    blocks = settled(edges.groupBy("scale", "center").agg(F.ceil(F.count("*") / SIBLINGS).alias("blocks")), "sibling-blocks")
    kids = with_facts(edges.join(vecs, ["child_scale", "child_center"]).withColumn("pid", F.col("child_center")), blocks, ["scale", "center"])
    kids = kids.withColumns({"block": F.pmod(F.xxhash64("pid"), F.col("blocks")), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    kids = kids.select("scale", "center", "child_scale", "block", "vec", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def count(rows: pa.Table) -> pa.Table:
        vecs, block = matrix(rows.column("vec").combine_chunks()), rows.column("block").to_numpy()
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        scales = rows.column("child_scale").to_numpy()
        n = 0
        for i in np.flatnonzero(block == lo):
            later = np.flatnonzero(block == hi) if lo != hi else np.arange(i + 1, len(vecs))
            near = metrics.rows_to_point(params.metric, vecs[later], vecs[i]) if len(later) else np.zeros(0)
            n += int((near < params.scale_base ** float(scales[i])).sum())
        return pa.table([rows.column("scale")[:1], rows.column("center")[:1], pa.array([n], pa.int64())], ["scale", "center", "close"])

    return kids.groupBy("scale", "center", "lo", "hi").applyInArrow(count, "scale int, center long, close long")


def violations(tree: CoverTree) -> DataFrame:
    """invariant, n: how often each fails; 0 for a sound tree."""
    p, base = tree.params, tree.params.scale_base
    final, steps, nodes = tree.final_address(), tree.steps(), tree.nodes()
    total = tree.points.select(F.count("*").alias("n"))
    covering = steps.where((F.col("dist") >= F.pow(F.lit(base), F.col("scale"))) & F.col("parent_center").isNotNull())
    parents = nodes.select(F.col("scale").alias("parent_scale"), F.col("center").alias("parent_center"))
    checks = {
        "I1": final.groupBy("pid").count().where("count != 1"),
        "I2": final.select(F.count("*").alias("m")).join(total).where("m != n"),
        "I3": nodes.join(tree.edges().groupBy("scale", "center").agg(F.sum("n").alias("kids")), ["scale", "center"], "left").where(F.col("coverage_count") != F.coalesce("kids", F.lit(0)) + F.col("n_singletons") + F.when(F.col("kids").isNull(), 1).otherwise(0)),
        "I4": covering,
        "I5": steps.where("scale >= parent_scale"),
        "I6": nodes.where("parent_center is not null").join(parents, ["parent_scale", "parent_center"], "left_anti"),
        "I7": close_siblings(tree),
        "I8": nodes.where(F.lit(not p.use_singletons) & (F.col("n_singletons") > 0) & ~F.col("is_leaf")),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg((F.coalesce(F.sum("close"), F.lit(0)) if name == "I7" else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("invariant"), "n")
        out = one if out is None else out.unionByName(one)
    return out
