"""Queries over a cover tree: paths of unseen points, exact and routed nearest neighbours.

What a walk needs of a tree is laid out once (and kept with it): for neighbours the upper nodes as arrays and
every point with its cell, for paths the nodes in pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators import cells
from orrery.operators.knn import knn, layer_best, matrix
from orrery.operators.tree import CoverTree, bounded, hash_order
from orrery.sources.tables import settled

NODE = ["scale", "center"]
#: A page's nodes cover up to so many times as many points as its smallest ones.
PAGE_RATIO = 1000
#: Nodes with more than one in SHARE of all points are sent to every executor.
SHARE = 10_000
#: Neighbours up to which the layout of a tree serves.
LAID_FOR = 64
STEP = "qid long, vec array<double>, depth int, scale int, center long, dist double, page string, tier int, goes_on boolean"


def coverage(tree: CoverTree) -> DataFrame:
    return tree.paths.groupBy(*NODE).agg(F.count("*").alias("n"), F.max("dist").alias("radius"))


def laid_cells(tree: CoverTree, k: int = LAID_FOR, cell_points: int | None = None, centers_only: bool = False) -> tuple[cells.Routes, DataFrame, DataFrame]:
    """The tree as routes, members and sizes for cells.search. Upper nodes are those of more than cell_points
    points. A cell is the whole subtree of a smaller child of theirs, or what rests at one of them.
    cell_points grows until all of these fit what may be sent out; full cells are parted when they meet
    queries. With centers_only, the points are the node centers."""
    points, spark = tree.points.select("pid", "vec"), tree.points.sparkSession
    if centers_only:
        points = points.join(tree.paths.select(F.col("center").alias("pid")).distinct(), "pid", "left_semi")
    cloud = settled(cells.without_copies(points, k), "points")
    nodes, most = settled(coverage(tree), "coverage"), cells.ROUTE_NUMBERS // max(1, len(cloud.first().vec))
    size = cell_points or cells.CELL_POINTS
    while True:
        big = nodes.where(F.col("n") > size).select(*NODE, F.lit(True).alias("big"))
        while big.count() > most // 2:
            size *= 4
            big = nodes.where(F.col("n") > size).select(*NODE, F.lit(True).alias("big"))
        rows = tree.paths.join(F.broadcast(big), NODE, "left")
        place, upper = F.struct(*NODE, "dist"), F.when(F.col("big"), F.struct("depth", *NODE))
        ways = rows.groupBy("pid").agg(F.array_sort(F.collect_list(upper)).alias("above"), F.min_by(F.when(F.col("big").isNull(), place), F.when(F.col("big").isNull(), F.col("depth"))).alias("low"), F.max_by(place, "depth").alias("rest"))
        own = F.coalesce("low", "rest")
        members = cloud.join(ways, "pid").select("pid", "vec", F.xxhash64(F.col("low").isNull(), own["scale"], own["center"]).alias("cell"), own.alias("own"), F.transform("above", lambda n: F.struct(n["scale"], n["center"])).alias("above"))
        members = settled(members, "members")
        balls = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("own.dist").alias("radius"), F.first("own.center").alias("center"), F.first("above").alias("above"))
        balls = settled(balls, "balls")
        if balls.count() <= most:
            break
        size *= 4
    known, found, nodes_of = balls.collect(), {}, {}
    for b in known:
        for i, n in enumerate(b.above):
            key = (n.scale, n.center)
            found.setdefault(key, len(found) + 1)
            nodes_of[key] = [found.get((b.above[i - 1].scale, b.above[i - 1].center)) if i else 0, nodes_of.get(key, [0, 0])[1] + b.n]
    wide = {(r.scale, r.center): r.radius for r in nodes.join(F.broadcast(big), NODE, "left_semi").collect()}
    wanted = spark.createDataFrame([(c,) for c in {b.center for b in known} | {c for _, c in found}], "pid long")
    vecs = {r.pid: r.vec for r in tree.points.join(F.broadcast(wanted), "pid").select("pid", metrics.doubles(F.col("vec")).alias("vec")).collect()}
    entries = [(vecs[c], wide[s, c], n, under, found[s, c], -1) for (s, c), (under, n) in nodes_of.items()]
    entries += [(vecs[b.center], b.radius, b.n, found[b.above[-1].scale, b.above[-1].center] if b.above else 0, -1, b.cell) for b in known]
    vec, radius, n, under, into, cell = (np.array(x) for x in zip(*entries, strict=True))
    routes = cells.Routes(vec, radius, n, under, into, cell)
    return routes, members.select("pid", "vec", "cell"), cells.sizes_of(spark, routes)


def tree_knn(tree: CoverTree, queries: DataFrame, k: int, cell_points: int | None = None) -> DataFrame:
    """qid, rk, pid, dist: the exact k nearest points by branch and bound over the tree. Every batch of
    queries goes down the upper nodes, each bounding the k-th distance further; only cells in reach of a
    query's bound are opened, for that query."""
    if tree.params.metric == "cosine":
        return knn(tree.points, queries, k, "cosine")  # no triangle inequality to prune by
    own = tree.kept("cells", lambda: laid_cells(tree)) if k <= LAID_FOR and cell_points is None else laid_cells(tree, k, cell_points)
    return cells.search(own[0], own[1], queries, k, tree.params.metric)


def routing_knn(tree: CoverTree, queries: DataFrame, k: int) -> DataFrame:
    """qid, rk, pid, dist: the k nearest node centers, by the same search; singletons are never met, so
    the answer is approximate as to points."""
    if tree.params.metric == "cosine":
        return center_knn(tree, queries, k)
    own = tree.kept("centers", lambda: laid_cells(tree, centers_only=True)) if k <= LAID_FOR else laid_cells(tree, k, centers_only=True)
    return cells.search(own[0], own[1], queries, k, tree.params.metric)


def with_counts(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows of nodes with the node's n. Those of nodes with more than one in SHARE of all points, few on each
    level, meet it by broadcast, all others by a shuffle."""
    hot = F.col("n") > total // SHARE
    marked = rows.join(F.broadcast(nodes.where(hot).select(*NODE, F.col("n").alias("hn"))), NODE, "left")
    rest = marked.where("hn is null").drop("hn").join(nodes.where(~hot).select(*NODE, "n"), NODE)
    return marked.where("hn is not null").withColumnRenamed("hn", "n").unionByName(rest)


def laid_pages(tree: CoverTree) -> DataFrame:
    """tier, page, scale, center, child_scale, child_center, child_page, child_tier, nested, ord, cvec: the edges
    of the tree by pages. A node's tier follows from its coverage; a page is a node and what lies below
    it in the same tier, so a page's nodes on one level are PAGE_RATIO at most, and a path goes through as
    many pages as there are tiers."""
    nodes, total = settled(coverage(tree).select(*NODE, "n"), "coverage"), tree.points.count()
    centers = tree.paths.select(F.col("center").alias("pid")).distinct()
    rows = with_counts(settled(tree.paths.join(centers, "pid", "left_semi"), "center-paths"), nodes, total)
    tier = F.floor(F.log(F.lit(float(total)) / F.col("n")) / F.log(F.lit(float(PAGE_RATIO))) + 1e-9).cast("int")
    rows = rows.withColumn("tier", tier)
    top, way = Window.partitionBy("pid", "tier").orderBy("depth"), Window.partitionBy("pid").orderBy("depth")
    rows = rows.withColumn("page", F.first(F.concat_ws(":", *NODE)).over(top))
    rows = rows.withColumn("up", F.lag(F.struct(*NODE, "tier", "page")).over(way)).where("center = pid and up is not null")
    place = tree.points.select(F.col("pid").alias("child_center"), hash_order(tree.params.rng_seed).alias("ord"), metrics.doubles(F.col("vec")).alias("cvec"))
    kids = rows.select("up.tier", F.col("up.page").alias("page"), "up.scale", "up.center", F.col("scale").alias("child_scale"), F.col("center").alias("child_center"), F.col("page").alias("child_page"), F.col("tier").alias("child_tier"), (F.col("center") == F.col("up.center")).alias("nested"))
    return settled(kids.join(place, "child_center"), "pages")


def path(tree: CoverTree, queries: DataFrame) -> DataFrame:
    """qid, depth, scale, center, dist: the nodes that each query (qid, vec) would fall under. It
    starts at the root without a test and steps to a child that covers it (strictly) until none does:
    the nearest child (the nested one only if strictly nearer), or the first in the order of creation
    with the nested one ahead. Queries are dealt to pages of the tree and walk there on arrays; those that
    leave a page at its lower edge go on in the next tier's. A page that many ask is sent to many tasks."""
    params, measure = tree.params, metrics.COLUMNS[tree.params.metric]
    pages = tree.kept("pages", lambda: laid_pages(tree))
    top = tree.paths.where("depth = 0").select(*NODE).limit(1).join(tree.points.select(F.col("pid").alias("center"), F.col("vec").alias("cvec")), "center")
    at = queries.select(F.col("qid").cast("long").alias("qid"), metrics.doubles(F.col("vec")).alias("vec")).where("vec is not null").crossJoin(F.broadcast(top))  # one row
    at = settled(at.select("qid", "vec", F.lit(0).alias("depth"), *NODE, measure(F.col("vec"), F.col("cvec")).alias("dist"), F.concat_ws(":", *NODE).alias("page"), F.lit(0).alias("tier")), "walk")

    def walk(asked: pa.Table, edges: pa.Table) -> pa.Table:
        return pages_walked(asked, edges, params)

    out, tiers = at.drop("vec", "page", "tier"), pages.agg(F.max("tier")).first()[0]
    for tier in range(0 if tiers is None else tiers + 1):
        here, later = at.where(F.col("tier") == tier), at.where(F.col("tier") > tier)
        busy = here.groupBy("page").agg(F.ceil(F.count("*") / cells.QUERY_BLOCK).alias("blocks")).where("blocks > 1")
        busy = bounded(settled(busy, "busy-pages"), 2)

        def blocks(rows: DataFrame, busy: DataFrame = busy) -> DataFrame:
            return rows.join(busy, "page", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))

        q = blocks(here).select("qid", "vec", "depth", *NODE, "page", F.pmod(F.xxhash64("qid"), F.col("blocks")).alias("block"))
        e = blocks(pages.where(F.col("tier") == tier)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        e = e.select("page", "block", *NODE, "child_scale", "child_center", "child_page", "child_tier", "nested", "ord", "cvec")
        stepped = settled(q.groupBy("page", "block").cogroup(e.groupBy("page", "block")).applyInArrow(walk, STEP), "walk")
        out = out.unionByName(stepped.select(*out.columns))
        at = stepped.where("goes_on").drop("goes_on").unionByName(later)
    return out.select("qid", "depth", *NODE, "dist")


def pages_walked(asked: pa.Table, edges: pa.Table, params) -> pa.Table:
    """STEP rows of the queries of one page, walked along its edges."""
    kids: dict[tuple[int, int], list[int]] = {}
    for i, node in enumerate(zip(edges.column("scale").to_pylist(), edges.column("center").to_pylist(), strict=True)):
        kids.setdefault(node, []).append(i)
    page = asked.column("page")[0].as_py() if asked.num_rows else None
    vecs = matrix(asked.column("vec").combine_chunks()) if asked.num_rows else np.zeros((0, 0))
    cvecs = matrix(edges.column("cvec").combine_chunks()) if edges.num_rows else np.zeros((0, 0))
    scale, center, order, nested = (edges.column(c).to_numpy() for c in ("child_scale", "child_center", "ord", "nested"))
    to, tier_of = edges.column("child_page").to_pylist(), edges.column("child_tier").to_numpy()
    steps: list[tuple[np.ndarray, ...]] = []
    depth = asked.column("depth").to_numpy().copy()
    level: dict[tuple[int, int], np.ndarray] = {}
    if asked.num_rows:
        nodes = list(zip(asked.column("scale").to_pylist(), asked.column("center").to_pylist(), strict=True))
        level = {n: np.array([i for i, x in enumerate(nodes) if x == n]) for n in set(nodes)}
    while level:
        deeper: dict[tuple[int, int], list[np.ndarray]] = {}
        for node, at in level.items():
            own = kids.get(node)
            if own is None:
                continue
            # The order of choice: the first of the least, so ties are settled by it.
            first = nested[own] if params.partition_type == "nearest" else ~nested[own]
            own = np.array(own)[np.lexsort((center[own], scale[own], order[own], first))]
            reach = params.scale_base ** scale[own].astype(np.float64)
            for part in np.array_split(at, -(-len(at) // 512)):
                d = np.stack([metrics.rows_to_point(params.metric, vecs[part], c) for c in cvecs[own]])
                best = d.argmin(axis=0) if params.partition_type == "nearest" else (d < reach[:, None]).argmax(axis=0)
                far = d[best, np.arange(len(part))]
                goes = far < reach[best]
                who, child = part[goes], own[best[goes]]
                depth[who] += 1
                steps.append((who, depth[who].copy(), child, far[goes]))
                for c in np.unique(child):
                    if to[c] == page:
                        deeper.setdefault((int(scale[c]), int(center[c])), []).append(who[child == c])
        level = {n: np.concatenate(parts) for n, parts in deeper.items()}
    who, depths, child, far = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 4
    pages = [to[c] for c in child]
    on = np.array([p != page for p in pages], bool)
    carried = asked.column("vec").combine_chunks().take(pa.array(np.where(on, who, 0), mask=~on)) if len(who) else pa.array([], pa.list_(pa.float64()))
    columns = [asked.column("qid").combine_chunks().take(pa.array(who)) if len(who) else pa.array([], pa.int64()), carried, pa.array(depths.astype(np.int32)), pa.array(scale[child].astype(np.int32)), pa.array(center[child].astype(np.int64)), pa.array(far.astype(np.float64)), pa.array(pages, pa.string()), pa.array(tier_of[child].astype(np.int32)), pa.array(on)]
    return pa.table(columns, [c.split()[0] for c in STEP.split(", ")])


def center_knn(tree: CoverTree, queries: DataFrame, k: int) -> DataFrame:
    """The exact k nearest among all node centers."""
    return knn(tree.centers().select(F.col("center").alias("pid"), "vec").dropDuplicates(["pid"]), queries, k, tree.params.metric)


def layer_knn(tree: CoverTree, queries: DataFrame, k: int) -> DataFrame:
    """qid, scale, rk, center, dist: the k nearest nodes on each layer."""
    nodes = tree.centers().select(F.col("center").alias("pid"), F.col("scale").alias("layer"), "vec")
    found = layer_best(nodes, queries, k, tree.params.metric)
    return found.select("qid", F.col("layer").cast("int").alias("scale"), "rk", F.col("pid").alias("center"), "dist")


def node_knn(tree: CoverTree, queries: DataFrame, scale: int, center: int, k: int) -> DataFrame:
    """qid, rk, pid, dist among one node's own child centers and singletons."""
    here = (F.col("scale") == scale) & (F.col("center") == center)
    pids = tree.edges().where(here).select(F.col("child_center").alias("pid")).unionByName(tree.singletons().where(here).select("pid")).distinct()
    return knn(pids.join(tree.points, "pid").select("pid", "vec"), queries, k, tree.params.metric)


def named(found: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `name` of each pid (names: pid, name)."""
    return found.join(names.select("pid", "name"), "pid", "left")


def path_with_labels(tree: CoverTree, way: DataFrame, label: str = "label") -> DataFrame:
    """A path's rows with the label histogram of each node."""
    from orrery.operators.aggregates import label_maps

    return way.join(label_maps(tree, label), ["scale", "center"], "left")
