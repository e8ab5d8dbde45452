"""Queries on vectors: neighbours, pivots, roots."""

from __future__ import annotations

import math
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators.cells import knn_join
from orrery.operators.knn import assign, first_cover, knn, layer_best, within
from orrery.operators.sparse import sparse_assign, sparse_knn
from orrery.operators.tree import CoverTree, TreeParams, build, root_of
from orrery.operators.walk import center_knn, tree_knn
from orrery.sources.raw import read_raw, write_raw
from orrery.sources.tables import shared_dir

#: The stated query set: every vector whose id divides by it.
EVERY = 20
PIVOTS = 8
METRICS = ("l2", "l1", "l1_sqrt", "linf", "cosine")

# Distances in SQL, over DOUBLE[] a and b.
SQL_DISTANCE = {
    "l2": "list_distance({a}, {b})",
    "l1": "list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    "l1_sqrt": "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2]))))",
    "linf": "list_max(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) / greatest(sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x))), 1e-5)",
}
SQL_POINTS = "p AS (SELECT vec_id pid, CAST(embedding AS DOUBLE[]) v, label FROM embeddings)"
#: Sparse clouds keep the components of more than this size.
SPARSE_OVER = 0.2
SQL_SPARSE = f"p AS (SELECT vec_id pid, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) > {SPARSE_OVER} THEN x ELSE 0.0 END) v, label FROM embeddings)"
SQL_QUERIES = f"q AS (SELECT pid qid, v FROM p WHERE pid % {EVERY} = 0)"


def sql_distance(name: str, a: str = "q.v", b: str = "p.v") -> str:
    return SQL_DISTANCE[name].format(a=a, b=b)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec"), "label")


def asked(cloud: DataFrame) -> DataFrame:
    return cloud.where(F.col("pid") % EVERY == 0).select(F.col("pid").alias("qid"), "vec")


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("rk").cast("long").alias("rk"), F.col("pid").alias("nid"), F.round("dist", 6).alias("dist"))


@cache
def _knn_query(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cloud = points(spark, sf_dir)
        return shown(knn(cloud, asked(cloud), 5, metric))

    return query


def knn_sql(metric: str, k: int = 5) -> str:
    return (
        f"WITH {SQL_POINTS}, {SQL_QUERIES}, d AS (SELECT qid, pid, {sql_distance(metric)} dist FROM q, p), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) rk FROM d) "
        f"SELECT qid, rk, pid nid, round(dist, 6) dist FROM r WHERE rk <= {k}"
    )


def tree_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return shown(tree_knn(tree_of(spark, sf_dir), asked(cloud), 5))


#: Trees by application, folder, state of its files and parameters: each is built once, and lies in the
#: shared folder.
BUILT: dict[tuple, CoverTree] = {}


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Newest time, number and bytes of the table's files: changed input gives another tree."""
    files = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return tuple(files.agg(F.max("file_modification_time").cast("string"), F.count("*"), F.sum("file_size")).first())


def tree_of(spark: SparkSession, sf_dir: str, **more) -> CoverTree:
    key = (spark.sparkContext.applicationId, sf_dir, *state_of(spark, sf_dir), *sorted(more.items()))
    if key not in BUILT:
        BUILT[key] = build(points(spark, sf_dir), TreeParams(**({"scale_base": 1.3} | more)))
    return BUILT[key]


def knn_join_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point's four nearest, itself the first: the queries are the whole table."""
    cloud = points(spark, sf_dir)
    return shown(knn_join(cloud, cloud.select(F.col("pid").alias("qid"), "vec"), 4))


def center_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest centers among all nodes of the built tree."""
    return shown(center_knn(tree_of(spark, sf_dir), asked(points(spark, sf_dir)), 3))


def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return within(cloud, asked(cloud), 1.1).select("qid", F.col("pid").alias("nid"), F.round("dist", 6).alias("dist"))


def pairwise_min_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    others = knn(cloud, asked(cloud), 2).where("qid != pid")
    best = others.groupBy("qid").agg(F.min(F.struct("dist", "pid")).alias("b"))
    return best.select("qid", F.col("b.pid").alias("nid"), F.round("b.dist", 6).alias("dist"))


def adjacency_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 closest pairs of a query and another point; a top-k report."""
    cloud = points(spark, sf_dir)
    order = [F.col("dist"), F.col("qid"), F.col("pid")]
    near = knn(cloud, asked(cloud), 101).where("qid != pid").orderBy(*order).limit(100)
    return near.select("qid", F.col("pid").alias("nid"), F.round("dist", 6).alias("dist"))


def root_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    pid, _, far = root_of(cloud.select("pid", metrics.doubles(F.col("vec")).alias("vec")), TreeParams())
    n = cloud.agg(F.count("*").alias("n"))
    return n.select(F.lit(pid).cast("long").alias("center"), F.lit(round(far, 6)).alias("radius"), F.lit(math.ceil(math.log2(far))).cast("long").alias("scale"), "n")


def pivots(cloud: DataFrame, n: int = PIVOTS) -> DataFrame:
    return cloud.where(F.col("pid") < n).select(F.col("pid").alias("cid"), "vec", F.col("pid").alias("ord"))


def sql_assigned(n: int = PIVOTS, name: str = "a") -> str:
    """pid, center, dist, label of the nearest pivot."""
    return (
        f"{name} AS (SELECT p.pid, p.label, p.v, arg_min(c.pid, (list_distance(c.v, p.v), c.pid)) center, min(list_distance(c.v, p.v)) dist "
        f"FROM p, (SELECT pid, v FROM p WHERE pid < {n}) c GROUP BY p.pid, p.label, p.v)"
    )


def assigned(cloud: DataFrame, n: int = PIVOTS) -> DataFrame:
    """pid, center, dist, and the point's columns."""
    return assign(cloud, pivots(cloud, n)).join(cloud, "pid")


def pivot_assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return assign(cloud, pivots(cloud)).select("pid", "center", F.round("dist", 6).alias("dist"))


def pivot_assign_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return first_cover(cloud, pivots(cloud), 1.4).select("pid", "center", F.round("dist", 6).alias("dist"))


def center_knn_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return shown(knn(pivots(cloud, 40).select(F.col("cid").alias("pid"), "vec"), asked(cloud), 3))


def layer_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of pivots, even and odd; the two nearest of each."""
    cloud = points(spark, sf_dir)
    layered = pivots(cloud, 40).select(F.col("cid").alias("pid"), (F.col("cid") % 2).alias("layer"), "vec")
    found = layer_best(layered, asked(cloud), 2)
    return found.select("qid", "layer", F.col("rk").cast("long").alias("rk"), F.col("pid").alias("nid"), F.round("dist", 6).alias("dist"))


def sparse_points(cloud: DataFrame) -> DataFrame:
    """pid, idx, val: the entries above SPARSE_OVER in size."""
    x = metrics.doubles(F.col("vec"))
    places = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: F.abs(e["v"]) > SPARSE_OVER)
    return cloud.where("vec is not null").select("pid", places.alias("e")).select("pid", F.col("e.i").alias("idx"), F.col("e.v").alias("val"))


@cache
def _sparse_query(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cloud = sparse_points(points(spark, sf_dir))
        return shown(sparse_knn(cloud, cloud.where(F.col("pid") % EVERY == 0).withColumnRenamed("pid", "qid"), 5, metric))

    return query


def sparse_assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = sparse_points(points(spark, sf_dir))
    return sparse_assign(cloud, cloud.where(F.col("pid") < PIVOTS).withColumnRenamed("pid", "cid")).select("pid", "center", F.round("dist", 6).alias("dist"))


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as raw files and read again: pid is now the place in the order of ids."""
    cloud = points(spark, sf_dir).where("vec is not null")
    where = f"{shared_dir(spark)}/orrery/raw-{uuid.uuid4().hex}"
    dim = cloud.select(F.size("vec")).first()
    write_raw(cloud, where, dim[0] if dim else 1)
    x = metrics.doubles(F.col("vec"))
    return read_raw(spark, where, dim[0] if dim else 1).select("pid", F.size("vec").cast("long").alias("dim"), x[0].alias("first_x"), F.round(metrics.sq_norm(x), 6).alias("sq_norm"))


QUERIES = {f"sparse_knn_{m}": _sparse_query(m) for m in metrics.SPARSE} | {f"knn_{m}": _knn_query(m) for m in METRICS} | {
    f.__name__: f
    for f in (tree_knn_l2, knn_join_l2, center_knn_l2, range_query, pairwise_min_distance, adjacency_topn, root_stats, pivot_assign_nearest, pivot_assign_first, center_knn_pivots, layer_topk, sparse_assign_nearest, raw_round_trip)
}

SQL = {f"knn_{m}": knn_sql(m) for m in METRICS} | {f"sparse_knn_{m}": knn_sql(m).replace(SQL_POINTS, SQL_SPARSE) for m in metrics.SPARSE} | {
    "sparse_assign_nearest": f"WITH {SQL_SPARSE}, {sql_assigned()} SELECT pid, center, round(dist, 6) dist FROM a",
    "raw_round_trip": f"WITH {SQL_POINTS} SELECT row_number() OVER (ORDER BY pid) - 1 pid, len(v) dim, v[1] first_x, round(list_sum(list_transform(v, lambda x: x * x)), 6) sq_norm FROM p WHERE v IS NOT NULL",
    "tree_knn_l2": knn_sql("l2"),
    "knn_join_l2": knn_sql("l2", 4).replace(SQL_QUERIES, "q AS (SELECT pid qid, v FROM p)"),
    "range_query": f"WITH {SQL_POINTS}, {SQL_QUERIES} SELECT qid, pid nid, round({sql_distance('l2')}, 6) dist FROM q, p WHERE {sql_distance('l2')} < 1.1",
    "pairwise_min_distance": f"WITH {SQL_POINTS}, {SQL_QUERIES}, d AS (SELECT qid, pid, {sql_distance('l2')} dist FROM q, p WHERE qid != pid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) rk FROM d) SELECT qid, pid nid, round(dist, 6) dist FROM r WHERE rk = 1",
    "adjacency_topn": f"WITH {SQL_POINTS}, {SQL_QUERIES}, d AS (SELECT qid, pid, {sql_distance('l2')} dist FROM q, p WHERE qid != pid) SELECT qid, pid nid, round(dist, 6) dist FROM (SELECT * FROM d ORDER BY dist, qid, pid LIMIT 100)",
    "root_stats": f"WITH {SQL_POINTS}, c AS (SELECT pid, v FROM p ORDER BY pid DESC LIMIT 1), m AS (SELECT c.pid center, max(list_distance(c.v, p.v)) far, count(*) n FROM c, p GROUP BY c.pid) SELECT center, round(far, 6) radius, CAST(ceil(log2(far)) AS BIGINT) AS scale, n FROM m",
    "pivot_assign_nearest": f"WITH {SQL_POINTS}, {sql_assigned()} SELECT pid, center, round(dist, 6) dist FROM a",
    "pivot_assign_first": f"WITH {SQL_POINTS}, d AS (SELECT p.pid, c.pid cid, list_distance(c.v, p.v) dist FROM p, (SELECT pid, v FROM p WHERE pid < {PIVOTS}) c), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY cid) k FROM d WHERE dist < 1.4) SELECT pid, cid center, round(dist, 6) dist FROM r WHERE k = 1",
    "center_knn_pivots": f"WITH {SQL_POINTS}, {SQL_QUERIES}, d AS (SELECT qid, pid, list_distance(q.v, p.v) dist FROM q, p WHERE pid < 40), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) rk FROM d) SELECT qid, rk, pid nid, round(dist, 6) dist FROM r WHERE rk <= 3",
    "layer_topk": f"WITH {SQL_POINTS}, {SQL_QUERIES}, d AS (SELECT qid, pid, pid % 2 layer, list_distance(q.v, p.v) dist FROM q, p WHERE pid < 40), r AS (SELECT *, row_number() OVER (PARTITION BY qid, layer ORDER BY dist, pid) rk FROM d) SELECT qid, layer, rk, pid nid, round(dist, 6) dist FROM r WHERE rk <= 2",
}
