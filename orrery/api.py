"""One object for a cloud and its tree, with the questions a user asks of them.

Every answer is a DataFrame; nothing is run until it is asked for, save for the build itself.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import aggregates, drift, tree, walk
from orrery.operators.cells import knn_join
from orrery.operators.knn import knn as brute_knn
from orrery.operators.tree import CoverTree, TreeParams
from orrery.sources.points import from_yaml, tree_params_from_yaml


class PointIndex:
    """Set parameters, fit a cloud, then ask."""

    def __init__(self, params: TreeParams | None = None):
        self.params = params or TreeParams()
        self.tree: CoverTree | None = None
        self.own: dict[str, tuple[list[str], tuple[Column, ...]]] = {}

    def set(self, **changes) -> PointIndex:
        """scale_base, leaf_cutoff, min_res_index, use_singletons, partition_type, rng_seed, metric."""
        self.params = replace(self.params, **changes)
        return self

    def load_yaml(self, spark, path: str) -> PointIndex:
        return self.set(**tree_params_from_yaml(path)).fit(from_yaml(spark, path))

    def fit(self, points: DataFrame) -> PointIndex:
        self.tree = tree.build(points, self.params)
        return self

    @property
    def built(self) -> CoverTree:
        if self.tree is None:
            raise RuntimeError("fit a cloud first")
        return self.tree

    # Points and nodes

    def data_point(self, pid: int) -> DataFrame:
        return self.built.points.where(F.col("pid") == pid)

    def parameters(self) -> dict:
        p = self.built.params
        return {"scale_base": p.scale_base, "leaf_cutoff": p.leaf_cutoff, "min_res_index": p.min_res_index, "use_singletons": p.use_singletons, "partition_type": p.partition_type, "rng_seed": p.rng_seed}

    def layers(self) -> DataFrame:
        return self.built.layers().join(aggregates.layer_fractal_dims(self.built), "scale").withColumn("radius", F.pow(F.lit(self.built.params.scale_base), F.col("scale")))

    def layer(self, scale: int) -> DataFrame:
        return self.nodes().where(F.col("scale") == scale)

    def nodes(self) -> DataFrame:
        return self.built.nodes().join(aggregates.fractal_dims(self.built), aggregates.NODE)

    def node(self, scale: int, center: int) -> DataFrame:
        return self.nodes().where((F.col("scale") == scale) & (F.col("center") == center))

    def root(self) -> DataFrame:
        return self.nodes().where("parent_center is null")

    def children(self, scale: int, center: int) -> DataFrame:
        """The nested child last, with each child's share of the coverage."""
        here = self.built.edges().where((F.col("scale") == scale) & (F.col("center") == center))
        total = self.built.nodes().where((F.col("scale") == scale) & (F.col("center") == center)).select("coverage_count")
        return here.crossJoin(F.broadcast(total)).withColumn("prob", F.col("n") / F.col("coverage_count")).orderBy("nested", "child_center")

    def singletons(self, scale: int, center: int) -> DataFrame:
        return self.built.singletons().where((F.col("scale") == scale) & (F.col("center") == center)).join(self.built.points, "pid")

    def layer_children(self, scale: int) -> DataFrame:
        """The child nodes of every node on a layer."""
        return self.built.edges().where(F.col("scale") == scale)

    def layer_singletons(self, scale: int) -> DataFrame:
        return self.built.singletons().where(F.col("scale") == scale)

    def layer_points(self, scale: int) -> DataFrame:
        """The layer's centers, as points."""
        return self.built.centers().where(F.col("scale") == scale)

    def cover_gaussian(self, scale: int, center: int) -> DataFrame:
        """pos, n, mean, var over all points under a node."""
        return self.gaussians(True).where((F.col("scale") == scale) & (F.col("center") == center)).select("pos", "n", "mean", "var")

    def add_aggregate(self, name: str, columns: list[str], *aggregates_: Column) -> PointIndex:
        """Names aggregates of point columns, for every node."""
        self.own[name] = (columns, aggregates_)
        return self

    def aggregate(self, name: str) -> DataFrame:
        columns, own = self.own[name]
        return aggregates.node_aggregate(self.built, columns, *own)

    def label_summary(self) -> DataFrame:
        return aggregates.label_maps(self.built)

    def gaussians(self, recursive: bool = False) -> DataFrame:
        return aggregates.gaussians(self.built, recursive)

    # Queries: DataFrames of qid, vec

    def knn(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return walk.tree_knn(self.built, queries, k)

    def knn_join(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The same answers by pivots' cells, without the tree; for queries as many as the points."""
        return knn_join(self.built.points, queries, k, self.built.params.metric)

    def brute_knn(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return brute_knn(self.built.points, queries, k, self.built.params.metric)

    def routing_knn(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return walk.routing_knn(self.built, queries, k)

    def named_knn(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return walk.named(self.knn(queries, k), self.built.points)

    def path(self, queries: DataFrame) -> DataFrame:
        return walk.path(self.built, queries)

    def path_with_labels(self, queries: DataFrame) -> DataFrame:
        return walk.path_with_labels(self.built, self.path(queries))

    def known_path(self, pids: DataFrame) -> DataFrame:
        return self.built.known_path(pids)

    def point_depths(self, queries: DataFrame, tau: float = 1e-5) -> DataFrame:
        return aggregates.homogeneity_depth(self.built, self.path(queries), tau)

    def index_depths(self, tau: float = 1e-5) -> DataFrame:
        return aggregates.homogeneity_depth(self.built, self.built.paths.withColumnRenamed("pid", "qid"), tau)

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return aggregates.sample(self.built, n, seed)

    # Drift

    def tracker(self, window: int = 0) -> Tracker:
        return Tracker(self, window)

    def track(self, way: DataFrame, order: DataFrame, ticks: DataFrame, window: int = 0) -> DataFrame:
        """at and the statistics of a tracker of that window. way: paths of the queries; order: tick,
        qid; ticks: where to look (tick)."""
        return self.tracker(window).push(way, order).stats(ticks)

    def baseline(self, sequences: int = 8, length: int = 0, sample_rate: int = 100, seed: int = 0) -> DataFrame:
        steps = self.built.steps().select("pid", aggregates.node_key(), F.when(F.col("next_center").isNotNull(), F.concat_ws(":", "next_scale", "next_center")).alias("bucket"))
        return drift.baseline(self.built.points.sparkSession, aggregates.priors(self.built), steps, self.built.points.count(), sequences, length, sample_rate, seed)

    # Storage

    def save(self, path: str) -> None:
        self.built.write(path)

    @staticmethod
    def load(spark, path: str) -> PointIndex:
        index = PointIndex()
        index.tree = CoverTree.read(spark, path)
        index.params = index.tree.params
        return index


class Tracker:
    """A window over the paths pushed so far, held against the tree's priors. Each question names the
    ticks (tick) at which it is asked."""

    def __init__(self, index: PointIndex, window: int = 0):
        self.index, self.window = index, window
        self.seq: DataFrame | None = None

    def push(self, way: DataFrame, order: DataFrame) -> Tracker:
        """Adds paths (qid, depth, scale, center) at ticks (order: tick, qid)."""
        more = drift.sequence(way, order)
        self.seq = more if self.seq is None else self.seq.unionByName(more)
        return self

    def evidence(self, ticks: DataFrame) -> DataFrame:
        """at, node, bucket, n."""
        if self.seq is None:
            raise RuntimeError("push a path first")
        return drift.evidence(self.seq, ticks, self.window)

    def probabilities(self, ticks: DataFrame) -> DataFrame:
        return drift.probabilities(aggregates.priors(self.index.built), self.evidence(ticks))

    def node_kl(self, ticks: DataFrame) -> DataFrame:
        return drift.node_kl(aggregates.priors(self.index.built), self.evidence(ticks))

    def stats(self, ticks: DataFrame) -> DataFrame:
        if self.seq is None:
            raise RuntimeError("push a path first")
        return drift.tracked_stats(aggregates.priors(self.index.built), self.seq, ticks, self.window)

    def total_kl(self, ticks: DataFrame) -> DataFrame:
        """at, kl of the whole tree, over the nodes where queries rest."""
        nodes = self.index.built.nodes().select(aggregates.node_key(), F.col("n_singletons").alias("singletons"))
        return drift.terminal_kl(nodes, self.evidence(ticks))

    def normalised(self, ticks: DataFrame, base: DataFrame) -> DataFrame:
        """The statistics less their baseline's means, over its deviations."""
        return drift.normalised(self.stats(ticks), base)
