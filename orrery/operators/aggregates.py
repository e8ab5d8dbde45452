"""Aggregates of cover-tree nodes: groupings of the path table joined with the points.

Everything is a partial sum before it is shuffled. `node_aggregate` takes any column expressions, which
is how users add their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.distributions import gaussian_mean_var, gaussian_moments
from orrery.operators.tree import CoverTree
from orrery.sources.points import ranked

NODE = ["scale", "center"]


def covered(tree: CoverTree, *columns: str) -> DataFrame:
    """scale, center and the named point columns, for every point under every node."""
    return tree.paths.select("pid", *NODE).join(tree.points.select("pid", *columns), "pid")


def node_aggregate(tree: CoverTree, columns: list[str], *aggregates: Column) -> DataFrame:
    return covered(tree, *columns).groupBy(*NODE).agg(*aggregates)


def summary_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., n, nones: rows with a value and without."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("nones"))


def category_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., value, n: the histogram of a column without its nulls."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def moment_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., n, m1, m2 of a numeric column."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(x).alias("m1"), F.sum(x * x).alias("m2"))


def label_summary(tree: CoverTree, label: str = "label") -> DataFrame:
    return category_summary(covered(tree, label), NODE, label)


def label_maps(tree: CoverTree, label: str = "label") -> DataFrame:
    """scale, center, labels (map of counts), nones. A map has an entry a class."""
    counts = covered(tree, label).groupBy(*NODE, label).agg(F.count("*").alias("n"))
    entry = F.when(F.col(label).isNotNull(), F.struct(F.col(label), F.col("n")))
    return counts.groupBy(*NODE).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"), F.coalesce(F.sum(F.when(F.col(label).isNull(), F.col("n"))), F.lit(0)).alias("nones"))


def gaussians(tree: CoverTree, recursive: bool = True) -> DataFrame:
    """scale, center, pos, n, m1, m2, mean, var: over all points under a node, or over those that rest
    there."""
    where = tree.paths.select("pid", *NODE) if recursive else tree.final_address().select("pid", *NODE)
    return gaussian_mean_var(gaussian_moments(where.join(tree.points.select("pid", "vec"), "pid"), NODE))


def child_counts(tree: CoverTree) -> DataFrame:
    """scale, center, bucket (the child's scale:center; null for points that rest here), n: the
    categorical over children, and the Dirichlet's parameters."""
    bucket = F.when(F.col("next_center").isNotNull(), F.concat_ws(":", "next_scale", "next_center")).alias("bucket")
    return tree.steps().groupBy(*NODE, bucket).agg(F.count("*").alias("n"))


def node_key() -> Column:
    return F.concat_ws(":", "scale", "center").alias("node")


def priors(tree: CoverTree) -> DataFrame:
    """child_counts in the form of the distribution functions: node, bucket, n."""
    return child_counts(tree).select(node_key(), "bucket", "n")


def coverage_indexes(tree: CoverTree, below: int) -> DataFrame:
    """scale, center, pids of the nodes that cover fewer than `below` points; so no list is longer."""
    small = tree.paths.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") < below).select(*NODE)
    return tree.paths.join(small, NODE).groupBy(*NODE).agg(F.array_sort(F.collect_list("pid")).alias("pids"))


def fractal_dims(tree: CoverTree) -> DataFrame:
    """scale, center, fractal_dim, weighted_fractal_dim: log_base of the number of parts a node splits
    into (children, the nested one too, and singletons); weighted, each part counts by its coverage
    relative to the largest child."""
    kids = tree.edges().groupBy(*NODE).agg(F.count("*").alias("kids"), F.sum("n").alias("under"), F.max("n").alias("most"))
    nodes = tree.nodes().join(kids, NODE, "left").na.fill(0, ["kids", "under"])
    single, most = F.col("n_singletons"), F.greatest(F.coalesce("most", F.lit(1)), F.lit(1))

    def log(x: Column) -> Column:
        return F.when(x > 0, F.log(x) / F.log(F.lit(tree.params.scale_base))).otherwise(0.0)

    return nodes.select(*NODE, log((single + F.col("kids")).cast("double")).alias("fractal_dim"), log((F.col("under") + single) / most).alias("weighted_fractal_dim"))


def layer_fractal_dims(tree: CoverTree) -> DataFrame:
    """scale, fractal_dim, weighted_fractal_dim of each layer: parts over nodes, plainly, and with both
    weighted by coverage relative to the largest of the layer."""
    kids = tree.edges().groupBy(*NODE).agg(F.count("*").alias("kids"), F.sum("n").alias("under"), F.max("n").alias("most"))
    nodes = tree.nodes().join(kids, NODE, "left").na.fill(0, ["kids", "under"])
    sums = nodes.groupBy("scale").agg(
        F.sum(F.col("kids") + F.col("n_singletons")).alias("parts"), F.count("*").alias("nodes"), F.max("coverage_count").alias("top"), F.sum("coverage_count").alias("mass"),
        F.greatest(F.coalesce(F.max("most"), F.lit(1)), F.lit(1)).alias("most"), F.sum(F.col("under") + F.col("n_singletons")).alias("below"),
    )

    def log(x: Column) -> Column:
        return F.log(F.greatest(x, F.lit(1e-300))) / F.log(F.lit(tree.params.scale_base))

    plain = F.when(F.col("parts") > 0, log(F.col("parts").cast("double")) - log(F.col("nodes").cast("double"))).otherwise(0.0)
    weighted = F.when(F.col("below") > 0, log(F.col("below") / F.col("most")) - log(F.col("mass") / F.col("top"))).otherwise(0.0)
    return sums.select("scale", plain.alias("fractal_dim"), weighted.alias("weighted_fractal_dim"))


def homogeneity_depth(tree: CoverTree, way: DataFrame, tau: float = 1e-5, label: str = "label") -> DataFrame:
    """qid, path_len, depth: where along each path the labels under the node become one, or all but a
    share of tau; the path's length if they never do."""
    counts = label_summary(tree, label).groupBy(*NODE).agg(F.count("*").alias("kinds"), F.max("n").alias("top"), F.sum("n").alias("all"))
    rows = way.join(counts, NODE, "left")
    pure = (F.col("kinds") == 1) | (1 - F.col("top") / F.col("all") < tau)
    found = rows.groupBy("qid").agg(F.count("*").alias("path_len"), F.min(F.when(pure, F.col("depth"))).alias("first"))
    return found.select("qid", "path_len", F.coalesce("first", "path_len").cast("long").alias("depth"))


def sample(tree: CoverTree, n: int, seed: int = 0, label: str = "label") -> DataFrame:
    """draw, scale, center, vec, labels: descends from the root by the children's shares until a draw
    rests, then draws each component from the resting points' Gaussian (standard deviation 0 where
    there is one point)."""
    spark = tree.points.sparkSession
    # A point drawn at random rests where a descent by coverage shares does.
    final = ranked(tree.final_address().select("pid", *NODE), ["pid"], "at").select(*NODE, "at")
    total = tree.points.count()
    draws = spark.range(n).select(F.col("id").alias("draw"), (F.floor(F.rand(seed) * total) + 1).cast("long").alias("at"))
    placed = draws.join(final, "at").select("draw", *NODE)
    each = placed.join(gaussians(tree, recursive=False), NODE)
    noise = F.sqrt(F.greatest("var", F.lit(0.0))) * F.randn(seed + 1)
    parts = each.select("draw", *NODE, F.struct("pos", (F.col("mean") + noise).alias("x")).alias("part"))
    vecs = parts.groupBy("draw", *NODE).agg(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"]).alias("vec"))
    return vecs.join(label_maps(tree, label), NODE, "left")
