"""Queries on trackers, baselines and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import aggregates, drift, plugins, walk
from orrery.operators.tree import CoverTree, TreeParams, violations
from orrery.plans.summaries import six, table
from orrery.plans.vectors import SQL_POINTS, asked, assigned, points, shown, sql_assigned, tree_of
from orrery.sources.points import glue, ranked, reindexed, source_address, with_labels, with_names

WINDOW, EACH, LONG_WINDOW = 100, 500, 5000


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tick, node, bucket: events in order of time, as one-step paths of seven nodes."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", (F.col("user_id") % 7).cast("string").alias("node"), F.col("event_type").alias("bucket"))
    return ranked(events, ["ts", "event_id"], "tick").select("tick", "node", "bucket")


def ticks(seq: DataFrame) -> DataFrame:
    return seq.where(F.col("tick") % EACH == 0).select("tick")


def event_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).cast("string").alias("node"), F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))


def tracker_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = event_sequence(spark, sf_dir)
    return drift.evidence(seq, ticks(seq), WINDOW).select("at", "node", "bucket", "n")


def tracker_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a window, at every tenth asked tick."""
    seq = event_sequence(spark, sf_dir)
    return drift.evidence(seq, seq.where(F.col("tick") % (10 * EACH) == 0).select("tick"), 0).select("at", "node", "bucket", "n")


def _node_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = event_sequence(spark, sf_dir)
    prior = event_prior(spark, sf_dir)
    return drift.node_kl(prior, drift.evidence(seq, ticks(seq), WINDOW))


def tracker_node_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_kl(spark, sf_dir).select("at", "node", "evidence", *six("kl"))


def tracker_kl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = event_sequence(spark, sf_dir)
    stats = drift.tracked_stats(event_prior(spark, sf_dir), seq, ticks(seq), WINDOW)
    return stats.select("at", "nz_count", *six("max", "min", "moment1_nz", "moment2_nz"))


def tracker_every_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics after every single event, of a window of 5,000 events."""
    seq = event_sequence(spark, sf_dir)
    stats = drift.tracked_stats(event_prior(spark, sf_dir), seq, seq.select("tick"), LONG_WINDOW)
    return stats.select("at", "nz_count", *six("max", "min", "moment1_nz", "moment2_nz"))


def tracker_kl_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event rests at its (node, type); the prior has one more than the counts."""
    seq = event_sequence(spark, sf_dir).select("tick", F.concat_ws("/", "node", "bucket").alias("node"), F.lit(None).cast("string").alias("bucket"))
    prior = event_prior(spark, sf_dir).select(F.concat_ws("/", "node", "bucket").alias("node"), F.col("n").alias("singletons"))
    return drift.terminal_kl(prior, drift.evidence(seq, ticks(seq), WINDOW)).select("at", *six("kl"))


def baseline_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values sampled at every thousandth event, read at every 250th and beyond."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), "value")
    samples = events.where((F.col("at") % 1000 == 0) & (F.col("at") > 0))
    read = events.where((F.col("at") % 250 == 0) & (F.col("at") > 0)).select(F.col("at").alias("tick")).unionByName(events.agg((F.max("at") + 500).alias("tick")))
    return drift.interpolate(samples, read, ["value"]).select("tick", *six("value"))


def pivot_tree(spark: SparkSession, sf_dir: str) -> CoverTree:
    """A tree of three fixed levels: the last point, 4 pivots, 16 pivots."""
    cloud = points(spark, sf_dir)
    a, b = assigned(cloud, 4).select("pid", F.col("center").alias("c1")), assigned(cloud, 16).select("pid", F.col("center").alias("c2"))
    top = cloud.agg(F.max("pid").alias("c0"))
    rows = a.join(b, "pid").crossJoin(F.broadcast(top))
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(2 - i).alias("scale"), F.col(f"c{i}").alias("center")) for i in range(3)])).alias("p")
    return CoverTree(TreeParams(), cloud, rows.select("pid", level).select("pid", "p.*", F.lit(0.0).alias("dist")))


def homogeneity_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = pivot_tree(spark, sf_dir)
    found = aggregates.homogeneity_depth(tree, tree.paths.withColumnRenamed("pid", "qid"), 0.85)
    return found.select("qid", "path_len", "depth")


_tree = tree_of


def pivot_known_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = pivot_tree(spark, sf_dir)
    return tree.known_path(tree.points.select("pid")).select("pid", *[F.col(c).cast("long").alias(c) for c in ("depth", "scale", "center")])


def pivot_node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.label_summary(pivot_tree(spark, sf_dir)).select(F.col("scale").cast("long").alias("scale"), "center", "label", "n")


def pivot_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.child_counts(pivot_tree(spark, sf_dir)).select(F.col("scale").cast("long").alias("scale"), "center", "bucket", "n")


def pivot_final_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_tree(spark, sf_dir).final_address().select("pid", F.col("scale").cast("long").alias("scale"), "center")


def pivot_coverage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the nodes that cover fewer than 100 points, as text."""
    found = aggregates.coverage_indexes(pivot_tree(spark, sf_dir), 100)
    return found.select(F.col("scale").cast("long").alias("scale"), "center", F.array_join(F.col("pids").cast("array<string>"), ",").alias("pids"))


def pivot_fractal_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.fractal_dims(pivot_tree(spark, sf_dir))
    return found.select(F.col("scale").cast("long").alias("scale"), "center", *six("fractal_dim", "weighted_fractal_dim"))


def pivot_layer_fractal_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aggregates.layer_fractal_dims(pivot_tree(spark, sf_dir))
    return found.select(F.col("scale").cast("long").alias("scale"), *six("fractal_dim", "weighted_fractal_dim"))


def pivot_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_tree(spark, sf_dir).layers().select(F.col("scale").cast("long").alias("scale"), "n_nodes", "n_points")


def pivot_node_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = aggregates.gaussians(pivot_tree(spark, sf_dir))
    return g.select(F.col("scale").cast("long").alias("scale"), "center", F.col("pos").cast("long").alias("pos"), "n", *six("mean", "var"))


def residue_tree(spark: SparkSession, sf_dir: str) -> CoverTree:
    """A nested tree of three levels over all points: the last point, and pids by their rest by 4 and by 16."""
    cloud = points(spark, sf_dir)
    rows = cloud.select("pid").crossJoin(F.broadcast(cloud.agg(F.max("pid").alias("c0")))).withColumns({"c1": F.col("pid") % 4, "c2": F.col("pid") % 16})
    level = F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), F.lit(2 - i).alias("scale"), F.col(f"c{i}").alias("center")) for i in range(3)])).alias("p")
    return CoverTree(TreeParams(), cloud, rows.select("pid", level).select("pid", "p.*", F.lit(0.0).alias("dist")))


def node_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node: its height, the leaf that one reaches by always going to the fullest child, and, of these
    chained, the height by the share of labelled points that rest there."""
    fullest = F.max_by(F.col("kid.leaf"), F.struct("n", -F.col("kid_center")))
    shape = plugins.NodePlugin("shape", {"height": F.coalesce(F.col("most") + 1, F.lit(0)), "leaf": F.coalesce("best", "center")}, kids={"most": F.max("kid.height"), "best": fullest})
    marked = plugins.NodePlugin("marked", {"n": F.coalesce("own", F.lit(0)) + F.coalesce("under", F.lit(0)), "tall": F.col("shape.height") * (F.coalesce("own", F.lit(0)) + F.coalesce("under", F.lit(0)))}, rests={"own": F.count("label")}, kids={"under": F.sum("kid.n")})
    found = plugins.fold(residue_tree(spark, sf_dir), [shape, marked], ["label"])
    return found.select(F.col("scale").cast("long").alias("scale"), "center", F.col("shape.height").cast("long").alias("height"), "shape.leaf", F.col("marked.n").alias("labelled"), F.col("marked.tall").cast("long").alias("tall"))


def top_pids(m: int) -> plugins.Summary:
    """The m largest pids, kept as a sorted list."""
    return plugins.Summary(list, lambda state, rows: sorted([*state, *rows["pid"]], reverse=True)[:m], lambda a, b: sorted([*a, *b], reverse=True)[:m], lambda state: (",".join(map(str, state)),), "pids string")


def pivot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest pids under each node, by a summary of the user's."""
    found = plugins.node_summary(pivot_tree(spark, sf_dir), ["label"], top_pids(5))
    return found.select(F.col("scale").cast("long").alias("scale"), "center", "pids")


def tree_split_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of a tree whose nodes of over 300 points are split by all tasks together."""
    tree = _tree(spark, sf_dir, group_points=300)
    return tree.root().select("center", F.col("coverage_count").alias("n"), F.round("radius", 6).alias("radius"))


def tree_split_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points have another path in the split tree than in the whole one: none."""
    a, b = _tree(spark, sf_dir, group_points=300).paths, _tree(spark, sf_dir).paths
    columns = ["pid", "depth", "scale", "center"]
    apart = a.select(*columns).exceptAll(b.select(*columns)).unionByName(b.select(*columns).exceptAll(a.select(*columns)))
    return apart.agg(F.count("*").alias("apart"))


def tree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each point rests in the built tree, counted: every point once."""
    return _tree(spark, sf_dir).final_address().select("pid")


def glued_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud three times over, the second time its labelled points alone, told apart again."""
    cloud = points(spark, sf_dir).select("pid", "label")
    size = cloud.agg(F.max("pid")).first()[0] + 1
    labelled = cloud.where("label is not null")
    part = labelled.agg(F.max("pid")).first()[0] + 1
    return source_address(glue(cloud, labelled, cloud), [size, part, size]).select("pid", "label", F.col("source").cast("long").alias("source"), "local")


def reindexed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pids in reverse."""
    cloud = points(spark, sf_dir).select("pid", "label")
    last = cloud.agg(F.max("pid")).first()[0]
    return reindexed(cloud, cloud.select(F.col("pid").alias("old"), (F.lit(last) - F.col("pid")).alias("new")))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents joined to points by id; names by default."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pid"), F.col("quality").cast("long").alias("label"))
    return with_names(with_labels(points(spark, sf_dir).select("pid", "label"), marks)).select("pid", "label", "name")


def tree_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_tree(spark, sf_dir))


def tree_coverage_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).root().select("center", F.col("coverage_count").alias("n"), F.round("radius", 6).alias("radius"))


def tree_label_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return aggregates.label_summary(tree).join(tree.root().select("scale", "center"), ["scale", "center"]).select("label", "n")


def tree_moments_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    g = aggregates.gaussians(tree).join(tree.root().select("scale", "center"), ["scale", "center"])
    return g.select(F.col("pos").cast("long").alias("pos"), "n", *six("m1", "m2"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).nodes()


def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return walk.path(tree, asked(tree.points))


def known_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return tree.known_path(tree.points.select("pid"))


def routing_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return shown(walk.routing_knn(tree, asked(tree.points), 5))


def layer_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    return walk.layer_knn(tree, asked(tree.points), 2)


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.label_summary(_tree(spark, sf_dir))


def child_dirichlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.child_counts(_tree(spark, sf_dir))


def fractal_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fractal_dims(_tree(spark, sf_dir))


def layer_fractal_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.layer_fractal_dims(_tree(spark, sf_dir))


def coverage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coverage_indexes(_tree(spark, sf_dir), 100)


def node_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.singular_values(_tree(spark, sf_dir), 10)


def tree_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sample(_tree(spark, sf_dir), 100)


def drift_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    bucket = F.when(F.col("next_center").isNotNull(), F.concat_ws(":", "next_scale", "next_center")).alias("bucket")
    steps = tree.steps().select("pid", aggregates.node_key(), bucket)
    return drift.baseline(spark, aggregates.priors(tree), steps, tree.points.count(), sequences=8, sample_rate=100)


QUERIES = {
    f.__name__: f
    for f in (
        tracker_window_counts, tracker_running_counts, tracker_node_kl, tracker_kl_stats, tracker_every_tick, tracker_kl_total, baseline_interpolate, homogeneity_depth, tree_invariants,
        tree_coverage_root, tree_label_root, tree_moments_root, tree_nodes, tree_path, known_path, routing_knn, layer_knn, node_labels, child_dirichlet, fractal_dims,
        layer_fractal_dims, coverage_lists, node_singular_values, tree_sample, drift_baseline, pivot_known_path, pivot_node_labels, pivot_child_counts, pivot_final_address,
        pivot_coverage_lists, pivot_fractal_dims, pivot_layer_fractal_dims, pivot_layers, pivot_node_gaussians, tree_split_root, tree_split_paths, tree_points, glued_clouds,
        reindexed_points, labelled_points, node_folds, pivot_summary,
    )
}

_SEQ = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) tick, CAST(user_id % 7 AS VARCHAR) node, event_type bucket FROM events)"
_HELD = f"r AS (SELECT tick \"at\" FROM s WHERE tick % {EACH} = 0), e AS (SELECT \"at\", node, bucket, count(*) n FROM r JOIN s ON tick <= \"at\" AND tick > \"at\" - {WINDOW} GROUP BY 1, 2, 3)"
_PRIOR = "p AS (SELECT CAST(user_id % 7 AS VARCHAR) node, event_type bucket, count(*) a FROM events GROUP BY 1, 2), t AS (SELECT node, CAST(sum(a) AS BIGINT) t FROM p GROUP BY 1)"
_HARM = "h AS (SELECT n, coalesce(sum(1.0 / n) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) h FROM (SELECT unnest(range(1, (SELECT 2 * count(*) + 1000 FROM events))) n))"
_KL = (
    f"WITH {_SEQ}, {_HELD}, {_PRIOR}, {_HARM}, k AS (SELECT \"at\", e.node, CAST(sum(e.n) AS BIGINT) evidence, max(t.t) t, "
    "sum(lgamma(a + e.n) - lgamma(a) - e.n * (ha.h - ht.h)) s FROM e JOIN p USING (node, bucket) JOIN t USING (node) JOIN h ha ON ha.n = a JOIN h ht ON ht.n = t.t GROUP BY 1, 2), "
    "kl AS (SELECT \"at\", node, evidence, greatest(0, lgamma(t) - lgamma(t + evidence) + s) kl FROM k)"
)

#: The pivot tree's paths: pid, label, v, depth, scale, center, and the next center.
_W = (
    f"{SQL_POINTS}, {sql_assigned(4, 'a')}, {sql_assigned(16, 'b')}, w0 AS (SELECT pid, label, v, 0 depth, (SELECT max(pid) FROM p) center FROM p UNION ALL SELECT pid, label, v, 1, center FROM a UNION ALL SELECT pid, label, v, 2, center FROM b), "
    "w AS (SELECT *, 2 - depth AS scale, lead(center) OVER (PARTITION BY pid ORDER BY depth) nxt FROM w0)"
)
_PARTS = (
    "e AS (SELECT depth, center, nxt, count(*) n FROM w WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT depth, center, count(*) kids, sum(n) under, max(n) most FROM e GROUP BY 1, 2), "
    "d AS (SELECT depth, center, count(*) coverage, count(*) FILTER (WHERE nxt IS NULL AND pid != center) single FROM w GROUP BY 1, 2), "
    "j AS (SELECT depth, center, coverage, single, coalesce(kids, 0) kids, coalesce(under, 0) under, greatest(coalesce(most, 1), 1) most FROM d LEFT JOIN k USING (depth, center))"
)
# Fixed value: the base of the pivot tree's scales.
_BASE = "2.0"

SQL = {
    "pivot_known_path": f"WITH {_W} SELECT pid, CAST(depth AS BIGINT) depth, CAST(scale AS BIGINT) AS scale, center FROM w",
    "pivot_node_labels": f"WITH {_W} SELECT CAST(scale AS BIGINT) AS scale, center, label, count(*) n FROM w WHERE label IS NOT NULL GROUP BY 1, 2, 3",
    "pivot_child_counts": f"WITH {_W} SELECT CAST(scale AS BIGINT) AS scale, center, CASE WHEN nxt IS NOT NULL THEN (scale - 1) || ':' || nxt END bucket, count(*) n FROM w GROUP BY 1, 2, 3",
    "pivot_final_address": f"WITH {_W} SELECT pid, CAST(scale AS BIGINT) AS scale, center FROM w WHERE depth = 2",
    "pivot_coverage_lists": f"WITH {_W} SELECT CAST(scale AS BIGINT) AS scale, center, string_agg(pid, ',' ORDER BY pid) pids FROM w GROUP BY 1, 2 HAVING count(*) < 100",
    "pivot_fractal_dims": f"WITH {_W}, {_PARTS} SELECT CAST(2 - depth AS BIGINT) AS scale, center, round(CASE WHEN single + kids > 0 THEN log2(single + kids) / log2({_BASE}) ELSE 0 END, 6) fractal_dim, round(CASE WHEN under + single > 0 THEN log2((under + single) / most) / log2({_BASE}) ELSE 0 END, 6) weighted_fractal_dim FROM j",
    "pivot_layer_fractal_dims": (
        f"WITH {_W}, {_PARTS}, l AS (SELECT depth, sum(kids + single) parts, count(*) nodes, max(coverage) top, sum(coverage) mass, max(most) most, sum(under + single) below FROM j GROUP BY 1) "
        f"SELECT CAST(2 - depth AS BIGINT) AS scale, round(CASE WHEN parts > 0 THEN (log2(parts) - log2(nodes)) / log2({_BASE}) ELSE 0 END, 6) fractal_dim, round(CASE WHEN below > 0 THEN (log2(below / most) - log2(mass / top)) / log2({_BASE}) ELSE 0 END, 6) weighted_fractal_dim FROM l"
    ),
    "pivot_layers": f"WITH {_W}, c AS (SELECT scale, center, count(*) n FROM w GROUP BY 1, 2) SELECT CAST(scale AS BIGINT) AS scale, count(*) n_nodes, CAST(sum(n) AS BIGINT) n_points FROM c GROUP BY 1",
    "pivot_node_gaussians": f"WITH {_W}, u AS (SELECT scale, center, unnest(v) x, unnest(range(len(v))) pos FROM w) SELECT CAST(scale AS BIGINT) AS scale, center, pos, count(*) n, round(avg(x), 6) mean, round(avg(x * x) - avg(x) * avg(x), 6) AS var FROM u GROUP BY 1, 2, 3",
    "node_folds": (
        f"WITH {SQL_POINTS}, w0 AS (SELECT pid, label, 0 depth, (SELECT max(pid) FROM p) center FROM p UNION ALL SELECT pid, label, 1, pid % 4 FROM p UNION ALL SELECT pid, label, 2, pid % 16 FROM p), "
        "w AS (SELECT *, lead(center) OVER (PARTITION BY pid ORDER BY depth) nxt FROM w0), c AS (SELECT depth, center, count(*) n FROM w GROUP BY 1, 2), t AS (SELECT DISTINCT depth, center, nxt FROM w WHERE nxt IS NOT NULL), "
        "l2 AS (SELECT center, center leaf FROM c WHERE depth = 2), "
        "l1 AS (SELECT t.center, arg_max(l2.leaf, (c.n, -c.center)) leaf FROM t JOIN c ON c.depth = 2 AND c.center = t.nxt JOIN l2 ON l2.center = t.nxt WHERE t.depth = 1 GROUP BY 1), "
        "l0 AS (SELECT t.center, arg_max(l1.leaf, (c.n, -c.center)) leaf FROM t JOIN c ON c.depth = 1 AND c.center = t.nxt JOIN l1 ON l1.center = t.nxt WHERE t.depth = 0 GROUP BY 1), "
        "l AS (SELECT 0 depth, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2), m AS (SELECT depth, center, count(label) labelled FROM w GROUP BY 1, 2) "
        "SELECT CAST(2 - depth AS BIGINT) AS scale, center, CAST(2 - depth AS BIGINT) AS height, leaf, labelled, CAST((2 - depth) * labelled AS BIGINT) tall FROM l JOIN m USING (depth, center)"
    ),
    "pivot_summary": f"WITH {_W}, r AS (SELECT scale, center, pid, row_number() OVER (PARTITION BY scale, center ORDER BY pid DESC) k FROM w) SELECT CAST(scale AS BIGINT) AS scale, center, string_agg(pid, ',' ORDER BY pid DESC) pids FROM r WHERE k <= 5 GROUP BY 1, 2",
    "tree_split_root": f"WITH {SQL_POINTS}, c AS (SELECT pid, v FROM p ORDER BY pid DESC LIMIT 1) SELECT c.pid center, count(*) n, round(max(list_distance(c.v, p.v)), 6) radius FROM c, p GROUP BY 1",
    "tree_split_paths": "SELECT CAST(0 AS BIGINT) apart",
    "tree_points": "SELECT vec_id pid FROM embeddings",
    "glued_clouds": (
        "WITH s AS (SELECT (SELECT max(vec_id) + 1 FROM embeddings) a, (SELECT max(vec_id) + 1 FROM embeddings WHERE label IS NOT NULL) b) "
        "SELECT vec_id pid, label, CAST(0 AS BIGINT) AS source, vec_id AS local FROM embeddings UNION ALL SELECT vec_id + a, label, 1, vec_id FROM embeddings, s WHERE label IS NOT NULL UNION ALL SELECT vec_id + a + b, label, 2, vec_id FROM embeddings, s"
    ),
    "reindexed_points": "SELECT (SELECT max(vec_id) FROM embeddings) - vec_id pid, label FROM embeddings",
    "labelled_points": "SELECT vec_id pid, CAST(quality AS BIGINT) AS label, CAST(vec_id AS VARCHAR) AS name FROM embeddings LEFT JOIN labels ON doc_id = vec_id",
    "tracker_window_counts": f"WITH {_SEQ}, {_HELD} SELECT \"at\", node, bucket, n FROM e",
    "tracker_running_counts": f"WITH {_SEQ}, r AS (SELECT tick \"at\" FROM s WHERE tick % {10 * EACH} = 0) SELECT \"at\", node, bucket, count(*) n FROM r JOIN s ON tick <= \"at\" GROUP BY 1, 2, 3",
    "tracker_node_kl": f"{_KL} SELECT \"at\", node, evidence, round(kl, 6) kl FROM kl",
    "tracker_kl_stats": f"{_KL} SELECT \"at\", count(*) FILTER (WHERE kl > 1e-10) nz_count, round(max(kl) FILTER (WHERE kl > 1e-10), 6) AS max, round(min(kl) FILTER (WHERE kl > 1e-10), 6) AS min, round(coalesce(sum(kl) FILTER (WHERE kl > 1e-10), 0), 6) moment1_nz, round(coalesce(sum(kl * kl) FILTER (WHERE kl > 1e-10), 0), 6) moment2_nz FROM kl GROUP BY 1",
    "tracker_every_tick": (
        f"WITH {_SEQ}, {_PRIOR}, {_HARM}, g AS (SELECT tick, node, bucket, a, count(*) FILTER (WHERE here) OVER (PARTITION BY node, bucket ORDER BY tick ROWS BETWEEN {LONG_WINDOW - 1} PRECEDING AND CURRENT ROW) n "
        "FROM (SELECT tick, p.node, p.bucket, a, s.node = p.node AND s.bucket = p.bucket here FROM s CROSS JOIN p)), k AS (SELECT tick, node, CAST(sum(g.n) AS BIGINT) evidence, max(t.t) t, sum(lgamma(a + g.n) - lgamma(a) - g.n * (ha.h - ht.h)) s FROM g JOIN t USING (node) JOIN h ha ON ha.n = a JOIN h ht ON ht.n = t.t WHERE g.n > 0 GROUP BY 1, 2), "
        "kl AS (SELECT tick \"at\", node, greatest(0, lgamma(t) - lgamma(t + evidence) + s) kl FROM k) "
        "SELECT \"at\", count(*) FILTER (WHERE kl > 1e-10) nz_count, round(max(kl) FILTER (WHERE kl > 1e-10), 6) AS max, round(min(kl) FILTER (WHERE kl > 1e-10), 6) AS min, round(coalesce(sum(kl) FILTER (WHERE kl > 1e-10), 0), 6) moment1_nz, round(coalesce(sum(kl * kl) FILTER (WHERE kl > 1e-10), 0), 6) moment2_nz FROM kl GROUP BY 1"
    ),
    "tracker_kl_total": (
        f"WITH {_SEQ}, {_HELD}, {_PRIOR}, {_HARM}, w AS (SELECT node, bucket, a + 1 a FROM p), tot AS (SELECT CAST(sum(a) AS BIGINT) t FROM w), ev AS (SELECT \"at\", CAST(sum(n) AS BIGINT) ee FROM e GROUP BY 1), "
        "x AS (SELECT e.\"at\", sum(-lgamma(a + e.n) + lgamma(a) + e.n * (hp.h - ht.h)) s FROM e JOIN w USING (node, bucket) JOIN ev ON ev.\"at\" = e.\"at\" CROSS JOIN tot JOIN h hp ON hp.n = a + e.n JOIN h ht ON ht.n = tot.t + ev.ee GROUP BY 1) "
        "SELECT x.\"at\", round(greatest(0, lgamma(t + ee) - lgamma(t) + s), 6) kl FROM x JOIN ev ON ev.\"at\" = x.\"at\" CROSS JOIN tot"
    ),
    "baseline_interpolate": (
        "WITH s AS (SELECT event_id \"at\", value, lag(event_id) OVER (ORDER BY event_id) pat, lag(value) OVER (ORDER BY event_id) pv FROM events WHERE event_id % 1000 = 0 AND event_id > 0), "
        "q AS (SELECT event_id tick FROM events WHERE event_id % 250 = 0 AND event_id > 0 UNION ALL SELECT max(event_id) + 500 FROM events), "
        "l AS (SELECT q.tick, s.* FROM q ASOF LEFT JOIN s ON q.tick >= s.\"at\"), n AS (SELECT q.tick, s.\"at\" nat, s.value nv FROM q ASOF LEFT JOIN s ON q.tick <= s.\"at\") "
        "SELECT tick, round(CASE WHEN \"at\" IS NULL THEN 0 WHEN \"at\" = tick THEN value WHEN nat IS NULL THEN CASE WHEN pat IS NULL THEN value ELSE pv + (value - pv) * (tick - pat) / (\"at\" - pat) END "
        "ELSE value + (nv - value) * (tick - \"at\") / (nat - \"at\") END, 6) AS value FROM l JOIN n USING (tick)"
    ),
    "homogeneity_depth": (
        f"WITH {SQL_POINTS}, {sql_assigned(4, 'a')}, {sql_assigned(16, 'b')}, w AS (SELECT pid, label, 0 depth, -1 center FROM p UNION ALL SELECT pid, label, 1, center FROM a UNION ALL SELECT pid, label, 2, center FROM b), "
        "c AS (SELECT depth, center, label, count(*) n FROM w WHERE label IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT depth, center, count(*) kinds, max(n) top, sum(n) tot FROM c GROUP BY 1, 2) "
        "SELECT pid qid, count(*) path_len, CAST(coalesce(min(depth) FILTER (WHERE kinds = 1 OR 1 - top / tot < 0.85), count(*)) AS BIGINT) AS depth FROM w LEFT JOIN g USING (depth, center) GROUP BY 1"
    ),
    "tree_invariants": "SELECT 'I' || i AS invariant, CAST(0 AS BIGINT) n FROM (SELECT unnest(range(1, 9)) i)",
    "tree_coverage_root": f"WITH {SQL_POINTS}, c AS (SELECT pid, v FROM p ORDER BY pid DESC LIMIT 1) SELECT c.pid center, count(*) n, round(max(list_distance(c.v, p.v)), 6) radius FROM c, p GROUP BY 1",
    "tree_label_root": "SELECT label, count(*) n FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
    "tree_moments_root": "WITH e AS (SELECT unnest(CAST(embedding AS DOUBLE[])) x, unnest(range(len(embedding))) pos FROM embeddings) SELECT pos, count(*) n, round(sum(x), 6) m1, round(sum(x * x), 6) m2 FROM e GROUP BY 1",
}
