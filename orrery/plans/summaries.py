"""Queries on summaries and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import distributions as dist
from orrery.operators.aggregates import category_summary, moment_summary, summary_counts
from orrery.plans.vectors import SQL_POINTS, assigned, points, sql_assigned
from orrery.sources.points import one_hot_label
from orrery.functions.metrics import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def label_summary_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_summary(points(spark, sf_dir), [], "label")


def label_summary_by_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_summary(assigned(points(spark, sf_dir)), ["center"], "label")


def unlabeled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return summary_counts(docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id", "left"), ["lang"], "quality")


def vec_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.gaussian_moments(points(spark, sf_dir), []).select(F.col("pos").cast("long").alias("pos"), "n", *six("m1", "m2"))


def diag_gaussian_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dist.gaussian_mean_var(dist.gaussian_moments(points(spark, sf_dir), ["label"]))
    return g.select("label", F.col("pos").cast("long").alias("pos"), "n", *six("mean", "var"))


def _by_label(cloud: DataFrame) -> DataFrame:
    return dist.gaussian_mean_var(dist.gaussian_moments(cloud, ["label"]))


def gaussian_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's Gaussian against that of all points."""
    cloud = points(spark, sf_dir)
    every = dist.gaussian_mean_var(dist.gaussian_moments(cloud, []))
    own = _by_label(cloud)
    q = own.select("label", "pos").join(every.select("pos", "mean", "var"), "pos")
    return dist.gaussian_kl(own, q, ["label"]).select("label", *six("kl"))


def gaussian_ln_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = points(spark, sf_dir)
    return dist.gaussian_ln_pdf(cloud, _by_label(cloud), ["label"]).select("pid", *six("ln_pdf"))


def string_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("node", F.col("user_id") % 7)
    return category_summary(events, ["node"], "event_type")


def float_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moment_summary(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", "n", F.round("m1", 3).alias("m1"), F.round("m2", 3).alias("m2"))


def int_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moment_summary(table(spark, sf_dir, "part"), ["p_brand"], "p_size").select("p_brand", "n", *[F.col(c).cast("long").alias(c) for c in ("m1", "m2")])


def coverage_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots that cover fewer points than an eighth of them."""
    cloud = points(spark, sf_dir)
    total = cloud.agg(F.count("*").alias("total"))
    sizes = assigned(cloud).groupBy("center").agg(F.count("*").alias("n"))
    return sizes.crossJoin(F.broadcast(total)).where("n * 8 < total").select("center", "n")


def _counts(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(where)
    return events.groupBy((F.col("user_id") % 7).alias("node"), F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))


def category_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.category_probs(_counts(spark, sf_dir, "true")).select("node", "bucket", "n", *six("prob"))


def category_ln_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.category_probs(_counts(spark, sf_dir, "true")).select("node", "bucket", *six("ln_pdf"))


def category_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dist.category_kl(_counts(spark, sf_dir, "event_id % 10 >= 5"), _counts(spark, sf_dir, "true")).select("node", *six("kl"))


def dirichlet_posterior_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, evidence = _counts(spark, sf_dir, "event_id % 10 < 9"), _counts(spark, sf_dir, "event_id % 10 = 9")
    found = dist.posterior_kl(prior, evidence)
    return found.select("node", "evidence", *six("kl"))


def dirichlet_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = _counts(spark, sf_dir, "event_id % 2 = 0"), _counts(spark, sf_dir, "event_id % 2 = 1")
    return dist.dirichlet_kl(p, q).select("node", *six("kl"))


def one_hot_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as one-hot vectors of ten, and back."""
    cloud = points(spark, sf_dir)
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return cloud.select("pid", one_hot_label(hot).cast("long").alias("label"))


def densify_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors kept sparse (components over 0.1), then densified, and summed by component."""
    cloud = points(spark, sf_dir)
    index = F.filter(F.sequence(F.lit(0), F.size("vec") - 1), lambda i: F.get(F.col("vec"), i) > 0.1)
    sparse = cloud.select("pid", F.size("vec").alias("dim"), index.alias("idx"), F.transform(index, lambda i: F.get(F.col("vec"), i)).alias("val"))
    dense = sparse.select("pid", F.posexplode(densify(F.col("dim"), F.col("idx"), F.col("val"))).alias("pos", "x"))
    return dense.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sum((F.col("x") > 0).cast("long")).alias("n"), F.round(F.sum("x"), 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (label_summary_root, label_summary_by_pivot, unlabeled_counts, vec_moments, diag_gaussian_by_label, gaussian_kl, gaussian_ln_pdf, string_summary, float_summary, int_summary, coverage_index_counts, category_probs, category_ln_pdf, category_kl, dirichlet_posterior_kl, dirichlet_kl, one_hot_to_int)
} | {"densify": densify_vectors}

_EACH = "e AS (SELECT pid, label, unnest(v) x, unnest(range(len(v))) pos FROM p)"
_OWN = "g AS (SELECT label, pos, count(*) n, sum(x) / count(*) mean, sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)) var FROM e GROUP BY 1, 2)"


def _counts_sql(where: str) -> str:
    return f"(SELECT user_id % 7 node, event_type bucket, count(*) n FROM events WHERE {where} GROUP BY 1, 2)"


_HARMONIC = "list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i))"

SQL = {
    "label_summary_root": "SELECT label, count(*) n FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
    "label_summary_by_pivot": f"WITH {SQL_POINTS}, {sql_assigned()} SELECT center, label, count(*) n FROM a WHERE label IS NOT NULL GROUP BY 1, 2",
    "unlabeled_counts": "SELECT lang, count(quality) n, count(*) - count(quality) nones FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "vec_moments": f"WITH {SQL_POINTS}, {_EACH} SELECT pos, count(*) n, round(sum(x), 6) m1, round(sum(x * x), 6) m2 FROM e GROUP BY 1",
    "diag_gaussian_by_label": f"WITH {SQL_POINTS}, {_EACH}, {_OWN} SELECT label, pos, n, round(mean, 6) mean, round(var, 6) var FROM g",
    "gaussian_kl": f"WITH {SQL_POINTS}, {_EACH}, {_OWN}, h AS (SELECT pos, sum(x) / count(*) qm, sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)) qv FROM e GROUP BY 1) SELECT label, round(sum(0.5 * (var / qv + (qm - mean) * (qm - mean) / qv - 1 + ln(qv) - ln(var))), 6) kl FROM g JOIN h USING (pos) WHERE var > 0 AND qv > 0 GROUP BY 1",
    "gaussian_ln_pdf": f"WITH {SQL_POINTS}, {_EACH}, {_OWN} SELECT pid, round(-0.5 * sum(CASE WHEN var > 0 THEN (x - mean) * (x - mean) / var + ln(var) + ln(2 * pi()) ELSE 0 END), 6) ln_pdf FROM e JOIN g USING (label, pos) GROUP BY 1",
    "string_summary": "SELECT user_id % 7 node, event_type, count(*) n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2",
    "float_summary": "SELECT event_type, count(value) n, round(sum(value), 3) m1, round(sum(value * value), 3) m2 FROM events GROUP BY 1",
    "int_summary": "SELECT p_brand, count(p_size) n, CAST(sum(p_size) AS BIGINT) m1, CAST(sum(p_size * p_size) AS BIGINT) m2 FROM part GROUP BY 1",
    "coverage_index_counts": f"WITH {SQL_POINTS}, {sql_assigned()} SELECT center, count(*) n FROM a GROUP BY 1 HAVING count(*) * 8 < (SELECT count(*) FROM p)",
    "category_probs": f"SELECT node, bucket, n, round(n / sum(n) OVER (PARTITION BY node), 6) prob FROM {_counts_sql('true')}",
    "category_ln_pdf": f"SELECT node, bucket, round(ln(n) - ln(sum(n) OVER (PARTITION BY node)), 6) ln_pdf FROM {_counts_sql('true')}",
    "category_kl": f"WITH a AS (SELECT *, sum(n) OVER (PARTITION BY node) t FROM {_counts_sql('event_id % 10 >= 5')}), b AS (SELECT *, sum(n) OVER (PARTITION BY node) t FROM {_counts_sql('true')}) SELECT a.node, round(sum(a.n / a.t * (ln(a.n / a.t) - ln(b.n / b.t))), 6) kl FROM a JOIN b USING (node, bucket) GROUP BY 1",
    "dirichlet_posterior_kl": (
        f"WITH a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY node) AS BIGINT) t FROM {_counts_sql('event_id % 10 < 9')}), b AS {_counts_sql('event_id % 10 = 9')}, "
        f"j AS (SELECT b.node, b.bucket, b.n e, a.n a, (SELECT max(t) FROM a a2 WHERE a2.node = b.node) t FROM b LEFT JOIN a ON a.node = b.node AND a.bucket = b.bucket), "
        f"s AS (SELECT node, CAST(sum(e) AS BIGINT) ee, max(t) t, sum(lgamma(a + e) - lgamma(a) - e * (coalesce({_HARMONIC.format(n='a')}, 0) - {_HARMONIC.format(n='t')})) s, count(*) FILTER (WHERE a IS NULL) bad FROM j WHERE t IS NOT NULL GROUP BY 1) "
        "SELECT node, ee evidence, CASE WHEN bad = 0 THEN round(greatest(0, lgamma(t) - lgamma(t + ee) + s), 6) END kl FROM s"
    ),
    "dirichlet_kl": (
        f"WITH a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY node) AS BIGINT) t FROM {_counts_sql('event_id % 2 = 0')}), b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY node) AS BIGINT) t FROM {_counts_sql('event_id % 2 = 1')}), "
        "j AS (SELECT coalesce(a.node, b.node) node, a.n a, b.n b, a.t ta, b.t tb FROM a FULL JOIN b ON a.node = b.node AND a.bucket = b.bucket) "
        f"SELECT node, CASE WHEN count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 THEN round(greatest(0, lgamma(max(ta)) - lgamma(max(tb)) + sum(lgamma(b) - lgamma(a) + (a - b) * (coalesce({_HARMONIC.format(n='a')}, 0) - {_HARMONIC.format(n='ta')}))), 6) END kl FROM j GROUP BY 1"
    ),
    "one_hot_to_int": "SELECT vec_id pid, CAST(label AS BIGINT) AS label FROM embeddings",
    "densify": "WITH e AS (SELECT unnest(CAST(embedding AS DOUBLE[])) x, unnest(range(len(embedding))) pos FROM embeddings) SELECT pos, CAST(sum(CASE WHEN x > CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) n, round(sum(CASE WHEN x > CAST(0.1 AS DOUBLE) THEN x ELSE 0 END), 6) total FROM e GROUP BY 1",
}
