"""Categorical, Dirichlet and diagonal Gaussian distributions over DataFrames.

A discrete distribution is rows (node, bucket, n); a null bucket is the one for points that stop at
the node. Log gamma and digamma are column expressions, so Dirichlet functions join nothing but the
distributions themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arguments are moved up by so many before the series, which are exact to 1e-11 from there on.
SHIFT = 8


def log_gamma(x: Column) -> Column:
    """Of a positive number: Stirling's series beyond SHIFT, and the recurrence down from there."""
    x = x.cast("double")
    z = x + SHIFT
    rise = x
    for i in range(1, SHIFT):
        rise = rise * (x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rise)


def digamma(x: Column) -> Column:
    x = x.cast("double")
    z = x + SHIFT
    series = 1 / (2 * z) + 1 / (12 * z * z) - 1 / (120 * F.pow(z, 4)) + 1 / (252 * F.pow(z, 6)) - 1 / (240 * F.pow(z, 8))
    down = 1 / x
    for i in range(1, SHIFT):
        down = down + 1 / (x + i)
    return F.log(z) - series - down


def gamma_excess(x: Column, e: Column) -> Column:
    """log_gamma(x + e) - log_gamma(x) - e digamma(x), for x and x + e over 0. Taken by differences, term by
    term of the same series: log gammas of millions are left out before they could round away what is asked."""
    x, e = x.cast("double"), e.cast("double")
    z, w = x + SHIFT, x + e + SHIFT

    def series(y: Column) -> Column:
        return 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))

    slope = 1 / (2 * z) + 1 / (12 * z * z) - 1 / (120 * F.pow(z, 4)) + 1 / (252 * F.pow(z, 6)) - 1 / (240 * F.pow(z, 8))
    down = e / x - F.log1p(e / x)
    for i in range(1, SHIFT):
        down = down + (e / (x + i) - F.log1p(e / (x + i)))
    return (w - 0.5) * F.log1p(e / z) - e + e * slope + (series(w) - series(z)) + down


def log_or_minus_inf(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))


def category_probs(counts: DataFrame) -> DataFrame:
    """node, bucket, n -> prob and ln_pdf; no rows for nodes whose total is 0."""
    total = F.sum("n").over(Window.partitionBy("node"))
    rows = counts.withColumn("total", total).where("total > 0")
    return rows.select("node", "bucket", "n", (F.col("n") / F.col("total")).alias("prob"), (log_or_minus_inf(F.col("n")) - F.log("total")).alias("ln_pdf"))


def category_kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """node, kl: KL(p || q) per node over the buckets of p. Null where a total is 0 or where q lacks
    a bucket of p."""
    a = p.withColumn("pt", F.sum("n").over(Window.partitionBy("node"))).select("node", "bucket", F.col("n").alias("pn"), "pt")
    b = q.withColumn("qt", F.sum("n").over(Window.partitionBy("node"))).select(F.col("node").alias("qnode"), F.col("bucket").alias("qbucket"), F.col("n").alias("qn"), "qt")
    rows = a.join(b, (F.col("node") == F.col("qnode")) & F.col("bucket").eqNullSafe(F.col("qbucket")), "left")
    term = F.when(F.col("pn") > 0, F.col("pn") / F.col("pt") * (F.log(F.col("pn") / F.col("pt")) - F.log(F.col("qn") / F.col("qt")))).otherwise(0.0)
    ok = F.min((F.col("pt") > 0) & (F.coalesce("qt", F.lit(0)) > 0) & (F.coalesce("qn", F.lit(0)) > 0))
    return rows.groupBy("node").agg(F.when(ok, F.sum(term)).alias("kl"))


def dirichlet_ln_probs(prior: DataFrame) -> DataFrame:
    """ln of the mean probabilities, for nodes whose total is over e."""
    total = F.sum("n").over(Window.partitionBy("node"))
    return prior.withColumn("total", total).where(F.log("total") > 1).select("node", "bucket", (log_or_minus_inf(F.col("n")) - F.log("total")).alias("ln_prob"))


def posterior(prior: DataFrame, evidence: DataFrame) -> DataFrame:
    """Prior plus observed counts."""
    return prior.select("node", "bucket", "n").unionByName(evidence.select("node", "bucket", "n")).groupBy("node", "bucket").agg(F.sum("n").alias("n"))


def excess_kl(buckets: Column, total: Column, seen: Column, stray: Column) -> Column:
    """The KL of a prior of `total` and its posterior of `seen` more, at least 0. buckets: the sum of each
    bucket's gamma_excess; stray: what is seen for buckets without a prior."""
    return F.greatest(F.lit(0.0), buckets - gamma_excess(total, seen) - stray * digamma(total))


def with_prior(evidence: DataFrame, prior: DataFrame) -> DataFrame:
    """evidence rows whose node has a prior, with prior_total and the bucket's own count a (null if the
    prior lacks the bucket)."""
    totals = prior.groupBy("node").agg(F.sum("n").cast("long").alias("prior_total"))
    own = prior.where("n > 0").select(F.col("node").alias("pnode"), F.col("bucket").alias("pbucket"), F.col("n").cast("long").alias("a"))
    same = (F.col("node") == F.col("pnode")) & F.col("bucket").eqNullSafe(F.col("pbucket"))
    return evidence.join(totals, "node").join(own, same, "left").drop("pnode", "pbucket")


def posterior_kl(prior: DataFrame, evidence: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., node, evidence (its count), kl: KL(prior || posterior) of each node's Dirichlet, at least
    0; null if the evidence names a bucket that the prior lacks. Evidence for the stopping bucket of
    a node without one counts in the total alone."""
    by = by or []
    rows = with_prior(evidence.where("n > 0").select(*by, "node", "bucket", F.col("n").cast("long").alias("e")), prior)
    term, stray = F.when(F.col("a").isNotNull(), gamma_excess(F.col("a"), F.col("e"))).otherwise(0.0), F.when(F.col("a").isNull(), F.col("e")).otherwise(0)
    unknown = F.max(F.col("a").isNull() & F.col("bucket").isNotNull())
    sums = rows.groupBy(*by, "node").agg(F.sum("e").alias("seen"), F.max("prior_total").alias("prior_total"), F.sum(term).alias("s"), F.sum(stray).alias("stray"), unknown.alias("unknown"))
    kl = excess_kl(F.col("s"), F.col("prior_total"), F.col("seen"), F.col("stray"))
    return sums.select(*by, "node", F.col("seen").alias("evidence"), F.when(~F.col("unknown"), kl).alias("kl"))


def dirichlet_kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """node, kl: KL(p || q) of Dirichlets with the same buckets; null where buckets differ."""
    a = p.where("n > 0").select("node", "bucket", F.col("n").cast("long").alias("a"))
    b = q.where("n > 0").select(F.col("node").alias("qnode"), F.col("bucket").alias("qbucket"), F.col("n").cast("long").alias("b"))
    rows = a.join(b, (F.col("node") == F.col("qnode")) & F.col("bucket").eqNullSafe(F.col("qbucket")), "full").withColumn("node", F.coalesce("node", "qnode"))
    term = gamma_excess(F.col("a"), F.col("b") - F.col("a"))
    same = F.min(F.col("a").isNotNull() & F.col("b").isNotNull())
    sums = rows.groupBy("node").agg(same.alias("same"), F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum(term).alias("s"))
    kl = F.col("s") - gamma_excess(F.col("ta"), F.col("tb") - F.col("ta"))
    return sums.select("node", F.when(F.col("same"), F.greatest(F.lit(0.0), kl)).alias("kl"))


def gaussian_moments(rows: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """by..., pos, n, m1, m2: sums of each component and of its square. A row for each group and
    component, partially summed before the shuffle."""
    each = rows.where(F.col(vec).isNotNull()).select(*by, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy(*by, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("m1"), F.sum(F.col("x") * F.col("x")).alias("m2"))


def gaussian_change(moments: DataFrame, rows: DataFrame, by: list[str], sign: int, vec: str = "vec") -> DataFrame:
    """by..., pos, n, m1, m2 with the rows' vectors added (sign 1) or taken out again (sign -1)."""
    more = gaussian_moments(rows, by, vec).select(*by, "pos", *[(sign * F.col(c)).alias(c) for c in ("n", "m1", "m2")])
    both = moments.select(*by, "pos", "n", "m1", "m2").unionByName(more)
    return both.groupBy(*by, "pos").agg(*[F.sum(c).alias(c) for c in ("n", "m1", "m2")])


def counts_change(counts: DataFrame, more: DataFrame, sign: int) -> DataFrame:
    """node, bucket, n with counts added or taken out; none falls below 0."""
    both = counts.select("node", "bucket", "n").unionByName(more.select("node", "bucket", (sign * F.col("n")).alias("n")))
    return both.groupBy("node", "bucket").agg(F.greatest(F.lit(0), F.sum("n")).alias("n"))


def gaussian_mean_var(moments: DataFrame) -> DataFrame:
    mean = F.when(F.col("n") > 0, F.col("m1") / F.col("n")).otherwise(0.0)
    var = F.when(F.col("n") > 0, F.col("m2") / F.col("n") - mean * mean).otherwise(0.0)
    return moments.withColumns({"mean": mean, "var": var})


def gaussian_ln_pdf(points: DataFrame, gaussian: DataFrame, on: list[str]) -> DataFrame:
    """pid, ln_pdf of each point under its group's diagonal Gaussian; components of variance 0 are
    left out."""
    each = points.select("pid", *on, F.posexplode("vec").alias("pos", "x")).join(gaussian, [*on, "pos"])
    z = (F.col("x").cast("double") - F.col("mean")) * (F.col("x").cast("double") - F.col("mean")) / F.col("var")
    part = F.when(F.col("var") > 0, z + F.log("var") + math.log(2 * math.pi)).otherwise(0.0)
    return each.groupBy("pid").agg((F.lit(-0.5) * F.sum(part)).alias("ln_pdf"))


def gaussian_kl(p: DataFrame, q: DataFrame, on: list[str]) -> DataFrame:
    """on..., kl: KL(p || q) of diagonal Gaussians (columns pos, mean, var)."""
    b = q.select(*on, "pos", F.col("mean").alias("qm"), F.col("var").alias("qv"))
    rows = p.join(b, [*on, "pos"]).where("var > 0 and qv > 0")
    d = F.col("qm") - F.col("mean")
    return rows.groupBy(*on).agg(F.sum(0.5 * (F.col("var") / F.col("qv") + d * d / F.col("qv") - 1.0 + F.log("qv") - F.log("var"))).alias("kl"))


def category_sample(counts: DataFrame, draws: DataFrame) -> DataFrame:
    """draws (draw, node, u in [0, 1)) -> the bucket that u falls in, by running counts in bucket
    order with the stopping bucket last; no bucket for nodes without counts."""
    upto = Window.partitionBy("node").orderBy(F.col("bucket").asc_nulls_last())
    runs = counts.where("n > 0").select("node", "bucket", F.sum("n").over(upto).alias("hi"), F.sum("n").over(Window.partitionBy("node")).alias("total"), "n")
    picked = (F.col("u") * F.col("total") >= F.col("hi") - F.col("n")) & (F.col("u") * F.col("total") < F.col("hi"))
    return draws.join(runs, "node").where(picked).select("draw", "node", "bucket")
