"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

A rule names a host suffix and a path start; the longest that fits a URL decides. URLs that no rule
fits are judged by boosted trees over lexical features: lengths, depth, digit ratio, character
entropy, parameter counts, and how often the host's suffixes of one and two labels were blocked
among the labelled URLs. The trees are trained here, from labelled URLs: a table of the caller's, or
else the URLs that rules decide. Suffix statistics count every labelled row; a training URL sees them
without the rows of its own fold of hosts, so that no label is among its features and what is learned
holds for hosts not seen. The trees learn from at most SAMPLE distinct URLs (those of the smallest
hash, so the choice is the same in each run), each with the label of most of its rows.

All of it is DataFrame columns and Spark's own tree learner.

Defined cases: a null URL, or one without "://", has empty host and path, no rule, and is judged by
its features like any other (null counts as empty); with no labelled URLs, or labels of one kind
only, everything that no rule decides has that label, or is allowed; a URL labelled both ways equally
often counts as allowed for the trees; repeated rows are judged alike;
columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, kept, small_or_not

# The rules, as (verdict, host and path start).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SAMPLE = 20_000
TREES, DEPTH = 12, 4
#: Suffix keys of one kind that may be sent to every executor; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
KEYS = ("suffix", "suffix2")
#: Folds of hosts; FOLDS stands for all of them.
FOLDS = 5
#: Added sightings of the mean when a suffix's share of blocked URLs is taken.
PRIOR = 20.0
NUMERIC = ["url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "percent_codes", "scheme_plain", "suffix_rate", "suffix2_rate"]


def parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the URL is null or has no "://"."""
    url = F.col("url")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": F.coalesce(ascii_lower(host), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def ruled(urls: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits, or null. Rules are columns: no join."""
    rules = RULES if rules is None else rules
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone, and the keys of the suffix statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    labels = F.split(host, r"\.")

    def count(what: str) -> Column:
        return F.regexp_count(url, F.lit(what)).cast("double")

    return urls.withColumns(
        {
            "url_chars": F.length(url).cast("double"), "host_chars": F.length(host).cast("double"), "path_chars": F.length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("/")).cast("double"), "labels": F.size(labels).cast("double"),
            "digit_ratio": count("[0-9]") / F.greatest(F.length(url), F.lit(1)), "hyphens": count("-"), "entropy": entropy(url),
            "params": count("[?&][^?&#=]+="), "percent_codes": count("%[0-9A-Fa-f]{2}"), "scheme_plain": F.startswith(url, F.lit("http:")).cast("double"),
            "suffix": F.element_at(labels, -1), "suffix2": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2))),
        }
    )


def with_rates(rows: DataFrame, rates: dict[str, DataFrame], mean: float) -> DataFrame:
    """Adds the blocked share of each suffix key, without what rows of its `fold` say. rates: key, fold
    and rate, by kind of key."""
    for key, own in rates.items():
        rows = rows.join(own, [key, "fold"], "left").withColumn(f"{key}_rate", F.coalesce(f"{key}_rate", F.lit(mean)))
    return rows


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(rows)


class Judge:
    """Trees and suffix statistics, trained from labelled URLs (url, label: 1.0 is block)."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE, seed: int = 7):
        rows = labelled.select("url", F.col("label").cast("double").alias("label")).where(F.col("url").isNotNull() & F.col("label").isNotNull())
        urls = kept(rows.groupBy("url").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "labelled-urls")
        n, blocked = urls.agg(F.sum("n"), F.sum("blocked")).first()
        self.mean = (blocked or 0.0) / n if n else 0.0
        self.model: GBTClassificationModel | None = None
        self.rates: dict[str, DataFrame] = {}
        if not n or not 0 < blocked < n:
            return
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).alias("key")) for k in KEYS])).alias("k")
        fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
        rows = lexical(parts(urls)).withColumn("fold", fold)
        sums = rows.select("n", "blocked", "fold", keys).groupBy("k.key_kind", "k.key", "fold").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        sums = kept(sums, "suffix-sums")
        every = sums.groupBy("key_kind", "key").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
        others = sums.join(every, ["key_kind", "key"]).select("key_kind", "key", "fold", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
        told = others.unionByName(every.select("key_kind", "key", F.lit(FOLDS).alias("fold"), F.col("all_n").alias("n"), F.col("all_blocked").alias("blocked")))
        rate = (F.col("blocked") + PRIOR * self.mean) / (F.col("n") + PRIOR)
        rates = kept(told.select("key_kind", "key", "fold", rate.alias("rate")), "suffix-rates")
        for k in KEYS:
            own = rates.where(F.col("key_kind") == k).select(F.col("key").alias(k), "fold", F.col("rate").alias(f"{k}_rate"))
            self.rates[k] = small_or_not(own, BROADCAST_ROWS)
        chosen = rows.orderBy(F.xxhash64("url"), "url").limit(sample).withColumn("label", (2 * F.col("blocked") > F.col("n")).cast("double"))
        chosen = kept(with_rates(chosen, self.rates, self.mean).select(*NUMERIC, "label"), "tree-urls")
        if chosen.select("label").distinct().count() > 1:
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=1.0).fit(assembled(chosen))

    def features(self, rows: DataFrame) -> DataFrame:
        return with_rates(rows.withColumn("fold", F.lit(FOLDS)), self.rates, self.mean)

    def judge(self, urls: DataFrame) -> DataFrame:
        """urls with host and path -> the same with model_verdict."""
        columns = urls.columns
        if self.model is None:
            return urls.withColumn("model_verdict", F.lit("block" if self.mean > 0.5 else "allow"))
        scored = self.model.transform(assembled(self.features(lexical(urls))))
        return scored.select(*columns, F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("model_verdict"))


def verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by_model."""
    rows = ruled(parts(pages.select("page_id", "url")), rules)
    if labelled is None:
        labelled = rows.where(F.col("rule").isNotNull()).select("url", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    judged = Judge(labelled, sample).judge(rows)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"), F.col("rule").isNull().alias("by_model"))
