"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

`histogram` encodes every whole text once and counts documents by length; the histogram is all that
is kept. `suffix_sums` turns it into, for every length L: documents and tokens at L or longer, the
tokens that are left when each document is cut to L, and the cumulative share that gives quantiles.
`at_limits` reads the same figures for any context limits, `quantiles` for any probabilities.

Defined cases: a null or empty text has length 0; repeated rows count each; an empty table gives an
empty histogram, and limits over it give zeros.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import kept

#: Lengths are summed within buckets of so many, and over the buckets' totals.
BUCKET = 1024


def encoded_lengths(docs: DataFrame, ranks_path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns and `length`, the tokens of the whole text in a byte-level vocabulary."""

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return docs.select(*carry, length("text").alias("length"))


def histogram(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """length, n_docs, kept as a table, as every answer reads it more than once. Tasks count their own documents first, so the shuffle has a row for each
    task and length at most."""
    return kept(encoded_lengths(docs, ranks_path).groupBy("length").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length, with exact suffix and prefix sums. Sums run inside buckets of lengths
    and over bucket totals, so no task holds the whole histogram."""
    bucket = (F.col("length") / BUCKET).cast("long")
    rows = hist.select("length", "n_docs", bucket.alias("bucket"))
    sums = [F.sum(c).alias(a) for c, a in ((F.col("n_docs"), "d"), (F.col("n_docs") * F.col("length"), "t"))]
    totals = rows.groupBy("bucket").agg(*sums)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(Window.partitionBy()).alias("docs"),
        F.sum("t").over(Window.partitionBy()).alias("tokens"),
    )
    upto = Window.partitionBy("bucket").orderBy("length")
    run = rows.join(offsets, "bucket").select(
        "length",
        "n_docs",
        (F.col("n_docs") * F.col("length")).alias("n_tokens"),
        (F.col("d0") + F.sum("n_docs").over(upto)).alias("docs_to"),
        (F.col("t0") + F.sum(F.col("n_docs") * F.col("length")).over(upto)).alias("tokens_to"),
        "docs",
        "tokens",
    )
    docs_from = F.col("docs") - F.col("docs_to") + F.col("n_docs")
    tokens_from = F.col("tokens") - F.col("tokens_to") + F.col("n_tokens")
    return run.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("tokens") - tokens_from + docs_from * F.col("length")).alias("tokens_cut_here"),
        F.round(F.col("docs_to") / F.col("docs"), 9).alias("share_to"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents, total tokens, documents over the limit, and tokens left
    after cutting. One pass over the histogram for all limits."""
    length, n = F.col("length"), F.col("n_docs")
    each = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    found = hist.select("length", "n_docs", each).groupBy("context_limit").agg(
        F.sum(n).alias("n_docs"),
        F.sum(n * length).alias("n_tokens"),
        F.sum(F.when(length > F.col("context_limit"), n).otherwise(0)).alias("docs_over"),
        F.sum(n * F.least(length, F.col("context_limit"))).alias("tokens_kept"),
    )
    names = hist.sparkSession.createDataFrame([(x,) for x in limits], "context_limit long")
    return names.join(found, "context_limit", "left").na.fill(0)


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """p, length: the smallest length that at least a share p of the documents does not exceed. Shares are
    turned into whole numbers of documents first, so any number of documents is told exactly."""
    total = sums.agg(F.max("docs_from")).first()[0] or 0
    wanted = [F.struct(F.lit(float(p)).alias("p"), F.lit(math.ceil(Fraction(str(p)) * total)).cast("long").alias("need")) for p in probabilities]
    docs_to = F.lit(total) - F.col("docs_from") + F.col("n_docs")
    reached = sums.select("length", docs_to.alias("docs_to"), F.explode(F.array(*wanted)).alias("w")).where(F.col("docs_to") >= F.col("w.need"))
    return reached.groupBy("w.p").agg(F.min("length").alias("length"))
