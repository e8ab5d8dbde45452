"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has as many words as the table. Each source's target is its share by weight, held at
`MAX_REPEATS` times the source's own size, the rest going to the others by weight. The mix is then
dealt in equal blocks of `BLOCK` words: blocks go to sources by the highest quotients
target / (2 s + 1), and a source's blocks go to its shards in the same way. Each shard's documents
stand in a seeded order, cut into blocks; its quota is filled with the blocks of that order, whole
passes first when the quota exceeds the shard. All counts are integers and depend on the rows and the
seed alone, so reruns agree. A source of many shards deals its blocks to runs of `FAN` shards first and
each run to its shards, so that no window holds all shards of a source.

Highest quotients are found without a loop: a divisor that deals too few blocks and one that deals
too many are at most one seat a source apart on average, and only the seats between them are ranked.

Defined cases: null text has size 0 and takes 0 words; a null source is one of its own, ordered
last; repeated rows each have their place and share; an empty table gives an empty result; columns
of the input other than doc_id, text, source are kept out of `allot`'s working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import SPACED_WORD, forget, kept, met

BLOCK = 16
MAX_REPEATS = 3
#: Words (or documents, if these are more) to a shard; a source has as many shards as its size needs, so
#: a hot source is spread out.
SHARD_WORDS = 500_000
#: Shards of a source that are dealt to together.
FAN = 1024
#: Sources that may be sent to every executor; beyond, documents meet their sources by a shuffle.
BROADCAST_ROWS = 200_000
SEED = 17


def size_of(text: Column) -> Column:
    """Words of the text, as runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def cyclic_weights(sizes: DataFrame) -> DataFrame:
    """Adds weight 1, 2, 3, repeating, to sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight -> target. Sources reach their limit in the order of limit per
    weight; with the first k at their limits, the others share what is left by weight."""
    limit = F.col("source_size") * F.lit(float(MAX_REPEATS))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = (
        sizes.withColumns({"limit": limit, "ratio": limit / F.col("weight"), "total": F.sum("source_size").over(every).cast("double")})
        .withColumn("level", level)
        # The first source in this order that stays below its limit fixes the level for all.
        .withColumn("fixed", -F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("down")))).over(every)["down"])
    )
    return rows.withColumn("target", F.least("limit", F.col("weight") * F.coalesce("fixed", F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def apportion(rows: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: within each group, deal `seats` seats to rows by their votes. Adds `out`.
    Ties go to the first key. Groups are windows, so a group must be of bounded size (sources of
    a mix, runs of shards, shards of a run)."""
    every = Window.partitionBy(*group)
    total, n = F.sum(votes).over(every), F.count("*").over(every)
    counted = rows.withColumns({"_total": total, "_n": n, "_seats": F.col(seats).cast("double")})

    def dealt(spread: Column) -> Column:
        share = F.col(votes) * (F.col("_seats") + spread) / F.col("_total")
        return F.when((F.col("_total") <= 0) | (share < 0.5), F.lit(0)).otherwise(F.floor(share + 0.5)).cast("long")

    # The half seat more on either side keeps rounding of the sums from hiding a seat.
    low, high = dealt(-(F.col("_n") / 2 + 0.5)), dealt(F.col("_n") / 2 + 1.5)
    bounds = counted.withColumns({"_low": low, "_high": high}).withColumn("_open", F.col(seats) - F.sum("_low").over(every))
    seat = F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_seat")
    claims = bounds.where(F.col("_high") > F.col("_low")).select(*group, *key, "_open", (F.col(votes)).alias("_votes"), seat)
    rank = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *[F.col(k).asc_nulls_last() for k in key], "_seat")
    won = (
        claims.withColumn("_quotient", F.col("_votes") / (2 * F.col("_seat") - 1))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= F.col("_open"))
        .groupBy(*group, *key)
        .agg(F.count("*").alias("_won"))
    )
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, *key)]
    return bounds.alias("a").join(won.alias("b"), on, "left").select(
        *[f"a.{c}" for c in rows.columns], (F.col("a._low") + F.coalesce("b._won", F.lit(0))).alias(out)
    )


def allot(docs: DataFrame, weigh=cyclic_weights, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    weigh: adds `weight` to a table source, source_size. What crosses the network is a few numbers a
    document; texts stay where they are read."""
    names = [F.xxhash64(F.lit(i), "source", F.col("source").isNull()).alias(f"s{i}") for i in (1, 2)]
    sized = docs.select("doc_id", "source", *names, size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("place"))
    sized = kept(sized, "sizes")
    by_source = kept(sized.groupBy("source", "s1", "s2").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "source-sizes")
    aimed = targets(weigh(by_source.select("source", "source_size"))).withColumn("blocks", F.sum("source_size").over(Window.partitionBy()) / F.lit(block))
    quotas = apportion(aimed.withColumn("blocks", F.floor(F.col("blocks") + 0.5)), [], ["source"], "target", "blocks", "quota")
    n_shards = F.ceil(F.greatest("source_size", "n_docs") / F.lit(shard_words)).cast("long").alias("n_shards")
    quotas = by_source.alias("b").join(quotas.alias("q"), F.col("b.source").eqNullSafe(F.col("q.source")))
    quotas = kept(quotas.select("s1", "s2", "b.source_size", "n_docs", "target", "quota").select("*", n_shards), "quotas")
    n_sources, n_docs = quotas.agg(F.count("*"), F.sum("n_docs")).first()
    if n_sources <= BROADCAST_ROWS:
        placed = sized.join(F.broadcast(quotas), ["s1", "s2"])
    else:
        placed = met(sized, quotas, ["s1", "s2"], ["place"], "n_docs", n_docs)
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("n_shards"))
    placed = placed.select("doc_id", "source", "size", "place", "source_size", "target", "quota", shard.alias("shard"))
    run = F.floor(F.col("shard") / F.lit(FAN)).alias("run")
    shards = kept(placed.groupBy("source", "shard", run).agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota")), "shards")
    totals = shards.groupBy("source", "run").agg(F.sum("shard_size").alias("run_size"), F.first("quota").alias("quota"))
    totals = apportion(totals, ["source"], ["run"], "run_size", "quota", "run_quota")
    on = [F.col("s.source").eqNullSafe(F.col("r.source")), F.col("s.run") == F.col("r.run")]
    shards = shards.alias("s").join(totals.alias("r"), on).select("s.source", "s.run", "s.shard", "s.shard_size", "r.run_quota")
    dealt = apportion(shards, ["source", "run"], ["shard"], "shard_size", "run_quota", "shard_quota").select("source", "shard", "shard_size", "shard_quota")
    forget(by_source)
    order = Window.partitionBy("d.source", "d.shard").orderBy("d.place", F.col("d.doc_id").asc_nulls_last(), "d.size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.least(F.col("shard_quota") * block, F.col("shard_size") * MAX_REPEATS)
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    start = F.coalesce(F.sum("d.size").over(order), F.lit(0))
    rest = F.least(F.greatest(words - passes * F.col("shard_size") - start, F.lit(0)), F.col("d.size"))
    on = [F.col("d.source").eqNullSafe(F.col("s.source")), F.col("d.shard") == F.col("s.shard")]
    return placed.alias("d").join(dealt.alias("s"), on).select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", (passes * F.col("d.size") + rest).cast("long").alias("taken"))
