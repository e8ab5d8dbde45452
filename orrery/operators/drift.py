"""Drift of query sequences against the tree's Dirichlet priors.

A sequence is rows (tick, depth, node, bucket): the path of the query that came at each tick, with the
child it went to (null where it stopped). A tracker with window w sees at tick t the last w queries
(all for w = 0).

Everything follows from signed changes: a row adds 1 at its tick and, with a window, takes 1 away w ticks
later. Counts, and KLs as sums over buckets, are running sums of changes, added up by blocks of ticks
so that a node that all paths pass is no single task. A node's KL holds from one change to the next;
statistics over nodes at every asked tick come from these spans, cut into aligned spans of 1, 2, 4, ...
ticks that are summed up first. So work is linear in the changes, times the logarithm of the ticks,
however long the window is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.distributions import excess_kl, gamma_excess, posterior_kl, with_prior
from orrery.operators.tree import bounded
from orrery.sources.points import ranked
from orrery.sources.tables import settled

#: KL below this counts as none.
NONZERO = 1e-10
#: Ticks of a block in which asked ticks are looked up.
TICK_BLOCK = 8192
STATS = ["max", "min", "nz_count", "moment1_nz", "moment2_nz"]


def sequence(way: DataFrame, order: DataFrame) -> DataFrame:
    """tick, node, bucket from paths (qid, depth, scale, center) and order (tick, qid)."""
    by = Window.partitionBy("qid").orderBy("depth")
    after = F.concat_ws(":", F.lead("scale").over(by), F.lead("center").over(by))
    steps = way.select("qid", F.concat_ws(":", "scale", "center").alias("node"), F.when(F.lead("center").over(by).isNotNull(), after).alias("bucket"))
    return order.join(steps, "qid").select("tick", "node", "bucket")


def changes(seq: DataFrame, ticks: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """turn, node, bucket, n: what is added (or, below 0, taken away) since the asked tick before; and
    the asked ticks, counted (at, turn from 1)."""
    asked = settled(ranked(ticks.select(F.col("tick").alias("at")).distinct(), ["at"], "turn").select("at", "turn"), "asked-ticks")
    rows = seq.select("tick", "node", "bucket", F.lit(1).cast("long").alias("n"))
    if window:
        rows = rows.unionByName(seq.select((F.col("tick") + window).alias("tick"), "node", "bucket", F.lit(-1).cast("long").alias("n")))
    parts = next_asked(rows, asked.select("at")).groupBy("at", "node", "bucket").agg(F.sum("n").alias("n")).where("n != 0")
    return settled(parts.join(asked, "at").select("turn", "node", "bucket", "n"), "changes"), asked


def running(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the running sums of values in order of turn (one row a key and turn), and `until`, the
    key's next turn. Added up within blocks of TICK_BLOCK turns, and over blocks by their sums."""
    rows = rows.withColumn("_block", F.floor(F.col("turn") / TICK_BLOCK))
    within, over = Window.partitionBy(*keys, "_block").orderBy("turn"), Window.partitionBy(*keys).orderBy("_block")
    blocks = rows.groupBy(*keys, "_block").agg(F.min("turn").alias("_first"), *[F.sum(v).alias(v) for v in values])
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), F.lead("_first").over(over).alias("_next"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    here = rows.withColumns({"_until": F.lead("turn").over(within)} | {v: F.sum(v).over(within) for v in values})
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = here.join(carried, same)
    own = [c for c in rows.columns if c not in values and c != "_block"]
    return found.select(*own, *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values], F.coalesce("_until", "_next").alias("until"))


def evidence(seq: DataFrame, ticks: DataFrame, window: int) -> DataFrame:
    """at, node, bucket, n: what a tracker holds at each asked tick; a row for each count over 0. The rows
    are what was asked for; kl statistics do not need them (see `tracked_stats`)."""
    parts, asked = changes(seq, ticks, window)
    held = running(parts, ["node", "bucket"], ["n"]).where("n > 0")
    spread = held.select("node", "bucket", "n", F.explode(F.sequence("turn", F.coalesce(F.col("until") - 1, F.lit(asked.count())))).alias("turn"))
    return spread.join(asked, "turn").select("at", "node", "bucket", "n")


def next_asked(seq: DataFrame, asked: DataFrame) -> DataFrame:
    """seq with `at`, the first asked tick not before the row's; rows after the last one go. Looked up
    within blocks of TICK_BLOCK ticks, and for the rest of a block's rows in the blocks' own order."""
    block = F.floor(F.col("tick") / TICK_BLOCK).alias("block")
    marks = asked.select(F.col("at").alias("tick"), F.lit(1).alias("ask"))
    both = seq.withColumn("ask", F.lit(0)).unionByName(marks, allowMissingColumns=True).select("*", block)
    # Read backwards, so that a frame grows by a row and is not added up anew for each.
    after = Window.partitionBy("block").orderBy(F.desc("tick"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.min(F.when(F.col("ask") == 1, F.col("tick"))).over(after)).where("ask = 0")
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = both.groupBy("block").agg(F.min(F.when(F.col("ask") == 1, F.col("tick"))).alias("m")).select("block", F.min("m").over(later).alias("later"))
    return here.join(blocks, "block").withColumn("at", F.coalesce("here", "later")).where("at is not null").select(*seq.columns, "at")


def node_kl(prior: DataFrame, found: DataFrame) -> DataFrame:
    """at, node, evidence, kl."""
    return posterior_kl(prior, found, ["at"])


def running_kl(prior: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """by..., node, turn, until, evidence, kl at the turns where a node's evidence changes; it holds before the
    turn `until` (null: to the end). parts: by..., turn, node, bucket, n of changes, of either sign. A
    KL is a sum over buckets, so each bucket's change is added up, and no turn is filled in
    between. Null while there is evidence for a bucket that the prior lacks."""
    summed = running(parts.select(*by, "turn", "node", "bucket", "n", F.col("n").alias("more")), [*by, "node", "bucket"], ["n"]).drop("until")
    rows = with_prior(summed.withColumn("e", F.col("n").cast("long")), prior)
    known = F.col("a").isNotNull()

    def term(e: Column) -> Column:
        return F.when(known, gamma_excess(F.col("a"), e)).otherwise(0.0)

    stray, strange = F.when(~known, F.col("more")).otherwise(0), F.when(~known & F.col("bucket").isNotNull(), F.col("more")).otherwise(0)
    rows = rows.withColumns({"change": term(F.col("e")) - term(F.col("e") - F.col("more")), "stray": stray, "strange": strange})
    steps = rows.groupBy(*by, "node", "turn").agg(F.sum("more").alias("evidence"), *[F.sum(c).alias(c) for c in ("change", "stray", "strange")], F.max("prior_total").alias("top"))
    sums = running(settled(steps, "kl-changes"), [*by, "node"], ["evidence", "change", "stray", "strange"])
    kl = excess_kl(F.col("change"), F.col("top"), F.col("evidence"), F.col("stray"))
    return sums.select(*by, "node", "turn", "until", "evidence", F.when(F.col("evidence") == 0, 0.0).when(F.col("strange") == 0, kl).alias("kl"))


def spans(lo: Column, hi: Column, levels: int) -> Column:
    """The aligned spans (level, index) of 2**level turns that make up the turns from lo to before hi."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first, end = F.ceil(lo / size), F.floor(hi / size)
        left = F.when((first < end) & (first % 2 == 1), F.struct(level.alias("level"), first.alias("index")))
        right = F.when((first < end) & (end % 2 == 1), F.struct(level.alias("level"), (end - 1).alias("index")))
        return F.filter(F.array(left, right), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def held_stats(kls: DataFrame, last: int, by: list[str] | None = None) -> DataFrame:
    """by..., turn and the statistics over nodes whose KL counts, at every turn up to `last` at which some
    node holds evidence. kls: rows of running_kl."""
    by, levels = by or [], max(1, int(last + 1).bit_length())
    big = F.when(F.col("kl") > NONZERO, F.col("kl"))
    cut = kls.where("evidence > 0").select(*by, "kl", F.explode(spans(F.col("turn"), F.coalesce("until", F.lit(last + 1)), levels)).alias("s")).select(*by, "kl", "s.*")
    sums = settled(cut.groupBy(*by, "level", "index").agg(F.max(big).alias("max"), F.min(big).alias("min"), F.count(big).alias("nz"), F.sum(big).alias("m1"), F.sum(big * big).alias("m2")), "span-sums")
    turns = kls.sparkSession.range(1, last + 1).select(F.col("id").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    turns = turns.withColumn("index", F.floor(F.col("turn") / F.pow(F.lit(2.0), F.col("level"))))
    # Wide spans are few and are sent out; a narrow one has few turns.
    wide = F.col("level") >= int(math.log2(TICK_BLOCK))
    met = turns.where(wide).join(bounded(settled(sums.where(wide), "wide-spans"), 8), ["level", "index"]).unionByName(turns.where(~wide).join(sums.where(~wide), ["level", "index"]))
    total = {n: F.coalesce(F.sum(c), F.lit(0.0)) for n, c in (("moment1_nz", "m1"), ("moment2_nz", "m2"))}
    return met.groupBy(*by, "turn").agg(F.max("max").alias("max"), F.min("min").alias("min"), F.sum("nz").alias("nz_count"), *[c.alias(n) for n, c in total.items()])


def tracked_stats(prior: DataFrame, seq: DataFrame, ticks: DataFrame, window: int) -> DataFrame:
    """at and the statistics of a tracker at each asked tick, without its evidence spread out."""
    parts, asked = changes(seq, ticks, window)
    stats = held_stats(running_kl(prior, parts, []), asked.count())
    return stats.join(asked, "turn").select("at", *STATS)


def kl_stats(kls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., max, min, nz_count, moment1_nz, moment2_nz over nodes whose KL counts; null extremes
    where none does."""
    by, big = by or ["at"], F.when(F.col("kl") > NONZERO, F.col("kl"))
    return kls.groupBy(*by).agg(F.max(big).alias("max"), F.min(big).alias("min"), F.count(big).alias("nz_count"), F.coalesce(F.sum(big), F.lit(0.0)).alias("moment1_nz"), F.coalesce(F.sum(big * big), F.lit(0.0)).alias("moment2_nz"))


def terminal_kl(resting: DataFrame, found: DataFrame) -> DataFrame:
    """at, kl: KL(posterior || prior) of the whole tree's Dirichlet over resting nodes. resting: node,
    singletons. found: evidence rows; those with a null bucket rest."""
    prior = resting.select("node", (F.col("singletons") + 1).cast("long").alias("a"))
    sums = prior.agg(F.sum("a").alias("prior_total"))
    rows = found.where("bucket is null").groupBy("at", "node").agg(F.sum("n").cast("long").alias("e")).join(prior, "node")
    part = gamma_excess(F.col("a") + F.col("e"), -F.col("e"))
    total = rows.groupBy("at").agg(F.sum("e").alias("seen"), F.sum(part).alias("s")).crossJoin(F.broadcast(sums))  # one row
    both = F.col("prior_total") + F.col("seen")
    return total.select("at", F.greatest(F.lit(0.0), F.col("s") - gamma_excess(both, -F.col("seen"))).alias("kl"))


def probabilities(prior: DataFrame, found: DataFrame) -> DataFrame:
    """at, node, bucket, prob: the posterior's mean; and the evidence's own shares as evidence_prob."""
    ats = found.select("at").distinct()
    seen = found.select("at", "node").distinct()
    rows = seen.join(prior, "node").select("at", "node", "bucket", F.col("n").alias("a"), F.lit(0).cast("long").alias("e"))
    both = rows.unionByName(found.select("at", "node", "bucket", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("e"))).join(ats, "at")
    each = both.groupBy("at", "node", "bucket").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    by = Window.partitionBy("at", "node")
    return each.select("at", "node", "bucket", ((F.col("a") + F.col("e")) / F.sum(F.col("a") + F.col("e")).over(by)).alias("prob"), (F.col("e") / F.sum("e").over(by)).alias("evidence_prob"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two trackers' evidence in one."""
    return first.unionByName(second).groupBy("at", "node", "bucket").agg(F.sum("n").alias("n"))


def layer_stats(found: DataFrame, coverage: DataFrame) -> DataFrame:
    """at, scale, nodes, weight: nodes with evidence on each layer, and their coverage relative to the
    layer's largest. coverage: scale, node, n."""
    most = F.max("n").over(Window.partitionBy("scale"))
    rel = coverage.select("scale", "node", (F.col("n") / most).alias("w"))
    return found.select("at", "node").distinct().join(rel, "node").groupBy("at", "scale").agg(F.count("*").alias("nodes"), F.sum("w").alias("weight"))


def baseline(spark: SparkSession, prior: DataFrame, steps: DataFrame, n_points: int, sequences: int = 8, length: int = 0, sample_rate: int = 100, seed: int = 0, prior_weight: int = 1, observation_weight: int = 1) -> DataFrame:
    """at, and mean and var of each statistic over `sequences` random orders of indexed points. steps:
    pid, node, bucket. length 0 takes all points. Weights multiply counts, 1 leaves them."""
    size = min(length or n_points, n_points)
    runs = spark.range(sequences).select(F.col("id").alias("run"))
    pids = steps.select("pid").distinct().crossJoin(F.broadcast(runs))  # a stated number of runs
    shuffled = ranked(pids.withColumn("_draw", F.xxhash64(F.lit(seed), "run", "pid")), ["run", "_draw", "pid"], "place", 0)
    order = shuffled.select("pid", "run", (F.col("place") - F.col("run") * n_points + 1).alias("tick")).where(F.col("tick") <= size)
    rows = order.join(steps, "pid").withColumn("turn", F.ceil(F.col("tick") / sample_rate))
    last = size // sample_rate
    parts = rows.where(F.col("turn") <= last).groupBy("run", "turn", "node", "bucket").agg((F.count("*") * observation_weight).alias("n"))
    kls = running_kl(prior.withColumn("n", F.col("n") * prior_weight), settled(parts, "changes"), ["run"])
    stats = held_stats(kls, last, ["run"]).withColumn("at", F.col("turn") * sample_rate)
    sums = [F.expr(f"avg(coalesce(`{s}`, 0.0D))").alias(f"{s}_mean") for s in STATS] + [F.expr(f"var_pop(coalesce(`{s}`, 0.0D))").alias(f"{s}_var") for s in STATS]
    return stats.groupBy("at").agg(*sums)


def interpolate(samples: DataFrame, asked: DataFrame, values: list[str]) -> DataFrame:
    """tick and values: samples (at, values...) read at any tick. At a sample, the sample; between two,
    on the line; beyond the last, on the line of the last two (the last itself if there is one);
    before the first, zeros. Neighbours are looked up within blocks of TICK_BLOCK ticks, and beyond a
    block's ends in the blocks' own order."""
    packed = samples.select(F.col("at").alias("tick"), F.struct("at", *values).alias("s"))
    both = packed.withColumn("ask", F.lit(0)).unionByName(asked.select("tick", F.lit(None).cast(packed.schema["s"].dataType).alias("s"), F.lit(1).alias("ask")))
    both = settled(both.withColumn("block", F.floor(F.col("tick") / TICK_BLOCK)), "samples-and-ticks")
    order = Window.partitionBy("block").orderBy("tick", "ask")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("block").orderBy(F.desc("tick"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, 0)
    # The last two samples up to a row: of its own block, or of blocks before it.
    two = F.struct(F.last("s", True).over(upto).alias("low"), F.last("older", True).over(upto).alias("before"))
    with_older = both.withColumn("older", F.when(F.col("s").isNotNull(), F.last("s", True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    here = with_older.withColumns({"two": two, "high": F.last("s", True).over(after)}).where("ask = 1")
    newest = Window.partitionBy("block").orderBy(F.desc("tick"))
    tops = both.where("ask = 0").withColumn("r", F.row_number().over(newest))
    ends = tops.groupBy("block").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("second"), F.min(F.struct("tick", "s"))["s"].alias("first"))
    blocks = both.select("block").distinct().join(ends, "block", "left")
    before, later = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.withColumn("earlier", F.coalesce("second", F.last("top", True).over(before)))
    blocks = blocks.select("block", F.last("top", True).over(before).alias("top_before"), F.last(F.when(F.col("top").isNotNull(), F.struct("earlier")), True).over(before)["earlier"].alias("second_before"), F.first("first", True).over(later).alias("first_after"))
    rows = here.join(blocks, "block").select(
        "tick",
        F.coalesce("two.low", "top_before").alias("low"),
        F.when(F.col("two.low").isNull(), F.col("second_before")).otherwise(F.coalesce("two.before", "top_before")).alias("before"),
        F.coalesce("high", "first_after").alias("high"),
    )

    def value(name: str) -> Column:
        low, high, before = F.col("low"), F.col("high"), F.col("before")

        def line(a: Column, b: Column) -> Column:
            return a[name] + (b[name] - a[name]) * (F.col("tick") - a["at"]) / (b["at"] - a["at"])

        beyond = F.when(before.isNull(), low[name]).otherwise(line(before, low))
        return F.when(low.isNull(), 0.0).when(low["at"] == F.col("tick"), low[name]).when(high.isNull(), beyond).otherwise(line(low, high)).cast("double").alias(name)

    return rows.select("tick", *[value(v) for v in values])


def normalised(stats: DataFrame, base: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Each statistic less its baseline's mean, over its deviation where that is not 0."""
    rows = stats.join(base, "at")
    z = [F.when(F.col(f"{s}_var") > 0, (F.col(s) - F.col(f"{s}_mean")) / F.sqrt(f"{s}_var")).otherwise(F.col(s) - F.col(f"{s}_mean")).alias(s) for s in names or STATS]
    return rows.select("at", *z)
