import math
import time

import pytest
from pyspark.sql import functions as F

from orrery.functions import distributions as dist
from orrery.operators import drift
from orrery.streaming import tracker


def counts(spark, rows):
    return spark.createDataFrame(rows, "node string, bucket string, n long")


def test_categorical(spark):
    assert dist.category_probs(counts(spark, [])).count() == 0
    one = {r.bucket: r.ln_pdf for r in dist.category_probs(counts(spark, [("x", None, 5), ("x", "a", 0)])).collect()}
    assert one[None] == 0.0 and one["a"] == -math.inf
    p, q = counts(spark, [("x", None, 6), ("x", "a", 6)]), counts(spark, [("x", None, 4), ("x", "a", 8)])
    assert dist.category_kl(p, q).first().kl == pytest.approx(0.05889151782, abs=1e-9)
    assert dist.category_kl(q, p).first().kl == pytest.approx(0.05663301226, abs=1e-9)
    assert dist.category_kl(p, p).first().kl == 0.0


def test_dirichlet(spark):
    some = [1, 2, 3, 5, 8, 9, 40, 1000, 123456]
    rows = spark.createDataFrame([(n,) for n in some], "n long").select("n", dist.log_gamma(F.col("n")).alias("lg"), dist.digamma(F.col("n")).alias("psi")).collect()
    for r in rows:
        assert r.lg == pytest.approx(math.lgamma(r.n), rel=1e-12, abs=1e-10)
        assert r.psi == pytest.approx(sum(1 / i for i in range(1, r.n)) - 0.5772156649015329, abs=1e-10)
    prior = counts(spark, [("x", None, 3), ("x", "a", 2)])
    assert dist.posterior_kl(prior, prior).first().kl == pytest.approx(0.1789970483832892)
    alone = counts(spark, [("x", None, 3)])
    assert dist.posterior_kl(alone, alone).first().kl == 0.0
    assert dist.posterior_kl(alone, counts(spark, [("x", "b", 1)])).first().kl is None
    six, nine, close = counts(spark, [("x", None, 6), ("x", "a", 6)]), counts(spark, [("x", None, 3), ("x", "a", 9)]), counts(spark, [("x", None, 5), ("x", "a", 7)])
    assert dist.dirichlet_kl(six, nine).first().kl > dist.dirichlet_kl(six, close).first().kl > 0
    ln = dist.dirichlet_ln_probs(dist.posterior(counts(spark, [("x", None, 3), ("x", "a", 5)]), counts(spark, [("x", None, 2)])))
    assert all(r.ln_prob == pytest.approx(math.log(0.5)) for r in ln.collect())


def excess(x, e):
    """log_gamma(x + e) - log_gamma(x) - e digamma(x) of a large x, summed up factor by factor."""
    return math.fsum(math.log1p(i / x) for i in range(e)) + e * (1 / (2 * x) + 1 / (12 * x * x) - 1 / (120 * x**4))


def test_small_evidence_of_large_priors(spark):
    prior = counts(spark, [("x", "a", 171_428), ("x", "b", 6_000_003), ("x", "c", 857_142)])
    seen = counts(spark, [("x", "a", 1), ("x", "b", 97), ("x", "c", 2)])
    kl = excess(171_428, 1) + excess(6_000_003, 97) + excess(857_142, 2) - excess(7_028_573, 100)
    assert dist.posterior_kl(prior, seen).first().kl == pytest.approx(kl, abs=1e-13)
    assert dist.dirichlet_kl(prior, dist.posterior(prior, seen)).first().kl == pytest.approx(kl, abs=1e-13)
    parts = spark.createDataFrame([(t, "x", b, n) for t, b, n in [(1, "a", 1), (2, "b", 99), (3, "c", 2), (4, "b", -2)]], "turn long, node string, bucket string, n long")
    assert {r.turn: r.kl for r in drift.running_kl(prior, parts, []).collect()}[4] == pytest.approx(kl, abs=1e-13)
    resting = spark.createDataFrame([("a", 171_427), ("b", 6_000_002)], "node string, singletons long")
    found = spark.createDataFrame([(1, "a", None, 3), (1, "b", None, 40)], "at long, node string, bucket string, n long")
    back = [math.fsum(math.log1p(-i / x) for i in range(1, e + 1)) - e * (-1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4)) for x, e in [(171_431, 3), (6_000_043, 40), (6_171_474, 43)]]
    assert drift.terminal_kl(resting, found).first().kl == pytest.approx(-back[0] - back[1] + back[2], abs=1e-13)


def test_sampling(spark):
    c = counts(spark, [("x", "a", 1), ("x", None, 3)])
    draws = spark.createDataFrame([(0, "x", 0.1), (1, "x", 0.25), (2, "x", 0.99)], "draw long, node string, u double")
    assert [r.bucket for r in dist.category_sample(c, draws).orderBy("draw").collect()] == ["a", None, None]


def steps(spark, n=60):
    rows = [(t, "r", "ab"[t % 3 == 0]) for t in range(1, n + 1)] + [(t, "ab"[t % 3 == 0], None) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "tick long, node string, bucket string")


PRIOR = [("r", "a", 40), ("r", "b", 20), ("a", None, 40), ("b", None, 20)]


def test_windows(spark):
    seq, asked = steps(spark), spark.createDataFrame([(10,), (25,), (60,)], "tick long")
    held = {(r["at"], r.node, r.bucket): r.n for r in drift.evidence(seq, asked, 7).collect()}
    brute = {}
    for r in seq.collect():
        for at in (10, 25, 60):
            if at - 7 < r.tick <= at:
                brute[at, r.node, r.bucket] = brute.get((at, r.node, r.bucket), 0) + 1
    assert held == brute
    whole = {(r["at"], r.node, r.bucket): r.n for r in drift.evidence(seq, asked, 0).collect()}
    assert sum(n for (at, node, _), n in whole.items() if at == 25 and node == "r") == 25
    two = drift.merged(drift.evidence(seq.where("tick <= 30"), asked, 0), drift.evidence(seq.where("tick > 30"), asked, 0))
    assert {(r["at"], r.node, r.bucket): r.n for r in two.collect()} == whole


def test_no_evidence_no_kl(spark):
    none = drift.evidence(steps(spark), spark.createDataFrame([], "tick long"), 5)
    assert drift.node_kl(counts(spark, PRIOR), none).count() == 0


@pytest.fixture
def one_part(spark):
    """Stream states in one partition, as each has a worker of its own to start."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


RESTS = {"r": 1, "a": 31, "b": 12}


def stream_rows(spark):
    """steps() as rows of a stream, with what the prior says of them."""
    prior = counts(spark, PRIOR)
    totals = prior.groupBy("node").agg(F.sum("n").alias("total"))
    more = spark.createDataFrame([(n, r, sum(RESTS.values()), 1 if n == "r" else 0, 0.5) for n, r in RESTS.items()], "node string, resting long, resting_total long, scale int, weight double")
    rows = steps(spark).withColumn("step", F.when(F.col("node") == "r", 0).otherwise(1))
    rows = rows.join(totals, "node").join(prior.select("node", F.col("bucket").alias("b"), F.col("n").alias("count")), "node").where(F.col("b").eqNullSafe(F.col("bucket")))
    return rows.join(more, "node").select(F.lit("t").alias("tracker"), F.col("tick").alias("seq"), "step", "node", "bucket", F.col("count").alias("a"), "total", "resting", "resting_total", "scale", "weight")


def psi(n):
    return sum(1 / i for i in range(1, n)) - 0.5772156649015329


def brute_stats(window, at):
    """The statistics of the last queries at a tick, counted one by one."""
    own = [t for t in range(1, at + 1) if not window or t > at - window]
    held, prior = {}, {(n, b): a for n, b, a in PRIOR}
    for t in own:
        child = "ab"[t % 3 == 0]
        for key in (("r", child), (child, None)):
            held[key] = held.get(key, 0) + 1
    kls = []
    for node in {n for n, _ in held}:
        total, e = sum(a for (n, _), a in prior.items() if n == node), sum(x for (n, _), x in held.items() if n == node)
        terms = [math.lgamma(prior[k] + x) - math.lgamma(prior[k]) - x * (psi(prior[k]) - psi(total)) for k, x in held.items() if k[0] == node]
        kls.append(max(0.0, math.lgamma(total) - math.lgamma(total + e) + sum(terms)))
    kls = [k for k in kls if k > drift.NONZERO]
    top, seen = sum(RESTS.values()), len(own)
    rest = [(RESTS[n], x) for (n, b), x in held.items() if b is None]
    kl = math.lgamma(top + seen) - math.lgamma(top) - seen * psi(top + seen) + sum(math.lgamma(a) - math.lgamma(a + x) + x * psi(a + x) for a, x in rest)
    layers = {1: (1, 0.5), 0: (len(rest), 0.5 * len(rest))}
    return kls, max(0.0, kl), layers


def streamed(spark, found, at):
    """What a query gives until its input ends; it goes on from its checkpoint."""
    found.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(f"{at}/out").collect()


def same_stats(got, window, at):
    kls, total, layers = brute_stats(window, at)
    assert (got.seen, got.sequence_len, got.nz_count) == (at, window or at, len(kls)) and got.total_kl == pytest.approx(total, abs=1e-9)
    assert [got.max, got.min, got.moment1_nz, got.moment2_nz] == [pytest.approx(x) for x in (max(kls), min(kls), sum(kls), sum(k * k for k in kls))]
    assert {x.scale: (x.nodes, pytest.approx(x.weight)) for x in got.layers} == layers


def test_stream_equals_batch(spark, one_part, tmp_path):
    """Two micro-batches, with a restart between them."""
    rows = stream_rows(spark)
    for i, (lo, hi) in enumerate(((0, 25), (25, 60))):
        rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "b=*"))
        found = {(r.window, r.seen): r for r in streamed(spark, tracker.track(stream, [7, 0]), tmp_path)}
        for window in (7, 0):
            same_stats(found[window, hi], window, hi)


def test_stream_starts_from_history(spark, one_part, tmp_path):
    """A tracker that starts from a batch goes on as if it had seen it."""
    rows = stream_rows(spark)
    rows.where("seq > 25").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    started = tracker.track(stream, [40, 0], tracker.history(rows.where("seq <= 25"), [40, 0]))
    found = {r.window: r for r in streamed(spark, started, tmp_path)}
    for window in (40, 0):
        same_stats(found[window], window, 60)


def test_idle_trackers_close(spark, one_part, tmp_path):
    rows = stream_rows(spark).where("seq <= 5")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = tracker.track(stream, [0], idle_ms=1).writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not (closed := spark.table("idle").where("closed").collect()):
            time.sleep(1)
    finally:
        query.stop()
    assert [(r.tracker, r.seen) for r in closed] == [("t", 5)]


def test_interpolation(spark):
    samples = spark.createDataFrame([(10, 1.0), (20, 3.0)], "at long, v double")
    asked = spark.createDataFrame([(5,), (10,), (15,), (30,)], "tick long")
    assert [r.v for r in drift.interpolate(samples, asked, ["v"]).orderBy("tick").collect()] == [0.0, 1.0, 2.0, 5.0]
    assert [r.v for r in drift.interpolate(samples.limit(1), asked, ["v"]).orderBy("tick").collect()] == [0.0, 1.0, 1.0, 1.0]


def test_gaussians(spark):
    points = spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 1.0])], "pid long, vec array<double>").withColumn("g", F.lit("x"))
    own = dist.gaussian_mean_var(dist.gaussian_moments(points, ["g"]))
    assert [(r.mean, r["var"]) for r in own.orderBy("pos").collect()] == [(1.0, 1.0), (1.0, 0.0)]
    ln = dist.gaussian_ln_pdf(points, own, ["g"]).first().ln_pdf
    assert ln == pytest.approx(-0.5 * (1 + math.log(2 * math.pi)))
    wide = own.withColumns({"mean": F.col("mean") + 1, "var": F.col("var") * 2})
    assert dist.gaussian_kl(own, wide, ["g"]).first().kl == pytest.approx(0.5 * (0.5 + 0.5 - 1 + math.log(2)))


def test_interpolation_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(drift, "TICK_BLOCK", 8)
    rows = [(at, float((at * 7) % 11)) for at in (3, 5, 6, 21, 50, 52, 53, 90)]
    asked = [0, 3, 4, 6, 7, 13, 21, 30, 47, 51, 60, 88, 90, 91, 200]

    def read(t):
        low, high = [r for r in rows if r[0] <= t], [r for r in rows if r[0] >= t]
        if not low:
            return 0.0
        (a, x), (b, y) = (low[-1], high[0]) if high else (low[-2], low[-1])
        return x if a == b else x + (y - x) * (t - a) / (b - a)

    got = drift.interpolate(spark.createDataFrame(rows, "at long, v double"), spark.createDataFrame([(t,) for t in asked], "tick long"), ["v"]).orderBy("tick").collect()
    assert [r.v for r in got] == pytest.approx([read(t) for t in asked])


@pytest.mark.parametrize("window", [0, 7])
def test_running_kl(spark, window, monkeypatch):
    """Signed changes add up to the KL of what the window holds, at every tick and across blocks of ticks;
    it is null just while evidence of an unknown bucket is there."""
    monkeypatch.setattr(drift, "TICK_BLOCK", 16)
    seq = steps(spark).unionByName(spark.createDataFrame([(41, "a", "new")], steps(spark).schema))
    prior, every = counts(spark, PRIOR), spark.range(1, 61).select(F.col("id").alias("tick"))
    parts, turns = drift.changes(seq, every, window)
    assert turns.count() == 60
    got = {}
    for r in drift.running_kl(prior, parts, []).collect():
        got |= {(r.node, t): r.kl for t in range(r.turn, r.until or 61) if r.evidence}
    want = {(r.node, r["at"]): r.kl for r in drift.node_kl(prior, drift.evidence(seq, every, window)).collect()}
    assert got.keys() == want.keys() and any(x is None for x in want.values())
    assert all(x is None if want[k] is None else x == pytest.approx(want[k], abs=1e-9) for k, x in got.items())
    stats = {r["at"]: r for r in drift.tracked_stats(prior, seq, every, window).collect()}
    plain = {r["at"]: r for r in drift.kl_stats(drift.node_kl(prior, drift.evidence(seq, every, window))).collect()}
    assert stats.keys() == plain.keys()
    for at, r in plain.items():
        assert stats[at].nz_count == r.nz_count
        for c in ("max", "min", "moment1_nz", "moment2_nz"):
            assert stats[at][c] == (pytest.approx(r[c], abs=1e-9) if r[c] is not None else None)


def test_spans(spark):
    """Aligned spans cover a range once, and are few."""
    rows = spark.range(1, 40).withColumnRenamed("id", "lo").crossJoin(spark.range(1, 41).withColumnRenamed("id", "hi")).where("lo < hi")
    for r in rows.select("lo", "hi", drift.spans(F.col("lo"), F.col("hi"), 6).alias("s")).collect():
        assert sorted(t for x in r.s for t in range(x["index"] << x.level, (x["index"] + 1) << x.level)) == list(range(r.lo, r.hi)) and len(r.s) <= 12
