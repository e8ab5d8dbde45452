"""A drift tracker over a stream of query paths, as keyed state: one for each tracker and window.

The stream's rows are path steps that already carry what the prior says of them, so no table is sent
along: tracker, seq (place in the tracker's order), step (place in the path), node, bucket (null where
the path stops), a (the prior's count of the bucket), total (the node's), and, where asked for,
resting (1 and the points that rest at the node), resting_total (their sum over all nodes), scale and
weight (the node's coverage relative to its layer's largest).

State is kept entry by entry in the state store: the steps in the window in portions of places, and a line
for each node with its counts and its sum of KL terms. A batch reads the lines once, for the statistics, and
writes just those that its own steps and the ones they push out of the window touch. A tracker can start
from a batch of history, and can be closed by a timer when nothing has come for a while.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orrery.operators.drift import NONZERO

OUTPUT = "tracker string, window int, seen long, sequence_len long, max double, min double, nz_count long, moment1_nz double, moment2_nz double, total_kl double, layers array<struct<scale:int,nodes:long,weight:double>>, closed boolean"
STEP = ["node", "bucket", "a", "total", "resting", "resting_total", "scale", "weight"]
STEP_TYPE = "node string, bucket string, a double, total double, resting double, resting_total double, scale int, weight double"
#: Places in a portion of the window.
PORTION = 256
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def digamma(x: float) -> float:
    """By recurrence up to 8, then the asymptotic series."""
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def term(a: float | None, n: int, total: float) -> float:
    """What a bucket of prior count a with n in evidence adds to its node's KL."""
    return math.lgamma(a + n) - math.lgamma(a) - n * (digamma(a) - digamma(total)) if a else 0.0


def resting_term(a: float, e: int) -> float:
    """What a node of prior count a where e queries rest adds to the tree's KL."""
    return math.lgamma(a) - math.lgamma(a + e) + e * digamma(a + e)


class Line:
    """A node in the state: its evidence, the sum of its buckets' terms, its evidence of unknown buckets, the
    prior's total, its layer and weight there, how many queries rest at it, and its buckets' counts."""

    FIELDS = "evidence long, terms double, strange long, total double, scale int, weight double, rests long, buckets array<string>, counts array<bigint>"

    def __init__(self, held: tuple):
        self.evidence, self.terms, self.strange, self.total, self.scale, self.weight, self.rests = held[:7]
        self.counts = dict(zip(held[7], held[8], strict=True))

    def packed(self) -> tuple:
        return self.evidence, self.terms, self.strange, self.total, self.scale, self.weight, self.rests, list(self.counts), list(self.counts.values())

    def add(self, step: dict, n: int) -> float:
        """Adds n of a step; returns the change of the resting terms' sum."""
        a, bucket = step["a"], step["bucket"]
        before = self.counts.pop(bucket, 0)
        if before + n:
            self.counts[bucket] = before + n
        self.terms += term(a, before + n, self.total) - term(a, before, self.total)
        self.evidence += n
        if not a and bucket is not None:
            self.strange += n
        if bucket is not None or step["resting"] is None:
            return 0.0
        self.rests += n
        return resting_term(step["resting"], self.rests) - resting_term(step["resting"], self.rests - n)

    def kl(self) -> float | None:
        """KL(prior || posterior); null while there is evidence of an unknown bucket."""
        return None if self.strange else max(0.0, math.lgamma(self.total) - math.lgamma(self.total + self.evidence) + self.terms)


class DriftState(StatefulProcessor):
    """The state of one tracker and window. The window's steps lie in portions of PORTION places."""

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getMapState("window", "portion long", f"steps array<struct<place:long,{STEP_TYPE.replace(' ', ':').replace(',:', ',')}>>")
        self.nodes = handle.getMapState("nodes", "node string", Line.FIELDS)
        # seen, the first place in the window, the sum of resting terms, queries at rest, the prior's total
        self.whole = handle.getValueState("whole", "seen long, first long, resting double, rests long, resting_total double")

    def lines(self) -> dict[str, Line]:
        return {key[0]: Line(held) for key, held in self.nodes.iterator()}

    def counted(self, lines: dict[str, Line], steps: list[tuple[dict, int]], now: tuple) -> tuple:
        """Adds steps, each so many times, to the lines, and writes those touched. now: the whole's values."""
        seen, first, resting, rests, prior = now
        touched = set()
        for step, n in steps:
            line = lines.setdefault(step["node"], Line((0, 0.0, 0, step["total"], step["scale"], step["weight"], 0, [], [])))
            resting += line.add(step, n)
            touched.add(step["node"])
            if step["bucket"] is None and step["resting"] is not None:
                rests, prior = rests + n, step["resting_total"]
        for node in touched:
            if lines[node].evidence:
                self.nodes.updateValue((node,), lines[node].packed())
            else:
                del lines[node]
                if self.nodes.containsKey((node,)):
                    self.nodes.removeKey((node,))
        now = seen, first, resting if rests else 0.0, rests, prior
        self.whole.update(now)
        return now

    def advance(self, window: int, rows: pd.DataFrame, now: tuple) -> tuple[dict[str, Line], tuple]:
        """Adds the paths in rows, and lets go of those that leave the window."""
        seen, first = now[:2]
        arrived: dict[int, list[dict]] = {}
        for _, group in rows.groupby("seq", sort=True):
            arrived[seen + len(arrived)] = [plain(r) for r in group.sort_values("step").to_dict("records")]
        steps = [(step, 1) for path in arrived.values() for step in path]
        after = seen + len(arrived)
        if window:
            begin = max(first, after - window)
            steps += [(step, -1) for place, path in arrived.items() if place < begin for step in path]
            steps += [(step, -1) for step in self.leaving(first, min(begin, seen))]
            self.held_on({place: path for place, path in arrived.items() if place >= begin})
            first = begin
        lines = self.lines()
        return lines, self.counted(lines, steps, (after, first, *now[2:]))

    def leaving(self, first: int, before: int) -> list[dict]:
        """The stored steps of places from first to before; portions that have gone by are deleted."""
        out = []
        for portion in range(first // PORTION, -(-before // PORTION)):
            held = self.window.getValue((portion,)) if self.window.containsKey((portion,)) else None
            out += [dict(zip(STEP, s[1:], strict=True)) for s in (held[0] if held else []) if first <= s[0] < before]
            if held and (portion + 1) * PORTION <= before:
                self.window.removeKey((portion,))
        return out

    def held_on(self, paths: dict[int, list[dict]]) -> None:
        portions: dict[int, list[tuple]] = {}
        for place, path in paths.items():
            portions.setdefault(place // PORTION, []).extend((place, *(step[k] for k in STEP)) for step in path)
        for portion, steps in portions.items():
            held = self.window.getValue((portion,)) if self.window.containsKey((portion,)) else None
            self.window.updateValue((portion,), ([tuple(s) for s in (held[0] if held else [])] + steps,))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of `history`: whole paths, or for no window counts alone."""
        seen = int(initialState["seen"].iloc[0])
        if int(key[1]):
            first = seen - initialState["seq"].nunique()
            self.advance(int(key[1]), initialState, (first, first, 0.0, 0, None))
        else:
            self.counted({}, [(plain(r), int(r["n"])) for r in initialState.to_dict("records")], (seen, 0, 0.0, 0, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.whole.get() if self.whole.exists() else (0, 0, 0.0, 0, None)
        lines, now = self.advance(int(key[1]), pd.concat(list(rows)), tuple(now))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield report(key, now, lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield report(key, tuple(self.whole.get()), self.lines(), True)
        for state in (self.window, self.nodes, self.whole):
            state.clear()

    def close(self) -> None:
        pass


def plain(row: dict) -> dict:
    return {k: None if pd.isna(row[k]) else row[k] for k in STEP}


def report(key: tuple, now: tuple, lines: dict[str, Line], closed: bool = False) -> pd.DataFrame:
    seen, first, resting, rests, prior = now
    kls, layers = [], {}
    for line in lines.values():
        kl = line.kl()
        if kl is not None and kl > NONZERO:
            kls.append(kl)
        if line.scale is not None:
            n, w = layers.get(line.scale, (0, 0.0))
            layers[line.scale] = n + 1, w + (line.weight or 0.0)
    total = None
    if rests:
        total = max(0.0, math.lgamma(prior + rests) - math.lgamma(prior) + resting - rests * digamma(prior + rests))
    row = [key[0], key[1], seen, seen - first, max(kls, default=None), min(kls, default=None), len(kls), float(sum(kls)), float(sum(k * k for k in kls)), total]
    shown = [{"scale": s, "nodes": n, "weight": w} for s, (n, w) in sorted(layers.items())]
    return pd.DataFrame([[*row, shown, closed]], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def steps_of(rows: DataFrame) -> DataFrame:
    """Rows with all columns of a step, those not given as nulls."""
    kinds = dict(c.split() for c in STEP_TYPE.split(", "))
    return rows.select("tracker", "seq", "step", *[F.col(c).cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in STEP])


def history(rows: DataFrame, windows: list[int]) -> DataFrame:
    """What trackers start from: for each window the steps of the last queries of a batch of rows, and for
    no window their counts."""
    steps = steps_of(rows)
    queries = steps.select("tracker", "seq").distinct()
    places = queries.withColumn("place", F.row_number().over(Window.partitionBy("tracker").orderBy(F.desc("seq"))))
    seen = queries.groupBy("tracker").agg(F.count("*").alias("seen"))
    out = None
    for w in windows:
        if w:
            part = steps.join(places.where(F.col("place") <= w).drop("place"), ["tracker", "seq"]).withColumn("n", F.lit(1).cast("long"))
        else:
            part = steps.groupBy("tracker", *STEP).agg(F.count("*").alias("n")).withColumns({"seq": F.lit(0).cast("long"), "step": F.lit(0)})
        part = part.join(seen, "tracker").select("tracker", F.lit(w).alias("window"), F.col("seq").cast("long").alias("seq"), F.col("step").cast("int").alias("step"), *STEP, "n", "seen")
        out = part if out is None else out.unionByName(part)
    return out


def track(stream: DataFrame, windows: list[int], start: DataFrame | None = None, idle_ms: int = 0) -> DataFrame:
    """OUTPUT rows: for each tracker and window that a batch touches, the statistics after its last query;
    and, `closed`, those of a tracker to which nothing has come for idle_ms, whose state goes. start:
    rows of `history`. A query must be whole within a micro-batch. The state store must be RocksDB, which
    this sets for the session. With idle_ms a stream goes on until it is stopped, as timers may be due."""
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    fanned = steps_of(stream).withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    state = DriftState(idle_ms)
    first = start.groupBy("tracker", "window") if start is not None else None
    return fanned.groupBy("tracker", "window").transformWithStateInPandas(statefulProcessor=state, outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if idle_ms else "None", initialState=first)
