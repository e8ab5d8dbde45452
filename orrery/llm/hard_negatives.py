"""Hard negatives by a vector-approximation file.

Every vector becomes integers, floor(256 x), and these one cell number a dimension. For an anchor, a
table gives what each cell of a dimension adds to the inner product at least and at most, so a row's
score is bounded from both sides by adding up table entries. Only rows that their bounds allow among
the first of an anchor's positives, or of one of its windows of negatives, are scored exactly.

Anchors are a stated set. They are sent out in blocks of ANCHOR_BLOCK against all rows, and each task
keeps a few rows for an anchor. A first look at one slice of the rows (1 in SLICES) gives thresholds
that already hold for all of them: the k-th best of a part is never better than that of the whole. So
what tasks return grows with SLICES and not with their number.

Cells are fitted to quantiles of at most FIT_ROWS rows or so (a share drawn by hash); the outermost reach to
the true extremes of all rows, so every bound holds for every row. All rows are in the file.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no
part. Of rows that share an id the one of the smallest label, then vector, counts. Vectors of
unequal lengths are taken as if the shorter went on with zeros; empty ones score 0. Equal scores go to
the smaller id. An anchor without another row of its label has no rows in the result, nor has a window
that nothing is in. Integers of more than 2**26 raise an error, since scores might not fit 64 bits.
Columns other than those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import forget, kept, small_or_not

#: Cells of a dimension; each row holds one byte a dimension.
CELLS = 64
ANCHOR_BLOCK = 1024
SLICES = 16
FIT_ROWS = 10_000
LARGEST = 1 << 26
#: Ids that may be sent to every executor, when some ids repeat.
BROADCAST_IDS = 200_000
#: Bounds that a task holds at a time.
SLAB = 1 << 18
LEAST = np.iinfo(np.int64).min

FOUND = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def integers(vec: Column) -> Column:
    """floor(256 x) of each component, x as double."""
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * 256))
    fits = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    return F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("components must stay within 2**18")))


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rows_of(points: DataFrame) -> DataFrame:
    """vec_id, label, vec (integers) of the rows that take part, once for each id. Only ids are shuffled
    to find those that repeat."""
    use = points.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows = use.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("vec")).alias("vec"))
    again = kept(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    marked = small_or_not(again, BROADCAST_IDS)
    first = rows.join(marked, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return rows.join(marked, "vec_id", "left_anti").unionByName(first.select("vec_id", "r.label", "r.vec"))


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of dim integers, zeros behind the shorter ones."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == dim).all():
        return flat.reshape(len(ends), dim)
    out = np.zeros((len(ends), dim), np.int64)
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """dim x CELLS smallest and largest integers of each cell. Cells that hold nothing are empty
    ranges; the first and last reach to the extremes of all rows, and zero."""
    ends = rows.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos").collect()
    dim, n = len(ends), rows.count()
    share = max(1, n // FIT_ROWS)
    seen = rows.where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(share)) == 0).select("vec").toArrow()
    low, high = np.array([min(0, e.lo) for e in ends], np.int64), np.array([max(0, e.hi) for e in ends], np.int64)
    lower, upper = np.empty((dim, CELLS), np.int64), np.empty((dim, CELLS), np.int64)
    sample = padded(seen.column(0).combine_chunks(), dim) if len(seen) else np.zeros((1, dim), np.int64)
    for d in range(dim):
        cuts = np.quantile(sample[:, d], np.arange(1, CELLS) / CELLS, method="nearest")
        cuts = np.clip(cuts.astype(np.int64), low[d], high[d])
        lower[d] = np.concatenate([[low[d]], cuts])
        upper[d] = np.maximum(np.concatenate([cuts - 1, [high[d]]]), lower[d])
    return lower, upper


def build(rows: DataFrame, lower: np.ndarray) -> DataFrame:
    """The file: vec_id, label, slice, cells (a byte a dimension), vec (integers, 32 bits each)."""
    dim = len(lower)
    sent = rows.sparkSession.sparkContext.broadcast(lower)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = padded(batch.column(2), dim)
            cells = np.empty(vecs.shape, np.uint8)
            for d in range(dim):
                cells[:, d] = np.maximum(np.searchsorted(sent.value[d], vecs[:, d], side="right") - 1, 0)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (cells, vecs.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["vec_id", "label", "cells", "vec"])

    cells = rows.select("vec_id", "label", "vec").mapInArrow(run, "vec_id long, label long, cells binary, vec binary")
    return cells.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(SLICES)).cast("int"))


class Bounds:
    """Table lookup for a block of anchors: entry [d, c] has what cell c of dimension d adds at
    least, or at most, to each anchor's score."""

    def __init__(self, anchors: np.ndarray, lower: np.ndarray, upper: np.ndarray):
        most = int(np.abs(anchors).max(initial=0)) * int(max(np.abs(lower).max(initial=0), np.abs(upper).max(initial=0)))
        kind = np.int32 if most * max(1, len(lower)) < 2**31 else np.int64
        a, b = lower[:, :, None] * anchors.T[:, None, :], upper[:, :, None] * anchors.T[:, None, :]
        self.least, self.most = np.minimum(a, b).astype(kind), np.maximum(a, b).astype(kind)

    def of(self, cells: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """rows x anchors bounds of the scores; `some` picks anchors."""
        least, most = (self.least, self.most) if some is None else (self.least[:, :, some], self.most[:, :, some])
        shape = (len(cells), least.shape[2])
        low, high, part = np.zeros(shape, least.dtype), np.zeros(shape, least.dtype), np.empty(shape, least.dtype)
        for d in range(cells.shape[1]):
            low += np.take(least[d], cells[:, d], axis=0, out=part, mode="clip")
            high += np.take(most[d], cells[:, d], axis=0, out=part, mode="clip")
        return low, high


def exactly(vecs: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Scores of pairs, a bounded number at a time."""
    out = np.empty(len(r), np.int64)
    for i in range(0, len(r), 1 << 14):
        part = slice(i, i + (1 << 14))
        out[part] = np.einsum("ij,ij->i", vecs[r[part]], anchors[a[part]])
    return out


class Best:
    """The k best (score, then smaller id) of each of n keys, and the score that a newcomer must
    reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.need = k, floor.astype(np.int64).copy()
        self.key = self.ids = self.score = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        key, ids, score = (np.concatenate(x) for x in ((self.key, key), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        place = np.arange(len(key)) - np.searchsorted(key, key, side="left")
        held = place < self.k
        full = place == self.k - 1
        self.need[key[full]] = np.maximum(self.need[key[full]], score[full])
        self.key, self.ids, self.score = key[held], ids[held], score[held]


def slabs(batches: Iterator[pa.RecordBatch], dim: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, labels, cells, vectors of so many rows at a time that their bounds fit SLAB."""
    step = max(64, SLAB // max(1, width))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            cells = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, dim)
            vecs = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).reshape(part.num_rows, dim).astype(np.int64)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), cells, vecs


def positives(file: DataFrame, sent, k: int) -> DataFrame:
    """anchor (its place in the block), positive_id, positive_score: the best of the rows, k for each task
    and anchor at most. sent: ids, labels, vectors, cell ends, and the score that each anchor's must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vecs, lower, upper, need = sent.value
        bounds, best = Bounds(vecs, lower, upper), Best(k, need)
        for pid, label, cells, rows in slabs(batches, len(lower), len(ids)):
            for own in np.intersect1d(label, labels):
                r, a = np.flatnonzero(label == own), np.flatnonzero(labels == own)
                low, high = bounds.of(cells[r], a)
                other = pid[r][:, None] != ids[a][None, :]
                reach = best.need[a]
                if len(r) >= k:  # what a slab has for certain bounds the rest of it
                    sure = np.where(other, low, LEAST)
                    reach = np.maximum(reach, np.partition(sure, len(r) - k, axis=0)[len(r) - k])
                i, j = np.nonzero(other & (high >= reach))
                score = exactly(rows, vecs, r[i], a[j])
                good = score >= best.need[a[j]]
                best.add(a[j][good], pid[r[i]][good], score[good])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.key, best.ids, best.score)], names=["anchor", "positive_id", "positive_score"])

    found = file.select("vec_id", "label", "cells", "vec").mapInArrow(run, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives(file: DataFrame, sent, k: int) -> DataFrame:
    """FOUND rows of a block of anchors. sent: ids, labels, vectors, cell ends, and of each window (anchor,
    place of the positive) its id and score, smallest and largest score, and the score to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vecs, lower, upper, positive, given, low_end, high_end, need = sent.value
        bounds, best, (n, wide) = Bounds(vecs, lower, upper), Best(k, need.ravel()), need.shape
        for pid, label, cells, rows in slabs(batches, len(lower), n):
            low, high = bounds.of(cells)
            other = label[:, None] != labels[None, :]
            likely, reach = np.zeros(low.shape, bool), best.need.reshape(n, wide).copy()
            for j in range(wide):
                # A window with no threshold yet takes one from the rows that are in it for certain.
                fresh = np.flatnonzero((reach[:, j] <= low_end[:, j]) & (low_end[:, j] <= high_end[:, j])) if len(pid) >= k else []
                if len(fresh):
                    sure = other[:, fresh] & (low[:, fresh] >= low_end[fresh, j]) & (high[:, fresh] <= high_end[fresh, j])
                    kth = np.partition(np.where(sure, low[:, fresh], LEAST), len(pid) - k, axis=0)[len(pid) - k]
                    reach[fresh, j] = np.maximum(reach[fresh, j], kth)
                likely |= (high >= reach[:, j]) & (low <= high_end[:, j])
            r, a = np.nonzero(likely & other)
            score = exactly(rows, vecs, r, a)
            for j in range(wide):
                good = (score >= np.maximum(low_end[a, j], reach[a, j])) & (score <= high_end[a, j])
                best.add(a[good] * wide + j, pid[r[good]], score[good])
        at = best.key
        out = [ids[at // wide], positive.ravel()[at], best.ids, given.ravel()[at], best.score]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=[c.split()[0] for c in FOUND.split(", ")])

    found = file.select("vec_id", "label", "cells", "vec").mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks(anchors: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, labels, vectors of a bounded number of anchors at a time."""
    n = -(-anchors.count() // ANCHOR_BLOCK)
    for i in range(n):
        part = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).orderBy("vec_id").collect()
        if part:
            vecs = np.array([np.frombuffer(r.vec, np.int32) for r in part]).reshape(len(part), dim).astype(np.int64)
            yield np.array([r.vec_id for r in part], np.int64), np.array([r.label for r in part], np.int64), vecs


def mine(points: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. points: vec_id, label,
    vec. anchor: which of them are asked (over vec_id). An anchor's positives are its best n_positives
    other rows of its label; for each, the first n_negatives rows of other labels whose score is between
    window[0] and window[1] hundredths of the positive's."""
    spark = points.sparkSession
    rows = kept(rows_of(points), "vectors")
    lower, upper = fit(rows)
    file = kept(build(rows, lower), "cells")
    part = kept(file.where("slice = 0"), "cells-slice")
    forget(rows)
    out = []
    for ids, labels, vecs in blocks(file.where(anchor), len(lower)):
        shared = (ids, labels, vecs, lower, upper)
        need = np.full(len(ids), LEAST)
        for table in (part, file):
            best = positives(table, spark.sparkContext.broadcast((*shared, need)), n_positives).collect()
            for r in best:
                if r.place == n_positives:
                    need[r.anchor] = r.positive_score
        # No window where there is no positive: its ends cross.
        shape = (len(ids), n_positives)
        positive, given, low_end, high_end = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.ones(shape, np.int64), np.zeros(shape, np.int64)
        for r in best:
            at = r.anchor, r.place - 1
            positive[at], given[at] = r.positive_id, r.positive_score
            low_end[at], high_end[at] = -(-window[0] * r.positive_score // 100), window[1] * r.positive_score // 100
        windows = (*shared, positive, given, low_end, high_end)
        reach = np.where(low_end <= high_end, low_end, np.iinfo(np.int64).max)
        place = {(a, p): (i, j) for i, a in enumerate(ids.tolist()) for j, p in enumerate(positive[i].tolist()) if low_end[i, j] <= high_end[i, j]}
        for r in negatives(part, spark.sparkContext.broadcast((*windows, reach)), n_negatives).where(F.col("rank") == n_negatives).collect():
            reach[place[r.anchor_id, r.positive_id]] = r.negative_score
        out.append(kept(negatives(file, spark.sparkContext.broadcast((*windows, reach)), n_negatives), "negatives"))
    if not out:
        return spark.createDataFrame([], f"{FOUND}, rank int").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return reduce(DataFrame.unionByName, out).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
