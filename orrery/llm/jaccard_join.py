"""N-gram Jaccard join by T-occurrence search, with DivideSkip's split of short and long lists.

A document is the set of its distinct word shingles. Two documents link when their sets' overlap
reaches the threshold; a class is what links connect. For a set of q shingles any partner shares at
least T = ceil(threshold q) of them, so of its inverted lists the T - 1 longest can be skipped: a
partner still occurs in one of the q - T + 1 short ones. What holds for one occurrence is done in four
steps, none of which lists the pairs of a group:

1. Equal texts collapse to one. Shingles that are frequent within some task's rows are counted; the
   MOST_FREQUENT of them are ordered last, all others by hash. The order only decides which lists
   are short; any order gives the same links.
2. Short lists are grouped. Documents that share one, with sizes and bit signatures that allow the
   threshold (a bound that never excludes a link), are tied together by a spanning forest: one edge
   a document. Lists of over LIST_BLOCK documents are split into blocks, every two of which meet.
3. The forest's components are the candidate groups. Their documents are brought together, a group of
   over GROUP_BLOCK documents in blocks, every two of which meet in a task of their own.
4. In a task, short lists are merged by counting and the long lists are probed by binary search in
   each candidate's sorted set; links are counted per document, and again a spanning forest leaves.

Classes are connected components, found by stars with shared-folder tables between rounds.

Defined cases: null or wordless texts have no shingles and link with nothing, not even equal ones;
texts of fewer words than a shingle are one shingle of all their words; repeated rows and equal
texts are in one class; a null doc_id joins a class but never names it (a class of null ids only has
null); empty tables give empty results; columns of the input other than those named are ignored.
Documents are named by 64-bit text hashes and shingles by 64-bit hashes, within the usual odds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, empty_text, forget, kept, met, met_once, slices

SHINGLE_WORDS = 4
THRESHOLD = (85, 100)
#: Shingles are counted in portions of COUNTED occurrences; those met FREQUENT_HERE times in a portion
#: are summed up, and the MOST_FREQUENT of them are sent to the executors (12 bytes each).
COUNTED, FREQUENT_HERE, MOST_FREQUENT = 500_000, 3, 500_000
LIST_BLOCK = 4096
#: Texts, and shingles of all of them, that a block of a candidate group holds on average. Two blocks
#: meet in a task, whose memory is a small multiple of their shingles.
GROUP_BLOCK, GROUP_SHINGLES = 2048, 500_000
#: Rows of a candidate group table that may be sent to every executor; beyond, texts pass a filter of fixed
#: size, and one of each is shuffled.
BROADCAST_ROWS = 200_000
#: Hashes of words that a task remembers.
CACHED_WORDS = 100_000
SIGNATURE_BITS = (128, 8192)
#: DivideSkip's cost of merging a row of a list against that of probing: lists are long beyond it.
MERGE_COST = 1.0

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of shingle hashes of whole texts, sorted, as int64."""

    def __init__(self, words: int = SHINGLE_WORDS, fold: bool = True):
        self.words, self.fold = words, fold
        self.known: dict[bytes, int] = {}

    def hashes(self, split: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, out = self.known, np.empty(len(split), np.uint64)
        for i, w in enumerate(split):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        split = [(r.translate(FOLD) if self.fold else r).split() for r in raw]
        sizes = [len(w) for w in split]
        h = self.hashes([x for w in split for x in w])
        ends = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
        k = self.words
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            rolled = finish(rolled + h[j : len(h) - k + 1 + j] + np.uint64(j + 1)) if len(rolled) else rolled
        out = []
        for end, n in zip(ends, sizes, strict=True):
            if n >= k:
                found = np.unique(rolled[end - n : end - k + 1].view(np.int64))
            elif n:
                whole = finish(np.array([n], np.uint64))
                for i in range(end - n, end):
                    whole = finish(whole + h[i : i + 1])
                found = whole.view(np.int64)
            else:
                found = np.zeros(0, np.int64)
            out.append(found)
        return out


def required(n: np.ndarray | int, m: np.ndarray | int, threshold: tuple[int, int]) -> np.ndarray | int:
    """Least overlap of linked sets of n and m: the least o with b o >= a (n + m - o)."""
    a, b = threshold
    return -(-(a * (n + m)) // (a + b))


def signature(shingles: np.ndarray, threshold: tuple[int, int]) -> bytes:
    """Parities of the set's shingles over 2^j bits. Sets that differ in d elements have signatures
    that differ in at most d bits; a longer one folds to a shorter by exclusive-or of its halves.
    Unrelated sets differ in half of the bits, so there are four times as many as linked sets of this
    size may differ in."""
    a, b = threshold
    bits, allowed = SIGNATURE_BITS[0], 2 * len(shingles) * (b - a) // (a + b)
    while bits < SIGNATURE_BITS[1] and bits < 4 * allowed:
        bits *= 2
    spot = (finish(shingles.view(np.uint64)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sig: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(sig, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


class Forest:
    """Components of a few thousand rows, as the row of least number in each."""

    def __init__(self, n: int):
        self.part = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        parts = np.unique(self.part[np.append(others, i)])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts[1:])] = parts[0]

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every id that is not the least of its component, with the least."""
        order = np.lexsort((ids, self.part))
        part, ids = self.part[order], ids[order]
        first = np.append(True, part[1:] != part[:-1])
        least = ids[np.flatnonzero(first)[np.cumsum(first) - 1]]
        return ids[~first], least[~first]


def texts_of(docs: DataFrame) -> DataFrame:
    """id, text: a document's name is its text's hash, so equal texts are one."""
    return docs.select(F.xxhash64(empty_text()).alias("id"), empty_text().alias("text"))


def sized(docs: DataFrame, shingle: tuple[int, bool], threshold: tuple[int, int]) -> DataFrame:
    """Rows of two kinds: (id, n, signature) of each text, once a task; and (id = shingle, n =
    occurrences) with null signature for what is frequent in the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(*shingle), set()
        counted: dict[int, int] = defaultdict(int)
        pending: list[np.ndarray] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts):
                fresh = [i for i in range(part.start, part.stop) if not (ids[i] in seen or seen.add(ids[i]))]
                sets = shingler.sets([texts[i] for i in fresh])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in fresh], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, threshold) for s in sets], pa.binary())], names=["id", "n", "signature"]
                )
                pending += sets
                if sum(map(len, pending)) > COUNTED:
                    _count(pending, counted)
        _count(pending, counted)
        often = [(s, n) for s, n in counted.items() if n >= FREQUENT_HERE]
        if often:
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in often], pa.int64()), pa.array([n for _, n in often], pa.int64()), pa.nulls(len(often), pa.binary())], names=["id", "n", "signature"])

    return texts_of(docs).mapInArrow(run, "id long, n long, signature binary")


def _count(pending: list[np.ndarray], counted: dict[int, int]) -> None:
    """Adds the occurrences of what is frequent in the pending sets; the rest is let go, so memory
    follows what repeats and not what is read."""
    if pending:
        values, counts = np.unique(np.concatenate(pending), return_counts=True)
        often = counts >= FREQUENT_HERE
        for v, c in zip(values[often].tolist(), counts[often].tolist(), strict=True):
            counted[v] += c
        pending.clear()


def short_lists(docs: DataFrame, frequent, shingle: tuple[int, bool], threshold: tuple[int, int]) -> DataFrame:
    """(shingle, id, n, often) for the q - T + 1 shingles of each text that come first in the order;
    often: the shingle is one of the most frequent, which several texts share."""
    a, b = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(*shingle), set()
        common = np.frombuffer(frequent.value[0], np.int64)
        rank = np.frombuffer(frequent.value[1], np.int32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices(texts):
                fresh = [i for i in range(part.start, part.stop) if not (ids[i] in seen or seen.add(ids[i]))]
                keys, owners, sizes, often = [], [], [], []
                for i, s in zip(fresh, shingler.sets([texts[i] for i in fresh]), strict=True):
                    q = len(s)
                    if not q:
                        continue
                    first = q - -(-a * q // b) + 1
                    ranks = np.zeros(q, np.int32)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        ranks = np.where(common[at] == s, rank[at], 0)
                    order = np.argsort(ranks, kind="stable")[:first]
                    keys.append(s[order])
                    owners.append(np.full(first, ids[i], np.int64))
                    sizes.append(np.full(first, q, np.int64))
                    often.append(ranks[order] > 0)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, owners, sizes, often)], names=["shingle", "id", "n", "often"])

    return texts_of(docs).mapInArrow(run, "shingle long, id long, n long, often boolean")


def shared_lists(lists: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """shingle, id, size of the lists with two texts or more. Lists of the most frequent shingles
    are shared, and may be long: their sizes are counted task by task first, and joined. Any other
    list has fewer than FREQUENT_HERE in COUNTED of all occurrences or is rarer than MOST_FREQUENT
    others, so it is told in one task from the single ones, which are the bulk, and these are shuffled
    once. There, a text stays in a list only
    if the next smaller or larger set is near enough in size to link with; else none in it is."""
    a, b = threshold
    common = lists.where("often").select("shingle", "id").distinct()
    sizes = kept(common.groupBy("shingle").agg(F.count("*").alias("size")), "list-sizes")
    counted = met(common, sizes.withColumn("rows", F.col("size")), ["shingle"], ["id"], "rows", sizes.agg(F.sum("size")).first()[0] or 0).select("shingle", "id", "size")
    single = lists.where("not often").select("shingle", "id", "n").repartition("shingle").distinct()
    by = Window.partitionBy("shingle")
    smaller, larger = F.lag("n").over(by.orderBy("n", "id")), F.lead("n").over(by.orderBy("n", "id"))
    fits = F.coalesce(smaller * b >= F.col("n") * a, F.lit(False)) | F.coalesce(F.col("n") * b >= larger * a, F.lit(False))
    told = single.select("shingle", "id", F.count("*").over(by).alias("size"), fits.alias("fits")).where("fits").drop("fits")
    return counted.where("size > 1").unionByName(told.select(*counted.columns))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Columns and the bounds of whole runs of rows with equal first n_keys columns. Rows come sorted
    by those; a run that goes on in the next batch is held until it ends."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:n_keys]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        rest = [c[cuts[-1] :] for c in columns]
        if len(cuts) > 1:
            yield columns, list(zip(cuts[:-1], cuts[1:], strict=True))
    if rest is not None and len(rest[0]):
        yield rest, [(0, len(rest[0]))]


def tied(ids: np.ndarray, sizes: np.ndarray, sigs: list[bytes], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the documents of one list whose sizes and signatures allow a link."""
    a, b = threshold
    if len(ids) == 2:
        n, m = sorted(sizes.tolist())
        size = min(map(len, sigs))
        differ = int(np.bitwise_count(folded(sigs[0], size) ^ folded(sigs[1], size)).sum())
        allowed = n * b >= m * a and (n + m - differ) // 2 >= required(n, m, threshold)
        ids = np.sort(ids)[: 2 * allowed]
        return ids[1:], ids[:-1]
    order = np.lexsort((ids, sizes))
    ids, sizes, sigs = ids[order], sizes[order], [sigs[i] for i in order]
    forest = Forest(len(ids))
    ends = np.searchsorted(sizes * a, sizes * b, "right")
    levels: dict[int, np.ndarray] = {}
    for i in range(len(ids) - 1):
        # Only what is not tied to i yet has to be compared with it.
        others = i + 1 + np.flatnonzero(forest.part[i + 1 : ends[i]] != forest.part[i])
        if not len(others):
            continue
        size = len(sigs[i])
        if size not in levels:
            levels[size] = np.array([folded(s, size) if len(s) >= size else np.zeros(size // 8, np.uint64) for s in sigs])
        differ = np.bitwise_count(levels[size][others] ^ levels[size][i]).sum(axis=1)
        overlap = (sizes[i] + sizes[others] - differ) // 2
        forest.join(i, others[overlap >= required(sizes[i], sizes[others], threshold)])
    return forest.edges(ids)


def candidate_edges(lists: DataFrame, known: DataFrame, threshold: tuple[int, int], block: int) -> DataFrame:
    """a, b: edges from every shared list. lists: shingle, id, size."""
    live = lists.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    meet = live.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    keyed = meet.select("id", "shingle", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = keyed.join(known.select("id", "n", "signature"), "id").select("shingle", "x", "y", "id", "n", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, ids, sizes, sigs), bounds in runs(batches, 3):
            edges = [tied(ids[i:j], sizes[i:j], sigs[i:j].tolist(), threshold) for i, j in bounds if j - i > 1]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(end)) for end in zip(*edges, strict=True)], names=["a", "b"])

    dealt = rows.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _state(flow: DataFrame) -> tuple:
    """Number and fingerprint of distinct rows, whatever their order."""
    return tuple(flow.agg(F.count("*"), F.bit_xor(F.xxhash64(F.lit(1), "a", "b")), F.bit_xor(F.xxhash64(F.lit(2), "b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, root for every end of an edge; root is the least id of the component. Every node points to
    smaller ones. A round moves each pointer on to what its target least points to, then ties all that
    a node points to under the least of them; it ends when a round changes nothing. The tables of a
    round are kept in the shared folder, and the round's before it deleted. Targets of many pointers
    are hot keys."""
    flow = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state, before = _state(flow), None
    while state != before:
        before, total = state, state[0]
        least = flow.groupBy("a").agg(F.min("b").alias("m"))
        targets = flow.groupBy("b").agg(F.count("*").alias("n"))
        targets = kept(targets.join(least, targets["b"] == least["a"], "left").select("b", "n", "m"), "targets")
        moved = met(flow, targets, ["b"], ["a"], "n", total).select("a", F.coalesce("m", "b").alias("b")).distinct()
        moved = kept(moved, "moved")
        floor = kept(moved.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "floors")
        small = met(moved, floor, ["a"], ["b"], "n", total)
        new = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = kept(new, "edges")
        forget(flow, targets, moved, floor)
        flow, state = new, _state(new)
    roots = flow.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(flow.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


class Index:
    """Inverted lists over a block of sets, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], threshold: tuple[int, int]):
        self.sets, self.threshold = sets, threshold
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.values, self.first, self.lengths = np.unique(flat[order], return_index=True, return_counts=True)

    def links(self, query: np.ndarray) -> np.ndarray:
        """Rows whose overlap with the query reaches what their sizes require. The longest lists are
        left out of the merge, as many as DivideSkip's rule says for the least requirement, and probed
        for the rows that the merge leaves open."""
        a, b = self.threshold
        q = len(query)
        at = np.minimum(np.searchsorted(self.values, query), max(0, len(self.values) - 1))
        held = self.values[at] == query if len(self.values) else np.zeros(q, bool)
        at, query = at[held], query[held]
        least = -(-a * q // b)
        if len(query) < least:
            return np.zeros(0, np.int64)
        order = np.argsort(self.lengths[at], kind="stable")
        n_long = min(least - 1, int(least / (1 + MERGE_COST * np.log2(1 + self.lengths[at].max()))))
        short, probes = at[order[: len(order) - n_long]], query[order[len(order) - n_long :]]
        sizes = self.lengths[short]
        spots = np.repeat(self.first[short] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        merged = np.bincount(self.owner[spots], minlength=len(self.sets))
        need = required(q, self.sizes, self.threshold)
        fits = (merged > 0) & (a * q <= b * self.sizes) & (a * self.sizes <= b * q)
        linked = fits & (merged >= need)
        for i in np.flatnonzero(fits & ~linked & (merged >= need - n_long)).tolist():
            s = self.sets[i]
            spot = np.minimum(np.searchsorted(s, probes), len(s) - 1)
            linked[i] = merged[i] + np.count_nonzero(s[spot] == probes) >= need[i]
        return np.flatnonzero(linked)


def verified(docs: DataFrame, groups: DataFrame, shingle: tuple[int, bool], threshold: tuple[int, int]) -> DataFrame:
    """Within each candidate group, exactly: (a, b, 0) of edges that tie what is linked, and (a, null,
    links) of links per text, where every equal text of the other side counts. groups: id, root, n,
    copies."""
    sizes = kept(groups.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("all")), "group-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    blocks = F.ceil(F.greatest(F.col("size") / GROUP_BLOCK, F.col("all") / GROUP_SHINGLES)).cast("int")
    dealt = met(groups.select("id", "root", "copies"), sizes.withColumn("rows", F.col("size")), ["root"], ["id"], "rows", total)
    dealt = dealt.where("size > 1").withColumn("blocks", F.greatest(blocks, F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int")
    meet = kept(dealt.withColumn("own", own).select("id", "root", "copies", "own", "blocks"), "meetings")
    rows = met_once(texts_of(docs), meet, "id", ["id"], BROADCAST_ROWS)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = rows.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(*shingle)
        for (_, x, y, owns, every, weights, texts), bounds in runs(batches, 3):
            for start, end in bounds:
                if end - start < 2:
                    continue
                ids, weight, own, group = every[start:end], weights[start:end], owns[start:end], texts[start:end]
                sets = [s for p in slices(group) for s in shingler.sets(group[p].tolist())]
                left, right = np.flatnonzero(own == x[start]), np.flatnonzero(own == y[start])
                index, forest, count = Index([sets[j] for j in right], threshold), Forest(len(ids)), np.zeros(len(ids), np.int64)
                for i in left.tolist():
                    others = right[index.links(sets[i])]
                    others = others[others != i]
                    count[i] += weight[others].sum()
                    if x[start] != y[start]:
                        count[others] += weight[i]
                    forest.join(i, others)
                a, b = forest.edges(ids)
                some = np.flatnonzero(count)
                ends = [np.concatenate([a, ids[some]]), pa.array(b.tolist() + [None] * len(some), pa.int64()), np.concatenate([np.zeros(len(a), np.int64), count[some]])]
                yield pa.RecordBatch.from_arrays([pa.array(ends[0]), ends[1], pa.array(ends[2])], names=["a", "b", "links"])

    ready = keyed.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return ready.mapInArrow(run, "a long, b long, links long")


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, fold: bool = True, threshold: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, int]:
    """A kept table and the number of documents. id (hash of the text), n_shingles, root (name of the
    class), links, copies, members (texts of the class), first (of the class: no_id, doc_id, id): one
    row per distinct text. Links count documents, equal texts among them."""
    shingle = (words, fold)
    measured = kept(sized(docs, shingle, threshold), "sized")
    known = measured.where(F.col("signature").isNotNull()).dropDuplicates(["id"])
    often = measured.where(F.col("signature").isNull()).groupBy(F.col("id").alias("shingle")).agg(F.sum("n").alias("n"))
    top = often.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas().sort_values("shingle")
    rank = top["n"].rank(method="first").to_numpy(np.int32)
    frequent = docs.sparkSession.sparkContext.broadcast((top["shingle"].to_numpy(np.int64).tobytes(), rank.tobytes()))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    copies = docs.select(F.xxhash64(empty_text()).alias("id"), own.alias("own")).groupBy("id").agg(F.count("*").alias("copies"), F.min("own").alias("own"))
    named = kept(known.join(copies, "id"), "texts")
    lists = kept(short_lists(docs, frequent, shingle, threshold), "short-lists")
    forget(measured)
    live = kept(shared_lists(lists, threshold), "shared-lists")
    forget(lists)
    edges = kept(candidate_edges(live, named, threshold, LIST_BLOCK), "candidates")
    forget(live)
    groups = kept(components(edges).join(named.select("id", "n", "copies"), "id"), "groups")
    found = kept(verified(docs, groups, shingle, threshold), "links")
    forget(edges, groups)
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    others = F.when(F.col("n") > 0, F.col("copies") - 1).otherwise(0)
    linked = named.join(roots, "id", "left").join(links, "id", "left")
    linked = kept(linked.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + others).alias("links"), "copies", "own"), "linked")
    first = F.min(F.struct("own.no_id", "own.doc_id", "id")).alias("first")
    firsts = kept(linked.groupBy("root").agg(F.count("*").alias("members"), first), "firsts")
    n_texts, n_docs = linked.agg(F.count("*"), F.sum("copies")).first()
    return kept(met(linked.drop("own"), firsts, ["root"], ["id"], "members", n_texts), "classes"), n_docs or 0


def join(docs: DataFrame, words: int = SHINGLE_WORDS, fold: bool = True, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links."""
    found, total = classes(docs, words, fold, threshold)
    named = docs.select("doc_id", F.xxhash64(empty_text()).alias("id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    judged = met(named, found.select("id", "n_shingles", "links", "copies", "first"), ["id"], ["doc_id"], "copies", total)
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, fold: bool = True, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that of the smallest id, null last, ties by text, then by a hash of
    the whole row, so that reruns agree. Wordless documents stay."""
    found, total = classes(docs, words, fold, threshold)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(packed, F.xxhash64(empty_text()).alias("id"), F.xxhash64("doc_id").alias("spread"))
    judged = met(rows, found.select("id", "n_shingles", "copies", "first"), ["id"], ["spread"], "copies", total)
    alone = F.col("n_shingles") == 0
    stays = alone | ((F.col("first.id") == F.col("id")) & F.col("first.doc_id").eqNullSafe(F.col("row.doc_id")))
    some = judged.where(stays).select("row", "id", alone.alias("alone"))
    one = some.where("not alone").groupBy("id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select("row").unionByName(some.where("alone").select("row")).select("row.*")
