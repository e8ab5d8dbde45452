"""Benchmark decontamination by CGK embedding and bit-sampling.

A document is contaminated by an item when one of its windows of the item's length in words is
within MAX_EDIT_SHARE of that length in word edits. Windows of every item length are taken at every
word; a document of fewer words than the item is one window of its own, if no more words are missing
than may be edited. A window that far from an item still shares most of its word pairs (each edit
breaks two at most), so windows with too few of the items' pairs are passed over; none that match are.

The others are embedded by the CGK random walk: at each of 3 n steps the walk writes the word under
its pointer and moves on by a random bit of (step, word), which maps edits to few Hamming
differences. Keys of SAMPLED steps each, from WALKS walks, are looked up among the items' keys; pairs
that share a key are verified by exact edit distance. Items of fewer than EDITED_FROM words may have no
edit; they are looked up whole.

Items are prepared once, on the driver, and sent to the executors in blocks of about WORDS_HELD words,
each block one pass over the rows, so what is broadcast is bounded whatever the benchmark's size. A
single longer item is a block of its own. Windows are embedded and
verified in portions of bounded size, whatever the items' lengths and the number of equal items.

Words are runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased. Defined cases:
null or empty texts match nothing; items that are null or have no words match nothing; equal items each
report; repeated rows each report; columns of either table that clash with working names are
carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.llm.common import kept, slices

MAX_EDIT_SHARE = 0.2
#: Words from which an item may be edited at all.
EDITED_FROM = 5
#: Words of a block of items, each counted as long as the block's longest may be.
WORDS_HELD = 1_000_000
#: Walk steps held at once, and pairs of windows and items.
STEPS_HELD, PAIRS_HELD = 4_000_000, 200_000
#: Keys of so many steps each, from so many walks. On passages edited up to the bound, these 72 keys
#: found all of 839 that brute force finds (50 keys of 4 steps: 0.995).
WALKS, KEYS, SAMPLED = 6, 12, 4
#: Pairs in a stretch that any matching window must fill to a good part.
STRETCH = 7
# ASCII capitals fold, other ASCII but digits and letters becomes a space.
FOLD = bytes(c if c > 127 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
HIT = "array<struct<item_id:bigint,start_word:bigint,n_words:int,distance:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def max_edits(n: int) -> int:
    return int(n * MAX_EDIT_SHARE + 1e-9)


class Items:
    """A block of benchmark items, made ready for lookups."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int = 11):
        split = sorted(((i, w) for i, t in rows if (w := words_of(t))), key=lambda x: len(x[1]) < EDITED_FROM)
        self.ids = [i for i, _ in split]
        self.code: dict[bytes, int] = {}
        every = [[self.code.setdefault(x, len(self.code) + 1) for x in w] for _, w in split]  # 0: any other word
        coded = [w for w in every if len(w) >= EDITED_FROM]
        self.short: dict[tuple[int, ...], list[int]] = {}
        for row, w in enumerate(every):
            if len(w) < EDITED_FROM:
                self.short.setdefault(tuple(w), []).append(row)
        self.lengths = np.array([len(w) for w in coded], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.pad = len(self.code) + 1
        self.table = np.full((len(coded), self.longest), self.pad, np.int64)
        for row, w in zip(self.table, coded, strict=True):
            row[: len(w)] = w
        left, right = self.table[:, :-1], self.table[:, 1:]
        inside = right < self.pad
        self.pairs = np.unique(left[inside] * np.int64(self.pad + 1) + right[inside])
        self.classes = np.unique(self.lengths)
        of_class = np.broadcast_to(self.lengths[:, None], left.shape)
        self.holds = {}
        for n in self.classes:
            own = left[inside & (of_class == n)] * np.int64(self.pad + 1) + right[inside & (of_class == n)]
            self.holds[int(n)] = np.unique(np.searchsorted(self.pairs, own))
        self.need = {int(n): int(n) - 1 - 2 * max_edits(int(n)) for n in self.classes}
        self.stretch_need = min((-(-k // -(-(n - 1) // STRETCH)) for n, k in self.need.items()), default=1)
        self.random = np.random.default_rng(seed)
        self.steps = self.random.random((WALKS, KEYS, SAMPLED))
        self.salt = self.random.integers(1, 2**63, WALKS).astype(np.uint64)
        keys = self.keys(self.table, self.lengths)
        order = np.argsort(keys, axis=None, kind="stable")
        self.sorted_keys, self.owner = keys.ravel()[order], order // keys.shape[1] if len(coded) else order

    @classmethod
    def of(cls, parts: dict) -> Items:
        """A block as it was, from its `vars`: plain values, which are sent without this class."""
        items = cls.__new__(cls)
        vars(items).update(parts)
        return items

    def keys(self, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """rows x (WALKS * KEYS) hashes of sampled steps of each row's embedding. table: word codes,
        padded after each row's length."""
        rows = np.arange(len(table))
        padded = np.hstack([table, np.full((len(table), 1), self.pad, np.int64)])
        out = np.zeros((len(table), WALKS * KEYS), np.uint64)
        for w in range(WALKS):
            pointer = np.zeros(len(table), np.int64)
            trace = np.empty((3 * self.longest, len(table)), np.int64)
            for step in range(3 * self.longest):
                here = padded[rows, pointer]
                trace[step] = here
                moves = mixed(here.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) + self.salt[w]) >> np.uint64(63)
                pointer = np.minimum(pointer + moves.astype(np.int64), lengths)
            for k in range(KEYS):
                key = np.full(len(table), self.salt[w] + np.uint64(k), np.uint64) ^ mixed(lengths.astype(np.uint64))
                for s in self.steps[w, k]:
                    key = mixed(key ^ trace[(s * 3 * lengths).astype(np.int64), rows].astype(np.uint64))
                out[:, w * KEYS + k] = key
        return out

    def held(self, n: int, code: np.ndarray) -> np.ndarray:
        """Which pairs, by code, the items of n words have."""
        mark = np.zeros(len(self.pairs) + 1, bool)
        mark[self.holds[n]] = True
        return mark[code]

    def windows(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and real words of the windows that share enough word pairs with items of
        their length. Only windows that are a whole document have fewer words than their length."""
        none = np.zeros(0, np.int64)
        if len(words) < 2 or not len(self.pairs):
            return none, none, none
        pair = words[:-1] * np.int64(self.pad + 1) + words[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = (self.pairs[at] == pair) & (doc[:-1] == doc[1:])
        code = np.append(np.where(known, at, len(self.pairs)), len(self.pairs))
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sizes = np.diff(np.append(first, len(doc)))
        starts, lengths, real = [none], [none], [none]
        for n, need in self.need.items():  # whole documents
            brief = (sizes < n) & (sizes >= n - max_edits(n))
            if brief.any():
                held = np.add.reduceat(self.held(n, code).astype(np.int64), first)
                brief &= held >= need
                starts.append(first[brief])
                lengths.append(np.full(len(starts[-1]), n, np.int64))
                real.append(sizes[brief])
        sums = np.concatenate([[0], np.cumsum(known)])
        width = min(STRETCH, len(known))
        dense = np.flatnonzero(sums[width:] - sums[:-width] >= min(self.stretch_need, width))
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(dense - self.longest, 0), 1)
        np.add.at(near, np.minimum(dense + self.longest + STRETCH, len(words)), -1)
        picked = np.flatnonzero(np.cumsum(near)[:-1] > 0)  # whole stretches of text around dense places
        gap = np.concatenate([[0], np.cumsum(np.diff(picked) > 1)]) if len(picked) else none
        part = doc[picked] * np.int64(len(picked) + 1) + gap
        code = code[picked]
        for n, need in self.need.items():
            if len(picked) < n:
                continue
            held = np.concatenate([[0], np.cumsum(self.held(n, code))])
            p = np.arange(len(picked) - n + 1)
            ok = (held[n - 1 : n - 1 + len(p)] - held[: len(p)] >= need) & (part[p] == part[p + n - 1])
            starts.append(picked[p[ok]])
            lengths.append(np.full(len(starts[-1]), n, np.int64))
            real.append(lengths[-1])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(real)

    def whole(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Matches of the short items, which stand in a text as they are."""
        for n in {len(w) for w in self.short}:
            firsts = np.array([w[0] for w in self.short if len(w) == n], np.int64)
            p = np.arange(len(words) - n + 1) if len(words) >= n else np.zeros(0, np.int64)
            p = p[np.isin(words[p], firsts) & (doc[p] == doc[p + n - 1])]
            for start, window in zip(p.tolist(), words[p[:, None] + np.arange(n)].tolist(), strict=True):
                for item in self.short.get(tuple(window), ()):
                    yield start, item, n, 0

    def candidates(self, table: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the table and items of their length that share a key, in bounded portions."""
        keys = self.keys(table, lengths)
        lo, hi = np.searchsorted(self.sorted_keys, keys, "left"), np.searchsorted(self.sorted_keys, keys, "right")
        upto = np.cumsum((hi - lo).sum(axis=1))
        a = 0
        while a < len(table):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS_HELD, "right")))
            reps = (hi[a:z] - lo[a:z]).ravel()
            window = a + np.repeat(np.arange(len(reps)) // keys.shape[1], reps)
            item = self.owner[np.repeat(lo[a:z].ravel() - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
            w, i = np.divmod(np.unique(window * np.int64(len(self.ids)) + item), len(self.ids))
            same = self.lengths[i] == lengths[w]
            yield w[same], i[same]
            a = z

    def matches(self, words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, item row, words, distance) of every window within the bound of an item."""
        out = list(self.whole(words, doc))
        starts, lengths, real = self.windows(words, doc)
        portion = max(1, min(20_000, STEPS_HELD // (3 * max(1, self.longest))))
        for a in range(0, len(starts), portion):
            s, n, m = starts[a : a + portion], lengths[a : a + portion], real[a : a + portion]
            offsets = np.arange(self.longest)
            table = np.where(offsets < m[:, None], words[np.minimum(s[:, None] + offsets, len(words) - 1)], self.pad)
            for w, i in self.candidates(table, n):
                same = (table[w] == self.table[i]).all(axis=1)
                out += zip(s[w[same]].tolist(), i[same].tolist(), n[w[same]].tolist(), repeat(0))
                # An item that stands in a document word by word has its best window there.
                settled = np.unique(doc[s[w[same]]] * np.int64(len(self.ids)) + i[same])
                rest = ~np.isin(doc[s[w]] * np.int64(len(self.ids)) + i, settled)
                w, i = w[rest], i[rest]
                step = max(1, min(5_000, STEPS_HELD // max(1, self.longest)))
                for b in range(0, len(w), step):
                    v, u = w[b : b + step], i[b : b + step]
                    d = edit_distance(table[v], self.table[u], m[v], n[v], max_edits(int(n[v].max())))
                    good = d <= (n[v] * MAX_EDIT_SHARE + 1e-9).astype(np.int64)
                    out += zip(s[v[good]].tolist(), u[good].tolist(), m[v[good]].tolist(), d[good].tolist(), strict=True)
        return out


def edit_distance(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, bound: int) -> np.ndarray:
    """Row-wise edit distance of the first len_a and len_b columns, exact up to `bound`, more than it
    beyond. One table row at a time, all pairs abreast."""
    n, far, pairs = a.shape[1], bound + 1, np.arange(len(a))
    a, b = np.ascontiguousarray(a.T.astype(np.int32)), np.ascontiguousarray(b.T.astype(np.int32))
    row = np.repeat(np.minimum(np.arange(n + 1), far).astype(np.int16)[:, None], a.shape[1], 1)
    found = np.full(len(pairs), far, np.int64)
    for i in range(1, n + 1):
        new = np.full_like(row, far)
        if i <= bound:
            new[0] = i
        lo, hi = max(1, i - bound), min(n, i + bound)
        other = np.minimum(row[lo - 1 : hi] + (b[lo - 1 : hi] != a[i - 1]), row[lo : hi + 1] + 1)
        for j in range(lo, hi + 1):
            np.minimum(other[j - lo], new[j - 1] + 1, out=new[j])
        row = np.minimum(new, far)
        ends = len_a == i
        found[ends] = row[len_b[ends], pairs[ends]]
    return found


def hits_of(texts: list[str | None], items: Items) -> list[list[dict]]:
    """For each text, its best window for each item that contaminates it."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter(map(items.code.get, chain.from_iterable(split), repeat(0)), np.int64, sizes.sum())
    doc, base = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for start, item, n, distance in items.matches(words, doc):
        key, value = (int(doc[start]), item), (distance, int(start - base[doc[start]]), n)
        if key not in best or value < best[key]:
            best[key] = value
    out: list[list[dict]] = [[] for _ in texts]
    for (d, item), (distance, start, n) in sorted(best.items()):
        out[d].append({"item_id": items.ids[item], "start_word": start, "n_words": n, "distance": distance})
    return out


def blocks(benchmark: DataFrame, held: int = WORDS_HELD) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about `held` words, all counted as long as the longest may be. Lengths are
    taken together by powers of two, short ones first, as long as they fit; what does not fit one
    block is dealt to several by hash."""
    n = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]+"))
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", n.alias("n")).where("n > 0")
    chosen = chosen.withColumn("top", F.pow(F.lit(2), F.floor(F.log2(F.greatest("n", F.lit(EDITED_FROM)).cast("double"))) + 1).cast("long"))
    groups: list[list[int]] = []  # least top, largest top, items
    for top, items in sorted(chosen.groupBy("top").agg(F.count("*")).collect()):
        if groups and (groups[-1][2] + items) * top <= held:
            groups[-1][1:] = [top, groups[-1][2] + items]
        else:
            groups.append([top, top, items])
    for low, top, items in groups:
        k = -(-items * top // held)
        for i in range(k):
            part = chosen.where(F.col("top").between(low, top) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i))
            rows = part.orderBy("item_id", "text").collect()
            if rows:
                yield [(r.item_id, r.text) for r in rows]


def with_hits(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), held: int = WORDS_HELD) -> DataFrame:
    """The carried columns as a struct `row`, and an array `hits`. A narrow pass for each block of
    items; no row leaves its task."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("text").alias("text"), F.array().cast(HIT).alias("hits"))
    for rows in blocks(benchmark, held):
        found = _pass(found, docs.sparkSession.sparkContext.broadcast(vars(Items(rows))))
    return found.select("row", "hits")


def _pass(found: DataFrame, sent) -> DataFrame:
    arrow = to_arrow_schema(found.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(sent.value)
        for batch in batches:
            texts, before = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in slices(texts):
                new = [a + b for a, b in zip(before[part], hits_of(texts[part], items), strict=True)]
                same = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([same.column(0), same.column(1), pa.array(new, arrow.field(2).type)], names=["row", "text", "hits"])

    return found.mapInArrow(run, found.schema)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance: one row for each item in each document, with
    its best window."""
    return kept(with_hits(docs, benchmark).select("row.doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*"), "benchmark-hits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, all columns as before."""
    return with_hits(docs, benchmark, tuple(docs.columns)).where(F.size("hits") == 0).select("row.*")
