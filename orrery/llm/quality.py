"""Quality rules: counts of words, symbols and repetition, and the fertility of a public tokenizer.

A document fails the base rules when it has too few words or when too many of its words stand in
repeated 8-word windows. What is left is held against rejection bands, one per language or else per
script, on three figures of a public vocabulary: characters per token, share of byte-fallback
tokens, and the entropy of the document's token distribution.

Bands are of two kinds, and a document has to keep to both: fixed outer ones (BANDS), and ones
derived from the figures of all documents that pass the base rules. These are fences around the
quartiles of each band and length class (half powers of two of the word count), with entropy
relative to log2 of the tokens. Documents of equal figures count once, so copies do not move a fence;
figures are counted in steps of 0.001, so quartiles are exact sums whatever the partitioning. A class of
fewer than MIN_DOCS distinct documents is pooled with the nearest length classes of its band, one distance
after the other, until they have as many. As figures move with the length (longer texts repeat more of
their tokens), those of other classes are moved along the band's straight trend, and fences lie
1 + d times as far out, d being the mean distance of the pool. A band of fewer documents in all is one pool,
whose fences lie MIN_DOCS / n times as far out again, as a handful says little. No document goes unfenced.

Defined cases: a null text counts as empty (0 words, rejected by the base rules); null or unknown
languages take the band of the text's script; repeated rows are judged alike, row by row; columns
of the input other than the named ones are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from orrery.llm.common import kept, slices

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
CACHED_WORDS = 200_000
#: Distinct documents from which a length class has fences of its own; below, neighbours join it.
MIN_DOCS = 30
#: Fences lie so many interquartile ranges below the first or above the third quartile.
BELOW, ABOVE = 2.0, 3.0
#: The least interquartile range of each figure that counts, for classes of much alike documents.
MIN_RANGE = {"chars_per_token": 0.04, "byte_share": 0.02, "relative_entropy": 0.015}


@dataclass(frozen=True)
class Band:
    """What a clean text may measure. Texts that pass the base rules have MIN_WORDS tokens or more, so up to
    4.3 bits of entropy at the least, and the lower bound binds them all."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: Bands by language, then by script. Kept wide: they are to catch text that is no prose
#: (encoded data, wrong encodings, one token over and over), not unusual prose.
BANDS = {
    "en": Band(1.25, 9.0, 0.20, 2.0),
    "de": Band(1.25, 9.0, 0.25, 2.0),
    "fr": Band(1.20, 9.0, 0.25, 2.0),
    "es": Band(1.20, 9.0, 0.25, 2.0),
    "latin": Band(1.10, 9.0, 0.30, 2.0),
    "cyrillic": Band(1.00, 8.0, 0.30, 2.0),
    "cjk": Band(0.30, 4.0, 0.85, 2.0),
    "other": Band(0.25, 9.0, 0.95, 1.5),
}

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, chars_per_token double, byte_share double, "
    "token_entropy double, band string"
)
INNER_COLUMNS = COLUMNS + ", n_tokens long"


def script_of(text: str) -> str:
    """The script of most letters, by code point ranges."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    letters = codes[(codes >= 0x41) & ~((codes > 0x7A) & (codes < 0xC0))]
    if not len(letters):
        return "latin"
    share = {
        "latin": np.count_nonzero(letters < 0x250),
        "cyrillic": np.count_nonzero((letters >= 0x400) & (letters < 0x530)),
        "cjk": np.count_nonzero((letters >= 0x3040) & (letters < 0xA000)) + np.count_nonzero((letters >= 0xAC00) & (letters < 0xD7A4)),
    }
    best = max(share, key=share.get)
    return best if 2 * share[best] >= len(letters) else "other"


class Vocabulary:
    """A public piece vocabulary with byte fallback. Words are encoded one by one, as its pieces
    never cross white space, and the most recent ones are remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.size = len(self.is_byte)
        self.known: dict[bytes, list[int]] = {}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        new = [w for w in words if w not in self.known]
        ids = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
        fresh = dict(zip(new, ids, strict=True))
        out = [self.known[w] if w in self.known else fresh[w] for w in words]
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.known.clear()
        self.known.update(fresh if len(fresh) <= CACHED_WORDS else {})
        return out


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document inside 8-word windows that the document has twice or more. Windows
    are named exactly, by naming pairs of names: 2, 4, then 8 words."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(n_docs, np.int64)
    names, width = words, 1
    while width < WINDOW:
        names = pd.factorize(names[:-width] * np.int64(n + 1) + names[width:])[0]
        width *= 2
    inside = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    names = pd.factorize(names[starts] * np.int64(n_docs) + doc[starts])[0]
    starts = starts[np.bincount(names)[names] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover)[:n] > 0], minlength=n_docs)


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


def measure(texts: list[str | None], langs: list[str | None], vocabulary: Vocabulary, bands: dict[str, Band]) -> dict[str, list]:
    n_docs = len(texts)
    texts = [t or "" for t in texts]
    raw = [t.encode("utf-8", "replace").split() for t in texts]  # bytes.split: ASCII white space only
    n_words = np.array([len(w) for w in raw], np.int64)
    doc = np.repeat(np.arange(n_docs), n_words)
    flat = np.empty(len(doc), object)
    flat[:] = [w for ws in raw for w in ws]
    names, distinct = pd.factorize(flat)
    names = names.astype(np.int64)
    tokens = vocabulary.encode(list(distinct))
    lengths = np.array([len(t) for t in tokens], np.int64)
    ids = np.fromiter((i for t in tokens for i in t), np.int64, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    bytes_of = np.array([vocabulary.is_byte[ids[s : s + k]].sum() for s, k in zip(starts, lengths, strict=True)], np.int64)
    chars = np.array([len(w.decode("utf-8", "replace")) for w in distinct], np.int64)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, n_docs).astype(np.int64)

    word_chars, n_tokens, n_bytes = (per_doc(x[names]) if len(names) else np.zeros(n_docs, np.int64) for x in (chars, lengths, bytes_of))
    # Token counts of each document: (document, word) counts first, then their tokens.
    pair, pair_count = np.unique(doc * np.int64(max(1, len(distinct))) + names, return_counts=True)
    word = pair % max(1, len(distinct))
    each = lengths[word] if len(word) else np.zeros(0, np.int64)
    at = np.repeat(starts[word] - (np.cumsum(each) - each), each) + np.arange(each.sum()) if len(word) else np.zeros(0, np.int64)
    key, inverse = np.unique(np.repeat(pair // max(1, len(distinct)), each) * vocabulary.size + ids[at], return_inverse=True)
    count = np.bincount(inverse, np.repeat(pair_count, each)) if len(key) else np.zeros(0)
    share = count / np.maximum(n_tokens, 1)[key // vocabulary.size]
    entropy = np.round(np.bincount(key // vocabulary.size, -share * np.log2(share), n_docs), 6)

    repeat = repeated_words(names, doc, n_docs)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    fertility = np.round(word_chars / np.maximum(n_tokens, 1), 6)
    byte_share = np.round(n_bytes / np.maximum(n_tokens, 1), 6)
    band = [lang if lang in bands else script_of(t) for lang, t in zip(langs, texts, strict=True)]
    keeps = [
        bool(not failed and b.min_chars_per_token <= f <= b.max_chars_per_token and s <= b.max_byte_share and e >= b.min_entropy)
        for failed, f, s, e, b in zip(base_failed, fertility, byte_share, entropy, (bands[x] for x in band), strict=True)
    ]
    return {
        "n_words": n_words, "word_chars": word_chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": [duplicate_lines(t) for t in texts], "n_repeat_words": repeat,
        "base_failed": base_failed, "kept": keeps,
        "chars_per_token": fertility, "byte_share": byte_share, "token_entropy": entropy, "band": band, "n_tokens": n_tokens,
    }


def measured(docs: DataFrame, vocabulary_path: str | None, bands: dict[str, Band] | None, carry: tuple[str, ...]) -> DataFrame:
    """One row per document: the carried columns as _0, _1, ..., the counts and the fertility figures;
    `kept` is by the base rules and the outer bands. A narrow pass over the rows."""
    used = BANDS | (bands or {})
    chosen = docs.select("text", "lang", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)])
    schema = StructType([*chosen.schema.fields[2:], *_parse_datatype_string(INNER_COLUMNS).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        vocabulary = Vocabulary(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                figures = measure(texts[part], rows.column(1).to_pylist(), vocabulary, used)
                columns = [rows.column(2 + i) for i in range(len(carry))]
                columns += [pa.array(figures[f.name], f.type) for f in list(arrow)[len(carry) :]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return chosen.mapInArrow(run, schema)


def in_classes(figures: DataFrame) -> DataFrame:
    """Adds length_class and relative_entropy."""
    bits = F.log2(F.greatest("n_tokens", F.lit(2)).cast("double"))
    return figures.withColumns({"length_class": F.floor(2 * F.log2(F.greatest("n_words", F.lit(2)).cast("double"))), "relative_entropy": F.col("token_entropy") / bits})


def pools(sizes: DataFrame) -> DataFrame:
    """band, length_class, other, distance: the length classes whose documents speak for a class. They come by distance,
    those of one distance together, until MIN_DOCS are reached. sizes: band, length_class, size; a band has
    some 60 length classes at most, whatever the table."""
    others = sizes.select("band", F.col("length_class").alias("other"), "size")
    pairs = sizes.select("band", "length_class").join(others, "band").withColumn("distance", F.abs(F.col("length_class") - F.col("other")))
    nearer = Window.partitionBy("band", "length_class").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("reached", F.coalesce(F.sum("size").over(nearer), F.lit(0))).where(F.col("reached") < MIN_DOCS).select("band", "length_class", "other", "distance")


def trends(steps: DataFrame) -> DataFrame:
    """band, figure, slope: least squares of a figure over the length classes of its band, 0 where there is one
    class. Sums are of whole thousandths, so they do not hang on the partitioning. steps: band, other, figure,
    value, n."""
    n, x, y = F.col("n"), F.col("other"), F.round(1000 * F.col("value")).cast("long")
    sums = steps.groupBy("band", "figure").agg(*[F.sum(c).cast("double").alias(k) for k, c in {"s": n, "x": n * x, "y": n * y, "xx": n * x * x, "xy": n * x * y}.items()])
    spread = F.col("s") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("s") * F.col("xy") - F.col("x") * F.col("y")) / spread / 1000).otherwise(0.0)
    return sums.select("band", "figure", slope.alias("slope"))


def fences(figures: DataFrame) -> DataFrame:
    """band, length_class, and the low and high fence of each figure. At most one row for a band and
    half power of two, whatever the table."""
    sound = figures.where(~F.col("base_failed")).select("band", "n_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.round(k, 3).alias("value")) for k in MIN_RANGE])).alias("f")
    steps = in_classes(sound).select("band", F.col("length_class").alias("other"), each).groupBy("band", "other", "f.figure", "f.value").agg(F.count("*").alias("n"))
    steps = kept(steps, "quality-steps")
    one = steps.where(F.col("figure") == next(iter(MIN_RANGE)))
    sizes = one.groupBy("band", F.col("other").alias("length_class")).agg(F.sum("n").alias("size"))
    moved = F.round(F.col("value") + F.col("slope") * (F.col("length_class") - F.col("other")), 3)
    pooled = steps.join(F.broadcast(pools(sizes)), ["band", "other"]).join(F.broadcast(trends(steps)), ["band", "figure"])
    pooled = pooled.groupBy("band", "length_class", "figure", moved.alias("value")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("distance")).alias("far"))
    quartiles = pooled.groupBy("band", "length_class", "figure").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.percentile("value", [0.25, 0.75], F.col("n")).alias("q"))
    least = F.create_map(*[F.lit(x) for pair in MIN_RANGE.items() for x in pair])
    reach = F.greatest(F.col("q")[1] - F.col("q")[0], least[F.col("figure")]) * (1 + F.col("far") / F.col("n")) * F.greatest(F.lit(1.0), MIN_DOCS / F.col("n"))
    limits = quartiles.select("band", "length_class", "figure", (F.col("q")[0] - BELOW * reach).alias("low"), (F.col("q")[1] + ABOVE * reach).alias("high"))
    of = {f"{k}_{end}": F.max(F.when(F.col("figure") == k, F.col(end))) for k in MIN_RANGE for end in ("low", "high")}
    return limits.groupBy("band", "length_class").agg(*[c.alias(k) for k, c in of.items()])


def fenced(figures: DataFrame) -> DataFrame:
    """figures, a kept table, with `kept` by the fences too."""
    columns = figures.columns
    limits = F.broadcast(fences(figures))
    # Much entropy is no fault of its own: random text already shows in its characters per token.
    inside = F.col("chars_per_token").between(F.col("chars_per_token_low"), F.col("chars_per_token_high")) & (F.col("byte_share") <= F.col("byte_share_high")) & (F.col("relative_entropy") >= F.col("relative_entropy_low"))
    joined = in_classes(figures).join(limits, ["band", "length_class"], "left")
    return joined.withColumn("kept", F.col("kept") & F.coalesce(inside, F.lit(True))).select(*columns)


def judge(docs: DataFrame, vocabulary_path: str | None = None, bands: dict[str, Band] | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns, the counts, the fertility figures and `kept`.
    Measured once, and held against the fences of all; memory follows the longest text.
    vocabulary_path: a piece model that every executor can open; by default the public tokenizer
    package's byte-fallback model. bands: outer bands to add or replace."""
    found = fenced(kept(measured(docs, vocabulary_path, bands, carry), "quality-figures"))
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)], *_parse_datatype_string(COLUMNS).names)


def keep_good(docs: DataFrame, vocabulary_path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    whole = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sound = measured(whole, vocabulary_path, bands, ("row",)).where(~F.col("base_failed"))
    return fenced(kept(sound, "quality-figures")).where("kept").select("_0.*")
