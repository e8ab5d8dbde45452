"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line goes when an earlier line is equal to it, or, from `min_chars` characters on, within one edit of
it. Earliest means the smallest document id (null last), then the place in the document.

Equal lines collapse first, so what follows sees each distinct line once. Two lines within an edit
have lengths at most one apart and share their first or their last half; lines that share neither
with any other have no neighbour and need no variants. The rest emit the hash of the line and of
every variant with one character deleted. Hashes are exclusive-ors of one hash a (place, character),
so running values give all variants of a line in linear time. Equal variants join: deletions at the
same place are substitutions, a deletion equal to a whole line is an insertion. Both kinds of groups
are bounded by the alphabet, whatever the number of copies. Pairs are verified by edit distance.

Defined cases: null text has no lines; lines without a word (white space only) are never dropped nor
compared; repeated rows with equal id and text count as one document and are treated alike;
ties of id go by the hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import doc_key, empty_text, forget, kept, met, met_once, small_or_not

#: Unless the caller says otherwise, lines of fewer characters are only compared for equality: they are
#: single words mostly, which one edit turns into other words ("A.", "An."). With 1 there is no floor.
MIN_CHARS = 12
#: Rows of one or two hashes that may be sent to every executor; beyond, the join shuffles, lines after a
#: filter of fixed size and without their copies.
BROADCAST_ROWS = 200_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_hashes() -> list[Column]:
    line = F.col("line")
    return [F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line, F.length(line)).alias("h2")]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, line_no, line, h1, h2 of every line with a word."""
    each = docs.select("doc_id", *doc_key(), F.posexplode(lines_of(empty_text())).alias("line_no", "line"))
    return each.where(has_word(F.col("line"))).select("*", *line_hashes())


def halves() -> Column:
    """Hashes of the first and last half, for pairs of lines whose shorter has n or n - 1 characters."""
    line, n = F.col("line"), F.length("line")

    def of(shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        return [
            F.xxhash64(F.lit("first"), shorter, F.substring(line, F.lit(1), half)),
            F.xxhash64(F.lit("last"), shorter, F.substring(line, n - half + 1, half)),
        ]

    return F.array(*of(n), *of(n - 1))


def distinct_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, place of the earliest occurrence, its number of occurrences, and the half hashes."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "line_no")
    shares = F.when(F.length("line") >= min_chars, halves())
    each = rows.select("h1", "h2", place.alias("place"), *[F.get(shares, F.lit(i)).alias(f"s{i}") for i in range(4)])
    firsts = [F.first(f"s{i}").alias(f"s{i}") for i in range(4)]
    return each.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *firsts)


def with_company(distinct: DataFrame) -> DataFrame:
    """h1 of lines that share a half with another line. A half of many lines is a hot key."""
    shares = distinct.where(F.col("s0").isNotNull()).select("h1", F.explode(F.array_distinct(F.array("s0", "s1", "s2", "s3"))).alias("share"))
    common = kept(shares.groupBy("share").agg(F.count("*").alias("sharers")).where("sharers > 1"), "shared-halves")
    total = common.agg(F.sum("sharers")).first()[0] or 0
    return met(shares, common, ["share"], ["h1"], "sharers", total).where(F.col("sharers").isNotNull()).select("h1").distinct()


def letter_hash(at: Column, letter: Column) -> Column:
    return F.xxhash64(at, letter)


def wholes(texts: DataFrame) -> DataFrame:
    """h1, h2, n (characters), whole: the exclusive-or of the line's letter hashes."""
    letters = F.transform(F.split("line", ""), lambda c, i: letter_hash(i, c))
    whole = F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return texts.select("h1", "h2", F.length("line").alias("n"), whole.alias("whole"))


def variants(texts: DataFrame) -> DataFrame:
    """h1, h2, n (characters left), at, variant: the hash of the line without the character at `at`.
    Lines are dealt out before they are taken apart, so their letters stay where they are."""
    dealt = texts.select("h1", "h2", "line").repartition("h1", "h2")
    chars = dealt.select("h1", "h2", F.length("line").alias("n"), F.posexplode(F.split("line", "")).alias("at", "c"))
    by = Window.partitionBy("h1", "h2").orderBy("at")
    before, upto, all_of = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("h1", "h2")
    head = F.coalesce(F.bit_xor("here").over(before), F.lit(0).cast("long"))
    tail = F.bit_xor("moved").over(all_of).bitwiseXOR(F.bit_xor("moved").over(upto))
    hashed = chars.select("h1", "h2", "n", "at", letter_hash(F.col("at"), F.col("c")).alias("here"), letter_hash(F.col("at") - 1, F.col("c")).alias("moved"))
    return hashed.select("h1", "h2", (F.col("n") - 1).alias("n"), "at", head.bitwiseXOR(tail).alias("variant"))


def near_pairs(texts: DataFrame) -> DataFrame:
    """h1, h2 of a line, e1, e2 of an earlier line within one edit of it. texts: h1, h2, line, place.

    A variant goes under the key of its length, place and hash, where substitutions meet; and if its
    hash is that of a whole line, under the key that this line goes under too. Keys of one line end
    there; what is left is small."""
    whole = kept(wholes(texts), "whole-lines")
    known = whole.select("n", F.col("whole").alias("variant"), F.lit(True).alias("grown")).distinct()
    cut = variants(texts).join(small_or_not(kept(known, "whole-hashes"), BROADCAST_ROWS), ["n", "variant"], "left")
    swap = F.struct(F.xxhash64("n", "variant", "at").alias("key"), F.lit(0).alias("kind"))
    grow = F.when(F.col("grown"), F.struct(F.xxhash64("n", "variant").alias("key"), F.lit(1).alias("kind")))
    emitted = cut.select("h1", F.explode(F.array_compact(F.array(swap, grow))).alias("v")).select("h1", "v.key", "v.kind")
    emitted = emitted.unionByName(whole.select("h1", F.xxhash64("n", "whole").alias("key"), F.lit(2).alias("kind")))
    # A key's lines differ in one character at one place, or are one line and its insertions.
    by = Window.partitionBy("key")
    met = kept(emitted.withColumns({"lo": F.min("h1").over(by), "hi": F.max("h1").over(by)}).where("lo != hi").select("key", "h1", "kind").distinct(), "met-lines")
    me = F.struct("place", "h1", "h2")
    placed = met.join(texts.select("h1", "h2", "place"), "h1").select("key", "kind", me.alias("me"))
    first = F.min("me").over(Window.partitionBy("key"))
    swapped = placed.where("kind = 0").select(F.col("me").alias("late"), first.alias("e")).where("late != e")
    lines_, grown = placed.where("kind = 2").select("key", F.col("me").alias("a")), placed.where("kind = 1").select("key", F.col("me").alias("b"))
    both = lines_.join(grown, "key").select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("e"))
    pairs = swapped.unionByName(both).select("late.h1", "late.h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    line = texts.select("h1", "h2", "line")
    early = line.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("early"))
    checked = pairs.join(line, ["h1", "h2"]).join(early, ["e1", "e2"])
    return checked.where(F.levenshtein("line", "early", 1).between(0, 1)).select("h1", "h2", "e1", "e2")


def drops(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, exact, near: numbers of the lines that go because an earlier line is equal, or else
    within an edit; documents that lose no line have no row."""
    rows = lines(docs)
    distinct = kept(distinct_lines(rows, min_chars), "distinct-lines")
    company = kept(with_company(distinct), "lines-in-company")
    long = rows.where(F.length("line") >= min_chars).select("h1", "h2", "line")
    texts = met_once(long, company, "h1", ["h1", "h2"], BROADCAST_ROWS)
    vary = kept(texts.join(distinct.select("h1", "h2", "place"), ["h1", "h2"]), "lines-to-vary")
    near = near_pairs(vary).select("h1", "h2").distinct()
    told = distinct.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near"))
    verdicts = kept(told.select("h1", "h2", "n", "place", F.coalesce("near", F.lit(False)).alias("near")), "line-verdicts")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    forget(distinct, company, vary)
    found = met(rows.select("h1", "h2", "k1", "k2", "line_no"), verdicts, ["h1", "h2"], ["k1", "k2", "line_no"], "n", total).where(F.col("place").isNotNull())
    first = (F.col("k1") == F.col("place.k1")) & (F.col("k2") == F.col("place.k2")) & (F.col("line_no") == F.col("place.line_no"))
    return (
        found.where(~first | F.col("near"))
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set(F.when(~first, F.col("line_no")))).alias("exact"), F.array_sort(F.collect_set(F.when(first, F.col("line_no")))).alias("near"))
    )


def mark(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, its lines with words, and the numbers of those that go."""
    none = F.array().cast("array<int>")
    n_lines = F.size(F.filter(lines_of(empty_text()), has_word)).cast("long")
    every = docs.select("doc_id", *doc_key(), n_lines.alias("n_lines"))
    return every.join(drops(docs, min_chars), ["k1", "k2"], "left").select("doc_id", "n_lines", F.coalesce("exact", none).alias("exact"), F.coalesce("near", none).alias("near"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that go, all columns as before; a document that loses its last line
    with a word goes too. Only the text changes."""
    gone = drops(docs, min_chars).select("k1", "k2", F.concat("exact", "near").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key())
    cut = rows.join(gone, ["k1", "k2"], "left").withColumn("lines", lines_of(empty_text("row.text")))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(numbers, "gone"), lambda i: F.get(F.col("lines"), i))
    cut = cut.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")))
    columns = [F.coalesce("left", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return cut.where(F.col("left").isNull() | has_word(F.col("left"))).select(*columns)
