"""Shared helpers of the corpus operators: columns, keys, tables kept in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of kept tables hold so many bytes, so that long texts come few at a time.
BATCH_BYTES = str(8 << 20)
#: A key is hot if it has more than one in SHARE of all rows and more than HOT_ROWS; there are fewer
#: than SHARE hot keys, whatever the table.
SHARE, HOT_ROWS = 10_000, 1_000
#: Bits of a filter of wanted keys: a table of at most SIFT_BITS / 64 rows of 16 bytes (8 MB), whatever it filters.
SIFT_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the text contracts: runs without ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or the warehouse where the
    session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost
    executor costs no recomputation of what went into it. Pressed by zstd, as some hold whole texts."""
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path = f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes kept tables of which nothing is read any more, since a later table holds the result."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files and "/orrery/" in files[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def met(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with facts by keys (longs). facts: a kept table with one row a key, and in
    `weight` the number of rows of that key, of `total` rows in all. Facts of hot keys, of which there
    are fewer than SHARE, are sent to every executor, and their rows are dealt out by the `spread`
    columns; all others meet by a shuffle. So no key's rows land in one task."""
    limit = max(HOT_ROWS, total // SHARE)
    packed = facts.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], F.col(weight).alias("_w"), F.struct(*[c for c in facts.columns if c not in keys]).alias("_v"))
    hot = packed.where(F.col("_w") > limit).select(*[F.col(f"_f{i}").alias(f"_h{i}") for i in range(len(keys))], F.col("_v").alias("_hv"))
    rest = packed.where(F.col("_w") <= limit).drop("_w")
    same = [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)]
    marked = rows.join(F.broadcast(hot), reduce(lambda a, b: a & b, same), "left")
    at = F.when(F.col("_h0").isNotNull(), F.xxhash64(*spread)).otherwise(F.col(keys[0]))
    marked = marked.withColumn("_at", at)
    same = [F.col("_at") == F.col("_f0"), *[F.col(k) == F.col(f"_f{i}") for i, k in enumerate(keys) if i]]
    found = marked.join(rest, reduce(lambda a, b: a & b, same), "left")
    return found.select(*rows.columns, F.coalesce("_hv", "_v").alias("_v")).select(*rows.columns, "_v.*")


def empty_text(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """k1, k2: 128 bits that name a document by its id and whole text, never null. Equal rows share
    a key, which every operator that groups by it allows for."""
    return [
        F.xxhash64(F.lit(1), F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit(2), F.col(text), F.col(doc_id), F.length(text)).alias("k2"),
    ]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are. Pure ASCII goes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def slices(column, budget: int = 2_000_000) -> Iterator[slice]:
    """Row ranges of an Arrow or pandas batch that hold about `budget` characters each; a single
    longer text is a range of its own, so memory follows the longest text and not the batch."""
    start = total = 0
    for i, text in enumerate(column):
        size = len(text) if text is not None else 0
        if i > start and total + size > budget:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(column):
        yield slice(start, len(column))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<before,match>>: each leftmost non-overlapping match with the code points of
    the piece between it and the previous match. Running sums of both give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    return F.when(
        text.rlike(pattern),
        F.zip_with(
            F.slice(pieces, 1, F.size(matches)),
            matches,
            lambda p, m: F.struct(F.char_length(p).cast("long").alias("before"), m.alias("match")),
        ),
    )


def ungrouped(pattern: str) -> str:
    """The pattern with its capturing groups made non-capturing."""
    return re.sub(r"\((?!\?)", "(?:", pattern)


def small_or_not(df: DataFrame, max_rows: int) -> DataFrame:
    """A kept table marked for broadcast if its rows, counted, are few enough; as it is otherwise,
    so that a join with it shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose `key` (a long) is not in wanted: a Bloom filter of fixed size, kept as
    a table of 64-bit words and sent to every executor. It never loses a wanted row; of n wanted keys it lets
    a share of 1 - exp(-n / SIFT_BITS) of the others pass."""
    bit = F.pmod(F.xxhash64(F.lit("sift"), key), F.lit(SIFT_BITS))
    marks = wanted.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(_bit % 64 AS int))").alias("_mask"))
    words = kept(marks.groupBy("_word").agg(F.bit_or("_mask").alias("_mask")), "sift")
    asked = rows.withColumn("_bit", bit).join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_word"))
    return asked.where("(shiftright(_mask, cast(_bit % 64 AS int)) & 1) = 1").select(*rows.columns)


def met_once(rows: DataFrame, facts: DataFrame, key: str, once: list[str], max_rows: int) -> DataFrame:
    """rows joined with facts by `key` (a long), one row for each value of `once`, which holds the key. facts: a
    kept table with one row a key. Up to max_rows of them, counted, are sent to every executor. Beyond, rows
    pass a filter of fixed size and their copies go, task by task first, before the join shuffles what is left:
    one row a task and value of `once` is the most that meets, however many copies there are."""
    if facts.count() <= max_rows:
        return rows.join(F.broadcast(facts), key).dropDuplicates(once)
    return sifted(rows, facts, key).dropDuplicates(once).join(facts, key)
