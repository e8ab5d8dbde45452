r"""WARC archives, written from tables and read back by boundary chains.

Writing. A payload is named by its SHA-256. Of records with equal payloads of MIN_COPY bytes or more the one
with the smallest id is a response; the others revisit it and carry no payload. A record is an HTTP
message under a WARC head; Spark's text writer puts it into a file for each partition, with the
blank lines between records as its line separator, so payloads go out as they are.

Reading. Files are cut into blocks of bytes, and a file's text is split wherever the magic of a record's
first line stands, be it in a payload. Each task of a first scan looks at the pieces of its blocks:
a piece with a length in its head is a candidate record, and that length names the offset of its
successor. The task follows these links to where they leave the block and emits one hop for each
candidate. Blocks are placed by the sum of the bytes before them. From offset 0 of each file pointer
jumping (every hop is joined with itself, so rounds are logarithmic in the blocks of a file) finds
where the true chain enters each block, and whether it meets the end of the file. A second scan follows
the chain from there: what it passes over is payload, whatever it looks like. A record that the
magic cut, or a block's end, is put together from its pieces.

Both scans read the same blocks, whatever executors come and go: they belong to a session of their own
with fixed sizes. Nothing is sent around but places of blocks.

Defined cases: a null payload is empty; a null uri leaves its line out; line ends in a uri are written as
%0D and %0A. Ids are long; a null id is never the smallest, and copies that all have null ids are
all responses, as are rows that repeat both id and payload of the smallest. Columns other than those named are
ignored. An empty table makes archives without records. A file is read up to the first place where no
record stands at its predecessor's end, or where one claims more bytes than the file has; a file that
does not begin with a record gives none. `complete` tells whether its chain met the end of its file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import BATCH_BYTES, forget, kept, met, shared_dir, small_or_not

#: Fixed values of the format.
MAGIC, BREAK = "WARC/1.0\r\n", "\r\n\r\n"
MIN_COPY = 100
#: Rows that may be sent to every executor: hashes of copied payloads, or places of blocks.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
HOP = "file string, block long, rel long, leaves long, size long"
PIECE = "file string, ends long, at long, whole boolean, complete boolean, value string"


def named(digest: Column) -> list[Column]:
    """d1, d2: 120 bits of a hexadecimal digest."""
    return [F.conv(F.substring(digest, i, 15), 16, 10).cast("long").alias(n) for i, n in ((1, "d1"), (16, "d2"))]


def deduplicated(rows: DataFrame, min_copy: int = MIN_COPY) -> DataFrame:
    """id, uri, payload, digest, n_bytes, first: the id that a revisit refers to, null for a response. Only
    digests are shuffled to find copies; payloads meet them by broadcast while there are few copied
    ones, and else by a shuffle that deals out the most frequent."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("uri").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    rows = rows.select("*", *named(F.col("digest")))
    sizes = rows.where(F.col("n_bytes") >= min_copy).groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    copies = kept(sizes.where("n > 1 and least is not null"), "copies")
    if copies.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(copies), ["d1", "d2"], "left")
    else:
        rows = met(rows, copies, ["d1", "d2"], ["id", "uri"], "n", rows.count())
    again = (F.col("n_bytes") >= min_copy) & F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    return rows.select("id", "uri", "payload", "digest", "n_bytes", F.when(again, F.col("least")).alias("first"))


def record_id(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """The bytes of each record, without the blank lines behind it, as the column `value`."""
    copy = F.col("first").isNotNull()

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.col("n_bytes").cast("string")), F.lit("\r\n"))
    uri = F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(copy, F.lit(b"")).otherwise(F.col("payload"))
    length = F.octet_length(http) + F.octet_length(body)
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(copy, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", date),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(copy, F.concat(line("WARC-Refers-To", record_id(F.col("first"))), line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))


def write(rows: DataFrame, path: str, min_copy: int = MIN_COPY, date: str = DATE) -> None:
    """Archives of rows (id, uri, payload) in a new folder, a file for each partition."""
    records(deduplicated(rows, min_copy), date).write.option("lineSep", BREAK).text(path)


def reading_session(spark: SparkSession, block_bytes: int | None) -> SparkSession:
    """A session whose file blocks have a fixed size: both scans of a read must see the same."""
    own = spark.newSession()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes") if block_bytes is None else str(block_bytes)
    held = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.minPartitionNum": "1", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(key, None) is not None:
            held[key] = spark.conf.get(key)
    for key, value in held.items():
        own.conf.set(key, value)
    return own


def pieces(own: SparkSession, path: str) -> DataFrame:
    """file, block (where it starts), value, size in bytes, need: the bytes of the whole record with its
    magic and the blank lines behind it, null where the piece's head names no length. In the file's order
    within each block. The piece at a file's start has no magic before it and is empty."""
    lines = own.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    head = F.substring_index("value", BREAK, 1)
    digits = F.regexp_extract(head, r"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1)
    need = len(MAGIC) + F.octet_length(head) + 2 * len(BREAK) + F.when(digits != "", digits.cast("long"))
    return lines.select("file", "block", "value", F.octet_length("value").cast("long").alias("size"), need.cast("long").alias("need"))


def spans(size: np.ndarray, first: bool) -> tuple[np.ndarray, int]:
    """Where each piece of a block begins (its magic), from the block's first piece on, and where the last ends."""
    full = size + len(MAGIC)
    if first and len(full):
        full[0] -= len(MAGIC)
    ends = np.cumsum(full)
    return ends - full, int(ends[-1]) if len(ends) else 0


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[pa.RecordBatch]]]:
    """The batches' rows by block; a task has its blocks one after the other."""
    own, parts = None, []
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[at], starts[at]):
                if own is not None and own != (files[at], starts[at]):
                    yield *own, parts
                    parts = []
                own = files[at], starts[at]
                parts.append(batch.slice(at, i - at))
                at = i
    if own is not None:
        yield *own, parts


def hops(found: DataFrame) -> DataFrame:
    """HOP rows: for each candidate of a block, by its place from the block's first piece on, the place
    beyond the block where the links from it lead (null: they break), and the block's bytes. A row without
    a place gives the bytes of a block that has no candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, parts in by_block(batches):
            size, need = (np.concatenate([p.column(i).fill_null(0).to_numpy() for p in parts]) for i in (2, 3))
            at, total = spans(size, block == 0)
            some = np.flatnonzero(need)
            at, to = at[some], at[some] + need[some]
            if block == 0 and len(some) and some[0] == 0:
                at, to = at[1:], to[1:]  # no magic stands before the first piece
            place = np.searchsorted(at, to)
            inside = to < total
            alive = ~inside | ((place < len(at)) & (at[np.minimum(place, len(at) - 1)] == to)) if len(at) else inside
            leaves = np.where(alive, to, -1)
            step = np.where(alive & inside, place, -1)
            while (step >= 0).any():  # jumps within the block
                go = np.flatnonzero(step >= 0)
                target = step[go]
                leaves[go] = leaves[target]
                step[go] = step[target]
            n = max(1, len(at))
            rel, out = (at, leaves) if len(at) else (np.array([-1]), np.array([-1]))
            columns = [pa.array([file] * n), pa.array(np.full(n, block)), pa.array(rel, mask=rel < 0), pa.array(out, mask=out < 0), pa.array(np.full(n, total))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HOP.split(", ")])

    return found.select("file", "block", "size", "need").mapInArrow(run, HOP)


def entries(links: DataFrame) -> DataFrame:
    """file, block, base (the offset of its first piece), ends (where the record that reaches into the block
    ends: the offset of the block's first true record, if it has one; null past a break), last (the
    file's end), complete. links: a kept table of hops."""
    sizes = links.groupBy("file", "block").agg(F.max("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    placed = kept(sizes.select("file", "block", F.coalesce(before, F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy("file")).alias("last")), "blocks")
    few = small_or_not(placed, BROADCAST_ROWS)
    leads = links.where("rel is not null").join(few, ["file", "block"])
    to = F.col("base") + F.col("leaves")
    leads = leads.select("file", "block", (F.col("base") + F.col("rel")).alias("at"), F.when(to <= F.col("last"), to).alias("to"))
    # Only places where some block is entered matter: few for a block.
    asked = leads.where("to is not null").select("file", F.col("to").alias("at")).unionByName(placed.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    asked = kept(asked, "entered")
    hop = kept(leads.join(small_or_not(asked, BROADCAST_ROWS), ["file", "at"]).select("file", "block", "at", "to"), "hops")
    reached = kept(placed.select("file", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    jump, n = hop.where("to is not null").select("file", "at", "to"), 0
    while (now := reached.count()) > n:
        n, before = now, reached
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = kept(reached.unionByName(more).distinct(), "reached")
        forget(before)
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")))
        jump = kept(twice.select("a.file", "a.at", "b.to"), "jumps")
    entered = reached.join(hop, ["file", "at"]).groupBy("file", "block").agg(F.min(F.struct("at", "to")).alias("way"))
    met_end = reached.join(placed.groupBy("file").agg(F.max("last").alias("at")), ["file", "at"]).select("file", F.lit(True).alias("met_end"))
    rows = placed.join(entered, ["file", "block"], "left").join(met_end, "file", "left")
    came = F.max("way.to").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = F.coalesce("way.at", F.when(came > F.col("base"), came))
    return rows.select("file", "block", "base", ends.alias("ends"), "last", F.coalesce("met_end", F.lit(False)).alias("complete"))


def chained(found: DataFrame, places: DataFrame) -> DataFrame:
    """PIECE rows: pieces of true records. `at` is the piece's offset and `ends` its record's end, which
    names the record among those of a file; whole records are one piece."""
    # Few blocks are sent out, and rows stay in order; else they meet by block and are put in order again.
    found = found.withColumn("turn", F.monotonically_increasing_id())
    if places.count() <= BROADCAST_ROWS:
        rows = found.join(F.broadcast(places), ["file", "block"])
    else:
        rows = found.join(places, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "turn")
    rows = rows.where("ends is not null").select("file", "block", "size", "need", "base", "ends", "last", "complete", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, expected, within = None, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            files, block, size, need, base, ends, last = (batch.column(i).to_pylist() for i in range(7))
            keep, place, until, whole = [], [], [], []
            for i in range(n):
                if own != (files[i], block[i]):
                    own, at, first = (files[i], block[i]), base[i], block[i] == 0
                    expected = within = ends[i]
                    if first:
                        expected = 0
                else:
                    first = False
                here, at = at, at + size[i] + (0 if first else len(MAGIC))
                if first:
                    continue
                if here == expected and need[i] is not None and here + need[i] <= last[i]:
                    within = expected = here + need[i]
                    whole.append(at == expected)
                elif here < expected and here < within:
                    whole.append(False)
                else:
                    expected = within = -1  # the chain has broken
                    continue
                keep.append(i), place.append(here), until.append(within)
            if keep:
                some = pa.array(keep)
                columns = [batch.column(0).take(some), pa.array(until, pa.int64()), pa.array(place, pa.int64()), pa.array(whole), batch.column(7).take(some), batch.column(8).take(some)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECE.split(", ")])

    return rows.mapInArrow(run, PIECE)


def read(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """file, offset, complete, type, id, uri, refers_to, declared (the digest its head names), payload
    (binary) of each record in the archives under a path. block_bytes: the size of a task's block."""
    own = reading_session(spark, block_bytes)
    found = pieces(own, path)
    links = kept(hops(found), "links")
    places = kept(entries(links), "places")
    forget(links)
    parts = chained(found, places)
    whole = parts.where("whole").select("file", F.col("at").alias("offset"), "complete", "value")
    # Pieces of one record, in order, with the magic that parted them.
    cut = parts.where(~F.col("whole")).groupBy("file", "ends").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.first("complete").alias("complete"))
    joined = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC)
    rows = whole.unionByName(cut.select("file", F.col("p")[0]["at"].alias("offset"), "complete", joined.alias("value")))
    head = F.concat(F.lit("\r\n"), F.substring_index("value", BREAK, 1), F.lit("\r\n"))

    def field(name: str) -> Column:
        value = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    body = F.expr("substring(cast(value as binary), octet_length(head) + 1, length)")
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), BREAK, 1)) + len(BREAK)
    payload = F.when(F.col("content").startswith("application/http"), F.expr("substring(block, http + 1)")).otherwise(F.col("block"))
    rows = rows.select(
        "file", "offset", "complete", "value", F.concat(F.substring_index("value", BREAK, 1), F.lit(BREAK)).alias("head"), field("Content-Length").cast("int").alias("length"), F.coalesce(field("Content-Type"), F.lit("")).alias("content"),
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Target-URI").alias("uri"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("declared"),
    ).withColumn("block", body).withColumn("http", http)
    return rows.select("file", "offset", "complete", "type", "id", "uri", "refers_to", "declared", payload.alias("payload"))


def resolved(found: DataFrame) -> DataFrame:
    """id, type, refers_to, digest, n_bytes of each record: for a response, of the payload that was read; for
    a revisit, of the payload of the response that it refers to and whose head names the same digest, null
    where there is none."""
    named_ = F.coalesce("declared", F.lit("")).alias("declared")
    facts = kept(found.select("id", "type", "refers_to", named_, F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")), "records")

    def keys(c: str) -> dict[str, Column]:
        return {f"r{i}": F.xxhash64(F.lit(i), F.col(c), F.col("declared")) for i in (1, 2)}

    again = facts.where("type = 'revisit'").withColumns(keys("refers_to"))
    asked = again.groupBy("r1", "r2").agg(F.count("*").alias("n"))
    shown = facts.where("type = 'response'").withColumns(keys("id")).groupBy("r1", "r2").agg(F.min(F.struct("digest", "n_bytes")).alias("found"))
    known = kept(shown.join(asked, ["r1", "r2"]), "referred")
    of = met(again, known, ["r1", "r2"], ["id", "refers_to"], "n", again.count())
    columns = ["id", "type", "refers_to"]
    return facts.where("type = 'response'").select(*columns, "digest", "n_bytes").unionByName(of.select(*columns, F.col("found.digest").alias("digest"), F.col("found.n_bytes").alias("n_bytes")))


def round_trip(spark: SparkSession, rows: DataFrame, path: str | None = None) -> DataFrame:
    """Writes rows (id, uri, payload) as archives, under a new folder in the shared one, and reads them back:
    id (long), n_bytes, digest, type, refers_to (long) of each."""
    path = path or f"{shared_dir(spark)}/orrery/archives-{uuid.uuid4().hex}"
    write(rows, path)
    facts = resolved(read(spark, path))

    def number(c: str) -> Column:
        return F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)

    return facts.select(*[F.when(number(c) != "", number(c).cast("long")).alias(c) for c in ("id", "refers_to")], "n_bytes", "digest", "type")
