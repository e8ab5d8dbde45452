"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean trigram query is derived: an OR of branches, each an AND of the
trigrams that any match of the branch must have. The index holds (trigram, document) postings for
the trigrams that some rule asks for; postings of a branch are intersected by counting, document by
document, and a document that holds all of a branch's trigrams is a candidate of the rule. Only
candidates are verified with the pattern itself. A rule whose pattern has a branch without a
mandatory trigram scans all documents.

Postings are a few integers a document. Texts are shuffled only where they hold some branch's last
trigram, which any candidate of that branch must.

Defined cases: null text counts as empty; a document without spans has counts 0 and the hash of the
empty string; repeated rows each get their row with equal spans; columns of the input other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as regex
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, doc_key, empty_text, spans_of, ungrouped


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: understood alike by Python and Java. value: the group whose
    length must reach min_chars (0: the whole match)."""

    kind: str
    pattern: str
    value: int = 0
    min_chars: int = 1
    base: bool = False


# The base kinds. Runs shorter than the bound can't match, so the bounds of access
# and hex stand in the pattern; an assignment that is too short still uses up its characters.
BASE = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
]
# Published formats of keys.
FORMATS = [
    Rule("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("git", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"sk_live_[A-Za-z0-9]{24,}"),
]
RULES = BASE + FORMATS
MAX_BRANCHES = 32


def literal_runs(pattern: str) -> list[list[str]]:
    """The pattern's branches, each as the literal runs (lower case) that a match must hold in this
    order. What has no fixed text ends a run."""

    def joined(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
        if len(left) * len(right) > MAX_BRANCHES:
            return [[*b, ""] for b in left]
        return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]

    def of(items) -> list[list[str]]:
        out = [[""]]
        for op, arg in items:
            if op is sre.LITERAL:
                part = [[chr(arg).lower()]]
            elif op is sre.BRANCH:
                part = [b for branch in arg[1] for b in of(branch)]
            elif op is sre.SUBPATTERN:
                part = of(arg[3])
            elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
                part = [[c] for c in sorted({chr(a).lower() for _, a in arg})]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and len(of(arg[2])) <= 4:
                part = [[""], *of(arg[2])]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1 and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
                part = [[chr(arg[2][0][1]).lower() * arg[0], "", ""]] if arg[1] > arg[0] else [[chr(arg[2][0][1]).lower() * arg[0]]]
            else:
                part = [["", ""]]
            out = joined(out, part)
        return out

    return of(regex.parse(pattern))


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of trigrams; None if some branch has none, so that all documents are scanned."""
    branches = {tuple(dict.fromkeys(run[i : i + 3] for run in runs for i in range(len(run) - 2))) for runs in literal_runs(pattern)}
    if () in branches:
        return None
    # A branch that asks for more than another adds no candidates.
    least = [b for b in branches if not any(set(o) < set(b) for o in branches)]
    return [list(b) for b in sorted(least)]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """k1, k2, trigram: the inverted index for the trigrams that are asked for."""
    low = docs.select(*doc_key(), ascii_lower(empty_text()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("k1", "k2", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """k1, k2, rules: documents that hold all trigrams of some branch of each rule named."""
    asked = sorted({t for q in queries.values() for b in q for t in b})
    branches = docs.sparkSession.createDataFrame([(k, i, len(b), t) for k, q in queries.items() for i, b in enumerate(q) for t in b], "rule string, branch int, needed int, trigram string")
    return (
        postings(docs, asked)
        .join(F.broadcast(branches), "trigram")  # as long as the rules' trigrams, whatever the table
        .groupBy("k1", "k2", "rule", "branch", "needed")
        .agg(F.size(F.collect_set("trigram")).alias("held"))
        .where(F.col("held") == F.col("needed"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("rule").alias("rules"))
    )


def matched(rows: DataFrame, rules: list[Rule], asked: Column | None) -> DataFrame:
    """k1, k2, kind, i, before, match of rows that have text, and `rules` where asked."""
    none = F.lit(None).cast("array<struct<before:bigint,match:string>>")
    per_rule = [
        F.struct(F.lit(r.kind).alias("kind"), (spans_of(F.col("text"), ungrouped(r.pattern)) if asked is None else F.when(F.array_contains(asked, r.kind), spans_of(F.col("text"), ungrouped(r.pattern))).otherwise(none)).alias("found"))
        for r in rules
    ]
    each = rows.select("k1", "k2", F.explode(F.array(*per_rule)).alias("r")).where(F.col("r.found").isNotNull())
    return each.select("k1", "k2", F.col("r.kind").alias("kind"), F.posexplode("r.found").alias("i", "m")).select("k1", "k2", "kind", "i", "m.before", "m.match")


def find(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """k1, k2, kind, start, end, base: every span, in code points, end exclusive; equal rows of the
    input have one set of spans."""
    rules = RULES if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    texts = docs.select(*doc_key(), empty_text().alias("text"))
    every = [r for r in rules if r.kind not in queries]
    anchors = sorted({b[-1] for q in queries.values() for b in q})
    parts = []
    if queries:
        low = ascii_lower(F.col("text"))
        anchored = F.lit(False)
        for t in anchors:
            anchored = anchored | F.contains("low", F.lit(t))
        likely = texts.withColumn("low", low).where(anchored).drop("low").dropDuplicates(["k1", "k2"])
        checked = likely.join(candidates(docs, queries), ["k1", "k2"])
        parts.append(matched(checked, [r for r in rules if r.kind in queries], F.col("rules")))
    if every:
        wanted = F.lit(False)
        for r in every:
            wanted = wanted | F.col("text").rlike(r.pattern)
        parts.append(matched(texts.where(wanted).dropDuplicates(["k1", "k2"]), every, None))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    upto = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    end = F.sum(F.col("before") + F.char_length("match")).over(upto)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match"))
    long_enough = F.lit(True)
    for r in rules:
        if r.min_chars > 1:
            value = F.regexp_extract("match", r.pattern, r.value)
            long_enough = F.when(F.col("kind") == r.kind, F.char_length(value) >= r.min_chars).otherwise(long_enough)
    return placed.where(long_enough).select("k1", "k2", "kind", "start", "end", F.col("kind").isin([r.kind for r in rules if r.base]).alias("base"))


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans."""
    rules = RULES if rules is None else rules
    order = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    spans = find(docs, rules).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "base"))).alias("spans"))

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    listed = F.coalesce("spans", F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,base:boolean>>"))
    every = docs.select("doc_id", *doc_key())

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in rules if r.base]
    return (
        every.join(spans, ["k1", "k2"], "left")
        .withColumn("spans", listed)
        .select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
    )
