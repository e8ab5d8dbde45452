"""Personal data: pattern spans, and a skip-chain conditional random field that adds to them.

Nodes of the field are the pattern spans, each as a whole, and the white-space tokens with a digit or
an "@" outside of them. Each node has a label out of none, email, ip, card, phone. Its own features are
its shape and the words around it. Chain edges join nodes that stand next to each other; skip edges
join each node with the next one, however far, that repeats it or resembles it (same letters, same
last digits, same mail name). Pattern spans are held at their label. Loopy sum-product over both kinds
of edge, run until no message moves any more, settles the others; those whose marginal reaches
`MIN_MARGINAL` become added spans.

All weights, of features, chain and skip edges, are trained together by pseudo-likelihood: each node's
label given its features and its neighbours' labels, on a bounded sample (SAMPLE documents of at most
SAMPLE_CHARS characters). Pattern spans are labelled by their kind and other nodes none, but for those
that a skip edge ties to a pattern span: whether these are mentions is what is asked, so they are left
open. Pattern spans show their kind by their shape alone; so that edges learn too, each node is also
shown without its features. Edge weights are drawn towards agreement (AGREEMENT) and the others to 0,
so that a sample without repeats still has a field.

Defined cases: null text counts as empty; a document without candidates has no spans and the hash
of the empty string; repeated rows are treated alike, row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import kept

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE, SAMPLE_CHARS = 1000, 20_000
MIN_MARGINAL = 0.9
#: Prior means of the weight of an edge between equal labels.
AGREEMENT = {"chain": 0.0, "skip": 4.0}
#: Hashed words before and after a node.
WORDS, CONTEXT = 2, 64
#: Messages that move by less have settled.
SETTLED = 1e-4
#: Rounds of messages at most: so many, and twice the nodes, as a chain's far end is heard of late.
ROUNDS = 500

# The patterns of the four kinds.
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A dotted match can only begin where a run of digits does, so no run is scanned twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]+")
EDGES_OF_TOKEN = ".,;:!?\"'()[]<>{}#*$%&|"

WHITE = " \t\n\x0b\x0c\r"

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAIL_NAME:
            start -= 1
        host = MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def pattern_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start, then kind as listed."""
    out = list(mails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Field:
    """A document's graph: nodes with places and features, held labels (0 for those to settle), edges."""

    places: list[tuple[int, int]]
    features: np.ndarray
    held: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def open(self) -> np.ndarray:
        """Nodes without a label that a skip edge ties to one with a label."""
        tied = np.zeros(len(self.places), bool)
        for i, j in (self.skip.T, self.skip.T[::-1]):
            tied[i[self.held[j] > 0]] = True
        return tied & (self.held == 0)


def shape(token: str) -> list[float]:
    digits = digits_of(token)
    parts = token.split(".")
    n = len(digits)
    return [
        1.0, "@" in token, "@" in token and "." in token.partition("@")[2], any(c.isalpha() for c in token), token.startswith("+"),
        "(" in token or ")" in token, "-" in token, len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts),
        n == len(token), 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19, 14 <= n <= 19 and luhn(digits),
    ]


def surroundings(text: str, a: int, b: int) -> list[float]:
    """Which hashed words stand within WORDS words before and after a node, as far as 40 characters."""
    out = [0.0] * (2 * CONTEXT)
    before = text[max(0, a - 40) : a].rpartition("\n")[2].split()[-WORDS:]
    after = text[b : b + 40].partition("\n")[0].split()[:WORDS]
    for side, words in enumerate((before, after)):
        for w in words:
            word = w.strip(EDGES_OF_TOKEN).lower()
            if word.isalpha():
                out[side * CONTEXT + zlib.crc32(word.encode()) % CONTEXT] = 1.0
    return out


def resemblances(token: str) -> Iterator[tuple[str, str]]:
    yield "same", token.lower()
    digits = digits_of(token)
    if len(digits) >= 7:
        yield "digits", digits[-7:]
    if "@" in token and len(name := token.partition("@")[0]) >= 3:
        yield "name", name.lower()


def field_of(text: str, spans: list[Span]) -> Field | None:
    ends = np.maximum.accumulate([s[1] for s in spans]) if spans else np.zeros(0, int)
    starts = [s[0] for s in spans]
    nodes = [(a, b, LABELS.index(kind)) for a, b, kind in spans]
    last_end = -1
    for m in MARKED.finditer(text):
        if m.start() < last_end:
            continue
        start, end = m.span()
        while start and text[start - 1] not in WHITE:
            start -= 1
        while end < len(text) and text[end] not in WHITE:
            end += 1
        last_end = end
        token = text[start:end]
        left = len(token) - len(token.lstrip(EDGES_OF_TOKEN.replace("(", "")))
        right = len(token) - len(token.rstrip(EDGES_OF_TOKEN))
        a, b = start + left, end - right
        # Of the spans that begin before b, the furthest end tells whether any reaches into the token.
        k = bisect_left(starts, b)
        if a < b and not (k and ends[k - 1] > a):
            nodes.append((a, b, 0))
    if not nodes:
        return None
    nodes.sort()
    places, held = [n[:2] for n in nodes], np.array([n[2] for n in nodes])
    last: dict[tuple[str, str], int] = {}
    skip = set()
    for i, (a, b) in enumerate(places):
        for key in resemblances(text[a:b]):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    chain = [(i, i + 1) for i in range(len(places) - 1) if places[i + 1][0] - places[i][1] <= 3]
    features = np.array([shape(text[a:b]) + surroundings(text, a, b) for a, b in places], float)
    return Field(places, features, held, np.array(chain, int).reshape(-1, 2), np.array(sorted(skip), int).reshape(-1, 2))


@dataclass
class Weights:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, symmetric
    skip: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], steps: int = 400, rate: float = 0.5, decay: float = 2e-3) -> Weights:
    """Ascends the pseudo-likelihood of all labelled nodes, with and without their own features."""
    fields = [f for t in texts if (f := field_of(t, pattern_spans(t)))]
    width, n_labels = len(shape("0")) + 2 * CONTEXT, len(LABELS)
    prior = {k: v * np.eye(n_labels) for k, v in AGREEMENT.items()}
    w = Weights(np.zeros((width, n_labels)), prior["chain"].copy(), prior["skip"].copy())
    if not fields:
        return w
    x = np.vstack([f.features for f in fields])
    bare = np.zeros_like(x)
    bare[:, 0] = 1.0
    told = ~np.concatenate([f.open() for f in fields])
    y = np.eye(n_labels)[np.concatenate([f.held for f in fields])] * told[:, None]
    base = np.cumsum([0, *(len(f.places) for f in fields)])
    near = {}
    for kind in ("chain", "skip"):  # the labels that a node's neighbours have, counted
        edges = np.vstack([getattr(f, kind) + o for f, o in zip(fields, base, strict=False)])
        near[kind] = np.zeros_like(y)
        np.add.at(near[kind], edges[:, 0], y[edges[:, 1]])
        np.add.at(near[kind], edges[:, 1], y[edges[:, 0]])
    n = max(1, told.sum())
    for _ in range(steps):
        grown = -decay * w.unary
        pull = {k: -decay * (getattr(w, k) - prior[k]) for k in prior}
        for seen in (x, bare):
            miss = (y - softmax(seen @ w.unary + near["chain"] @ w.chain + near["skip"] @ w.skip)) * told[:, None]
            grown = grown + seen.T @ miss / (2 * n)
            for k in pull:
                g = near[k].T @ miss / (2 * n)
                pull[k] = pull[k] + (g + g.T) / 2
        w.unary += rate * grown
        for k, g in pull.items():
            setattr(w, k, getattr(w, k) + rate * g)
    return w


def marginals(field: Field, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product until every message has settled; linear in nodes and edges a round. A message has
    settled when a round would move it by no more than SETTLED, however much it is damped. Messages
    are damped more from round to round, but on some graphs that does not settle them: after ROUNDS and twice
    the nodes it stops. Gives the marginals, and which nodes all messages have settled for."""
    own = softmax(np.clip(field.features @ w.unary, -30, 30))
    own[field.held > 0] = 1e-9
    own[field.held > 0, field.held[field.held > 0]] = 1.0
    edges = np.vstack([field.chain, field.skip])
    if not len(edges):
        return own, np.ones(len(own), bool)
    factor = np.exp(np.vstack([np.broadcast_to(m, (len(e), *m.shape)) for m, e in ((w.chain, field.chain), (w.skip, field.skip))]))
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent = np.full((len(source), len(LABELS)), 1 / len(LABELS))
    patience, moved = 2 * len(own) + 50, np.ones(len(source))
    for rounds in range(ROUNDS + 2 * len(own)):
        total = np.log(own)
        np.add.at(total, target, np.log(sent))
        new = np.einsum("es,est->et", softmax(total[source] - np.log(sent[back])), factor)
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - sent).max(axis=1)
        step = 0.7 if rounds < patience else 0.7 * patience / rounds
        sent = sent + step * (new - sent)
        if moved.max() <= SETTLED:
            break
    total = np.log(own)
    np.add.at(total, target, np.log(sent))
    settled = np.ones(len(own), bool)
    settled[target[moved > SETTLED]] = False
    return softmax(total), settled


def added_spans(text: str, spans: list[Span], w: Weights) -> tuple[list[Span], int]:
    """The spans that the field adds, and the number of nodes that it leaves without a label because their
    messages did not settle."""
    field = field_of(text, spans)
    if field is None or not (field.held == 0).any():
        return [], 0
    p, settled = marginals(field, w)
    best = p.argmax(axis=1)
    keep = (best > 0) & (field.held == 0) & (p.max(axis=1) >= MIN_MARGINAL) & settled
    return [(*field.places[i], LABELS[best[i]]) for i in np.flatnonzero(keep)], int((~settled & (field.held == 0)).sum())


def find(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), weights: Weights | None = None) -> DataFrame:
    """One row per document: the carried columns, `spans`, array<struct<start,end,kind,added>>,
    by start, then kind, and `n_unsettled`, the places left open as their messages did not settle. A narrow pass; the field of a document is built within its row. The result is
    kept as a table, as Arrow batches of kept tables are bounded by bytes: long texts come few at a time."""
    if weights is None:
        likely = docs.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= SAMPLE_CHARS)).select("text", F.xxhash64("text").alias("h"))
        # Hashes first, so that tasks send the driver numbers and only the chosen texts follow.
        last = likely.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
        sample = likely.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).orderBy("h") if last is not None else likely.limit(0)
        weights = train([r.text for r in sample.collect()])

    @F.pandas_udf("spans array<struct<start:int,end:int,kind:string,added:boolean>>, n_unsettled long")
    def spans(texts: pd.Series) -> pd.DataFrame:
        def of(text: str | None) -> tuple[list[dict], int]:
            if not text or not MARKED.search(text):
                return [], 0
            base = pattern_spans(text)
            more, n_unsettled = added_spans(text, base, weights)
            found = [(*s, False) for s in base] + [(*s, True) for s in more if s not in base]
            found.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
            return [dict(zip(("start", "end", "kind", "added"), s, strict=True)) for s in found], n_unsettled

        return pd.DataFrame([of(text) for text in texts], columns=["spans", "n_unsettled"])

    return kept(docs.select(*carry, spans("text").alias("_found")).select(*carry, "_found.*"), "personal-data")


def joined(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and a hash of the pattern spans, and all spans as text."""
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.withColumn("base", base).select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"), "n_unsettled"
    )


def hash_of(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
