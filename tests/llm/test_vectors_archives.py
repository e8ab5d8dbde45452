"""Hard negatives, sort-means, WARC archives."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, hard_negatives, sort_means, warc

VECTORS = "vec_id long, label int, vec array<float>, score int, cells int, anchor int"


def points_of(spark, rows):
    """Vectors with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, x, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3) for i, x, v in rows], VECTORS)


def whole(vec, dim=None):
    out = [math.floor(256 * float(np.float32(x))) for x in vec]
    return out + [0] * ((dim or 0) - len(out))


def clean(rows):
    """One row an id: the smallest label, then vector."""
    out = {}
    for i, x, v in rows:
        if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            one = (x, whole(v))
            out[i] = min(out.get(i, one), one)
    return out


def brute_negatives(rows, every, n_pos=5, n_neg=10):
    own = clean(rows)
    dim = max((len(v) for _, v in own.values()), default=0)
    vecs = {i: np.array(v + [0] * (dim - len(v)), np.int64) for i, (_, v) in own.items()}
    out = set()
    for a in own:
        if a % every:
            continue
        score = {i: int(vecs[a] @ vecs[i]) for i in own if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        same, others = ([i for i in order if (own[i][0] == own[a][0]) == want] for want in (True, False))
        for p in same[:n_pos]:
            fit = [i for i in others if 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fit[:n_neg])}
    return out


def mined(spark, rows, every):
    found = hard_negatives.mine(points_of(spark, rows), F.col("vec_id") % every == 0)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_hard_negatives(spark, monkeypatch):
    """Clusters with many ties, a group of near copies, and several blocks of anchors."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 8)) / 3
    rows = [(i, int(rng.integers(0, 3)), centers[rng.integers(0, 4)] + rng.integers(-2, 3, 8) / 32) for i in range(700)]
    rows += [(1000 + i, i % 2, centers[0]) for i in range(150)]
    want = brute_negatives(rows, 5)
    assert len(want) > 1000
    assert mined(spark, rows, 5) == want
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "SLAB", 4000)
    assert mined(spark, rows, 5) == want


def test_few_rows_are_scored(spark):
    """The bounds hold for every row, and leave out most of them."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (900, 16))
    df = points_of(spark, [(i, 0, r / 256) for i, r in enumerate(rows)])
    made = hard_negatives.rows_of(df)
    lower, upper = hard_negatives.fit(made)
    file = hard_negatives.build(made, lower).orderBy("vec_id").collect()
    cells = np.array([np.frombuffer(r.cells, np.uint8) for r in file])
    low, high = hard_negatives.Bounds(rows[:20].astype(np.int64), lower, upper).of(cells)
    true = rows @ rows[:20].T
    assert (low <= true).all() and (true <= high).all()
    tenth = np.sort(low, axis=0)[-10]
    assert (high >= tenth).mean() < 0.2


def test_hard_negatives_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (0, 0, [0.1, 0.9]), (1, 1, [0.5, 0.4]), (2, 0, [0.5]), (3, 0, [0.3, 0.3]), (4, None, [1.0, 1.0]), (5, 0, None), (6, 0, [nan, 1.0])]
    rows += [(7, 0, [inf, 1.0]), (None, 0, [0.4, 0.4]), (8, 0, [None, 1.0]), (9, 0, []), (10, 5, [0.9, 0.9]), (-5, 1, [0.2, 0.3]), (15, 1, [-0.5, -0.5])]
    assert mined(spark, rows, 5) == brute_negatives(rows, 5)
    assert mined(spark, [], 5) == set()
    assert mined(spark, [(0, 0, []), (1, 0, []), (2, 1, [])], 2) == brute_negatives([(0, 0, []), (1, 0, []), (2, 1, [])], 2)
    with pytest.raises(Exception, match="2\\*\\*18"):
        mined(spark, [(0, 0, [1e30])], 5)


def brute_means(rows, k, rounds, dim):
    kept = [(i, whole(v)) for i, _, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    name = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~" for i, _ in kept}
    centers = [v for _, v in sorted(kept, key=lambda r: (name[r[0]], r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centers)):
            mine = [v for (_, v), (_, own) in zip(kept, at, strict=True) if own == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    inertia = [sum(d for d, own in at if own == j) for j in range(len(centers))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia), names[j]) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_sort_means(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, 0, rng.integers(-40, 40, 3) / 16) for i in range(300)] + [(500 + i, 0, [0.25, 0.5, 1.0]) for i in range(60)]
    state, centers = sort_means.cluster(points_of(spark, rows), k, dim=3)
    assert sorted((tuple(r) for r in sort_means.report(state, centers).collect()), key=str) == brute_means(rows, k, 5, 3)


def test_sort_means_measures_few(monkeypatch):
    """Ties count, and of well-parted groups few centroids are measured."""
    rng = np.random.default_rng(1)
    groups = rng.integers(-5000, 5000, (12, 4))
    vecs = groups[rng.integers(0, 12, 400)] + rng.integers(-3, 4, (400, 4))
    far = ((vecs[:, None, :] - groups[None]) ** 2).sum(axis=2)
    for before in (np.zeros(400, np.int64), far.argmin(axis=1)):
        got, d = sort_means.nearest(vecs, before, groups)
        assert (got == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    line = np.array([[0], [2], [4]])
    for before in range(3):
        got, d = sort_means.nearest(np.array([[1], [3], [2]]), np.full(3, before), line)
        assert got.tolist() == [0, 1, 1] and d.tolist() == [1, 1, 0]


def test_sort_means_defined_cases(spark):
    rows = [(1, 0, [0.1, 0.2, 0.3]), (1, 0, [0.1, 0.2, 0.3]), (1, 0, [0.0, 0.2, 0.3]), (None, 0, [1.0, 1.0, 1.0]), (2, None, [-1.0, 0.0, 0.0]), (3, 0, None), (4, 0, [1.0]), (5, 0, [float("nan"), 0.0, 0.0]), (6, 0, [None, 0.0, 0.0])]
    state, centers = sort_means.cluster(points_of(spark, rows), 4, dim=3)
    assert sorted((tuple(r) for r in sort_means.report(state, centers).collect()), key=str) == brute_means(rows, 4, 5, 3)
    state, centers = sort_means.cluster(points_of(spark, []), 4, dim=3)
    assert sort_means.report(state, centers).count() == 0


PAGES = "id long, uri string, payload string, value int, block int, file string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", p, 1, 2, "f", "d") for i, p in rows], PAGES)


def brute_trip(rows):
    out, least = [], {}
    for i, p in rows:
        if i is not None:
            least[p or ""] = min(least.get(p or "", i), i)
    for i, p in rows:
        data = (p or "").encode()
        first = least.get(p or "")
        copy = len(data) >= 100 and first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first if copy else None))
    return sorted(out, key=str)


def nasty(seed=1):
    """Payloads with magic, whole records, blank lines and long runs inside, copies, short and odd ones."""
    rng = random.Random(seed)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    texts = [None, "", "x" * 99, "y" * 100, "é漢𝒳" * 40, "WARC/1.0\r\n", "WARC/1.0\r\n" * 30, "\r\n\r\n" * 20, inner.format(5, "hello") * 4, inner.format(10**12, "z"), "a" * 3000, "WARC/1.0\r\nContent-Length: 3", "tail\r\n\r\nWARC/1.0\r\n\r\n" + "q" * 200]
    rows = [(i, rng.choice(texts) if i % 3 else "".join(rng.choice("ab\r\n<>") for _ in range(rng.randint(0, 400)))) for i in range(160)]
    return rows + [(None, "y" * 100), (None, "only null ids" * 20), (None, "only null ids" * 20), (7, rows[7][1]), (-4, "y" * 100)]


@pytest.mark.parametrize("block", [1500, None])
def test_archives(spark, tmp_path, block):
    rows = nasty()
    at = str(tmp_path / "w")
    warc.write(pages_of(spark, rows).repartition(3), at)
    found = warc.read(spark, at, block)
    got = found.collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    texts = {i: {(p or "").encode() for j, p in rows if j == i} for i, _ in rows}
    for r in got:
        own = int(r.id[10:-1]) if r.id != "<urn:page:none>" else None
        assert r.uri == f"http://h/{own}" and (bytes(r.payload) in texts[own] if r.type == "response" else bytes(r.payload) == b"")


def test_round_trip(spark, monkeypatch):
    rows = nasty(2)
    trip = warc.round_trip(spark, pages_of(spark, rows).repartition(4)).select("id", "n_bytes", "digest", "type", "refers_to")
    assert sorted((tuple(r) for r in trip.collect()), key=str) == brute_trip(rows)
    assert warc.round_trip(spark, pages_of(spark, [])).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    trip = warc.round_trip(spark, pages_of(spark, rows).repartition(2)).select("id", "n_bytes", "digest", "type", "refers_to")
    assert sorted((tuple(r) for r in trip.collect()), key=str) == brute_trip(rows)


def record(name, body):
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: {name}\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("block", [500])
def test_damaged_archives(spark, tmp_path, block):
    """Foreign bytes, lengths that lie, cut ends, a file that does not begin with a record, an empty one."""
    bodies = [b"\xff\x00\xfe" * 50, b"WARC/1.0\r\n\r\n", b"", record("inner", b"abc")]
    good = [record(f"r{i}", b) for i, b in enumerate(bodies * 3)]
    files = {
        "whole": (b"".join(good), 12, True),
        "gap": (b"".join(good[:5]) + b"junk" + b"".join(good[5:]), 5, False),
        "cut": (b"".join(good)[:-30], 11, False),
        "late": (b"\r\n" + b"".join(good), 0, False),
        "none": (b"", 0, False),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    got = warc.read(spark, str(tmp_path / "*.warc"), block).collect()
    for name, (_, n, complete) in files.items():
        own = sorted((r for r in got if r.file.endswith(f"{name}.warc")), key=lambda r: r.offset)
        assert [r.id for r in own] == [f"r{i}" for i in range(n)]
        assert all(r.complete == complete and bytes(r.payload) == bodies[i % 4] for i, r in enumerate(own))
