"""Aggregates that users write, against one pass over the points."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import plugins
from orrery.operators.tree import TreeParams, build
from orrery.sources.points import from_rows


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(5, 2))[rng.integers(0, 5, 90)] + 0.1 * rng.normal(size=(90, 2))
    return build(from_rows(spark, rows.tolist(), [int(x) if x < 3 else None for x in rng.integers(0, 4, 90)]), TreeParams(scale_base=1.6))


def under(tree):
    out = defaultdict(list)
    for r in tree.paths.collect():
        out[r.scale, r.center].append(r.pid)
    return out


def test_fold(spark, tree):
    """Height, which no sum over points gives, and one that reads it there and at the children."""
    height = plugins.NodePlugin("height", {"h": F.coalesce(F.col("most") + 1, F.lit(0)), "lone": F.coalesce("lone", F.lit(0))}, {"lone": F.count("*")}, {"most": F.max("kid.h")})
    path = plugins.NodePlugin("path", {"sum": F.coalesce("below", F.lit(0)) + F.col("height.h"), "first": F.coalesce("near", F.col("center"))}, kids={"below": F.sum("kid.sum"), "near": F.min(F.when(F.col("height.h") == 0, F.col("kid_center")))})
    got = {(r.scale, r.center): r for r in plugins.fold(tree, [height, path]).collect()}
    kids, rests = defaultdict(list), defaultdict(int)
    for r in tree.edges().collect():
        kids[r.scale, r.center].append((r.child_scale, r.child_center))
    for r in tree.final_address().collect():
        rests[r.scale, r.center] += 1
    h = {}
    for n in sorted(got):
        h[n] = max((h[k] + 1 for k in kids[n]), default=0)
        assert (got[n].height.h, got[n].height.lone) == (h[n], rests[n])
        assert got[n].path["sum"] == h[n] + sum(got[k].path["sum"] for k in kids[n])
        assert got[n].path.first == min((k[1] for k in kids[n] if h[k] == 0), default=n[1])
    assert max(h.values()) > 2 and got.keys() == under(tree).keys()


def test_summaries(spark, tree, monkeypatch):
    """The three most frequent labels, and a count of rows, whatever the partitioning."""
    monkeypatch.setattr(plugins, "HELD_STATES", 3)

    def add(state, rows):
        out = dict(state)
        for x in rows["label"]:
            key = None if x != x or x is None else int(x)
            out[key] = out.get(key, 0) + 1
        return out

    def combine(a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}

    def finish(state):
        best = sorted((k for k in state if k is not None), key=lambda k: (-state[k], k))[:3]
        return sum(state.values()), ",".join(map(str, best))

    most = plugins.Summary(dict, add, combine, finish, "n long, labels string")
    labels = {r.pid: r.label for r in tree.points.collect()}
    want = {n: finish(add({}, {"label": [labels[p] for p in pids]})) for n, pids in under(tree).items()}
    for found in (plugins.node_summary(tree, ["label"], most), plugins.summarise(tree.paths.join(tree.points.select("pid", "label"), "pid").select("scale", "center", "label").repartition(7), ["scale", "center"], most)):
        assert {(r.scale, r.center): (r.n, r.labels) for r in found.collect()} == want


def test_singular_values(spark, tree):
    """Of all nodes over a size, the root too, as numpy finds them; axes up to their sign."""
    vecs = {r.pid: np.array(r.vec, np.float64) for r in tree.points.collect()}
    own = {n: np.array([vecs[p] for p in pids]) for n, pids in under(tree).items() if len(pids) > 6}
    got = defaultdict(dict)
    for r in plugins.singular_values(tree, 6).collect():
        got[r.scale, r.center][r.k] = r
    assert got.keys() == own.keys() and max(map(len, own.values())) == len(vecs)
    for n, x in own.items():
        _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        for k in range(2):
            assert got[n][k].value == pytest.approx(s[k], rel=1e-6, abs=1e-6)
        assert abs(np.dot(got[n][0].axis, vt[0])) == pytest.approx(1.0, abs=1e-6)
