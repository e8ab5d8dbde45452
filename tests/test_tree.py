"""Cover trees against their definition, point by point."""

from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators import aggregates, cells, walk
from orrery.operators import tree as tree_module
from orrery.operators.knn import assign, knn, layer_best
from orrery.operators.tree import CoverTree, TreeParams, build, hash_order, violations
from orrery.sources.points import from_rows


def clusters(seed, n, dim=3, spread=0.05):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def cloud(spark, rows, labels=None):
    return from_rows(spark, [r.tolist() for r in rows], labels)


def asked(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "qid long, vec array<float>")


def ways(tree):
    out = defaultdict(list)
    for r in sorted(tree.paths.collect(), key=lambda r: (r.pid, r.depth)):
        out[r.pid].append((r.scale, r.center, r.dist))
    return out


def check(rows, tree):
    """Every path begins at the root, the last point; steps go down in scale to balls that hold the
    point; distances are true; every center holds itself; children of a node are apart; children take
    all points but lone ones."""
    p, own = tree.params, ways(tree)
    rows = np.asarray(rows, np.float64)
    assert sorted(own) == list(range(len(rows)))
    kids, rests = defaultdict(set), defaultdict(list)
    for pid, way in own.items():
        assert way[0][1] == len(rows) - 1
        for (s, c, _), (t, d, far) in zip(way, way[1:], strict=False):
            assert t < s and far < p.scale_base**t + 1e-9
            kids[s, c].add((t, d))
        for _, c, far in way:
            assert far == pytest.approx(np.linalg.norm(rows[pid] - rows[c]), abs=1e-6)
        rests[way[-1][:2]].append(pid)
    for (s, c), below in kids.items():
        assert any(d == c for _, d in below)
        for t, d in below:
            assert (t, d) in {x[:2] for x in own[d]}
            assert all(np.linalg.norm(rows[d] - rows[e]) >= p.scale_base**t - 1e-6 for _, e in below if e != d)
        if not p.use_singletons:
            assert not rests[s, c]
    sizes = {n: sum(n in [x[:2] for x in w] for w in own.values()) for n in {x[:2] for w in own.values() for x in w}}
    for n, size in sizes.items():
        if n not in kids:
            alone = size <= p.leaf_cutoff or n[0] < p.min_res_index
            assert alone or all(len(own[q]) and own[q][-1][:2] == n for q in rests[n])
    return sizes


@pytest.mark.parametrize("kind", ["first", "nearest"])
@pytest.mark.parametrize("more", [{}, {"use_singletons": False}, {"leaf_cutoff": 9}, {"scale_base": 1.4, "min_res_index": -4}])
def test_definition(spark, kind, more):
    rows = clusters(len(more) + 2, 130)
    params = TreeParams(partition_type=kind, **more)
    tree = build(cloud(spark, rows), params)
    sizes = check(rows, tree)
    nodes = {(r.scale, r.center): r for r in tree.nodes().collect()}
    assert {n: r.coverage_count for n, r in nodes.items()} == sizes
    if kind == "nearest":
        split = build(cloud(spark, rows), TreeParams(partition_type=kind, group_points=25, **more))
        assert {p: [x[:2] for x in w] for p, w in ways(split).items()} == {p: [x[:2] for x in w] for p, w in ways(tree).items()}


@pytest.fixture(scope="module")
def rows():
    return clusters(11, 240, dim=2, spread=0.2)


@pytest.fixture(scope="module")
def tree(spark, rows):
    return build(cloud(spark, rows, [int(x > 0) if i % 7 else None for i, x in enumerate(rows[:, 0])]), TreeParams(scale_base=1.5))


def test_split_tree_is_sound(spark, small):
    points = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec"))
    both = [build(points, TreeParams(scale_base=1.2, partition_type="first", group_points=n)) for n in (20_000, 120)]
    assert all(r.n == 0 for r in violations(both[1]).collect())
    same = [sorted(r[:4] for r in t.paths.collect()) for t in both]
    assert same[0] == same[1]


@pytest.mark.parametrize("kind", ["first", "nearest"])
@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_split_in_rounds(spark, monkeypatch, kind, sent):
    """Short beginnings, and points dealt into parts that meet blocks of centers, give the same tree; the
    rounds grow with the logarithm of the centers."""
    made = []
    monkeypatch.setattr(tree_module, "settled", lambda df, name, real=tree_module.settled: made.append(name) or real(df, name))
    for name, value in {"FIRST_BATCH": 8, "BROADCAST_NUMBERS": sent, "PART_POINTS": 50, "BLOCK_NUMBERS": 60, "LAST_BATCH": 16, "COPIES": 4}.items():
        monkeypatch.setattr(tree_module, name, value)
    params = TreeParams(partition_type=kind, scale_base=4.0, leaf_cutoff=30)
    points = cloud(spark, clusters(21, 400, dim=3, spread=2.0))
    split = build(points, replace(params, group_points=150))
    whole = build(points, params)
    assert {p: [x[:2] for x in w] for p, w in ways(split).items()} == {p: [x[:2] for x in w] for p, w in ways(whole).items()}
    assert 1 < made.count("centers") <= 4 * made.count("split")


@pytest.mark.parametrize("siblings", [1024, 3])
def test_close_siblings_are_counted(spark, rows, tree, monkeypatch, siblings):
    """A cloud shrunk under its tree breaks the separation; each pair counts once, in whatever blocks."""
    monkeypatch.setattr(tree_module, "SIBLINGS", siblings)
    shrunk = CoverTree(tree.params, tree.points.withColumn("vec", F.transform("vec", lambda x: x / 3)), tree.paths)
    want = 0
    kids = defaultdict(list)
    for r in tree.edges().collect():
        kids[r.scale, r.center].append((r.child_scale, r.child_center))
    small = (rows / np.float32(3)).astype(float)
    for own in kids.values():
        want += sum(np.linalg.norm(small[a] - small[b]) < tree.params.scale_base**s for i, (s, a) in enumerate(own) for _, b in own[:i])
    assert {r.invariant: r.n for r in violations(shrunk).where("invariant = 'I7'").collect()} == {"I7": want} and want > 5
    assert violations(tree).where("n > 0").count() == 0


def test_neighbours(spark, rows, tree):
    queries = clusters(12, 15, dim=2, spread=0.3)
    far = np.linalg.norm(queries[:, None, :].astype(float) - rows[None, :, :].astype(float), axis=2)
    want = {(q, k + 1): p for q in range(15) for k, p in enumerate(np.lexsort((np.arange(len(rows)), far[q]))[:6])}
    for search in (walk.tree_knn, lambda t, q, k: knn(t.points, q, k)):
        assert {(r.qid, r.rk): r.pid for r in search(tree, asked(spark, queries), 6).collect()} == want
    routed = walk.routing_knn(tree, asked(spark, queries), 4).collect()
    assert all(r.dist == pytest.approx(far[r.qid, r.pid], abs=1e-6) for r in routed)
    centers = {r.center for r in tree.nodes().collect()}
    best = {q: min(sorted(centers), key=lambda c: (far[q, c], c)) for q in range(15)}
    nearest = {(q, k + 1): c for q in range(15) for k, c in enumerate(sorted(centers, key=lambda c: (far[q, c], c))[:4])}
    assert {(r.qid, r.rk): r.pid for r in routed} == nearest
    points = {(q, p) for (q, rk), p in want.items() if rk <= 4}
    # Of the nearest points all are found that are centers, and no singleton is.
    assert {(r.qid, r.pid) for r in routed} & points == {(q, p) for q, p in points if p in centers}
    near = {r.qid: r.pid for r in walk.center_knn(tree, asked(spark, queries), 1).collect()}
    assert near == best
    layers = defaultdict(set)
    for r in tree.nodes().collect():
        layers[r.scale].add(r.center)
    for r in walk.layer_knn(tree, asked(spark, queries), 1).collect():
        assert r.center == min(sorted(layers[r.scale]), key=lambda c: (far[r.qid, c], c))


def test_layer_best_and_assign(spark, rows):
    points = cloud(spark, rows).withColumn("layer", F.col("pid") % 3).repartition(4)
    got = {(r.qid, r.layer, r.rk): r.pid for r in layer_best(points, asked(spark, rows[:5]), 2).collect()}
    assert all(got[q, q % 3, 1] == q for q in range(5)) and len(got) == 30
    centers = spark.createDataFrame([(i, [float(x) for x in rows[i]]) for i in range(600 - 590)], "cid long, vec array<float>")
    nearest = {r.pid: r.center for r in assign(points, centers).collect()}
    far = np.linalg.norm(rows[:, None, :].astype(float) - rows[None, :10, :].astype(float), axis=2)
    assert nearest == {i: int(np.lexsort((np.arange(10), far[i]))[0]) for i in range(len(rows))}


def test_paths(spark, rows, tree):
    """An unseen point goes to the nearest covering child, step by step; an indexed one goes its own way."""
    queries = np.concatenate([clusters(13, 9, dim=2), rows[:9]])
    kids = defaultdict(list)
    for r in tree.edges().collect():
        kids[r.scale, r.center].append((r.child_scale, r.child_center))
    root = tree.root().first()
    got = defaultdict(list)
    for r in walk.path(tree, asked(spark, queries)).orderBy("qid", "depth").collect():
        got[r.qid].append((r.scale, r.center))
    for q, vec in enumerate(queries.astype(float)):
        way = [(root.scale, root.center)]
        while kids[way[-1]]:
            here = way[-1]
            d = {k: np.linalg.norm(vec - rows[k[1]].astype(float)) for k in kids[here]}
            best = min(d, key=lambda k: (round(d[k], 9), k[1] == here[1]))
            if d[best] >= tree.params.scale_base ** best[0]:
                break
            way.append(best)
        assert got[q] == way
    own = ways(tree)
    known = defaultdict(list)
    for r in tree.known_path(spark.createDataFrame([(4,), (999,)], "pid long")).orderBy("depth").collect():
        known[r.pid].append((r.scale, r.center) if r.depth is not None else None)
    assert known[4] == [x[:2] for x in own[4]] and known[999] == [None]


@pytest.mark.parametrize("kind", ["first", "nearest"])
def test_paths_by_pages(spark, rows, kind, monkeypatch):
    """Small pages, each asked by several blocks of queries, and tiers that some paths skip."""
    monkeypatch.setattr(walk, "PAGE_RATIO", 4)
    monkeypatch.setattr(walk, "SHARE", 6)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 3)
    tree = build(cloud(spark, rows), TreeParams(scale_base=1.4, partition_type=kind, rng_seed=3))
    kids = defaultdict(list)
    for r in tree.edges().collect():
        kids[r.scale, r.center].append((r.child_scale, r.child_center))
    drawn = {r.pid: r.ord for r in tree.points.select("pid", hash_order(3).alias("ord")).collect()}
    queries = np.concatenate([clusters(13, 8, dim=2), rows[:8], np.array([[90.0, 90.0]])])
    got = defaultdict(list)
    for r in walk.path(tree, asked(spark, queries)).orderBy("qid", "depth").collect():
        assert r.dist == pytest.approx(np.linalg.norm(queries[r.qid].astype(float) - rows[r.center].astype(float)), abs=1e-6) and r.depth == len(got[r.qid])
        got[r.qid].append((r.scale, r.center))
    root = tree.root().first()
    for q, vec in enumerate(queries.astype(float)):
        way = [(root.scale, root.center)]
        while kids[way[-1]]:
            here = way[-1]
            d = {k: np.linalg.norm(vec - rows[k[1]].astype(float)) for k in kids[here]}
            if kind == "first":
                d = {k: x for k, x in d.items() if x < 1.4 ** k[0]}
                best = min(d, key=lambda k: (k[1] != here[1], drawn[k[1]]), default=None)
            else:
                best = min(d, key=lambda k: (round(d[k], 9), k[1] == here[1]))
                best = best if d[best] < 1.4 ** best[0] else None
            if best is None:
                break
            way.append(best)
        assert got[q] == way
    assert walk.laid_pages(tree).agg(F.max("tier")).first()[0] >= 2


def near_by(rows, queries, k):
    far = np.linalg.norm(queries[:, None, :].astype(float) - rows[None, :, :].astype(float), axis=2)
    return {(q, i + 1): p for q in range(len(queries)) for i, p in enumerate(np.lexsort((np.arange(len(rows)), far[q]))[:k])}


def test_search_opens_few_cells(spark, monkeypatch):
    """On clustered points most cells are never met, whether they are subtrees or pivots' cells."""
    rows, queries = clusters(21, 400, dim=4, spread=0.05), clusters(21, 30, dim=4, spread=0.05)
    tree = build(cloud(spark, rows), TreeParams(scale_base=1.5))
    routes, members, sizes = walk.laid_cells(tree, cell_points=20)
    assert members.count() == len(rows) and sizes.agg(F.sum("n")).first()[0] == len(rows)
    below = routes.below()
    kth = np.sort(np.linalg.norm(queries[:, None, :].astype(float) - rows[None].astype(float), axis=2), axis=1)[:, 2]
    a, cell = cells.open_cells(routes, below, "l2", queries.astype(float), kth, 3)
    assert len(cell) < 0.5 * len(queries) * sizes.count()
    monkeypatch.setattr(cells, "CELL_POINTS", 7)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 4)
    for found in (walk.tree_knn(tree, asked(spark, queries), 3, cell_points=20), cells.knn_join(cloud(spark, rows), asked(spark, queries), 3, cell_points=20)):
        assert {(r.qid, r.rk): r.pid for r in found.collect()} == near_by(rows, queries, 3)


@pytest.mark.parametrize("metric", ["l1", "linf", "l1_sqrt"])
def test_join_of_points_with_themselves(spark, metric):
    """All points against all, with a group of equal ones, far-off and huge vectors; other metrics too."""
    rows = np.concatenate([clusters(5, 150, dim=3), np.full((90, 3), 0.5, np.float32), np.float32([[1e6, 0, 0], [1e6, 1, 0], [-3e5, 2, 2]])])
    far = np.stack([metrics.rows_to_point(metric, rows.astype(float), r) for r in rows.astype(float)])
    want = {(q, i + 1): p for q in range(len(rows)) for i, p in enumerate(np.lexsort((np.arange(len(rows)), far[q]))[:4])}
    found = cells.knn_join(cloud(spark, rows), asked(spark, rows), 4, metric, cell_points=25)
    assert {(r.qid, r.rk): r.pid for r in found.collect()} == want


def test_join_shuffles_by_groups(spark, monkeypatch):
    """However many cells a query opens, its vector is laid out once and copied once for each of a few groups."""
    rows, laid, settled = np.random.default_rng(3).normal(size=(300, 6)).astype(np.float32), {}, cells.settled
    monkeypatch.setattr(cells, "settled", lambda df, name: laid.setdefault(name, settled(df, name)))
    monkeypatch.setattr(cells, "CELL_POINTS", 4)
    monkeypatch.setattr(cells, "GROUPS", 3)
    found = cells.knn_join(cloud(spark, rows), asked(spark, rows), 3, cell_points=4)
    assert {(r.qid, r.rk): r.pid for r in found.collect()} == near_by(rows, rows, 3)
    assert laid["members"].select("cell").distinct().count() > 30
    assert laid["open-cells"].count() <= len(rows)
    assert laid["open-cells"].agg(F.max(F.size("groups"))).first()[0] <= 3


def test_join_edges(spark):
    points = cloud(spark, np.float32([[0.0], [1.0], [1.0], [3.0]]))
    one = spark.createDataFrame([(7, [1.0]), (8, None)], "qid long, vec array<float>")
    assert [(r.rk, r.pid) for r in cells.knn_join(points, one, 10).orderBy("rk").collect()] == [(1, 1), (2, 2), (3, 0), (4, 3)]
    assert cells.knn_join(points, one.limit(0), 3).count() == 0
    assert cells.knn_join(points.limit(0), one, 3).count() == 0


def test_aggregates(spark, rows, tree):
    own = ways(tree)
    under = defaultdict(list)
    for pid, way in own.items():
        for s, c, _ in way:
            under[s, c].append(pid)
    labels = {r.pid: r.label for r in tree.points.collect()}
    for r in aggregates.label_maps(tree).collect():
        mine = [labels[p] for p in under[r.scale, r.center]]
        assert dict(r.labels) == {x: mine.count(x) for x in set(mine) - {None}} and r.nones == mine.count(None)
    for r in aggregates.gaussians(tree).where("pos = 1").collect():
        xs = rows[under[r.scale, r.center], 1].astype(float)
        assert (r.n, r.mean, r["var"]) == (len(xs), pytest.approx(xs.mean(), abs=1e-6), pytest.approx(xs.var(), abs=1e-6))
    lists = {(r.scale, r.center): r.pids for r in aggregates.coverage_indexes(tree, 50).collect()}
    assert lists == {n: sorted(p) for n, p in under.items() if len(p) < 50}
    kids = defaultdict(lambda: defaultdict(int))
    for way in own.values():
        for a, b in zip(way, way[1:] + [None], strict=True):
            kids[a[:2]][f"{b[0]}:{b[1]}" if b else None] += 1
    got = defaultdict(dict)
    for r in aggregates.child_counts(tree).collect():
        got[r.scale, r.center][r.bucket] = r.n
    assert got == kids
    for r in aggregates.fractal_dims(tree).collect():
        parts = kids[r.scale, r.center]
        rests = [p for p in under[r.scale, r.center] if own[p][-1][:2] == (r.scale, r.center) and p != r.center]
        n = len([k for k in parts if k]) + len(rests)
        assert r.fractal_dim == pytest.approx(np.log(n) / np.log(1.5) if n else 0.0)
    drawn = aggregates.sample(tree, 25, seed=3).collect()
    rest = {w[-1][:2] for w in own.values()}
    assert len(drawn) == 25 and all((r.scale, r.center) in rest and len(r.vec) == 2 for r in drawn)


def test_one_point_and_equal_points(spark):
    def nodes(rows):
        return [(r.scale, r.center, r.coverage_count, r.is_leaf) for r in build(cloud(spark, np.array(rows)), TreeParams()).nodes().collect()]

    assert nodes([[2.5, 1.0]]) == [(-11, 0, 1, True)]
    assert nodes([[2.5, 1.0]] * 5) == [(-11, 4, 5, True)]
    with pytest.raises(ValueError):
        build(cloud(spark, np.zeros((0, 2))), TreeParams())
    for wrong in ({"scale_base": 1.0}, {"partition_type": "other"}):
        with pytest.raises(ValueError):
            TreeParams(**wrong)


def test_published_versions(spark, tree, rows, tmp_path):
    """A reader gets the last version that was published whole."""
    at = str(tmp_path / "tree")
    tree.write(at)
    again = CoverTree.read(spark, at)
    assert again.params == tree.params and ways(again) == ways(tree)
    other = build(cloud(spark, rows[:50]), TreeParams())
    other.write(at)
    assert len(ways(CoverTree.read(spark, at))) == 50 and len(ways(again)) == len(rows)


@pytest.fixture
def weighted():
    """A metric of two components, there for one test only."""
    weights = np.array([1.0, 3.0])
    metrics.register("weighted", lambda a, b: F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.array(F.lit(1.0), F.lit(3.0)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x), lambda r, p: np.abs(r - p) @ weights)
    yield weights
    metrics.unregister("weighted")


def test_own_metric(spark, rows, weighted):
    """A metric of the user's in searches and trees; taken names and built-in ones are kept."""
    for wrong in (lambda: metrics.register("weighted", metrics.l1, metrics.ROWS["l1"]), lambda: metrics.unregister("l1")):
        with pytest.raises(ValueError):
            wrong()
    points = cloud(spark, rows)
    far = (np.abs(rows[:4, None, :].astype(float) - rows[None, :, :].astype(float)) * weighted).sum(axis=2)
    want = {(q, k + 1): p for q in range(4) for k, p in enumerate(np.lexsort((np.arange(len(rows)), far[q]))[:3])}
    tree = build(points, TreeParams(metric="weighted"))
    for found in (knn(points, asked(spark, rows[:4]), 3, "weighted"), walk.tree_knn(tree, asked(spark, rows[:4]), 3)):
        assert {(r.qid, r.rk): r.pid for r in found.collect()} == want


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_net_by_blocks(monkeypatch, metric):
    """The net in order, of points on a grid whose distances often equal the reach; rows are measured in blocks."""
    vecs, measured, one = np.random.default_rng(8).integers(0, 4, (1500, 5)).astype(float), [], metrics.rows_to_point
    reach = {"l2": 2.0, "l1": 2.0, "cosine": 0.002}[metric]
    left, want = np.arange(len(vecs)), []
    while len(left):
        want.append(int(left[0]))
        left = left[1:][~(one(metric, vecs[left[1:]], vecs[left[0]]) < reach)]
    monkeypatch.setattr(tree_module, "LAST_BATCH", 40)
    assert tree_module.net(metric, vecs, reach) == want
    far = np.random.default_rng(9).normal(size=(1500, 12))
    monkeypatch.setattr(metrics, "rows_to_point", lambda name, rows, point: measured.append(len(rows)) or one(name, rows, point))
    assert tree_module.net("l2", far, 0.1) == list(range(1500))
    assert sum(measured) < 1500 * 40
