import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators import sparse
from orrery.operators.knn import assign, knn, within
from orrery.sources.points import dense

DIM = 300


@pytest.fixture(scope="module")
def cloud(spark):
    """Few entries a point, in any order; equal points, an empty one, a null one."""
    rng, rows = np.random.default_rng(5), []
    for pid in range(200):
        at = rng.choice(DIM, size=rng.integers(1, 12), replace=False)
        rows.append((pid, at.tolist(), np.round(rng.normal(size=len(at)), 2).tolist()))
    rows += [(200, *rows[3][1:]), (201, [], []), (202, None, None)]
    return spark.createDataFrame(rows, "pid long, idx array<int>, val array<float>").repartition(3)


@pytest.mark.parametrize("metric", ["l2", "l1", "l1_sqrt", "cosine"])
def test_sparse_equals_dense(spark, cloud, metric, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK_NUMBERS", 2000)
    whole = dense(cloud.where("idx is not null"), DIM)
    asked = cloud.where("pid % 9 = 0 or pid > 199").withColumnRenamed("pid", "qid")
    dense_asked = dense(asked.where("idx is not null").withColumnRenamed("qid", "pid"), DIM).withColumnRenamed("pid", "qid")
    found = sparse.sparse_knn(cloud, asked, 4, metric).collect()
    want = {(r.qid, r.rk): round(r.dist, 9) for r in knn(whole, dense_asked, 4, metric).collect()}
    assert {(r.qid, r.rk): round(r.dist, 9) for r in found} == pytest.approx(want, abs=2e-8)
    near = {(r.qid, r.pid): r.dist for r in within(whole, dense_asked, 1.2, metric).collect()}
    assert {(r.qid, r.pid): r.dist for r in sparse.sparse_within(cloud, asked, 1.2, metric).collect()} == pytest.approx(near, abs=2e-8)
    centers = cloud.where("pid in (3, 17, 200, 55, 90)").withColumnRenamed("pid", "cid")
    of = assign(whole, dense(centers.withColumnRenamed("cid", "pid"), DIM).withColumnRenamed("pid", "cid"), metric)
    mine = {r.pid: r.dist for r in sparse.sparse_assign(cloud, centers, metric).collect()}
    assert mine == pytest.approx({r.pid: r.dist for r in of.collect()}, abs=2e-8) and 202 not in mine


@pytest.mark.parametrize("metric", list(metrics.SPARSE))
def test_columns_and_kernels_agree(spark, metric):
    rows = spark.createDataFrame([([7, 2], [3, -4], [2, 9], [1, 5])], "ai array<int>, av array<int>, bi array<int>, bv array<int>")
    column = rows.select(metrics.SPARSE[metric](*[F.col(c) for c in rows.columns])).first()[0]
    point = spark.createDataFrame([(1, [7, 2], [3, -4])], "pid long, idx array<int>, val array<int>")
    query = spark.createDataFrame([(1, [2, 9], [1, 5])], "qid long, idx array<int>, val array<int>")
    assert sparse.sparse_knn(point, query, 1, metric).first().dist == pytest.approx(column)
    a, b = np.zeros(10), np.zeros(10)
    a[[7, 2]], b[[2, 9]] = [3, -4], [1, 5]
    assert column == pytest.approx(metrics.rows_to_point(metric, a[None, :], b)[0])


def test_ties_and_far_dimensions(spark):
    """Equal distances go to the smaller pid; indices may be as large as longs."""
    cloud = spark.createDataFrame([(i, [10**15 + i % 2], [1.0]) for i in range(20)], "pid long, idx array<long>, val array<double>")
    query = spark.createDataFrame([(0, [10**15], [1.0])], "qid long, idx array<long>, val array<double>")
    assert [(r.pid, r.dist) for r in sparse.sparse_knn(cloud, query, 3).orderBy("rk").collect()] == [(0, 0.0), (2, 0.0), (4, 0.0)]
    centers = cloud.where("pid < 4").withColumnRenamed("pid", "cid")
    assert {r.center for r in sparse.sparse_assign(cloud, centers).collect()} == {0, 1}
    assert sparse.sparse_knn(cloud.limit(0), query, 3).count() == 0
    assert sparse.sparse_knn(cloud, query.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sparse.sparse_knn(cloud, query, 3, "linf")


@pytest.mark.parametrize("bad", [([1, 1], [1.0, 2.0]), ([1, 2], [1.0]), ([1], [None])])
def test_bad_vectors(spark, bad):
    cloud = spark.createDataFrame([(0, *bad)], "pid long, idx array<int>, val array<double>")
    query = spark.createDataFrame([(0, [1], [1.0])], "qid long, idx array<int>, val array<double>")
    with pytest.raises(Exception, match="sparse vector"):
        sparse.sparse_knn(cloud, query, 1).collect()
