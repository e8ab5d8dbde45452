import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import metrics
from orrery.operators.knn import assign, first_cover, knn, within
from orrery.sources import points as src
from orrery.sources import raw


def test_metrics_agree(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 5))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    for name, column in metrics.COLUMNS.items():
        got = df.select(column(F.col("a"), F.col("b"))).first()[0]
        assert got == pytest.approx(metrics.rows_to_point(name, a[None, :], b)[0])
        assert got == pytest.approx(metrics.pairwise(name, a[None, :], b[None, :])[0, 0])
    assert df.select(metrics.l1_sqrt(F.col("a"), F.col("b"))).first()[0] == pytest.approx(np.sqrt(np.abs(a - b).sum()))
    assert df.select(metrics.sq_norm(F.col("a"))).first()[0] == pytest.approx((a * a).sum())
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(metrics.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_integer_and_sparse_vectors(spark):
    ints = spark.createDataFrame([([1, 2, 3], [4, 6, 3])], "a array<int>, b array<int>")
    assert ints.select(metrics.l2(F.col("a"), F.col("b"))).first()[0] == 5.0
    rows = spark.createDataFrame([([0, 4], [1.0, 2.0], [1, 4], [3.0, 2.0])], "ai array<int>, av array<float>, bi array<int>, bv array<float>")
    cols = [F.col(c) for c in ("ai", "av", "bi", "bv")]
    assert rows.select(metrics.sparse_l2(*cols)).first()[0] == pytest.approx(np.sqrt(10))
    assert rows.select(metrics.sparse_l1(*cols)).first()[0] == 4.0
    assert rows.select(metrics.densify(6, F.col("ai"), F.col("av"))).first()[0] == [1.0, 0.0, 0.0, 0.0, 2.0, 0.0]


def test_fixed_and_glued_clouds(spark):
    fixed = src.from_rows(spark, [[i] * 5 for i in range(5)])
    zero = spark.createDataFrame([(0, [0.0] * 5)], "qid long, vec array<float>")
    near = {r.pid: r.dist for r in within(fixed, zero, 100.0).collect()}
    assert near[1] == pytest.approx(np.sqrt(5))
    parts = [src.from_rows(spark, [[j] * 3 for j in range(2)], [0, 1]) for _ in range(5)]
    whole = src.source_address(src.glue(*parts), [2] * 5)
    assert [(r.source, r.local) for r in whole.orderBy("pid").collect()] == [(i // 2, i % 2) for i in range(10)]
    odd = whole.where("pid % 2 = 1")
    assert odd.groupBy("label").count().collect()[0][:] == (1, 5)


def test_glue_of_single_points(spark):
    one, two = src.from_rows(spark, [[1.0]]), src.from_rows(spark, [[2.0], [3.0]])
    assert sorted(r.pid for r in src.glue(one, one, two, two.limit(0), one).collect()) == [0, 1, 2, 3, 4]


def test_globs_of_any_case(spark, tmp_path):
    for i, name in enumerate(["b.DAT", "A.dat", "c.Dat", "d.csv"]):
        np.full(2, i, "<f4").tofile(tmp_path / name)
    (tmp_path / "c.yml").write_text("data_path: '*.dAt'\ndata_dim: 2\n")
    assert [r.vec[0] for r in src.from_yaml(spark, str(tmp_path / "c.yml")).orderBy("pid").collect()] == [1.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        src.globbed(spark, str(tmp_path / "*.none"))


def test_many_label_lines(spark, tmp_path):
    """Label files are numbered by their blocks, however they are split."""
    (tmp_path / "y.csv").write_text("y\n" + "".join(f"{i + 1}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = src.read_labels(spark, str(tmp_path / "y.csv"), 0)
        assert all(r.label == r.pid + 1 for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_knn_edges(spark):
    cloud = src.from_flat(spark, [0.0, 1.0, 1.0, 3.0], 1)
    one = spark.createDataFrame([(7, [1.0]), (8, None)], "qid long, vec array<float>")
    assert [(r.rk, r.pid) for r in knn(cloud, one, 10).orderBy("rk").collect()] == [(1, 1), (2, 2), (3, 0), (4, 3)]
    assert knn(cloud, one.limit(0), 3).count() == 0
    assert knn(cloud.limit(0), one, 3).count() == 0


def test_assignment_ties(spark):
    cloud = src.from_flat(spark, [0.0, 1.0, 2.0, 5.0], 1)
    centers = spark.createDataFrame([(0, [0.0], 1), (2, [2.0], 0)], "cid long, vec array<float>, ord int")
    assert {r.pid: r.center for r in assign(cloud, centers).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert {r.pid: r.center for r in assign(cloud, centers, nested=0).collect()}[1] == 2
    assert {r.pid: r.center for r in first_cover(cloud, centers, 1.5).collect()} == {0: 0, 1: 2, 2: 2}


def test_labels(spark, tmp_path):
    hot = spark.createDataFrame([([0.0, 1.0, 0.0],), ([0.1, 0.2, 0.3],)], "v array<double>")
    assert [r[0] for r in hot.select(src.one_hot_label(F.col("v"))).collect()] == [1, None]
    binary = spark.createDataFrame([([0.7],), ([0.2],)], "v array<double>")
    assert [r[0] for r in binary.select(src.binary_label(F.col("v"))).collect()] == [1, 0]
    with gzip.open(tmp_path / "y.csv.gz", "wt") as f:
        f.write("name,y\na,3\nb,0\nc,\nd,-2\ne,x\nf,1\n")
    assert [r.label for r in src.read_labels(spark, str(tmp_path / "y.csv.gz"), 1).orderBy("pid").collect()] == [3, None, None, None, None, 1]


def test_raw_files_and_yaml(spark, tmp_path):
    data = np.arange(12, dtype="<f4")
    data[:6].tofile(tmp_path / "a.dat")
    data.tofile(tmp_path / "x.dat")
    (tmp_path / "y.csv").write_text("i,y\n0,5\n1,0\n2,7\n3,1\n")
    (tmp_path / "c.yml").write_text("data_path: x.dat\nlabels_path: y.csv\nlabels_index: 1\ndata_dim: 3\nscale_base: 1.5\ncutoff: 4\nresolution: -3\n")
    got = src.from_yaml(spark, str(tmp_path / "c.yml")).orderBy("pid").collect()
    assert [r.vec for r in got] == data.reshape(4, 3).tolist() and [r.label for r in got] == [5, None, 7, 1]
    assert src.tree_params_from_yaml(str(tmp_path / "c.yml")) == {"scale_base": 1.5, "leaf_cutoff": 4, "min_res_index": -3}
    two = src.read_raw(spark, [str(tmp_path / "a.dat"), str(tmp_path / "x.dat")], 3)
    assert two.count() == 6 and sorted(r.pid for r in two.collect()) == list(range(6))


def test_raw_source(spark, tmp_path):
    """Byte ranges, folders, appended and replaced clouds."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1000, 7)).astype("<f4")
    cloud = src.from_rows(spark, data.tolist()).repartition(5)
    where = str(tmp_path / "cloud")
    raw.write_raw(cloud, where, 7)
    back = raw.read_raw(spark, where, 7, task_bytes=7 * 4 * 64)
    assert back.rdd.getNumPartitions() > 10
    rows = back.orderBy("pid").collect()
    assert [r.pid for r in rows] == list(range(1000)) and np.array_equal(np.array([r.vec for r in rows], "<f4"), data)
    raw.write_raw(cloud.where("pid < 10"), where, 7, append=True)
    (tmp_path / "cloud" / "part-stray.f32").write_bytes(b"123")  # left behind by a lost task
    assert [r.vec for r in raw.read_raw(spark, where, 7).where("pid >= 1000").orderBy("pid").collect()] == data[:10].tolist()
    raw.write_raw(cloud.where("pid >= 990"), where, 7)
    assert [r.vec for r in raw.read_raw(spark, [where, where], 7).orderBy("pid").collect()] == data[990:].tolist() * 2
    raw.write_raw(cloud.limit(0), where, 7)
    assert raw.read_raw(spark, where, 7).count() == 0
    with pytest.raises(Exception, match="whole number"):
        data.tofile(tmp_path / "odd.dat")
        raw.read_raw(spark, str(tmp_path / "odd.dat"), 3).count()
    with pytest.raises(Exception, match="components"):
        raw.write_raw(cloud, where, 6)
    assert raw.read_raw(spark, where, 7).count() == 0


def test_reindex_and_checks(spark):
    cloud = src.from_flat(spark, [0.0, 1.0], 1)
    full = spark.createDataFrame([(0, 10), (1, 11)], "old long, new long")
    assert sorted(r.pid for r in src.reindexed(cloud, full).collect()) == [10, 11]
    with pytest.raises(ValueError):
        src.reindexed(cloud, full.limit(1))
    with pytest.raises(ValueError):
        src.from_flat(spark, [1.0, 2.0, 3.0], 2)
    with pytest.raises(Exception, match="components"):
        src.checked(cloud, 2).collect()


def test_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "x long")
    assert all(r.x + 1 == r["rank"] for r in src.ranked(df, ["x"]).collect())
