"""Every query with SQL gives what DuckDB gives on the small tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orrery import plans
from orrery.api import PointIndex


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else int(x) if isinstance(x, np.integer) else x for x in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, small, duck, name):
    assert rows(plans.queries()[name](spark, small).toPandas()) == rows(duck.execute(plans.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_facade(spark, small, tmp_path):
    from orrery.plans.vectors import asked, points

    index = PointIndex().set(scale_base=1.3).fit(points(spark, small))
    some = asked(points(spark, small))
    assert index.knn(some, 3).count() == index.brute_knn(some, 3).count()
    assert index.children(*index.root().select("scale", "center").first()).count() > 0
    assert index.point_depths(some).count() == some.count()
    order = some.selectExpr("qid", "qid div 20 + 1 as tick")
    stats = index.track(index.path(some), order, order.where("tick % 5 = 0").select("tick"), 4)
    assert stats.count() > 0
    ticks = order.where("tick % 5 = 0").select("tick")
    tracker = index.tracker(4).push(index.path(some), order)
    assert tracker.stats(ticks).count() == stats.count() == ticks.count()
    assert tracker.probabilities(ticks).where("prob > 1 or prob <= 0").count() == 0
    assert tracker.total_kl(ticks).where("kl < 0").count() == 0
    assert tracker.normalised(ticks, index.baseline(sequences=2, sample_rate=5)).count() > 0
    top = index.root().select("scale", "center").first()
    assert index.layer_points(top.scale).count() == 1 and index.layer_children(top.scale).count() == index.children(*top).count()
    assert index.cover_gaussian(*top).where("n = 500").count() == 64
    assert index.layer_singletons(top.scale).count() == index.singletons(*top).count()
    most = index.add_aggregate("most", ["label"], F.max("label").alias("most")).aggregate("most")
    assert most.count() == index.nodes().count()
    index.save(str(tmp_path / "i"))
    assert PointIndex.load(spark, str(tmp_path / "i")).nodes().count() == index.nodes().count()
