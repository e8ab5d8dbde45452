"""Aggregates of nodes that users write: recursive ones over children's results, and summaries of their own.

A NodePlugin is told in columns. Nodes are taken from the smallest scale up, so that a node sees what its
children came to; work beyond one grouping of the points is on tables of nodes.

A Summary is told in Python: an empty state, how to add rows, how to combine two states. States are made for
each task, and combined in two steps after a shuffle, so that no task gets all the states of a node that
many tasks have seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.aggregates import NODE, covered
from orrery.operators.tree import CoverTree
from orrery.sources.tables import settled

#: Nodes whose states a task holds before it hands them on.
HELD_STATES = 10_000
#: Numbers of scatter matrices that a task keeps.
SCATTER_NUMBERS = 8_000_000
#: Groups in which the states of a node are combined first.
FIRST_GROUPS = 64


@dataclass(frozen=True)
class NodePlugin:
    """rests: aggregates over the columns of the points that rest at a node. kids: aggregates over its
    children, whose own result is the struct `kid`, beside kid_scale, kid_center, nested and n (points covered).
    result: columns over scale, center, coverage_count, is_leaf, rests, kids and the results of plugins
    named before this one (structs by name). Nodes without children or resting points see nulls."""

    name: str
    result: dict[str, Column]
    rests: dict[str, Column] = field(default_factory=dict)
    kids: dict[str, Column] = field(default_factory=dict)


def fold(tree: CoverTree, plugins: list[NodePlugin], columns: list[str] | None = None) -> DataFrame:
    """scale, center and a struct for each plugin, named after it. Plugins run in their order at each node, so
    that a later one can read what an earlier one found there and at the children."""
    rest = tree.final_address().select(*NODE, "pid", "dist")
    if columns:
        rest = rest.join(tree.points.select("pid", *columns), "pid")
    nodes = tree.nodes().select(*NODE, "parent_scale", "parent_center", "coverage_count", "is_leaf")
    own = [c.alias(f"{p.name}_{n}") for p in plugins for n, c in p.rests.items()]
    if own:
        nodes = nodes.join(rest.groupBy(*NODE).agg(*own), NODE, "left")
    nodes = settled(nodes, "nodes")
    scales = [r.scale for r in nodes.select("scale").distinct().orderBy("scale").collect()]  # a row for each layer
    done: list[DataFrame] = []
    for scale in scales:
        here = nodes.where(F.col("scale") == scale)
        for p in plugins:
            if p.kids and done:
                below = reduce(DataFrame.unionByName, done).where(F.col("parent_scale") == scale)
                kids = below.select(F.col("parent_scale").alias("scale"), F.col("parent_center").alias("center"), F.col("scale").alias("kid_scale"), F.col("center").alias("kid_center"), (F.col("center") == F.col("parent_center")).alias("nested"), F.col("coverage_count").alias("n"), F.col(p.name).alias("kid"), *[F.col(q.name) for q in plugins if q.name != p.name])
                here = here.join(kids.groupBy(*NODE).agg(*[c.alias(f"{p.name}_{n}") for n, c in p.kids.items()]), NODE, "left")
            elif p.kids:
                here = here.withColumns({f"{p.name}_{n}": F.lit(None) for n in p.kids})
            seen = here
            for n in (*p.rests, *p.kids):
                seen = seen.withColumn(n, F.col(f"{p.name}_{n}"))
            here = seen.withColumn(p.name, F.struct(*[c.alias(n) for n, c in p.result.items()])).select(*here.columns, p.name)
        done.append(settled(here.select(*NODE, "parent_scale", "parent_center", "coverage_count", *[p.name for p in plugins]), "layer"))
    return reduce(DataFrame.unionByName, done).select(*NODE, *[p.name for p in plugins])


@dataclass(frozen=True)
class Summary:
    """empty() makes a state; add(state, rows) and combine(state, state) give one; finish(state) gives the
    values of `output`, a schema. The result must not depend on the order of rows or states; states are
    pickled. held: the states that a task keeps before it hands them on."""

    empty: Callable[[], Any]
    add: Callable[[Any, pd.DataFrame], Any]
    combine: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]
    output: str
    held: int = HELD_STATES


def summarise(rows: DataFrame, by: list[str], summary: Summary) -> DataFrame:
    """by... and the summary's output for each group of rows."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    values = [c for c in rows.columns if c not in by]

    def packed(states: dict[tuple, Any]) -> pa.RecordBatch:
        frame = pd.DataFrame([(*key, pickle.dumps(state)) for key, state in states.items()], columns=[*by, "state"])
        return pa.RecordBatch.from_pandas(frame, preserve_index=False)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            for key, part in batch.to_pandas().groupby(by, dropna=False, sort=False):
                states[key] = summary.add(states[key] if key in states else summary.empty(), part[values])
                if len(states) > summary.held:
                    yield packed(states)
                    states = {}
        if states:
            yield packed(states)

    def combined(group: pd.DataFrame) -> Any:
        return reduce(summary.combine, map(pickle.loads, group["state"]))

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return group[by].head(1).assign(state=pickle.dumps(combined(group)))

    def last(group: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in summary.output.split(", ")]
        return pd.concat([group[by].head(1).reset_index(drop=True), pd.DataFrame([summary.finish(combined(group))], columns=names)], axis=1)

    parts = rows.select(*by, *values).mapInArrow(added, f"{keys}, state binary").select(*by, "state")
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("state"), F.lit(FIRST_GROUPS)))
    fewer = dealt.groupBy(*by, "_group").applyInPandas(first, f"{keys}, state binary")
    return fewer.groupBy(*by).applyInPandas(last, f"{keys}, {summary.output}")


def spectrum(dim: int, keep: int) -> Summary:
    """Singular values and right vectors of centred vectors, from their count, sum and scatter matrix; so the
    smallest values are good to half the digits of the largest."""

    def add(state: tuple, rows: pd.DataFrame) -> tuple:
        x = np.array(rows["vec"].tolist(), np.float64)
        return state[0] + len(x), state[1] + x.sum(axis=0), state[2] + x.T @ x

    def finish(state: tuple) -> tuple:
        n, total, scatter = state
        values, axes = np.linalg.eigh(scatter - np.outer(total, total) / n)
        top = np.argsort(-values)[: min(keep, n, dim)]
        return n, np.sqrt(np.maximum(values[top], 0.0)).tolist(), axes.T[top].tolist()

    return Summary(lambda: (0, np.zeros(dim), np.zeros((dim, dim))), add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)), finish, "n long, value array<double>, axis array<array<double>>", max(1, SCATTER_NUMBERS // dim**2))


def singular_values(tree: CoverTree, min_points: int, keep: int = 8) -> DataFrame:
    """scale, center, k, value, axis of every node that covers more than min_points points, the root too: scatter
    matrices are added up, and none of a node's points are gathered."""
    dim = len(tree.points.select("vec").first().vec)
    large = tree.paths.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > min_points).select(*NODE)
    rows = covered(replace(tree, paths=tree.paths.join(large, NODE, "left_semi")), "vec").select(*NODE, "vec")
    found = summarise(rows, NODE, spectrum(dim, keep))
    return found.select(*NODE, F.posexplode(F.arrays_zip("value", "axis")).alias("k", "s")).select(*NODE, "k", "s.value", "s.axis")


def node_summary(tree: CoverTree, columns: list[str], summary: Summary) -> DataFrame:
    """scale, center and the summary of all points under each node; rows have pid and the columns."""
    return summarise(covered(tree, *columns).select(*NODE, "pid", *columns), NODE, summary)
