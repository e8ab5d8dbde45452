"""Point clouds as DataFrames points(pid, vec, ...): reading, joining and reshaping.

A missing label is null. Row ids come from the data, or from the position in a file or list.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.metrics import densify
from orrery.sources.raw import read_raw
from orrery.sources.tables import settled


def ranked(df: DataFrame, order: list[Column | str], out: str = "rank", start: int = 1) -> DataFrame:
    """df with its rows' places in the order, counted without gathering them: rows are dealt out by
    ranges, numbered in their partition, and shifted by the rows of the partitions before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(shifts, "_part").withColumn(out, F.col("_at") + F.col("_shift") + start).drop("_part", "_at", "_n", "_shift")


def from_rows(spark: SparkSession, rows: Sequence[Sequence[float]], labels: Sequence[int | None] | None = None) -> DataFrame:
    """pid, vec, label of vectors in memory; pid is the position. All must be equally long."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    kept = labels if labels is not None else [None] * len(rows)
    if len(kept) != len(rows):
        raise ValueError("as many labels as vectors are needed")
    return spark.createDataFrame([(i, [float(x) for x in r], y) for i, (r, y) in enumerate(zip(rows, kept, strict=True))], "pid long, vec array<float>, label long")


def from_flat(spark: SparkSession, data: Sequence[float], dim: int, labels: Sequence[int | None] | None = None) -> DataFrame:
    """A flat list of numbers, cut into vectors of dim."""
    if dim < 1 or len(data) % dim:
        raise ValueError("the data's length is no multiple of dim")
    return from_rows(spark, [data[i : i + dim] for i in range(0, len(data), dim)], labels)


def read_labels(spark: SparkSession, path: str, column: int, min_valid: int = 1) -> DataFrame:
    """pid, label of a CSV file (.gz too) with a header; the column by position. Missing or unreadable
    fields, and labels under min_valid, are null. pid is the line's position: lines are counted by the
    blocks in which they are read, and only the blocks are put in order."""
    lines = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if not 0 <= column < len(lines.columns):
        raise ValueError(f"the file has no column {column}")
    value = F.expr(f"try_cast(`{lines.columns[column]}` as bigint)")
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = settled(lines.select(*block, F.monotonically_increasing_id().alias("at"), value.alias("label")), "label-lines")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = rows.join(blocks, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("pid"), "label")
    return numbered.select("pid", F.when(F.col("label") >= min_valid, F.col("label")).alias("label"))


def with_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points with `label` by pid; unlabelled points stay, with null."""
    return points.drop("label").join(labels.select("pid", "label"), "pid", "left")


def with_names(points: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """points with `name` by pid; by default the pid in decimal."""
    if names is None:
        return points.withColumn("name", F.col("pid").cast("string"))
    return points.drop("name").join(names.select("pid", "name"), "pid", "left")


def by_name(points: DataFrame, names: list[str]) -> DataFrame:
    return points.where(F.col("name").isin(names))


def glue(*parts: DataFrame) -> DataFrame:
    """Clouds put end to end: each part's pids follow the part before's largest. Adds nothing else."""
    out, shift = [], 0
    for part in parts:
        out.append(part.withColumn("pid", F.col("pid") + F.lit(shift)))
        last = part.agg(F.max("pid")).first()[0]
        shift += 0 if last is None else last + 1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def source_address(points: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds source and local: which glued part a pid came from, and its place there."""
    bounds = np.cumsum([0, *sizes]).tolist()
    source = F.coalesce(*[F.when((F.col("pid") >= a) & (F.col("pid") < b), F.lit(i)) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])
    base = F.coalesce(*[F.when(F.col("pid") < b, F.lit(a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return points.withColumns({"source": source, "local": F.col("pid") - base})


def reindexed(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """points with new pids (mapping: old, new); every point must have one, and every old must exist."""
    missing = points.join(mapping, points["pid"] == mapping["old"], "left_anti").count()
    unknown = mapping.join(points, points["pid"] == mapping["old"], "left_anti").count()
    if missing or unknown:
        raise ValueError(f"{missing} points without a new pid, {unknown} unknown old pids")
    return points.join(mapping, points["pid"] == mapping["old"]).withColumn("pid", F.col("new")).drop("old", "new")


def one_hot_label(vec: Column) -> Column:
    """The first component over a half, from 0; null without one."""
    at = F.array_position(F.transform(vec, lambda x: x > 0.5), True)
    return F.when(at > 0, at - 1)


def binary_label(vec: Column) -> Column:
    """1 or 0 of a one-component vector; an error for longer ones."""
    return F.when(F.size(vec) != 1, F.raise_error(F.lit("a binary label has one component"))).otherwise(F.when(vec[0] > 0.5, 1).otherwise(0)).cast("long")


def dense(points: DataFrame, dim: int) -> DataFrame:
    """points(pid, idx, val) of sparse vectors -> pid, vec."""
    return points.select("pid", densify(dim, F.col("idx"), F.col("val")).alias("vec"))


def checked(points: DataFrame, dim: int) -> DataFrame:
    """points, failing on the first vector that is null or not of dim components."""
    good = F.col("vec").isNotNull() & (F.size("vec") == dim)
    return points.withColumn("vec", F.when(good, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} components"))))


def any_case(pattern: str) -> str:
    """A glob in which each letter stands for both its cases."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in pattern)


def globbed(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a path whose last part is a glob of any case, in order of their names. Listed by
    Spark's own file system, so that any store will do."""
    folder, _, last = pattern.rpartition("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{any_case(last)}" if folder else any_case(last))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(f.getPath().toString()) for f in found or [])
    if not names:
        raise ValueError(f"no files for {pattern}")
    return names


def from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """points of a data set's YAML file: data_path (relative to the file; its last part a glob of any case), data_dim, and with
    labels labels_path and either labels_index (CSV column, or label_csv_index) or labels_dim (raw
    vectors; one component is binary, more are one-hot)."""
    import yaml

    with open(path) as lines:
        config = yaml.safe_load(lines)
    here = os.path.dirname(os.path.abspath(path))
    points = read_raw(spark, globbed(spark, os.path.join(here, config["data_path"])), int(config["data_dim"]))
    if not config.get("labels_path"):
        return points
    where = globbed(spark, os.path.join(here, config["labels_path"]))[0]
    column = config.get("labels_index", config.get("label_csv_index"))
    if column is not None:
        return with_labels(points, read_labels(spark, where, int(column)))
    n = int(config.get("labels_dim", 1))
    raw = read_raw(spark, where, n)
    return with_labels(points, raw.select("pid", (binary_label(F.col("vec")) if n == 1 else one_hot_label(F.col("vec"))).alias("label")))


def tree_params_from_yaml(path: str) -> dict:
    """Tree parameters of the same file; `cutoff` and `resolution` are known as leaf_cutoff and
    min_res_index."""
    import yaml

    with open(path) as lines:
        config = yaml.safe_load(lines) or {}
    known = {"scale_base": float, "leaf_cutoff": int, "min_res_index": int, "use_singletons": bool, "rng_seed": int, "partition_type": lambda x: str(x).lower()}
    alias = {"cutoff": "leaf_cutoff", "resolution": "min_res_index"}
    found = {alias.get(k, k): v for k, v in config.items()}
    return {k: kind(found[k]) for k, kind in known.items() if found.get(k) is not None}
