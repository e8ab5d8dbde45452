"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or the warehouse where the
    session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: its lineage ends, and losing an executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/orrery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes settled tables of which nothing is read any more, since a later table holds the result."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files and "/orrery/" in files[0]:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
