"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder for intermediate tables of a session in one process (tests, laptops) that names none.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a cluster the session must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which may be deleted when the application ends."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage at files that outlive executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that a task takes where it makes several wide rows of each.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in a number of partitions that follows its rows, so that a task's memory does not grow with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if f"/{spark.sparkContext.applicationId}/" in folder:
                at = spark._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
