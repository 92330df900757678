"""Tables that Spark writes in the folder which driver and executors share, and joins with small ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS, SMALL_BYTES = 1 << 16, 8 << 20  # bounds of a side that is broadcast


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where none is set and Spark runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="emberlog-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if its rows and their texts are within the bounds."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"]
    size = sum(texts, F.lit(0)) if texts else F.lit(0)
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(table) if rows <= SMALL_ROWS and total <= SMALL_BYTES else table


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """df over all cores where its few files make fewer tasks than that; a plan over many files stays as it is.

    With `most`, there are as many tasks as give each so many bytes of the files at most, on average.
    """
    tasks, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if most:
        tasks = max(tasks, -(-plan.optimizedPlan().stats().sizeInBytes() // most))
    return df.repartition(tasks) if plan.toRdd().getNumPartitions() < tasks else df
