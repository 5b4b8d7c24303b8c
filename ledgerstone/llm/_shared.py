"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def shared_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write and reread: cuts the lineage, survives lost executors."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as make it none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release() -> None:
    """Give Arrow's free memory back to the system: workers outlive a task, and the next stage's would come on top of it."""
    pa.default_memory_pool().release_unused()
