"""Snapshots in the folder that driver and executors share, and total orders over tables of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def snapshot(df: DataFrame) -> DataFrame:
    """Written to a shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """Adds the place of each row in the order, from 1: ranges are sorted apart, and each adds the rows of the ranges before it. Equal rows of the order stand in any order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition in its upper bits, the place in the lower 33
    rows = snapshot(rows.withColumn("_part", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_place") + 1).cast("long")).drop("_part", "_place", "_before")
