"""Incremental ingest of statement text: an addition, as the batch library has no stream of its own.

JSON files of (filename, pages) arriving in a folder are parsed once per content. Contents that came before are kept in the stream's own state, a hash each, so a micro-batch reads
nothing but its own files. It writes a folder of its own, which a replay of the batch writes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerstone.operators.statements import parse_statements, reconcile

SCHEMA = "filename string, pages array<string>"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive, with the sha256 of their text and an id from it."""
    raw = spark.readStream.schema(SCHEMA).json(folder)
    sha = F.sha2(F.array_join(F.coalesce("pages", F.array()), "\f"), 256)
    return raw.withColumn("sha256", sha).withColumn("id", F.xxhash64("sha256"))


def start(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Parse what arrives in a folder to a Parquet store until stopped; all that is there now, once, with ``availableNow``.

    Of files of one content the first stays, also where they come in different batches or runs: the state is in the checkpoint. It grows by a hash for each content, over as many partitions
    as the session shuffles to at the first start.
    """

    def put(batch: DataFrame, number: int) -> None:
        fresh = batch.persist()
        parsed = reconcile(parse_statements(fresh)).join(fresh.select("id", "filename", "sha256"), "id")
        parsed.write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={number}")
        fresh.unpersist()

    fresh = incoming(spark, folder).dropDuplicates(["sha256"])
    return fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
