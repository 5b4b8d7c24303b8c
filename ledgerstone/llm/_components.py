"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm._shared import shared_table


def components(links: DataFrame) -> DataFrame:
    """(node long, comp long) for every node of links (a long, b long): comp is the smallest node reachable.

    Smallest labels spread along links, and every label is replaced by its own label's label, so chains shrink by half a round. Each
    round is written to the shared folder; the driver sees one count per round.
    """
    spark = links.sparkSession
    both = shared_table(spark, links.select("a", "b").unionAll(links.select("b", "a")).where("a <> b").distinct())
    labels = shared_table(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = shared_table(spark, labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        up = step.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        labels = shared_table(spark, step.join(up, step.comp == up.up, "left").select("node", "old", F.least("comp", "top").alias("comp")))
        if not labels.where("comp <> old").limit(1).count():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
