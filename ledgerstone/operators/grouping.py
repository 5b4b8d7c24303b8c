"""Company suggestions: merchant keys that share a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.sources.shared import positions

#: What follows a company's name on an outlet: nothing, a bracket or dash, or words with digits only.
MARKER = r"^$|^[(\-\[#/*]|^(\S*[0-9]\S*)(\s+\S*[0-9]\S*)*$"


def suggest(keys: DataFrame, taken: DataFrame | None = None, key: str = "merchant_normalized") -> DataFrame:
    """Groups (prefix, name, members, n) of two or more keys.

    A key's prefixes are nested, so the shortest one that qualifies claims all of its keys: the first word, if two keys or more
    share it, it has three characters or more, and it is a key itself or only outlet markers follow it; else the first two words.
    """
    k = keys.select(F.col(key).alias("k")).where("k IS NOT NULL AND k != ''").distinct()
    if taken is not None:
        k = k.join(taken.select(F.col(key).alias("k")), "k", "left_anti")
    k = k.withColumn("t", F.split("k", r"\s+")).withColumn("one", F.col("t")[0]).withColumn("two", F.when(F.size("t") >= 2, F.concat_ws(" ", F.slice("t", 1, 2))))
    rest = F.trim(F.expr("substring(k, length(one) + 1)"))
    solo = k.groupBy("one").agg(F.count("*").alias("c"), F.bool_or(F.col("k") == F.col("one")).alias("bare"), F.bool_and(rest.rlike(MARKER)).alias("outlets"))
    solo = solo.select("one", ((F.col("c") >= 2) & (F.length("one") >= 3) & (F.col("bare") | F.col("outlets"))).alias("wide"))
    k = k.join(solo, "one").withColumn("prefix", F.when(F.col("wide"), F.col("one")).otherwise(F.col("two"))).where("prefix IS NOT NULL")
    g = k.groupBy("prefix").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("members"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.min(F.size("t")).alias("shortest")).where("n >= 2")
    # The words all members share are those the smallest and the largest share; an outlet marker ends the name.
    stop = F.expr(rf"array_min(filter(transform(sequence(0, shortest), i -> IF(i >= shortest OR lo[i] != hi[i] OR (i >= size(split(prefix, ' ')) AND lo[i] RLIKE '{MARKER.replace(chr(92), chr(92) * 2)}'), i, NULL)), x -> x IS NOT NULL))")
    g = g.withColumn("stop", stop)
    return g.select("prefix", F.array_join(F.expr("slice(lo, 1, greatest(stop, size(split(prefix, ' '))))"), " ").alias("name"), F.array_join("members", ",").alias("members"), "n")


def priced(suggestions: DataFrame, txns: DataFrame) -> DataFrame:
    """Suggestions with the rows and net value of their members, largest absolute value first."""
    from ledgerstone.functions.money import net_spend

    each = txns.groupBy("merchant_normalized").agg(F.count("*").alias("rows_total"), net_spend().alias("v"))
    m = suggestions.select("prefix", "name", "n", F.explode(F.split("members", ",")).alias("merchant_normalized")).join(each, "merchant_normalized", "left")
    priced = m.groupBy("prefix", "name", "n").agg(F.coalesce(F.sum("rows_total"), F.lit(0)).alias("rows_total"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    return positions(priced, F.desc(F.abs("v")), "name", "prefix", name="place")
