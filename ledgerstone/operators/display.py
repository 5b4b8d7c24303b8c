"""Columns that a page shows: periods, month labels, notes, shares, intensities, sparklines, summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.dates import month_index
from ledgerstone.functions.money import half_even_mean


def period_text(start: Column, end: Column, closing: Column, first_row: Column, last_row: Column) -> Column:
    """The printed period, else "to" the statement's date, else the span of its rows, else a dash."""
    s = lambda c: c.cast("string")
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(s(start), F.lit(" → "), s(end))).when(closing.isNotNull(), F.concat(F.lit("to "), s(closing)))
        .when(first_row.isNotNull(), F.concat(s(first_row), F.lit(" → "), s(last_row), F.lit(" (from rows)"))).otherwise("—")
    )


def months_label(months: DataFrame, by: str) -> DataFrame:
    """Per key, its months as "first → last" if they are neighbours without a gap, else a comma list."""
    n = F.count("*")
    i = month_index(F.col("month"))
    listed = F.array_join(F.sort_array(F.collect_list("month")), ", ")
    label = F.when((n > 1) & (F.max(i) - F.min(i) == n - 1), F.concat(F.min("month"), F.lit(" → "), F.max("month"))).otherwise(listed)
    return months.select(by, "month").distinct().groupBy(by).agg(label.alias("label"), n.alias("n"))


def row_notes(txns: DataFrame, dedup: str = "dedup_key") -> DataFrame:
    """Adds notes to rows (statement_id, amount_ambiguous, dedup key): more than one amount on the line, and how many other rows of the statement repeat it."""
    twins = F.count("*").over(Window.partitionBy("statement_id", dedup)) - 1
    repeat = F.when(F.coalesce(F.col(dedup), F.lit("")) != "", twins).otherwise(0)
    return txns.withColumn("notes", F.array_join(F.array_compact(F.array(F.when(F.col("amount_ambiguous"), F.lit("more than one amount")), F.when(repeat > 0, F.concat(F.lit("repeats "), repeat.cast("string"), F.lit(" other row(s)"))))), "; "))


def shares(rows: DataFrame, value: str = "v") -> DataFrame:
    """Adds width (percent of the largest value, half even) and part (percent of the total): rows are a report's lines."""
    w = Window.partitionBy()
    top, total = F.max(value).over(w), F.sum(value).over(w)
    return rows.withColumn("width", F.when(top > 0, F.bround(100 * F.col(value) / top))).withColumn("part", F.when(total != 0, F.bround(100 * F.col(value) / total, 1)))


def heat(grid: DataFrame) -> DataFrame:
    """Adds to rows with cells: intensity of each cell against the row's peak (three decimals, 0 for none) and spark, each cell's place between the lowest and highest (a flat row lies in the middle)."""
    lo, hi = F.array_min("cells"), F.array_max("cells")
    g = grid.withColumn("_lo", lo).withColumn("_hi", hi)
    intensity = F.transform("cells", lambda v: F.when((F.col("_hi") > 0) & (v > 0), F.bround(v / F.col("_hi"), 3)).otherwise(0.0))
    spark = F.transform("cells", lambda v: F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5))
    return g.withColumn("intensity", intensity).withColumn("spark", spark).drop("_lo", "_hi")


def against_average(months: DataFrame, value: str = "spend_minor") -> DataFrame:
    """Adds the average of all rows and the deviation from it."""
    w = Window.partitionBy()
    avg = half_even_mean(F.sum(value).over(w), F.count("*").over(w))
    return months.withColumn("average", avg).withColumn("deviation", F.col(value) - F.col("average"))


def run_summary(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """Outcomes (kind, message) of a run: counts of stored, duplicate and failed, and the most frequent failure messages with how often each came."""
    n = outcomes.groupBy("kind", F.when(F.col("kind") == "failed", F.col("message")).alias("message")).agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "failed", F.struct((-F.col("n")).alias("o"), "message", "n")))), 1, most)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    return n.agg(count("stored"), count("duplicate"), count("failed"), F.array_join(F.transform(top, lambda s: F.concat(s["message"], F.when(s["n"] > 1, F.concat(F.lit(" ×"), s["n"].cast("string"))).otherwise(""))), "; ").alias("messages"))


def months_by_year(months: DataFrame) -> DataFrame:
    """(year, months): the months of each year in order, comma-joined."""
    return months.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"))
