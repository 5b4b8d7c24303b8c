"""Coverage algebra: what statements cover, per card and calendar month, and which months may be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statement_windows(statements: DataFrame, by: str = "card") -> DataFrame:
    """Merged windows (card, start, end) of statements (id, period_start, period_end, statement_date, first_txn).

    The end is the printed one or the statement's date; without either a statement is dropped. A start that is not printed is
    the day after the previous end, else the first transaction. Windows that touch are one.
    """
    dated = statements.withColumn("end", F.coalesce("period_end", "statement_date")).where("end IS NOT NULL")
    w = Window.partitionBy(by).orderBy("end", "id")
    start = F.coalesce("period_start", F.date_add(F.lag("end").over(w), 1), "first_txn")
    return merge_windows(dated.select(by, start.alias("start"), "end").where("start <= end"), by)


def merge_windows(windows: DataFrame, by: str = "card") -> DataFrame:
    """Overlapping or touching (start, end) windows of a key joined to one."""
    w = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > F.date_add(reach, 1)), 1).otherwise(0)
    island = F.sum("fresh").over(w)
    return windows.withColumn("fresh", fresh).withColumn("island", island).groupBy(by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _binned(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Adds _level and _bin: one or two bins of 2^level days that the row's days fall in, at its own level (the least whose bins are no shorter than it) and at each higher level of the other table."""
    level = lambda: F.ceil(F.log2(F.datediff("end", "start") + 1)).cast("int")
    others = other.agg(F.collect_set(level()).alias("levels")).scalar()  # at most one entry for each power of two
    rows = rows.withColumn("_own", level()).withColumn("_others", others)
    rows = rows.withColumn("_level", F.explode(F.array_union(F.array("_own"), F.filter("_others", lambda k: k > F.col("_own"))))).drop("_others")
    first, last = (F.expr(f"shiftright(unix_date({c}), _level)") for c in ("`start`", "`end`"))
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlaps(windows: DataFrame, spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every window beside every span that shares a day with it: their columns, and shared_start and shared_end.

    Both have start and end (days, inclusive) of any lengths; rows without either, or that end before they start, meet nothing. ``by``: columns of both that must be equal. A
    pair meets by equality of bins, at the level of its longer side, where either touches two bins at most; it counts in the bin where the shared days begin. So nothing is
    compared but what lies close by, whatever the lengths. Columns of the spans are named span_<name>.
    """
    by = by or []
    sound = lambda t: t.where("`start` <= `end`")
    a, b = sound(windows), sound(spans)
    at, bt = _binned(a, b), _binned(b, a)
    bt = bt.withColumnsRenamed({c: f"span_{c}" for c in b.columns if c not in by} | {"_own": "_span_own"})
    start, end = F.greatest("start", "span_start"), F.least("end", "span_end")
    met = at.join(bt, [*by, "_level", "_bin"]).where((F.col("_level") == F.greatest("_own", "_span_own")) & (start <= end) & (F.expr("shiftright(unix_date(greatest(`start`, span_start)), _level)") == F.col("_bin")))
    return met.withColumn("shared_start", start).withColumn("shared_end", end).drop("_level", "_bin", "_own", "_span_own")


def card_months(windows: DataFrame, cards: DataFrame, months: DataFrame, by: str = "card") -> DataFrame:
    """What each card covers of each month: state, from_date, through_date, gap.

    Windows are cut at month ends, so they meet months by equality; cards (one row each) and months are small and every pair has a row.
    """
    cut = windows.select(by, "start", "end", F.explode(F.sequence(F.trunc("start", "MM"), F.trunc("end", "MM"), F.expr("INTERVAL 1 MONTH"))).alias("first"))
    cut = cut.select(by, F.date_format("first", "yyyy-MM").alias("month"), F.greatest("start", "first").alias("s"), F.least("end", F.last_day("first")).alias("e"))
    # Windows are merged and do not touch, so their pieces in a month do not either.
    inside = cut.groupBy(by, "month").agg(F.count("*").alias("pieces"), F.min("s").alias("s"), F.min_by("e", "s").alias("e"))
    first = F.to_date(F.concat("month", F.lit("-01")))
    # One row of all months for each card, rather than a join of everything with everything.
    every = months.agg(F.sort_array(F.collect_set("month")).alias("ms"), F.lit(1).alias("k"))
    grid = cards.select(by).distinct().withColumn("k", F.lit(1)).join(F.broadcast(every), "k").select(by, F.explode("ms").alias("month"))
    rows = grid.join(inside, [by, "month"], "left")
    whole = (F.col("pieces") == 1) & (F.col("s") == first) & (F.col("e") == F.last_day(first))
    return rows.select(by, "month", F.when(F.col("pieces").isNull(), "missing").when(whole, "complete").otherwise("partial").alias("state"), F.col("s").alias("from_date"), F.col("e").alias("through_date"), F.coalesce(F.col("pieces") > 1, F.lit(False)).alias("gap"))


def month_completeness(card_month: DataFrame, by: str = "card") -> DataFrame:
    """Per month: cards_total, cards_complete, partial, missing and gaps (labels), covered_from and covered_through (of all cards), is_complete, and the days it may be compared on."""
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col(by))))
    g = card_month.groupBy("month").agg(
        F.count("*").alias("cards_total"), F.count_if(F.col("state") == "complete").alias("cards_complete"),
        pick(F.col("state") == "partial").alias("partial"), pick(F.col("state") == "missing").alias("missing"), pick(F.col("gap")).alias("gaps"),
        F.max("from_date").alias("f"), F.min("through_date").alias("t"),
    )
    bounded = (F.size("missing") == 0) & (F.size("gaps") == 0)
    g = g.withColumn("covered_from", F.when(bounded, F.col("f"))).withColumn("covered_through", F.when(bounded, F.col("t"))).withColumn("is_complete", F.col("cards_complete") == F.col("cards_total"))
    last = F.dayofmonth(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    open_ = ~F.col("is_complete") & F.col("covered_from").isNotNull()
    return g.drop("f", "t").select(
        "*",
        last.alias("last_day"),
        F.when(open_, F.dayofmonth("covered_from")).alias("day_lo"), F.when(open_, F.dayofmonth("covered_through")).alias("day_hi"),
        F.when(F.col("is_complete"), 1).otherwise(F.dayofmonth("covered_from")).alias("range_lo"), F.when(F.col("is_complete"), last).otherwise(F.dayofmonth("covered_through")).alias("range_hi"),
    )


def covers_days(range_lo, range_hi, last, lo, hi):
    """Whether a month billed for days range_lo to range_hi covers lo to hi, as far as it has such days."""
    return F.coalesce((range_lo <= lo) & (F.least(hi, last) <= range_hi), F.lit(False))


def coverage_segments(windows: DataFrame, by: str = "card") -> DataFrame:
    """Covered windows and the gaps between them in order: kind, start, end, days."""
    nxt = F.lead("start").over(Window.partitionBy(by).orderBy("start"))
    w = windows.withColumn("nxt", nxt)
    both = w.select(by, F.lit("covered").alias("kind"), "start", "end").unionAll(w.where("nxt IS NOT NULL").select(by, F.lit("gap"), F.date_add("end", 1), F.date_sub("nxt", 1)))
    return both.withColumn("days", F.datediff("end", "start") + 1)


def timeline(windows: DataFrame, today: str, pad_months: int = 1, by: str = "card") -> DataFrame:
    """Segments with their place (at, len) on an axis of whole months that also holds today: axis_start, axis_end, axis_days and all_covered_to repeat on every row."""
    seg = coverage_segments(windows, by)
    last = F.max("end").over(Window.partitionBy(by))
    edge = windows.withColumn("last", last).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("last").alias("all_covered_to"), F.lit(1).alias("k"))
    now = F.to_date(F.lit(today))
    start = F.add_months(F.trunc("lo", "MM"), -pad_months)
    end = F.greatest(F.last_day(F.add_months(F.trunc("hi", "MM"), pad_months)), F.last_day(now))
    rows = seg.withColumn("k", F.lit(1)).join(F.broadcast(edge), "k").withColumn("axis_start", start).withColumn("axis_end", end)
    total = F.datediff("axis_end", "axis_start") + 1
    return rows.select(by, "kind", "start", "end", "days", "axis_start", "axis_end", total.alias("axis_days"), (F.datediff("start", "axis_start") / total).alias("at"), (F.col("days") / total).alias("len"), "all_covered_to")


def timeline_ticks(windows: DataFrame, today: str, pad_months: int = 1, by: str = "card") -> DataFrame:
    """Month starts of the timeline's axis: date, at, year_start, label."""
    axis = timeline(windows, today, pad_months, by).select("axis_start", "axis_end", "axis_days").limit(1)
    ticks = axis.select("*", F.explode(F.sequence("axis_start", "axis_end", F.expr("INTERVAL 1 MONTH"))).alias("date"))
    first = (F.month("date") == 1) | (F.col("date") == F.col("axis_start"))
    return ticks.select("date", (F.datediff("date", "axis_start") / F.col("axis_days")).alias("at"), first.alias("year_start"), F.concat(F.date_format("date", "MMM"), F.when(first, F.date_format("date", " yyyy")).otherwise("")).alias("label"))
