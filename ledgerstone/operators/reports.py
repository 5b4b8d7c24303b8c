"""Monthly reports: totals, like-for-like deltas, trailing and rolling means, breakdowns, notable rows, year overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.dates import bounds, in_months, month_index, month_of
from ledgerstone.functions.money import half_even_mean, net_spend
from ledgerstone.operators.coverage import card_months, covers_days, month_completeness, statement_windows
from ledgerstone.sources.shared import snapshot

NONE = "(uncategorized)"


def month_key() -> Column:
    return month_of(F.col("txn_date"))


def category_label() -> Column:
    return F.coalesce("category", F.lit(NONE))


def month_totals(txns: DataFrame) -> DataFrame:
    return txns.groupBy(month_key().alias("month")).agg(
        F.count("*").alias("n"), net_spend().alias("spend_minor"), F.count_if(F.col("category").isNull()).alias("uncategorized"), F.countDistinct("account_id").alias("cards"))


def daily_cube(txns: DataFrame) -> DataFrame:
    """account_id, txn_date, n, v (net spend), u (uncategorized rows): a small table from which reports are summed instead of from the ledger's rows."""
    return txns.groupBy("account_id", "txn_date").agg(F.count("*").alias("n"), net_spend().alias("v"), F.count_if(F.col("category").isNull()).alias("u"))


def cube_totals(cube: DataFrame) -> DataFrame:
    """month_totals from a daily cube."""
    return cube.groupBy(month_key().alias("month")).agg(F.sum("n").alias("n"), F.sum("v").alias("spend_minor"), F.sum("u").alias("uncategorized"), F.countDistinct("account_id").alias("cards"))


def daily_spend(cube: DataFrame) -> DataFrame:
    """Net spend by month and day of month: at most 31 rows a month, from which any range of days is summed."""
    return cube.groupBy(month_key().alias("month"), F.dayofmonth("txn_date").alias("day")).agg(F.sum("v").alias("v"))


def month_day_window(txns: DataFrame, lo: int, hi: int) -> DataFrame:
    day = F.dayofmonth("txn_date")
    inside = day.between(lo, hi)
    return txns.groupBy(month_key().alias("month")).agg(F.coalesce(F.sum(F.when(inside & (F.col("flow_type") == "spend"), F.col("amount_minor")).when(inside & (F.col("flow_type") == "refund"), -F.col("amount_minor"))), F.lit(0)).alias("spend_minor"))


def completeness(statements: DataFrame, cards: DataFrame, months: DataFrame) -> DataFrame:
    """month_completeness of months. statements and cards carry ``card``, the lineage label."""
    return month_completeness(card_months(statement_windows(statements), cards, months))


def complete_months(txns: DataFrame, statements: DataFrame, cards: DataFrame) -> DataFrame:
    """(month, spend_minor) of the months that every card covers."""
    totals = cube_totals(daily_cube(txns)).select("month", "spend_minor")
    return totals.join(completeness(statements, cards, totals).where("is_complete").select("month"), "month")


def _range_sum(rows: DataFrame, daily: DataFrame, month: str, lo: str, hi: str, out: str) -> DataFrame:
    """Adds the net spend of each row's month over its days lo to hi (all, if null)."""
    d = daily.select(F.col("month").alias("_m"), F.col("day").alias("_d"), F.col("v").alias("_v"))
    keep = F.col(lo).isNull() | F.col("_d").between(F.col(lo), F.col(hi))
    return rows.join(d, F.col(month) == F.col("_m"), "left").groupBy(*rows.columns).agg(F.coalesce(F.sum(F.when(keep, F.col("_v"))), F.lit(0)).alias(out))


def month_report(cube: DataFrame, statements: DataFrame, cards: DataFrame) -> DataFrame:
    """Per month with transactions: its totals, completeness, delta against the previous listed month on the same days, and the mean of up to three earlier months.

    not_comparable says why there is no delta. Everything is summed from a daily cube, best a kept one: it is read several times.
    """
    daily, totals = daily_spend(cube), cube_totals(cube)
    m = snapshot(totals.join(completeness(statements, cards, totals), "month"))  # a row per month, read five times below
    w = Window.orderBy("month")
    keep = ("month", "missing", "gaps", "range_lo", "range_hi", "last_day")
    m = m.withColumn("idx", F.row_number().over(w)).withColumn("prior", F.lag(F.struct(*keep)).over(w))
    m = _range_sum(m, daily, "month", "day_lo", "day_hi", "spend_comparable")
    m = m.withColumn("prior_month", F.col("prior.month"))
    m = _range_sum(m, daily, "prior_month", "day_lo", "day_hi", "base")
    lo, hi = F.coalesce("day_lo", F.lit(1)), F.coalesce("day_hi", F.col("last_day"))
    names = F.array_join(F.concat("prior.missing", "prior.gaps"), ", ")
    reason = (
        F.when(F.col("prior").isNull(), "nothing earlier to compare against")
        .when(~F.col("is_complete") & F.col("day_lo").isNull(), "this month cannot be bounded")
        .when(F.col("prior.range_lo").isNull(), F.concat("prior_month", F.lit(" has no statement covering it for "), F.when(names != "", names).otherwise("a card")))
        .when(~covers_days(F.col("prior.range_lo"), F.col("prior.range_hi"), F.col("prior.last_day"), lo, hi), F.concat("prior_month", F.lit(" is only billed for days "), F.col("prior.range_lo").cast("string"), F.lit("–"), F.col("prior.range_hi").cast("string"), F.lit(", so the same days cannot be compared")))
    )
    m = m.withColumn("not_comparable", reason)
    m = m.withColumn("prior_comparable", F.when(F.col("not_comparable").isNull(), F.col("base"))).withColumn("delta_minor", F.when(F.col("not_comparable").isNull(), F.col("spend_comparable") - F.col("base")))
    return m.drop("prior", "base", "idx").join(trailing(m, daily), "month", "left")


def trailing(m: DataFrame, daily: DataFrame) -> DataFrame:
    """month, trailing_months, trailing_short, trailing_note, trailing_avg_minor: the mean over those of the last three listed months that are billed for the same days, two at least."""
    bounded = F.col("is_complete") | F.col("day_lo").isNotNull()
    me = m.select("month", "idx", "day_lo", "day_hi", F.coalesce("day_lo", F.lit(1)).alias("lo"), F.coalesce("day_hi", F.col("last_day")).alias("hi"), bounded.alias("bounded"))
    back = me.withColumn("at", F.explode(F.array(*[F.col("idx") - k for k in (1, 2, 3)])))
    other = m.select(F.col("idx").alias("at"), F.col("month").alias("om"), F.col("range_lo").alias("rl"), F.col("range_hi").alias("rh"), F.col("last_day").alias("ol"))
    rows = back.join(other, "at", "left").withColumn("ok", F.col("om").isNotNull() & covers_days(F.col("rl"), F.col("rh"), F.col("ol"), F.col("lo"), F.col("hi")))
    rows = _range_sum(rows, daily, "om", "day_lo", "day_hi", "v")
    g = rows.groupBy("month", "bounded", "lo", "hi").agg(
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("om")))).alias("usable"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("om")))).alias("short"), F.sum(F.when(F.col("ok"), F.col("v"))).alias("total"))
    enough = F.col("bounded") & (F.size("usable") >= 2)
    none = F.array().cast("array<string>")
    tail = F.when(F.size("short") > 0, F.concat(F.lit(" — "), F.array_join("short", ", "), F.lit(" fall short"))).otherwise("")
    note = F.when(~F.col("bounded"), "this month cannot be bounded").when(F.size("usable") < 2, F.concat(F.lit("fewer than two earlier months are billed across days "), F.col("lo").cast("string"), F.lit("–"), F.col("hi").cast("string"), tail))
    return g.select("month", F.when(enough, F.col("usable")).otherwise(none).alias("trailing_months"), F.when(F.col("bounded"), F.col("short")).otherwise(none).alias("trailing_short"), note.alias("trailing_note"), F.when(enough, half_even_mean(F.col("total"), F.size("usable"))).alias("trailing_avg_minor"))


def company_label() -> Column:
    return F.coalesce("group_name", F.col("merchant_normalized"))


def with_company(txns: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds group_name; a merchant is in one group at most. Spark broadcasts groups if they are small."""
    return txns.join(groups.select("merchant_normalized", "group_name"), "merchant_normalized", "left")


def breakdown(txns: DataFrame, month: str, label: Column) -> DataFrame:
    return txns.where(in_months(F.col("txn_date"), [month])).groupBy(label.alias("label")).agg(F.count("*").alias("n"), net_spend().alias("v"))


def by_category(txns: DataFrame, month: str) -> DataFrame:
    return breakdown(txns, month, category_label())


def by_card(txns: DataFrame, lineage: DataFrame, month: str) -> DataFrame:
    return breakdown(txns.join(lineage, "account_id"), month, F.col("label"))


def by_company(txns: DataFrame, groups: DataFrame, month: str, top: int = 12) -> DataFrame:
    """The companies of largest net spend with their outlets, largest first; a merchant outside any group has no outlets."""
    rows = with_company(txns, groups).where(in_months(F.col("txn_date"), [month]))
    each = rows.groupBy(company_label().alias("label"), F.col("group_name").isNotNull().alias("grouped"), "merchant_normalized").agg(F.count("*").alias("n"), net_spend().alias("v"))
    member = F.when(F.col("grouped"), F.struct((-F.col("v")).alias("o"), F.col("merchant_normalized").alias("key"), "v", "n"))
    g = each.groupBy("label").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.transform(F.array_sort(F.collect_list(member)), lambda s: F.concat_ws(":", s["key"], s["v"].cast("string"), s["n"].cast("string"))).alias("m"))
    return g.where("v > 0").orderBy(F.desc("v"), F.asc_nulls_first("label")).limit(top).select("label", "n", "v", F.array_join("m", ";").alias("members"))


def held_out_flows(txns: DataFrame, month: str) -> DataFrame:
    """Flows other than spend at gross amount. Rows without a flow are not among them, refunds are."""
    return txns.where(in_months(F.col("txn_date"), [month]) & (F.col("flow_type") != "spend")).groupBy("flow_type").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("v"))


def pivot(txns: DataFrame, label: Column, months: list[str]) -> DataFrame:
    """label, one cell per month in ``cells`` (0 where there is none), total, n, avg over the months, top and the first month that reaches it (if above 0)."""
    cell = txns.where(in_months(F.col("txn_date"), months)).groupBy(label.alias("label"), month_key().alias("month")).agg(net_spend().alias("v"), F.count("*").alias("n"))
    g = cell.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("month", "v"))).alias("per"), F.sum("v").alias("total"), F.sum("n").alias("n"))
    listed = F.array(*[F.lit(m) for m in months])
    cells = F.transform(listed, lambda m: F.coalesce(F.try_element_at("per", m), F.lit(0)))
    g = g.withColumn("cells", cells).withColumn("top", F.array_max("cells"))
    peak = F.when(F.col("top") > 0, F.element_at(listed, F.array_position("cells", F.col("top")).cast("int")))
    return g.select("label", "cells", "total", "n", half_even_mean(F.col("total"), F.lit(len(months))).alias("avg"), "top", peak.alias("peak"))


def consecutive_runs(months: DataFrame) -> DataFrame:
    """(month, ...) rows with run, the first month of their run of neighbouring calendar months, and pos in it."""
    w = Window.orderBy("month")
    island = month_index(F.col("month")) - F.row_number().over(w)
    run = Window.partitionBy("island")
    return months.withColumn("island", island).withColumn("run", F.min("month").over(run)).withColumn("pos", F.row_number().over(run.orderBy("month"))).drop("island")


def rolling_mean(months: DataFrame, size: int = 3, value: str = "spend_minor") -> DataFrame:
    """Mean over windows of ``size`` months that lie within one run; shorter windows give no row."""
    w = Window.partitionBy("run").orderBy("month").rowsBetween(-(size - 1), 0)
    rows = consecutive_runs(months).withColumn("total", F.sum(value).over(w)).withColumn("k", F.count("*").over(w))
    return rows.where(F.col("k") == size).select("month", "run", half_even_mean(F.col("total"), F.lit(size)).alias("avg_minor"))


def year_overlay(months: DataFrame, years: int = 3, value: str = "spend_minor") -> DataFrame:
    """Per drawn year (the last ones with data): n_months, total, mean, months_common (those all drawn years have), total_common, and slot among three colours."""
    up, down = Window.orderBy("year"), Window.orderBy(F.desc("year"))  # a row per month
    m = months.select(F.substring("month", 1, 4).alias("year"), F.substring("month", 6, 2).alias("mm"), F.col(value).alias("v"))
    m = m.withColumn("slot", (F.dense_rank().over(up) - 1) % 3 + 1).withColumn("recent", F.dense_rank().over(down)).where(F.col("recent") <= years)
    m = m.withColumn("n_years", F.max("recent").over(Window.partitionBy())).withColumn("common", F.count("*").over(Window.partitionBy("mm")) == F.col("n_years"))
    return m.groupBy("year", "slot").agg(
        F.count("*").alias("n_months"), F.sum("v").alias("total"), half_even_mean(F.sum("v"), F.count("*")).alias("mean"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("common"), F.col("mm")))), ",").alias("months_common"), F.coalesce(F.sum(F.when(F.col("common"), F.col("v"))), F.lit(0)).alias("total_common"),
    )


def new_merchants(txns: DataFrame, groups: DataFrame, month: str, top: int = 12) -> DataFrame:
    """Companies with net spend in the month that have no earlier row, largest first. Rows without a merchant do not count."""
    first, last = bounds(month)
    rows = with_company(txns.where(F.coalesce("merchant_normalized", F.lit("")) != ""), groups).withColumn("label", company_label())
    before = rows.where(F.col("txn_date") < F.lit(first)).select("label").distinct()
    now = rows.where(F.col("txn_date").between(F.lit(first), F.lit(last))).groupBy("label").agg(F.count("*").alias("n"), net_spend().alias("v"))
    return now.where("v > 0").join(before, "label", "left_anti").orderBy(F.desc("v"), "label").limit(top)


def hot_categories(txns: DataFrame, month: str, trailing_months: list[str], days: tuple[int, int] | None, factor: float = 1.5) -> DataFrame:
    """Categories whose net spend over the days exceeds ``factor`` times their mean in the trailing months, as base and over (percent). None for a complete month (no days) or fewer than two months."""
    t = txns.where(in_months(F.col("txn_date"), [month, *trailing_months]))
    if days is None or len(trailing_months) < 2:
        t = t.where(F.lit(False))
    else:
        t = t.where(F.dayofmonth("txn_date").between(*days))
    now = month_key() == month
    flow, amount = F.col("flow_type"), F.col("amount_minor")
    net = F.when(flow == "spend", amount).when(flow == "refund", -amount).otherwise(0)
    g = t.groupBy(category_label().alias("label")).agg(F.coalesce(F.sum(F.when(now, net)), F.lit(0)).alias("v"), (F.coalesce(F.sum(F.when(~now, net)), F.lit(0)) / max(1, len(trailing_months))).alias("mean"))
    return g.where((F.col("mean") > 0) & (F.col("v") > F.col("mean") * factor)).select("label", "v", F.bround("mean").cast("long").alias("base"), F.bround(100 * (F.col("v") - F.col("mean")) / F.col("mean")).cast("long").alias("over"))


def analytics_months(report: DataFrame) -> DataFrame:
    """Complete months with their spend, and why others are left out."""
    why = F.when(F.col("is_complete"), None).when(F.size("missing") > 0, F.concat(F.lit("no statement for "), F.array_join("missing", ", "))).when(F.size("gaps") > 0, F.concat(F.lit("a gap in "), F.array_join("gaps", ", "))).otherwise(F.concat(F.lit("part-billed: "), F.array_join("partial", ", ")))
    return report.select("month", "spend_minor", F.col("is_complete").alias("used"), why.alias("excluded"))


def month_detail(txns: DataFrame, lineage: DataFrame, groups: DataFrame, month: str) -> DataFrame:
    """One month as rows (part, label, n, v, width): category, card and company breakdowns, and held-out flows at gross amount; width is the percent of the part's largest value."""
    t = txns.where(in_months(F.col("txn_date"), [month]))
    parts = {"category": by_category(t, month), "card": by_card(t, lineage, month), "company": by_company(t, groups, month).drop("members"), "held out": held_out_flows(t, month).withColumnRenamed("flow_type", "label")}
    rows = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), "label", "n", "v")
        rows = one if rows is None else rows.unionAll(one)
    top = F.max("v").over(Window.partitionBy("part"))  # a few rows per label
    return rows.withColumn("width", F.when(top > 0, F.bround(100 * F.col("v") / top).cast("long")))


def analytics(report: DataFrame, txns: DataFrame, lineage: DataFrame, groups: DataFrame, months: list[str] | None = None) -> dict[str, DataFrame]:
    """The report over complete months (of those given, or all): series with the average and extremes, excluded months with reasons, year overlay, rolling mean, and grids by category, card, company and flow. Fewer than two complete months give a series only."""
    a = analytics_months(report if months is None else report.where(F.col("month").isin(months)))
    used = a.where("used").select("month", "spend_minor")
    chosen = sorted(r.month for r in used.select("month").collect())  # one per month
    out = {"series": used, "excluded": a.where("NOT used").select("month", "excluded"), "extremes": extremes(used)}
    if len(chosen) < 2:
        return out
    grid = {"category": (txns, category_label()), "card": (txns.join(lineage, "account_id"), F.col("label")), "company": (with_company(txns.where(F.coalesce("merchant_normalized", F.lit("")) != ""), groups), company_label())}
    grids = {f"by_{k}": pivot(t, label, chosen) for k, (t, label) in grid.items()}
    return out | {"overlay": year_overlay(used), "rolling": rolling_mean(used)} | grids | {"by_company": top_rows(grids["by_company"]), "held_out": gross_pivot(txns, chosen)}


def extremes(series: DataFrame, value: str = "spend_minor") -> DataFrame:
    """One row: n, average, the highest and lowest value and the first month that has it; no row values for an empty series."""
    first = lambda of: F.min_by("month", F.struct(of, "month"))
    return series.agg(F.count("*").alias("n"), half_even_mean(F.sum(value), F.count("*")).alias("average"), F.max(value).alias("highest"), first(-F.col(value)).alias("highest_month"), F.min(value).alias("lowest"), first(F.col(value)).alias("lowest_month"))


def top_rows(grid: DataFrame, top: int = 12) -> DataFrame:
    """The rows of a pivot with the largest totals."""
    return grid.orderBy(F.desc("total"), F.asc_nulls_first("label")).limit(top)


def gross_pivot(txns: DataFrame, months: list[str]) -> DataFrame:
    """Gross amounts of flows other than spend, as a pivot."""
    t = txns.where(F.col("flow_type") != "spend").withColumn("_flow", F.col("flow_type")).withColumn("flow_type", F.lit("spend"))
    return pivot(t, F.col("_flow"), months)


def year_runs(months: DataFrame, years: int = 3, value: str = "spend_minor") -> DataFrame:
    """(year, run, points): the runs of neighbouring months of each drawn year, first month and value pairs; a run ends with its year. Nothing where fewer than two years have data."""
    recent = F.dense_rank().over(Window.orderBy(F.desc("year")))  # a row per month
    m = months.select(F.substring("month", 1, 4).alias("year"), "month", F.col(value).alias("v")).withColumn("recent", recent)
    m = m.withColumn("n_years", F.max("recent").over(Window.partitionBy())).where((F.col("recent") <= years) & (F.col("n_years") >= 2))
    island = month_index(F.col("month")) - F.row_number().over(Window.partitionBy("year").orderBy("month"))
    g = m.withColumn("island", island).groupBy("year", "island").agg(F.min("month").alias("run"), F.array_sort(F.collect_list(F.struct("month", "v"))).alias("p"))
    return g.select("year", "run", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["month"], x["v"].cast("string"))), ",").alias("points"))
