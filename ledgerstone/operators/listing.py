"""Lists: filtered slices with whole-slice totals and pages, statements, cards, merchants, groups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.dates import in_months
from ledgerstone.functions.money import net_spend
from ledgerstone.operators.coverage import statement_windows
from ledgerstone.operators.lineage import card_label
from ledgerstone.operators.reports import NONE
from ledgerstone.sources.shared import positions

CATEGORIES = ["Groceries", "Dining", "Transport", "Shopping", "Bills & Utilities", "Health", "Entertainment", "Travel", "Education", "Fees & Interest", "Cash & Transfers", "Income/Refunds", "Other"]  # fixed values
FLOW_TYPES = ["spend", "refund", "transfer", "fee", "income"]  # fixed values


def txn_slice(txns: DataFrame, accounts: DataFrame | None = None, groups: DataFrame | None = None, *, uncategorized: bool = False, month: str | list[str] | None = None, category: str | None = None, account: int | None = None, merchant: str | None = None, merchant_group: str | None = None, flow: str | None = None) -> DataFrame:
    """Rows that pass every given filter. A card brings the cards it replaced; a group its merchants.

    A value that is no month's form (YYYY-MM), no known category or no known flow is no filter; a month beyond the calendar (2026-13) has no rows.
    """
    t = txns
    months = [m for m in ([month] if isinstance(month, str) else month or []) if re.fullmatch(r"[0-9]{4}-[0-9]{2}", m or "")]
    category, flow = (None if bad_filters(category=category) else category), (None if bad_filters(flow=flow) else flow)
    if uncategorized or category == NONE:
        t = t.where(F.col("category").isNull())
    if months:
        real = sorted({m for m in months if not bad_filters(month=m)})
        t = t.where(in_months(F.col("txn_date"), real) if real else F.lit(False))
    if category and category != NONE:
        t = t.where(F.col("category") == category)
    if account:
        own = accounts.where((F.col("id") == account) | (F.col("replaced_by_id") == account)).select(F.col("id").alias("account_id"))
        t = t.join(own, "account_id", "left_semi")
    if merchant:
        t = t.where(F.col("merchant_normalized") == merchant)
    if merchant_group:
        t = t.join(groups.where(F.col("group_name") == merchant_group), "merchant_normalized", "left_semi")
    if flow:
        t = t.where(F.col("flow_type") == flow)
    return t


def slice_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), net_spend().alias("shown_minor"))


def page(rows: DataFrame, number: int = 1, per_page: int = 100) -> DataFrame:
    """One page, newest first; a page number beyond the ends is the nearest page. total, shown_minor and pages, of the whole slice, are on every row. One job counts the slice first: how far the page lies is part of the plan."""
    got = slice_totals(rows).first()
    pages = max(1, -(-got.total // per_page))
    number = min(max(number, 1), pages)
    top = rows.orderBy(F.desc("txn_date"), F.desc("id")).offset((number - 1) * per_page).limit(per_page)
    return top.withColumns({"page": F.lit(number), "pages": F.lit(pages), "total": F.lit(got.total).cast("long"), "shown_minor": F.lit(got.shown_minor).cast("long")})


def tier_coverage(txns: DataFrame) -> DataFrame:
    """One row per (kind, label): counts by category source and flow, and the totals."""
    src = txns.groupBy(F.lit("source").alias("kind"), F.coalesce("category_source", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))
    flow = txns.groupBy(F.lit("flow").alias("kind"), F.coalesce("flow_type", F.lit("unset")).alias("label")).agg(F.count("*").alias("n"))
    totals = txns.agg(F.count("*").alias("total"), F.count("category_source").alias("categorized"), net_spend().alias("spend_minor")).select(F.lit("total").alias("kind"), F.expr("stack(3, 'total', total, 'categorized', categorized, 'spend_minor', spend_minor) AS (label, n)"))
    return src.unionAll(flow).unionAll(totals)


STATEMENT_ORDERS = {"uploaded": ["id"], "period": ["period_start_floor", "id"], "card": ["label", "id"]}


def statement_list(statements: DataFrame, accounts: DataFrame, txns: DataFrame, order: str = "period", descending: bool = True) -> DataFrame:
    """Statements with their card and their rows' count, first and last date. An unknown order is the default one."""
    a = accounts.select(F.col("id").alias("account_id"), card_label(F.col("issuer"), F.col("last4")).alias("label"))
    n = txns.groupBy("statement_id").agg(F.count("*").alias("rows_total"), F.min("txn_date").alias("first_row"), F.max("txn_date").alias("last_row"))
    s = statements.join(a, "account_id").join(n, statements.id == n.statement_id, "left").withColumn("period_start_floor", F.coalesce("period_start", "first_row"))
    keys = [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in STATEMENT_ORDERS.get(order, STATEMENT_ORDERS["period"])]
    return s.select("id", "label", "period_start_floor", "first_row", "last_row", F.coalesce("rows_total", F.lit(0)).alias("rows_total")).orderBy(*keys)


def assign_statements(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds statement_id: the statement of the account whose cycle holds the date. A cycle touches two months at most, so both sides meet by (account, month)."""
    s = statements.select("account_id", F.col("id").alias("statement_id"), F.date_add(F.add_months("statement_date", -1), 1).alias("lo"), F.col("statement_date").alias("hi"))
    s = s.withColumn("mm", F.explode(F.array_distinct(F.array(F.trunc("lo", "MM"), F.trunc("hi", "MM")))))
    t = txns.withColumn("mm", F.trunc("txn_date", "MM"))
    return t.join(s, ["account_id", "mm"]).where("txn_date BETWEEN lo AND hi").drop("mm", "lo", "hi")


def card_list(accounts: DataFrame, statements: DataFrame, txns: DataFrame, lineage: DataFrame) -> DataFrame:
    """Every card, those without statements too: counts of statements and rows, what its own statements cover, and its lineage."""
    s = statements.groupBy("account_id").agg(F.countDistinct("id").alias("statements"))
    t = txns.groupBy("account_id").agg(F.count("*").alias("rows_total"))
    w = statement_windows(statements.withColumnRenamed("account_id", "card")).groupBy("card").agg(F.min("start").alias("covered_from"), F.max("end").alias("covered_through"))
    a = accounts.select(F.col("id").alias("account_id"), card_label(F.col("issuer"), F.col("last4")).alias("card_name"))
    rows = a.join(s, "account_id", "left").join(t, "account_id", "left").join(w, F.col("account_id") == F.col("card"), "left").join(lineage, "account_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("account_id", "card_name", zero("statements"), zero("rows_total"), "covered_from", "covered_through", F.col("label").alias("lineage_label"), (F.col("head_id") == F.col("account_id")).alias("is_head"), "lineage_size")


def merchant_summary(txns: DataFrame, memory: DataFrame, only_unknown: bool = False) -> DataFrame:
    """Per merchant: rows, uncategorized rows, net value, first and last date, an example line, a category and where memory has it from."""
    t = txns.where(F.coalesce("merchant_normalized", F.lit("")) != "")
    g = t.groupBy("merchant_normalized").agg(
        F.count("*").alias("n"), F.count_if(F.col("category").isNull()).alias("unknown"), net_spend().alias("value_minor"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), F.max("description_raw").alias("example"), F.max("category").alias("category"))
    g = g.join(memory.select("merchant_normalized", F.col("source").alias("memory_source")), "merchant_normalized", "left")
    return g.where("unknown > 0") if only_unknown else g


def cluster_order(merchants: DataFrame) -> DataFrame:
    """Adds root, root_total and position: variants of one merchant stand together, clusters lead with the money; the weight is the absolute net value."""
    root = F.substring_index("merchant_normalized", " ", 1)
    m = merchants.withColumn("root", root).withColumn("weight", F.abs("value_minor"))
    m = m.withColumn("root_total", F.sum("weight").over(Window.partitionBy("root")))
    return positions(m, F.desc("root_total"), "root", F.desc("weight"), "merchant_normalized")


def page_of(rows: DataFrame, number: int, per_page: int = 100, position: str = "position") -> DataFrame:
    """One page of rows that carry their position; a number beyond the ends is the nearest page. page and pages are on every row."""
    last = F.greatest(F.lit(1), F.ceil(F.max(position) / per_page))
    n = rows.agg(F.coalesce(last, F.lit(1)).cast("int").alias("pages")).withColumn("page", F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages")).cast("int"))
    return rows.join(F.broadcast(n), F.col(position).between((F.col("page") - 1) * per_page + 1, F.col("page") * per_page))  # one row


def undecided(merchants: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: merchants with uncategorized rows, their net value, and how many keys groups hold."""
    m = merchants.agg(F.count_if(F.col("unknown") > 0).alias("merchants"), F.coalesce(F.sum(F.when(F.col("unknown") > 0, F.col("value_minor"))), F.lit(0)).alias("value_minor"))
    return m.join(F.broadcast(groups.agg(F.count("*").alias("grouped_keys"))))


def memory_list(memory: DataFrame) -> DataFrame:
    """Memory entries (with hit_count) and their place: most used first, then by source and key."""
    return positions(memory, F.desc("hit_count"), "source", "merchant_normalized")


def statement_rows(txns: DataFrame, statement_id: int | None = None, source_page: int | None = None) -> DataFrame:
    """Rows of one statement (all, without one) with their place in it by date and id; of one page of it, which is moved to the nearest that has rows."""
    t = txns if statement_id is None else txns.where(F.col("statement_id") == statement_id)
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("statement_id").orderBy("txn_date", "id")))
    if source_page is None:
        return t
    w = Window.partitionBy("statement_id")
    at = F.least(F.greatest(F.lit(source_page), F.min("source_page").over(w)), F.max("source_page").over(w))
    return t.withColumn("_at", at).where("source_page = _at").drop("_at")


def bad_filters(month: str | list[str] | None = None, category: str | None = None, flow: str | None = None, order: str | None = None) -> list[str]:
    """Names of the given filters whose values are not of the known kind, before a plan is built."""
    months = [month] if isinstance(month, str) else list(month or [])
    checks = {
        "month": all(re.fullmatch(r"\d{4}-(?:0[1-9]|1[0-2])", m or "") for m in months), "category": category in (None, "", NONE, *CATEGORIES),
        "flow": flow in (None, "", *FLOW_TYPES), "order": order in (None, "", *STATEMENT_ORDERS),
    }
    return [name for name, ok in checks.items() if not ok]


def named_like(statements: DataFrame, prefix: str) -> DataFrame:
    """One row: n, the statements whose file name starts with the prefix."""
    return statements.where(F.col("filename").startswith(prefix)).agg(F.count("*").alias("n"))


def group_list(groups: DataFrame, txns: DataFrame) -> DataFrame:
    """Groups with members, rows and net value; members without rows count as members."""
    each = groups.join(txns, "merchant_normalized", "left").groupBy("group_name", "merchant_normalized").agg(F.count("id").alias("n"), net_spend().alias("v"))
    return each.groupBy("group_name").agg(F.count("*").alias("members"), F.sum("n").alias("n"), F.sum("v").alias("v"), F.array_join(F.sort_array(F.collect_list("merchant_normalized")), ",").alias("names"))


def with_account(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with their card's label; rows of no card are left out. Spark broadcasts the accounts if they are small."""
    return txns.join(accounts.select(F.col("id").alias("account_id"), card_label(F.col("issuer"), F.col("last4")).alias("label")), "account_id")
