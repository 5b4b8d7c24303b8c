"""Every query of the library by name, each over its whole tables, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerstone.functions import merchants as N
from ledgerstone.functions import textlines as T
from ledgerstone.functions.money import money_text, net_spend, to_minor
from ledgerstone.operators import classify, coverage, display, gate, grouping, issuers, lineage, listing, reports, statements
from ledgerstone.operators.rules import with_rule
from ledgerstone.sources import documents as D
from ledgerstone.sources import ledger as L
from ledgerstone.sources.shared import snapshot

MONTH, DAYS = "1998-05", (5, 20)
TODAY = "2001-09-10"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


class Ledger:
    """The ledger's tables for one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.txn, self.lines, self.account = L.txn(spark, sf_dir), L.txn_lines(spark, sf_dir), L.account(spark)
        self.memory, self.rules = L.merchant_memory(spark), L.merchant_rule(spark)

    @property
    def groups(self) -> DataFrame:
        return L.merchant_group(self.spark, self.lines)

    @cached_property
    def cube(self) -> DataFrame:
        """The daily cube, written once for a query, however often it is read; kept_report has one that is kept from change to change."""
        return snapshot(reports.daily_cube(self.txn))

    @property
    def statement(self) -> DataFrame:
        return L.statement(self.cube)  # only accounts and dates matter

    @cached_property
    def lineage(self) -> DataFrame:
        return lineage.lineages(self.account)

    def carded(self) -> tuple[DataFrame, DataFrame]:
        """Statements and cards with ``card``, the lineage label: cards are those with a statement."""
        s = self.statement.join(self.lineage.select("account_id", F.col("label").alias("card")), "account_id")
        return s, s.select("card").distinct()

    def report(self, cube: DataFrame | None = None) -> DataFrame:
        if cube is not None:
            self.cube = cube
        return reports.month_report(self.cube, *self.carded())

    def completeness(self) -> DataFrame:
        return reports.completeness(*self.carded(), reports.cube_totals(self.cube))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


NET = "CASE flow_type WHEN 'spend' THEN amount_minor WHEN 'refund' THEN -amount_minor ELSE 0 END"
#: Lineage labels, coverage and reports as SQL, used by several queries.
LINEAGE = """
lin AS (SELECT a.id AS account_id, COALESCE(a.replaced_by_id, a.id) AS head_id FROM account a),
lab AS (SELECT l.account_id, l.head_id, h.issuer || COALESCE(' ····' || h.last4, '') || COALESCE((SELECT ' (was ' || string_agg(COALESCE('····' || o.last4, o.issuer), ', ' ORDER BY o.id) || ')' FROM account o WHERE o.replaced_by_id = l.head_id), '') AS label,
  (SELECT COUNT(*) FROM lin x WHERE x.head_id = l.head_id) AS lineage_size FROM lin l JOIN account h ON h.id = l.head_id)"""
WINDOWS = """
dated AS (SELECT lab.label AS card, s.id, s.period_start, s.first_txn, COALESCE(s.period_end, s.statement_date) AS e FROM statement s JOIN lab ON lab.account_id = s.account_id),
started AS (SELECT card, COALESCE(period_start, CAST(LAG(e) OVER (PARTITION BY card ORDER BY e, id) + INTERVAL 1 DAY AS DATE), first_txn) AS s, e FROM dated),
marked AS (SELECT card, s, e, CASE WHEN s <= MAX(e) OVER (PARTITION BY card ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM started WHERE s <= e),
island AS (SELECT card, s, e, SUM(f) OVER (PARTITION BY card ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
win AS (SELECT card, MIN(s) AS s, MAX(e) AS e FROM island GROUP BY card, k)"""
COVER = """
ms AS (SELECT DISTINCT strftime(txn_date, '%Y-%m') AS month FROM txn),
mb AS (SELECT month, CAST(month || '-01' AS DATE) AS first, CAST(CAST(month || '-01' AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last FROM ms),
piece AS (SELECT w.card, mb.month, GREATEST(w.s, mb.first) AS s, LEAST(w.e, mb.last) AS e FROM win w JOIN mb ON w.s <= mb.last AND w.e >= mb.first),
cm AS (SELECT c.card, mb.month, mb.first, mb.last, COUNT(p.s) AS pieces, MIN(p.s) AS s, MIN_BY(p.e, p.s) AS e FROM (SELECT DISTINCT card FROM dated) c CROSS JOIN mb LEFT JOIN piece p ON p.card = c.card AND p.month = mb.month GROUP BY 1, 2, 3, 4),
cs AS (SELECT card, month, CASE WHEN pieces = 0 THEN 'missing' WHEN pieces = 1 AND s = first AND e = last THEN 'complete' ELSE 'partial' END AS state, s AS from_date, e AS through_date, pieces > 1 AS gap FROM cm),
comp0 AS (SELECT month, COUNT(*) AS cards_total, COUNT(*) FILTER (state = 'complete') AS cards_complete,
  COALESCE(list(card ORDER BY card) FILTER (state = 'partial'), []) AS partial, COALESCE(list(card ORDER BY card) FILTER (state = 'missing'), []) AS missing, COALESCE(list(card ORDER BY card) FILTER (gap), []) AS gaps, MAX(from_date) AS f, MIN(through_date) AS t FROM cs GROUP BY month),
comp1 AS (SELECT month, cards_total, cards_complete, partial, missing, gaps, CASE WHEN len(missing) + len(gaps) = 0 THEN f END AS covered_from, CASE WHEN len(missing) + len(gaps) = 0 THEN t END AS covered_through, cards_complete = cards_total AS is_complete,
  day(last_day(CAST(month || '-01' AS DATE))) AS last_day FROM comp0),
comp AS (SELECT *, CASE WHEN NOT is_complete THEN day(covered_from) END AS day_lo, CASE WHEN NOT is_complete THEN day(covered_through) END AS day_hi,
  CASE WHEN is_complete THEN 1 ELSE day(covered_from) END AS range_lo, CASE WHEN is_complete THEN last_day ELSE day(covered_through) END AS range_hi FROM comp1)"""
REPORT = f"""
dly AS (SELECT strftime(txn_date, '%Y-%m') AS month, day(txn_date) AS d, SUM({NET}) AS v FROM txn GROUP BY 1, 2),
tot AS (SELECT strftime(txn_date, '%Y-%m') AS month, SUM({NET}) AS spend FROM txn GROUP BY 1),
seq AS (SELECT c.*, tot.spend, ROW_NUMBER() OVER (ORDER BY c.month) AS i FROM comp c JOIN tot ON tot.month = c.month),
pr AS (SELECT a.*, b.month AS pm, b.missing AS pmissing, b.gaps AS pgaps, b.range_lo AS plo, b.range_hi AS phi, b.last_day AS plast,
  COALESCE((SELECT SUM(v) FROM dly WHERE dly.month = a.month AND (a.day_lo IS NULL OR d BETWEEN a.day_lo AND a.day_hi)), 0) AS spend_comparable,
  COALESCE((SELECT SUM(v) FROM dly WHERE dly.month = b.month AND (a.day_lo IS NULL OR d BETWEEN a.day_lo AND a.day_hi)), 0) AS base,
  COALESCE(a.day_lo, 1) AS lo, COALESCE(a.day_hi, a.last_day) AS hi FROM seq a LEFT JOIN seq b ON b.i = a.i - 1),
rep AS (SELECT *, CASE WHEN pm IS NULL THEN 'nothing earlier to compare against' WHEN NOT is_complete AND day_lo IS NULL THEN 'this month cannot be bounded'
  WHEN plo IS NULL THEN pm || ' has no statement covering it for ' || CASE WHEN len(pmissing) + len(pgaps) > 0 THEN array_to_string(list_concat(pmissing, pgaps), ', ') ELSE 'a card' END
  WHEN NOT (plo <= lo AND LEAST(hi, plast) <= phi) THEN pm || ' is only billed for days ' || CAST(plo AS VARCHAR) || '–' || CAST(phi AS VARCHAR) || ', so the same days cannot be compared' END AS not_comparable FROM pr)"""


def query(name: str, sql: str | None = None, ledger: bool = True):
    """Registers a function of a Ledger as a query, with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Ledger(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {L.SQL}{sql}" if ledger else sql
        return f

    return put


# ---- totals and breakdowns


@query("month_totals", f" SELECT strftime(txn_date, '%Y-%m') AS month, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS spend_minor, COUNT(*) FILTER (category IS NULL) AS uncategorized, COUNT(DISTINCT account_id) AS cards FROM txn GROUP BY 1")
def _(g):
    return reports.month_totals(g.txn)


@query("month_day_window", f" SELECT strftime(txn_date, '%Y-%m') AS month, CAST(COALESCE(SUM({NET}) FILTER (day(txn_date) BETWEEN 5 AND 20), 0) AS BIGINT) AS spend_minor FROM txn GROUP BY 1")
def _(g):
    return reports.month_day_window(g.txn, *DAYS)


@query("month_category", f" SELECT COALESCE(category, '(uncategorized)') AS label, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS v FROM txn_lines WHERE strftime(txn_date, '%Y-%m') = '{MONTH}' GROUP BY 1")
def _(g):
    return reports.by_category(g.lines, MONTH)


@query("month_card_lineage", f", {LINEAGE} SELECT label, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS v FROM txn JOIN lab ON lab.account_id = txn.account_id WHERE strftime(txn_date, '%Y-%m') = '{MONTH}' GROUP BY 1")
def _(g):
    return reports.by_card(g.txn, g.lineage, MONTH)


@query("top_companies", f""", r AS (SELECT t.*, g.group_name, COALESCE(g.group_name, t.merchant_normalized) AS label FROM txn_lines t LEFT JOIN merchant_group g ON g.merchant_normalized = t.merchant_normalized WHERE strftime(txn_date, '%Y-%m') = '{MONTH}'),
  m AS (SELECT label, group_name, merchant_normalized AS k, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS v FROM r GROUP BY 1, 2, 3)
  SELECT label, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(v) AS BIGINT) AS v, COALESCE(string_agg(k || ':' || v || ':' || n, ';' ORDER BY v DESC, k) FILTER (group_name IS NOT NULL), '') AS members FROM m GROUP BY label HAVING SUM(v) > 0 ORDER BY SUM(v) DESC, label LIMIT 12""")
def _(g):
    return reports.by_company(g.lines, g.groups, MONTH)


@query("heldout_flows", f" SELECT flow_type, COUNT(*) AS n, CAST(SUM(amount_minor) AS BIGINT) AS v FROM txn_lines WHERE strftime(txn_date, '%Y-%m') = '{MONTH}' AND flow_type <> 'spend' GROUP BY 1")
def _(g):
    return reports.held_out_flows(g.lines, MONTH)


_GRID = ["1998-03", "1998-04", "1998-05"]


@query("category_month_grid", f""", c AS (SELECT COALESCE(category, '(uncategorized)') AS label, {', '.join(f"CAST(COALESCE(SUM({NET}) FILTER (strftime(txn_date, '%Y-%m') = '{m}'), 0) AS BIGINT) AS m{i}" for i, m in enumerate(_GRID))}, COUNT(*) AS n FROM txn_lines WHERE strftime(txn_date, '%Y-%m') IN ('1998-03', '1998-04', '1998-05') GROUP BY 1)
  SELECT label, [m0, m1, m2] AS cells, CAST(m0 + m1 + m2 AS BIGINT) AS total, n, CAST(round_even((m0 + m1 + m2) / 3.0, 0) AS BIGINT) AS avg, GREATEST(m0, m1, m2) AS top,
  CASE WHEN GREATEST(m0, m1, m2) <= 0 THEN NULL WHEN m0 = GREATEST(m0, m1, m2) THEN '1998-03' WHEN m1 = GREATEST(m0, m1, m2) THEN '1998-04' ELSE '1998-05' END AS peak FROM c""")
def _(g):
    return reports.pivot(g.lines, reports.category_label(), _GRID)


@query("company_members", f""" SELECT g.group_name, g.merchant_normalized, COUNT(t.id) AS n, CAST(COALESCE(SUM({NET}), 0) AS BIGINT) AS v, CAST(SUM(COALESCE(SUM({NET}), 0)) OVER (PARTITION BY g.group_name) AS BIGINT) AS group_v
  FROM merchant_group g LEFT JOIN txn_lines t ON t.merchant_normalized = g.merchant_normalized GROUP BY 1, 2""")
def _(g):
    each = g.groups.join(g.lines, "merchant_normalized", "left").groupBy("group_name", "merchant_normalized").agg(F.count("id").alias("n"), net_spend().alias("v"))
    return each.withColumn("group_v", F.sum("v").over(Window.partitionBy("group_name")))


# ---- lists


@query("tier_coverage", f""" SELECT 'source' AS kind, COALESCE(category_source, 'none') AS label, COUNT(*) AS n FROM txn GROUP BY 2 UNION ALL SELECT 'flow', COALESCE(flow_type, 'unset'), COUNT(*) FROM txn GROUP BY 2
  UNION ALL SELECT 'total', 'total', COUNT(*) FROM txn UNION ALL SELECT 'total', 'categorized', COUNT(category_source) FROM txn UNION ALL SELECT 'total', 'spend_minor', CAST(SUM({NET}) AS BIGINT) FROM txn""")
def _(g):
    return listing.tier_coverage(g.txn)


@query("filtered_slice_totals", f" SELECT COUNT(*) AS total, CAST(COALESCE(SUM({NET}), 0) AS BIGINT) AS shown_minor FROM txn WHERE category IS NULL AND strftime(txn_date, '%Y-%m') IN ('1998-04', '1998-05') AND account_id IN (SELECT id FROM account WHERE id = 1 OR replaced_by_id = 1) AND flow_type = 'spend'")
def _(g):
    return listing.slice_totals(listing.txn_slice(g.txn, g.account, uncategorized=True, month=["1998-04", "1998-05"], account=1, flow="spend"))


@query("txn_page", f""", s AS (SELECT * FROM txn WHERE account_id IN (SELECT id FROM account WHERE id = 5 OR replaced_by_id = 5)),
  k AS (SELECT COUNT(*) AS total, CAST(SUM({NET}) AS BIGINT) AS shown_minor, CAST(GREATEST(1, CEIL(COUNT(*) / 100.0)) AS INTEGER) AS pages FROM s)
  SELECT id, account_id, txn_date, description_raw, merchant_normalized, amount_minor, direction, flow_type, category, category_source, 2 AS page, pages, total, shown_minor FROM s, k ORDER BY txn_date DESC, id DESC LIMIT 100 OFFSET 100""")
def _(g):
    return listing.page(listing.txn_slice(g.txn, g.account, account=5), 2).select("id", "account_id", "txn_date", "description_raw", "merchant_normalized", "amount_minor", "direction", "flow_type", "category", "category_source", "page", "pages", "total", "shown_minor")


@query("semi_company_rows", " SELECT merchant_normalized, COUNT(*) AS n FROM txn_lines WHERE merchant_normalized IN (SELECT merchant_normalized FROM merchant_group WHERE group_name = 'Red Holdings') GROUP BY 1")
def _(g):
    return listing.txn_slice(g.lines, groups=g.groups, merchant_group="Red Holdings").groupBy("merchant_normalized").agg(F.count("*").alias("n"))


@query("accounts_without_statement", " SELECT id FROM account a WHERE NOT EXISTS (SELECT 1 FROM statement s WHERE s.account_id = a.id)")
def _(g):
    return g.account.join(g.statement.select(F.col("account_id").alias("id")), "id", "left_anti").select("id")


_ASSIGNED = ", asg AS (SELECT t.*, s.id AS statement_id FROM txn t JOIN statement s ON s.account_id = t.account_id AND t.txn_date > s.statement_date - INTERVAL 1 MONTH AND t.txn_date <= s.statement_date)"


@query("statement_list", f"""{_ASSIGNED}, n AS (SELECT statement_id, COUNT(*) AS c, MIN(txn_date) AS a, MAX(txn_date) AS b FROM asg GROUP BY 1)
  SELECT s.id, a.issuer || COALESCE(' ····' || a.last4, '') AS label, COALESCE(s.period_start, n.a) AS period_start_floor, n.a AS first_row, n.b AS last_row, COALESCE(n.c, 0) AS rows_total FROM statement s JOIN account a ON a.id = s.account_id LEFT JOIN n ON n.statement_id = s.id""")
def _(g):
    s = g.statement
    return listing.statement_list(s, g.account, listing.assign_statements(g.txn, s))


@query("statement_totals", f"{_ASSIGNED} SELECT statement_id, CAST(COALESCE(SUM(amount_minor) FILTER (direction = 'debit'), 0) AS BIGINT) AS debits, CAST(COALESCE(SUM(amount_minor) FILTER (direction = 'credit'), 0) AS BIGINT) AS credits FROM asg GROUP BY 1")
def _(g):
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount_minor"))), F.lit(0))
    return listing.assign_statements(g.txn, g.statement).groupBy("statement_id").agg(side("debit").alias("debits"), side("credit").alias("credits"))


@query("card_list", f""", {LINEAGE}, dated AS (SELECT account_id AS card, id, period_start, first_txn, COALESCE(period_end, statement_date) AS e FROM statement), {WINDOWS.split(chr(10), 2)[2]},
  w AS (SELECT card, MIN(s) AS s, MAX(e) AS e FROM win GROUP BY 1)
  SELECT a.id AS account_id, a.issuer || COALESCE(' ····' || a.last4, '') AS card_name, (SELECT COUNT(*) FROM statement s WHERE s.account_id = a.id) AS statements, (SELECT COUNT(*) FROM txn t WHERE t.account_id = a.id) AS rows_total,
  w.s AS covered_from, w.e AS covered_through, lab.label AS lineage_label, lab.head_id = a.id AS is_head, lab.lineage_size FROM account a JOIN lab ON lab.account_id = a.id LEFT JOIN w ON w.card = a.id""")
def _(g):
    return listing.card_list(g.account, g.statement, g.txn, g.lineage)


_MERCHANT = f"""m AS (SELECT merchant_normalized, COUNT(*) AS n, COUNT(*) FILTER (category IS NULL) AS unknown, CAST(SUM({NET}) AS BIGINT) AS value_minor, MIN(txn_date) AS first_date, MAX(txn_date) AS last_date, MAX(description_raw) AS example, MAX(category) AS category FROM txn_lines GROUP BY 1)"""


@query("merchant_summary", f", {_MERCHANT} SELECT m.*, y.source AS memory_source FROM m LEFT JOIN merchant_memory y ON y.merchant_normalized = m.merchant_normalized WHERE unknown > 0")
def _(g):
    return listing.merchant_summary(g.lines, g.memory, only_unknown=True)


@query("cluster_order", f""", {_MERCHANT}, r AS (SELECT merchant_normalized, split_part(merchant_normalized, ' ', 1) AS root, abs(value_minor) AS weight FROM m), t AS (SELECT *, CAST(SUM(weight) OVER (PARTITION BY root) AS BIGINT) AS root_total FROM r)
  SELECT merchant_normalized, root, weight, root_total, CAST(ROW_NUMBER() OVER (ORDER BY root_total DESC, root, weight DESC, merchant_normalized) AS BIGINT) AS position FROM t""")
def _(g):
    return listing.cluster_order(listing.merchant_summary(g.lines, g.memory)).select("merchant_normalized", "root", "weight", "root_total", "position")


@query("group_list", f""", e AS (SELECT g.group_name, g.merchant_normalized AS k, COUNT(t.id) AS n, CAST(COALESCE(SUM({NET}), 0) AS BIGINT) AS v FROM merchant_group g LEFT JOIN txn_lines t ON t.merchant_normalized = g.merchant_normalized GROUP BY 1, 2)
  SELECT group_name, COUNT(*) AS members, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(v) AS BIGINT) AS v, string_agg(k, ',' ORDER BY k) AS names FROM e GROUP BY 1""")
def _(g):
    return listing.group_list(g.groups, g.lines)


@query("new_merchants", f""", r AS (SELECT t.*, COALESCE(g.group_name, t.merchant_normalized) AS label FROM txn t LEFT JOIN merchant_group g ON g.merchant_normalized = t.merchant_normalized),
  n AS (SELECT label, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS v FROM r WHERE strftime(txn_date, '%Y-%m') = '1995-02' GROUP BY 1 HAVING SUM({NET}) > 0)
  SELECT label, n, v FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.label = n.label AND r.txn_date < DATE '1995-02-01') ORDER BY v DESC, label LIMIT 12""")
def _(g):
    return reports.new_merchants(g.txn, g.groups, "1995-02")


@query("hot_categories", f""", t AS (SELECT COALESCE(category, '(uncategorized)') AS label, strftime(txn_date, '%Y-%m') AS m, {NET} AS x FROM txn_lines WHERE day(txn_date) BETWEEN 1 AND 3),
  g AS (SELECT label, CAST(SUM(x) FILTER (m = '1998-05') AS BIGINT) AS v, SUM(x) FILTER (m IN ('1998-02', '1998-03', '1998-04')) / 3.0 AS mean FROM t GROUP BY 1)
  SELECT label, v, CAST(round_even(mean, 0) AS BIGINT) AS base, CAST(round_even(100 * (v - mean) / mean, 0) AS BIGINT) AS over FROM g WHERE mean > 0 AND v > mean * 1.05""")
def _(g):
    return reports.hot_categories(g.lines, MONTH, ["1998-02", "1998-03", "1998-04"], (1, 3), factor=1.05)


# ---- coverage and reports


@query("statement_windows", f', {LINEAGE}, {WINDOWS} SELECT card, s AS start, e AS "end" FROM win')
def _(g):
    return coverage.statement_windows(g.carded()[0])


@query("card_month_coverage", f", {LINEAGE}, {WINDOWS}, {COVER} SELECT card, month, state, from_date, through_date, gap FROM cs")
def _(g):
    s, cards = g.carded()
    return coverage.card_months(coverage.statement_windows(s), cards, reports.cube_totals(reports.daily_cube(g.txn)).select("month"))


@query("month_completeness", f", {LINEAGE}, {WINDOWS}, {COVER} SELECT month, cards_total, cards_complete, array_to_string(partial, ',') AS partial, array_to_string(missing, ',') AS missing, array_to_string(gaps, ',') AS gaps, covered_from, covered_through, is_complete FROM comp")
def _(g):
    return g.completeness().select("month", "cards_total", "cards_complete", *[F.array_join(c, ",").alias(c) for c in ("partial", "missing", "gaps")], "covered_from", "covered_through", "is_complete")


@query("comparable_days", f", {LINEAGE}, {WINDOWS}, {COVER} SELECT month, CAST(day_lo AS INTEGER) AS day_lo, CAST(day_hi AS INTEGER) AS day_hi, CAST(range_lo AS INTEGER) AS range_lo, CAST(range_hi AS INTEGER) AS range_hi, COALESCE(range_lo <= 5 AND LEAST(20, last_day) <= range_hi, false) AS covers FROM comp")
def _(g):
    return g.completeness().select("month", "day_lo", "day_hi", "range_lo", "range_hi", coverage.covers_days(F.col("range_lo"), F.col("range_hi"), F.col("last_day"), F.lit(DAYS[0]), F.lit(DAYS[1])).alias("covers"))


@query("like_for_like_delta", f""", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT} SELECT month, pm AS prior_month, CAST(spend AS BIGINT) AS spend_minor, CAST(spend_comparable AS BIGINT) AS spend_comparable, not_comparable,
  CASE WHEN not_comparable IS NULL THEN CAST(base AS BIGINT) END AS prior_comparable, CASE WHEN not_comparable IS NULL THEN CAST(spend_comparable - base AS BIGINT) END AS delta_minor FROM rep""")
def _(g):
    return g.report().select("month", "prior_month", "spend_minor", "spend_comparable", "not_comparable", "prior_comparable", "delta_minor")


@query("trailing_average", f""", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT}, b AS (SELECT a.month, a.lo, a.hi, a.is_complete OR a.day_lo IS NOT NULL AS ok, o.month AS om, COALESCE(o.range_lo <= a.lo AND LEAST(a.hi, o.last_day) <= o.range_hi, false) AS use,
  COALESCE((SELECT SUM(v) FROM dly WHERE dly.month = o.month AND (a.day_lo IS NULL OR d BETWEEN a.day_lo AND a.day_hi)), 0) AS v FROM pr a LEFT JOIN seq o ON o.i BETWEEN a.i - 3 AND a.i - 1),
  k AS (SELECT month, lo, hi, ok, COUNT(*) FILTER (use) AS n, COALESCE(string_agg(om, ',' ORDER BY om) FILTER (use), '') AS u, string_agg(om, ',' ORDER BY om) FILTER (NOT use) AS short, SUM(v) FILTER (use) AS t FROM b GROUP BY 1, 2, 3, 4)
  SELECT month, CASE WHEN ok AND n >= 2 THEN u ELSE '' END AS trailing_months, CASE WHEN ok THEN COALESCE(short, '') ELSE '' END AS trailing_short,
  CASE WHEN NOT ok THEN 'this month cannot be bounded' WHEN n < 2 THEN 'fewer than two earlier months are billed across days ' || CAST(lo AS VARCHAR) || '–' || CAST(hi AS VARCHAR) || COALESCE(' — ' || replace(short, ',', ', ') || ' fall short', '') END AS trailing_note,
  CASE WHEN ok AND n >= 2 THEN CAST(round_even(CAST(t AS DOUBLE) / n, 0) AS BIGINT) END AS trailing_avg_minor FROM k""")
def _(g):
    return g.report().select("month", F.array_join("trailing_months", ",").alias("trailing_months"), F.array_join("trailing_short", ",").alias("trailing_short"), "trailing_note", "trailing_avg_minor")


@query("analytics_months", f""", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT} SELECT month, CAST(spend AS BIGINT) AS spend_minor, is_complete AS used, CASE WHEN is_complete THEN NULL WHEN len(missing) > 0 THEN 'no statement for ' || array_to_string(missing, ', ') WHEN len(gaps) > 0 THEN 'a gap in ' || array_to_string(gaps, ', ') ELSE 'part-billed: ' || array_to_string(partial, ', ') END AS excluded FROM rep""")
def _(g):
    return reports.analytics_months(g.report())


_COMPLETE = "full_m AS (SELECT month, CAST(spend AS BIGINT) AS spend FROM rep WHERE is_complete)"
_RUNS = "rn AS (SELECT month, spend, CAST(month[1:4] AS INTEGER) * 12 + CAST(month[6:7] AS INTEGER) - ROW_NUMBER() OVER (ORDER BY month) AS isl FROM full_m), run AS (SELECT month, spend, MIN(month) OVER (PARTITION BY isl) AS run, CAST(ROW_NUMBER() OVER (PARTITION BY isl ORDER BY month) AS INTEGER) AS pos FROM rn)"


def _complete(g) -> DataFrame:
    return reports.complete_months(g.txn, *g.carded())


@query("consecutive_runs", f", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT}, {_COMPLETE}, {_RUNS} SELECT month, spend AS spend_minor, run, pos FROM run")
def _(g):
    return reports.consecutive_runs(_complete(g))


@query("rolling_mean", f", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT}, {_COMPLETE}, {_RUNS}, w AS (SELECT month, run, pos, SUM(spend) OVER (PARTITION BY run ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM run) SELECT month, run, CAST(round_even(CAST(t AS DOUBLE) / 3, 0) AS BIGINT) AS avg_minor FROM w WHERE pos >= 3")
def _(g):
    return reports.rolling_mean(_complete(g))


@query("year_overlay", f""", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT}, {_COMPLETE}, y AS (SELECT month[1:4] AS year, month[6:7] AS mm, spend FROM full_m), o AS (SELECT year, ROW_NUMBER() OVER (ORDER BY year DESC) AS r, CAST((ROW_NUMBER() OVER (ORDER BY year) - 1) % 3 + 1 AS INTEGER) AS slot FROM (SELECT DISTINCT year FROM y)),
  d AS (SELECT y.*, o.slot FROM y JOIN o ON o.year = y.year WHERE r <= 3), c AS (SELECT mm FROM d GROUP BY mm HAVING COUNT(*) = (SELECT COUNT(*) FROM o WHERE r <= 3))
  SELECT year, slot, COUNT(*) AS n_months, CAST(SUM(spend) AS BIGINT) AS total, CAST(round_even(CAST(SUM(spend) AS DOUBLE) / COUNT(*), 0) AS BIGINT) AS mean, COALESCE(string_agg(c.mm, ',' ORDER BY c.mm), '') AS months_common, CAST(COALESCE(SUM(spend) FILTER (c.mm IS NOT NULL), 0) AS BIGINT) AS total_common FROM d LEFT JOIN c ON c.mm = d.mm GROUP BY 1, 2""")
def _(g):
    return reports.year_overlay(_complete(g))


@query("selected_complete_months", f", {LINEAGE}, {WINDOWS}, {COVER} SELECT month FROM comp WHERE is_complete INTERSECT SELECT unnest(['1998-03', '1998-04', '1998-05', '1997-05', '2030-01'])")
def _(g):
    picked = g.spark.createDataFrame([(m,) for m in [*_GRID, "1997-05", "2030-01"]], "month string")
    return g.completeness().where("is_complete").select("month").intersect(picked)


@query("coverage_segments", f""", {LINEAGE}, {WINDOWS}, n AS (SELECT card, s, e, LEAD(s) OVER (PARTITION BY card ORDER BY s) AS nx FROM win), g AS (SELECT card, 'covered' AS kind, s, e FROM n UNION ALL SELECT card, 'gap', CAST(e + INTERVAL 1 DAY AS DATE), CAST(nx - INTERVAL 1 DAY AS DATE) FROM n WHERE nx IS NOT NULL),
  x AS (SELECT CAST(date_trunc('month', MIN(s)) - INTERVAL 1 MONTH AS DATE) AS a, GREATEST(last_day(CAST(MAX(e) + INTERVAL 1 MONTH AS DATE)), last_day(DATE '{TODAY}')) AS z, (SELECT MIN(m) FROM (SELECT MAX(e) AS m FROM win GROUP BY card)) AS all_covered_to FROM win)
  SELECT card, kind, s AS start, e AS "end", CAST(e - s + 1 AS INTEGER) AS days, a AS axis_start, z AS axis_end, CAST(z - a + 1 AS INTEGER) AS axis_days, (s - a) / CAST(z - a + 1 AS DOUBLE) AS at, (e - s + 1) / CAST(z - a + 1 AS DOUBLE) AS len, all_covered_to FROM g, x""")
def _(g):
    return coverage.timeline(coverage.statement_windows(g.carded()[0]), TODAY)


@query("timeline_ticks", f""", {LINEAGE}, {WINDOWS}, x AS (SELECT CAST(date_trunc('month', MIN(s)) - INTERVAL 1 MONTH AS DATE) AS a, GREATEST(last_day(CAST(MAX(e) + INTERVAL 1 MONTH AS DATE)), last_day(DATE '{TODAY}')) AS z FROM win), t AS (SELECT a, z, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS date FROM x)
  SELECT date, (date - a) / CAST(z - a + 1 AS DOUBLE) AS at, month(date) = 1 OR date = a AS year_start, strftime(date, '%b') || CASE WHEN month(date) = 1 OR date = a THEN strftime(date, ' %Y') ELSE '' END AS label FROM t""")
def _(g):
    return coverage.timeline_ticks(coverage.statement_windows(g.carded()[0]), TODAY)


@query("lineage_recursive", f", {LINEAGE} SELECT account_id, head_id, label, lineage_size FROM lab")
def _(g):
    return g.lineage


@query("replacement_refusals", """, q AS (SELECT * FROM (VALUES (1, 9), (9, 1), (3, 3), (1, 3), (1, 2), (4, 3), (6, NULL)) AS t(a, b))
  SELECT CAST(a AS BIGINT) AS account_id, CAST(b AS BIGINT) AS by_id, CASE WHEN x.id IS NULL THEN 'No such card' WHEN b IS NULL THEN '' WHEN y.id IS NULL THEN 'No such card' WHEN a = b THEN 'A card cannot replace itself' WHEN x.issuer <> y.issuer THEN 'A replacement card is issued by the same bank'
  WHEN COALESCE(y.replaced_by_id, y.id) = a THEN 'That card is already part of this one''s history' ELSE '' END AS reason, CASE WHEN a = 4 THEN CAST(3 AS BIGINT) END AS head_id FROM q LEFT JOIN account x ON x.id = a LEFT JOIN account y ON y.id = b""")
def _(g):
    asked = g.spark.createDataFrame([(1, 9), (9, 1), (3, 3), (1, 3), (1, 2), (4, 3), (6, None)], "account_id long, by_id long")
    return lineage.replacement_refusal(g.account, asked)


# ---- merchants, flows, categories

#: Ways in which issuers print one merchant; the line's part key picks one.
_PRINTS = ["{n} {b}", "SMP*{n} PAYA SINGAPORE 065", "GRAB *{n} 4821", "{n} SINGAPORE SG", "www.{f}.com/bill 99", "{n} - REFUND", "AMZN Mktp SG*RT4G91", "  {n}   @ RAFFLES CITY  ", "PAYPAL *{f}", "M1*Data SG", "{n} 88 88 7001", "*** {n}"]


def _described(g) -> DataFrame:
    """Distinct descriptions: every merchant printed in every way."""
    p = g.table("part").select(F.upper("p_name").alias("n"), F.upper("p_brand").alias("b"), F.split(F.upper("p_name"), " ")[0].alias("f")).distinct()
    forms = [F.concat(*[x for part in _pieces(s) for x in part]) for s in _PRINTS]
    return p.select(F.explode(F.array(*forms)).alias("description_raw")).distinct()


def _pieces(s: str):
    import re

    for part in re.split(r"(\{\w\})", s):
        if part:
            yield [F.col(part[1]) if part[0] == "{" else F.lit(part)]


_FORMS = ", ".join("'" + s.replace("'", "''").replace("{n}", "' || n || '").replace("{b}", "' || b || '").replace("{f}", "' || f || '") + "'" for s in _PRINTS)
_DESCRIBED = f"p AS (SELECT DISTINCT upper(p_name) AS n, upper(p_brand) AS b, split_part(upper(p_name), ' ', 1) AS f FROM part), ds AS (SELECT DISTINCT unnest([{_FORMS}]) AS description_raw FROM p)"
_EDGE = N.EDGE.replace("'", "''")
_PLACES = ", ".join("'" + x.replace("'", "''") + "'" for x in N.CITIES + N.COUNTRIES)
_JUNK = "(CASE WHEN NOT regexp_matches({x}, '[0-9]') THEN false WHEN NOT regexp_matches({x}, '\\p{{L}}') THEN len(regexp_replace({x}, '[^0-9]', '', 'g')) >= 3 ELSE len({x}) >= 5 END)"


def _sql_places(t: str) -> str:
    return f"list_slice({t}, 1, GREATEST(LEAST(1, len({t})), COALESCE(list_max(list_transform({t}, lambda x, i: CASE WHEN trim(x, '{_EDGE}') IN ({_PLACES}) THEN 0 ELSE i END)), 0)))"


_words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_NORM = f"""
n0 AS (SELECT description_raw, trim(lower(description_raw)) AS o FROM ds),
n1 AS (SELECT *, regexp_replace(o, '(?i)\\s*[-–—]?\\s*\\b(?:refund|refunded|reversal|reversed|chargeback|credit\\s+voucher)\\b\\s*$', '') AS s FROM n0),
n2 AS (SELECT *, CASE WHEN contains(s, '*') THEN split_part(s, '*', 1) ELSE s END AS b, CASE WHEN contains(s, '*') THEN s[strpos(s, '*') + 1:] ELSE '' END AS r FROM n1),
n3 AS (SELECT *, {_words('b')} AS lw, list_slice(list_filter(list_transform({_words('r')}, lambda w: trim(w, '{_EDGE}')), lambda w: w <> '' AND NOT regexp_matches(w, '^[^a-z0-9]+$')), 1, 2) AS nm FROM n2),
n4 AS (SELECT *, {_sql_places('lw')} AS l FROM n3),
n5 AS (SELECT *, CASE WHEN NOT contains(s, '*') THEN s WHEN len(l) = 0 OR array_to_string(l, ' ') IN ('sq', 'paypal', 'pp', 'pypl', 'stripe') THEN COALESCE(NULLIF(trim(r), ''), trim(b))
  WHEN len(l) = 1 AND trim(l[1], '{_EDGE}') <> '' AND (len(trim(l[1], '{_EDGE}')) <= 3 OR regexp_matches(l[1], '[0-9]')) AND len(nm) = 2 AND len(list_filter(nm, lambda w: {_JUNK.format(x='w')} OR w IN ({_PLACES}))) = 0 THEN trim(r) ELSE array_to_string(l, ' ') END AS m FROM n4),
n6 AS (SELECT *, list_filter({_words('m')}, lambda w: NOT regexp_matches(w, '^[^a-z0-9]+$')) AS t FROM n5),
n7 AS (SELECT *, COALESCE(list_min(list_filter(list_transform(t, lambda x, i: CASE WHEN i > 1 AND {_JUNK.format(x='x')} THEN i END), lambda q: q IS NOT NULL)), len(t) + 1) AS k, regexp_extract(t[1], '^(?:www\\.)?([a-z0-9][a-z0-9&''-]*)\\.([a-z]{{2,}})', 1) AS dn, regexp_extract(t[1], '^(?:www\\.)?([a-z0-9][a-z0-9&''-]*)\\.([a-z]{{2,}})', 2) AS dt FROM n6),
n8 AS (SELECT *, list_slice(t, 1, k - 1) AS c FROM n7),
n9 AS (SELECT *, regexp_replace(trim(array_to_string({_sql_places('c')}, ' '), '{_EDGE}'), '\\s+', ' ', 'g') AS key0 FROM n8),
keyed AS (SELECT description_raw, COALESCE(NULLIF(CASE WHEN dt IN ({', '.join(f"'{x}'" for x in N.TLDS)}) THEN regexp_replace(dn, '^amzn( mktp)?( |$)', 'amazon\\2') END, ''), NULLIF(regexp_replace(key0, '^amzn( mktp)?( |$)', 'amazon\\2'), ''), NULLIF(trim(regexp_replace(m, '\\s+', ' ', 'g'), '{_EDGE}'), ''), o) AS merchant_key FROM n9)"""


@query("normalize_merchant", f"WITH {_DESCRIBED}, {_NORM} SELECT description_raw, merchant_key, split_part(merchant_key, ' ', 1) AS root FROM keyed", ledger=False)
def _(g):
    return _described(g).withColumn("merchant_key", N.normalize("description_raw")).withColumn("root", N.merchant_root("merchant_key"))


@query("suggest_groups", """, k AS (SELECT DISTINCT merchant_normalized AS k FROM txn_lines WHERE merchant_normalized NOT IN (SELECT merchant_normalized FROM merchant_group) UNION SELECT DISTINCT split_part(merchant_normalized, ' ', 1) FROM txn_lines WHERE merchant_normalized LIKE 'blue%' UNION SELECT DISTINCT merchant_normalized || ' (' || CAST(account_id AS VARCHAR) || ')' FROM txn_lines WHERE merchant_normalized LIKE 'old r%' UNION SELECT DISTINCT 'kiosk ' || CAST(account_id AS VARCHAR) FROM txn_lines),
  t AS (SELECT k, string_split(k, ' ') AS t, split_part(k, ' ', 1) AS one FROM k), s AS (SELECT one, COUNT(*) >= 2 AND len(one) >= 3 AND (bool_or(k = one) OR bool_and(regexp_matches(trim(k[len(one) + 1:]), '^$|^[(\\-\\[#/*]|^(\\S*[0-9]\\S*)(\\s+\\S*[0-9]\\S*)*$'))) AS wide FROM t GROUP BY one),
  p AS (SELECT t.k, t.t, CASE WHEN wide THEN t.one WHEN len(t) >= 2 THEN t[1] || ' ' || t[2] END AS prefix FROM t JOIN s ON s.one = t.one)
  SELECT prefix, prefix AS name, string_agg(k, ',' ORDER BY k) AS members, COUNT(*) AS n FROM p WHERE prefix IS NOT NULL GROUP BY 1 HAVING COUNT(*) >= 2""")
def _(g):
    m = F.col("merchant_normalized")
    keys = g.lines.select(m).join(g.groups, "merchant_normalized", "left_anti")
    keys = keys.unionAll(g.lines.where(m.startswith("blue")).select(F.substring_index(m, " ", 1))).unionAll(g.lines.where(m.startswith("old r")).select(F.concat(m, F.lit(" ("), F.col("account_id").cast("string"), F.lit(")")))).unionAll(g.lines.select(F.concat(F.lit("kiosk "), F.col("account_id").cast("string"))))
    return grouping.suggest(keys)


_FLOWS = ["INTEREST CHARGE", "LATE PAYMENT FEE", "PAYMENT - THANK YOU", "PAYNOW TRANSFER TO BOB", "GIRO UTILITIES", "REFUND SPECIALISTS", "CASH BACK", "CASHBACK REBATE", "SALARY MAY", "FUND TRANSFER", "CARD PAYMENT", "UNIQLO REVERSAL", "GST ON FEE", "TOP-UP"]


def _flow_sql() -> str:
    whens = [f"WHEN regexp_matches(d, '(?i){p}')" + (" AND direction = 'credit'" if f in ("refund", "income") else "") + f" THEN '{f}'" for f, p in classify.FLOW_PATTERNS]
    return "CASE " + " ".join(whens) + " WHEN direction = 'credit' THEN 'income' ELSE 'spend' END"


@query("flow_type", f""", x AS (SELECT unnest([{', '.join(f"'{s}'" for s in _FLOWS)}]) AS s), r AS (SELECT DISTINCT merchant_normalized || ' ' || s AS d, direction FROM txn_lines, x) SELECT d AS description_raw, direction, {_flow_sql()} AS flow FROM r""")
def _(g):
    t = g.lines.select("merchant_normalized", "direction").distinct().withColumn("s", F.explode(F.array(*[F.lit(s) for s in _FLOWS])))
    t = t.select(F.concat_ws(" ", "merchant_normalized", "s").alias("description_raw"), "direction").distinct()
    return t.withColumn("flow", classify.default_flow(F.col("description_raw"), F.col("direction")))


_RULED = f""", u AS (SELECT DISTINCT description_raw, merchant_normalized, direction FROM txn_lines),
  hit AS (SELECT u.*, r.id AS rule_id, r.category AS rc, r.flow_type AS rf, ROW_NUMBER() OVER (PARTITION BY u.description_raw, u.merchant_normalized, u.direction ORDER BY r.priority DESC, r.id) AS k FROM u JOIN merchant_rule r ON trim(r.pattern) <> '' AND CASE r.match_type WHEN 'exact' THEN lower(trim(r.pattern)) IN (u.merchant_normalized, lower(u.description_raw))
    WHEN 'contains' THEN contains(u.merchant_normalized, lower(trim(r.pattern))) OR contains(lower(u.description_raw), lower(trim(r.pattern))) ELSE regexp_matches(u.merchant_normalized, lower(r.pattern)) OR regexp_matches(lower(u.description_raw), lower(r.pattern)) END),
  fl AS (SELECT u.*, h.rule_id, h.rc, h.rf, {_flow_sql().replace("(d, ", "(u.description_raw, ").replace("direction =", "u.direction =")} AS flow, m1.merchant_normalized AS k1, m1.category AS c1, m1.source AS s1, m2.merchant_normalized AS k2, m2.category AS c2, m2.source AS s2 FROM u LEFT JOIN hit h ON h.k = 1 AND h.description_raw = u.description_raw AND h.merchant_normalized = u.merchant_normalized AND h.direction = u.direction
    LEFT JOIN merchant_memory m1 ON m1.merchant_normalized = u.merchant_normalized LEFT JOIN merchant_memory m2 ON m2.merchant_normalized = split_part(u.merchant_normalized, ' ', 1)),
  res AS (SELECT description_raw, merchant_normalized, direction, CAST(rule_id AS BIGINT) AS rule_id, CASE WHEN rule_id IS NOT NULL THEN rc WHEN k1 IS NOT NULL THEN c1 WHEN k2 IS NOT NULL THEN c2 ELSE CASE flow WHEN 'transfer' THEN 'Cash & Transfers' WHEN 'fee' THEN 'Fees & Interest' WHEN 'income' THEN 'Income/Refunds' END END AS new_category,
    CASE WHEN rule_id IS NOT NULL THEN COALESCE(rf, flow) ELSE flow END AS new_flow, CASE WHEN rule_id IS NOT NULL THEN 'rule' WHEN k1 IS NOT NULL THEN s1 WHEN k2 IS NOT NULL THEN s2 WHEN flow IN ('transfer', 'fee', 'income') THEN 'flow' END AS new_source, CASE WHEN rule_id IS NOT NULL THEN NULL WHEN k1 IS NOT NULL THEN k1 WHEN k2 IS NOT NULL THEN k2 END AS memory_key FROM fl)"""


def _distinct_rows(g) -> DataFrame:
    return g.lines.select("description_raw", "merchant_normalized", "direction").distinct()


@query("resolve_category", _RULED + " SELECT description_raw, merchant_normalized, direction, rule_id, new_category, new_flow, new_source FROM res")
def _(g):
    return classify.resolve(_distinct_rows(g), g.rules, g.memory).select("description_raw", "merchant_normalized", "direction", "rule_id", "new_category", "new_flow", "new_source")


@query("rule_match", _RULED + " SELECT rule_id, COUNT(*) AS n FROM res GROUP BY 1")
def _(g):
    return with_rule(_distinct_rows(g), g.rules).groupBy(F.col("rule.id").alias("rule_id")).agg(F.count("*").alias("n"))


@query("recategorize", _RULED + """ SELECT t.category_source = 'user' AS by_user, CASE WHEN t.category_source = 'user' THEN t.category ELSE r.new_category END AS category, COUNT(*) AS n, COUNT(*) FILTER (t.category_source IS DISTINCT FROM 'user' AND (t.category IS DISTINCT FROM r.new_category OR t.flow_type IS DISTINCT FROM r.new_flow OR t.category_source IS DISTINCT FROM r.new_source)) AS moved
  FROM (SELECT description_raw, merchant_normalized, direction, category, flow_type, COALESCE(category_source, '-') AS category_source FROM txn_lines) t JOIN res r ON r.description_raw = t.description_raw AND r.merchant_normalized = t.merchant_normalized AND r.direction = t.direction GROUP BY 1, 2""")
def _(g):
    t = classify.recategorize(g.lines.withColumn("category_source", F.coalesce("category_source", F.lit("-"))), g.rules, g.memory)
    return t.groupBy((F.coalesce("category_source", F.lit("-")) == "user").alias("by_user"), "category").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


@query("hit_counts", _RULED + """, h AS (SELECT r.memory_key, COUNT(*) AS n FROM txn_lines t JOIN res r ON r.description_raw = t.description_raw AND r.merchant_normalized = t.merchant_normalized AND r.direction = t.direction WHERE COALESCE(t.category_source, '') <> 'user' AND r.new_source IN ('memory', 'seed') GROUP BY 1)
  SELECT m.merchant_normalized, m.source, COALESCE(h.n, 0) AS hit_count FROM merchant_memory m LEFT JOIN h ON h.memory_key = m.merchant_normalized""")
def _(g):
    return classify.hit_counts(g.lines, g.rules, g.memory)


@query("user_decision", """, one AS (SELECT MIN(id) AS id FROM txn), key AS (SELECT merchant_normalized AS k FROM txn WHERE id = (SELECT id FROM one)),
  c AS (SELECT CASE WHEN id = (SELECT id FROM one) OR (merchant_normalized = (SELECT k FROM key) AND category_source IS DISTINCT FROM 'user') THEN 'Dining' ELSE category END AS category, CASE WHEN id = (SELECT id FROM one) THEN 'user' WHEN merchant_normalized = (SELECT k FROM key) AND category_source IS DISTINCT FROM 'user' THEN 'memory' ELSE category_source END AS category_source FROM txn)
  SELECT category, category_source, COUNT(*) AS n FROM c GROUP BY 1, 2""")
def _(g):
    one = g.txn.agg(F.min("id")).first()[0]
    return classify.set_category(g.txn, one, "Dining", to_matching=True).groupBy("category", "category_source").agg(F.count("*").alias("n"))


@query("upsert_memory", """, n AS (SELECT * FROM (VALUES ('red widget', 'Health', 'memory'), ('new rod', 'Travel', 'memory')) AS t(k, c, s)) SELECT * FROM merchant_memory WHERE merchant_normalized NOT IN (SELECT k FROM n) UNION ALL SELECT k, c, s FROM n""")
def _(g):
    return D.upsert(g.memory, g.spark.createDataFrame([("red widget", "Health", "memory"), ("new rod", "Travel", "memory")], g.memory.schema), "merchant_normalized")


@query("fill_gaps", """ SELECT * FROM merchant_memory UNION ALL SELECT 'new rod', 'Travel', 'llm'""")
def _(g):
    return D.fill_gaps(g.memory, g.spark.createDataFrame([("red widget", "Health", "llm"), ("new rod", "Travel", "llm")], g.memory.schema), "merchant_normalized")


@query("changed_rows", " SELECT id, amount_minor FROM (SELECT id, CASE WHEN account_id = 2 THEN amount_minor + 1 ELSE amount_minor END AS amount_minor, amount_minor AS was FROM txn) t WHERE amount_minor <> was")
def _(g):
    return D.changed_rows(g.txn, g.txn.withColumn("amount_minor", F.when(F.col("account_id") == 2, F.col("amount_minor") + 1).otherwise(F.col("amount_minor"))), "id", ["amount_minor"]).select("id", "amount_minor")


@query("replace_group", " SELECT merchant_normalized, group_name FROM merchant_group WHERE group_name <> 'Gone' AND merchant_normalized <> 'red ring' UNION ALL SELECT unnest(['red ring', 'old rod']), 'Gone'")
def _(g):
    return D.replace_group(g.groups, "  Gone ", ["red ring", "old rod", "red ring"])


# ---- text, statements, verification

_LINES = "ln AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents)"


def _text_lines(g) -> DataFrame:
    return g.table("documents").select("doc_id", F.explode(F.split("text", r"\R")).alias("line"))


#: A number of 16 digits, and the same digits inside a reference of 23, which stays.
_CARD_TAIL = " card 4111 1111-1111 1111 ref 99941111111111111119999, 4111111111111111 378282246310005"
_MARKED = r"\x01([0-9](?:(?:\x01[ -]\x01)?[0-9]){12,18})\x01"


@query("redact_cards", f"""WITH d AS (SELECT doc_id, chr(1) || regexp_replace(text || '{_CARD_TAIL}', '([^0-9])', chr(1) || '\\1' || chr(1), 'g') || chr(1) AS t FROM documents WHERE text IS NOT NULL),
  m AS (SELECT doc_id, string_split_regex(t, '{_MARKED}') AS kept, list_transform(regexp_extract_all(t, '{_MARKED}', 1), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS nums FROM d)
  SELECT doc_id, md5(replace(array_to_string(list_transform(range(1, len(kept) + 1), lambda i: kept[i] || CASE WHEN i <= len(nums) THEN repeat('*', len(nums[i]) - 4) || right(nums[i], 4) ELSE '' END), ''), chr(1), '')) AS masked FROM m""", ledger=False)
def _(g):
    t = g.table("documents").where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit(_CARD_TAIL)).alias("text"))
    return t.select("doc_id", F.md5(T.redact("text")).alias("masked"))


_TAILS = [("{a}", "debit", False), ("{a} CR", "credit", False), ("+{a}", "credit", False), ("-{a}", "debit", False), ("({a})", "debit", False), ("S$ {a} DR", "debit", False), ("10.00 {a} cr", "credit", True)]


@query("trailing_amount", f""", x AS (SELECT *, id % 7 AS k FROM txn) SELECT id, CAST(amount_minor / 100.0 AS DECIMAL(18,2)) AS amount, CASE {" ".join(f"WHEN k = {i} THEN '{t[1]}'" for i, t in enumerate(_TAILS))} END AS direction, description_raw || CASE WHEN k = 6 THEN ' 10.00' ELSE '' END AS description, k = 6 AS ambiguous FROM x""")
def _(g):
    money, k = money_text(F.col("amount_minor")), F.col("id") % 7
    tail = F.lit(None).cast("string")
    for i, t in enumerate(_TAILS):
        before, after = t[0].split("{a}")
        tail = F.when(k == i, F.concat(F.lit(before), money, F.lit(after))).otherwise(tail)
    a = g.txn.select("id", T.trailing_amount(F.concat_ws("  ", "description_raw", tail)).alias("a"))
    return a.select("id", "a.amount", "a.direction", "a.description", "a.ambiguous")


@query("leading_dates", """, ln AS (SELECT id, txn_date, ' ' || description_raw AS rest FROM txn)
  SELECT id, CAST(day(txn_date) AS INTEGER) AS day, CAST(month(txn_date) AS INTEGER) AS month, CASE WHEN id % 4 = 1 THEN NULL WHEN id % 4 = 2 THEN CAST(2000 + year(txn_date) % 100 AS INTEGER) ELSE CAST(year(txn_date) AS INTEGER) END AS year, rest FROM ln""")
def _(g):
    d, k = F.col("txn_date"), F.col("id") % 4
    printed = F.when(k == 0, F.date_format(d, "dd MMM yyyy")).when(k == 1, F.date_format(d, "MMM dd")).when(k == 2, F.date_format(d, "dd/MM/yy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    t = g.txn.select("id", T.leading_date(F.concat_ws(" ", printed, "description_raw")).alias("x"))
    return t.select("id", "x.day", "x.month", "x.year", "x.rest")


#: The fifth is a day and month with slashes, glued to a name after its year: the looser reading takes it.
_SHAPED = ["{d} NAME {a}", "{d} NAME", "NAME {a}", "  {d}  NAME {a} cr ", "{d}NAME {a}", "{d} {a}0"]


@query("txn_shaped_lines", f""", x AS (SELECT id, id % 6 AS k, id % 3 AS s FROM txn) SELECT id, k IN (0, 3, 4) AS row_shaped FROM x""")
def _(g):
    printed = F.when(F.col("id") % 3 == 0, F.date_format("txn_date", "dd MMM")).when(F.col("id") % 3 == 1, F.date_format("txn_date", "dd/MM/yyyy")).otherwise(F.date_format("txn_date", "yyyy-MM-dd"))
    line = F.element_at(F.array(*[F.lit(x) for x in _SHAPED]), (F.col("id") % 6 + 1).cast("int"))
    line = F.replace(F.replace(line, F.lit("{d}"), printed), F.lit("{a}"), money_text(F.col("amount_minor")))
    return g.txn.select("id", T.looks_like_row(line).alias("row_shaped"))


def _parsed(g) -> DataFrame:
    s = g.statement
    return statements.parse_statements(D.generate_statements(listing.assign_statements(g.txn, s), s, g.account))


@query("parse_statements", f"""{_ASSIGNED} SELECT statement_id AS id, txn_date, txn_date AS posted_date, description_raw AS description, CAST(amount_minor / 100.0 AS DECIMAL(18,2)) AS amount, direction FROM asg""")
def _(g):
    return _parsed(g).select("id", F.explode("rows").alias("r")).select("id", "r.txn_date", "r.posted_date", "r.description", "r.amount", "r.direction")


@query("reconcile_statement", f"""{_ASSIGNED} SELECT statement_id AS id, MAX(COALESCE(a.last4, '0000')) AS last4, 'SGD' AS currency, MAX(s.statement_date) AS statement_end, CAST(COALESCE(SUM(amount_minor) FILTER (direction = 'debit'), 0) / 100.0 AS DECIMAL(18,2)) AS debits, CAST(COUNT(*) AS INTEGER) AS rows_expected, 'pass' AS verdict, 'matches printed totals' AS detail, 'parsed' AS status
  FROM asg JOIN account a ON a.id = asg.account_id JOIN statement s ON s.id = asg.statement_id GROUP BY 1""")
def _(g):
    return statements.reconcile(_parsed(g)).select("id", "last4", "currency", F.col("period_end").alias("statement_end"), "debits", "rows_expected", "verdict", "detail", "status")


@query("statement_warnings", f"""{_ASSIGNED}, k AS (SELECT statement_id AS id, COUNT(*) - COUNT(DISTINCT (txn_date, amount_minor, description_raw)) AS twins FROM asg GROUP BY 1) SELECT id, CASE WHEN twins > 0 THEN CAST(twins AS VARCHAR) || ' identical row(s) — genuine repeats, or a page read twice' ELSE '' END AS warnings FROM k""")
def _(g):
    return statements.warnings(_parsed(g)).select("id", F.array_join("warnings", "; ").alias("warnings"))


@query("duplicate_rows", f"""{_ASSIGNED} SELECT statement_id, txn_date, description_raw, COUNT(*) AS n FROM asg GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""")
def _(g):
    return listing.assign_statements(g.txn, g.statement).groupBy("statement_id", "txn_date", "description_raw").agg(F.count("*").alias("n")).where("n > 1")


@query("money_forms", " SELECT id, replace(format('{:,.2f}', amount_minor / 100.0), ' ', '') AS shown, amount_minor AS back FROM txn")
def _(g):
    t = g.txn.select("id", money_text(F.col("amount_minor")).alias("shown"))
    return t.withColumn("back", to_minor(F.concat(F.lit("$"), "shown")))


@query("file_names", """, p AS (SELECT id, '/store\\' || CAST(id AS VARCHAR) || '/stmt-' || CAST(id % 7 AS VARCHAR) || '.pdf' AS path FROM statement) SELECT id, 'stmt-' || CAST(id % 7 AS VARCHAR) || '.pdf' AS name FROM p""")
def _(g):
    return g.statement.select("id", D.file_name(F.concat(F.lit("/store\\"), F.col("id").cast("string"), F.lit("/stmt-"), (F.col("id") % 7).cast("string"), F.lit(".pdf"))).alias("name"))


@query("content_hash_new", "WITH d AS (SELECT sha256(text) AS sha256, MIN(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT sha256 FROM d WHERE sha256 NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0' AND text IS NOT NULL)", ledger=False)
def _(g):
    d = g.table("documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256"), "source")
    return D.only_new(d, d.where("source = 'src0'")).select("sha256")


_HEADS = ["DBS Bank Ltd www.posb.com", "Maybank and UOB and UOB", "no name here", "Citi Trust Bank", "HSBC\n16 MAY DBS DBS DBS PAYMENT 1,000.00 CR", ""]
_SECOND = ["", "", "see maribank.sg", "", "", ""]


def _score_sql(t: str) -> str:
    one = lambda p: f"len(regexp_extract_all({t}, '(?i)" + p.replace("'", "''") + "'))"
    rows = ", ".join(f"{{'s': {one(m)} + {'5 * ' + one(k) if k else '0'}, 'o': {-i}, 'n': '{name}'}}" for i, (name, m, k) in enumerate(issuers.ISSUERS))
    return f"list_sort([{rows}], 'DESC')[1]"


@query("issuer_detection", f""", x AS (SELECT id, CASE id % 6 {" ".join(f"WHEN {i} THEN '{h.split(chr(10))[0]}'" for i, h in enumerate(_HEADS))} END AS a, CASE id % 6 WHEN 2 THEN 'see maribank.sg' ELSE '' END AS b FROM statement), y AS (SELECT id, {_score_sql("a")} AS p, {_score_sql("a || chr(10) || b")} AS q FROM x)
  SELECT id, CASE WHEN p.s > 0 THEN p.n WHEN q.s > 0 THEN q.n ELSE 'My Card ' || CAST(id AS VARCHAR) END AS issuer FROM y""")
def _(g):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("id") % 6 + 1).cast("int"))
    d = g.statement.select("id", F.array(pick(_HEADS), pick(_SECOND)).alias("pages"), F.concat(F.lit("my-card_"), F.col("id").cast("string"), F.lit(".pdf")).alias("filename"))
    return issuers.detect(d).select("id", "issuer")


# ---- what pages show


@query("period_text", f"""{_ASSIGNED}, n AS (SELECT statement_id, MIN(txn_date) AS a, MAX(txn_date) AS b FROM asg GROUP BY 1) SELECT s.id, CASE WHEN period_start IS NOT NULL AND period_end IS NOT NULL THEN CAST(period_start AS VARCHAR) || ' → ' || CAST(period_end AS VARCHAR) WHEN id % 3 > 0 THEN 'to ' || CAST(statement_date AS VARCHAR) WHEN a IS NOT NULL THEN CAST(a AS VARCHAR) || ' → ' || CAST(b AS VARCHAR) || ' (from rows)' ELSE '—' END AS period FROM statement s LEFT JOIN n ON n.statement_id = s.id""")
def _(g):
    s = g.statement
    n = listing.assign_statements(g.txn, s).groupBy("statement_id").agg(F.min("txn_date").alias("a"), F.max("txn_date").alias("b"))
    closing = F.when(F.col("id") % 3 > 0, F.col("statement_date"))
    return s.join(n, s.id == n.statement_id, "left").select("id", display.period_text(F.col("period_start"), F.col("period_end"), closing, F.col("a"), F.col("b")).alias("period"))


@query("months_label", """, m AS (SELECT DISTINCT merchant_normalized AS k, strftime(txn_date, '%Y-%m') AS month FROM txn WHERE amount_minor > 45000000), c AS (SELECT k, COUNT(*) AS n, MIN(month) AS a, MAX(month) AS b, string_agg(month, ', ' ORDER BY month) AS l, MAX(CAST(month[1:4] AS INTEGER) * 12 + CAST(month[6:7] AS INTEGER)) - MIN(CAST(month[1:4] AS INTEGER) * 12 + CAST(month[6:7] AS INTEGER)) AS w FROM m GROUP BY 1)
  SELECT k AS merchant_normalized, CASE WHEN n > 1 AND w = n - 1 THEN a || ' → ' || b ELSE l END AS label, n FROM c""")
def _(g):
    return display.months_label(g.txn.where("amount_minor > 45000000").select("merchant_normalized", reports.month_key().alias("month")), "merchant_normalized")


@query("row_notes", f"""{_ASSIGNED}, d AS (SELECT *, CASE WHEN id % 5 = 0 THEN '' ELSE CAST(txn_date AS VARCHAR) || description_raw END AS key FROM asg), c AS (SELECT *, COUNT(*) OVER (PARTITION BY statement_id, key) - 1 AS twins FROM d)
  SELECT id, CASE WHEN id % 11 = 0 THEN 'more than one amount' ELSE '' END || CASE WHEN id % 11 = 0 AND key <> '' AND twins > 0 THEN '; ' ELSE '' END || CASE WHEN key <> '' AND twins > 0 THEN 'repeats ' || CAST(twins AS VARCHAR) || ' other row(s)' ELSE '' END AS notes FROM c""")
def _(g):
    t = listing.assign_statements(g.txn, g.statement).withColumn("amount_ambiguous", F.col("id") % 11 == 0)
    t = t.withColumn("dedup_key", F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.col("txn_date").cast("string"), "description_raw")))
    return display.row_notes(t).select("id", "notes")


@query("category_shares", f", c AS (SELECT COALESCE(category, '(uncategorized)') AS label, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS v FROM txn_lines WHERE strftime(txn_date, '%Y-%m') = '{MONTH}' GROUP BY 1) SELECT label, n, v, round_even(100.0 * v / MAX(v) OVER (), 0)::DOUBLE AS width, round_even(100.0 * v / SUM(v) OVER (), 1)::DOUBLE AS part FROM c")
def _(g):
    return display.shares(reports.by_category(g.lines, MONTH))


@query("heat_grid", f""", c AS (SELECT COALESCE(category, '(uncategorized)') AS label, [{', '.join(f"CAST(COALESCE(SUM({NET}) FILTER (strftime(txn_date, '%Y-%m') = '{m}'), 0) AS BIGINT)" for m in _GRID)}] AS cells FROM txn_lines WHERE strftime(txn_date, '%Y-%m') IN ('1998-03', '1998-04', '1998-05') GROUP BY 1)
  SELECT label, list_transform(cells, lambda v: CASE WHEN v > 0 THEN round_even(v / CAST(list_max(cells) AS DOUBLE), 3) ELSE 0.0 END) AS intensity, list_transform(cells, lambda v: CASE WHEN list_max(cells) > list_min(cells) THEN (v - list_min(cells)) / CAST(list_max(cells) - list_min(cells) AS DOUBLE) ELSE 0.5 END) AS spark FROM c""")
def _(g):
    return display.heat(reports.pivot(g.lines, reports.category_label(), _GRID)).select("label", "intensity", "spark")


@query("against_average", f", m AS (SELECT strftime(txn_date, '%Y-%m') AS month, CAST(SUM({NET}) AS BIGINT) AS spend_minor FROM txn GROUP BY 1), a AS (SELECT *, CAST(round_even(CAST(SUM(spend_minor) OVER () AS DOUBLE) / COUNT(*) OVER (), 0) AS BIGINT) AS average FROM m) SELECT month, spend_minor, average, spend_minor - average AS deviation FROM a")
def _(g):
    return display.against_average(reports.month_totals(g.txn).select("month", "spend_minor"))


@query("run_summary", "WITH o AS (SELECT CASE status WHEN 0 THEN 'failed' WHEN 1 THEN 'duplicate' ELSE 'stored' END AS kind, event_type AS message FROM (SELECT event_id % 4 AS status, event_type FROM events)), f AS (SELECT message, COUNT(*) AS n FROM o WHERE kind = 'failed' GROUP BY 1), t AS (SELECT * FROM f ORDER BY n DESC, message LIMIT 3) SELECT COUNT(*) FILTER (kind = 'stored') AS stored, COUNT(*) FILTER (kind = 'duplicate') AS duplicate, COUNT(*) FILTER (kind = 'failed') AS failed, (SELECT string_agg(message || CASE WHEN n > 1 THEN ' ×' || CAST(n AS VARCHAR) ELSE '' END, '; ' ORDER BY n DESC, message) FROM t) AS messages FROM o", ledger=False)
def _(g):
    k = F.col("event_id") % 4
    return display.run_summary(g.table("events").select(F.when(k == 0, "failed").when(k == 1, "duplicate").otherwise("stored").alias("kind"), F.col("event_type").alias("message")))


@query("rule_list", " SELECT CAST(id AS BIGINT) AS id, pattern, CAST(priority AS INTEGER) AS priority, CAST(ROW_NUMBER() OVER (ORDER BY priority DESC, id) AS INTEGER) AS place FROM merchant_rule")
def _(g):
    return g.rules.select("id", "pattern", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "id")).alias("place"))


@query("deleted_statements", " SELECT s.id FROM statement s WHERE CAST(s.id AS VARCHAR) NOT LIKE '3%'")
def _(g):
    return D.delete_by_prefix(g.statement.withColumn("filename", F.col("id").cast("string")), "3").select("id")


@query("pruned_accounts", " SELECT id FROM account WHERE id <> 6")
def _(g):
    return D.without_accounts(g.account, g.statement, ["East Bank", "North Bank"]).select("id")


# ---- suggestions of an outside model


@query("batch_payloads", f", {_MERCHANT}, b AS (SELECT merchant_normalized AS k, example, CAST((ROW_NUMBER() OVER (ORDER BY merchant_normalized) - 1) // 40 AS INTEGER) AS batch FROM m) SELECT batch, string_agg(k || ' | ' || example, chr(10) ORDER BY k) AS payload FROM b GROUP BY 1")
def _(g):
    m = listing.merchant_summary(g.lines, g.memory)
    return gate.payloads(gate.batches(m), m.select("merchant_normalized", "example")).select("batch", "payload")


@query("gate_sets", f""", {_MERCHANT}, b AS (SELECT merchant_normalized AS k, (ROW_NUMBER() OVER (ORDER BY merchant_normalized) - 1) // 40 AS batch FROM m) SELECT CAST(batch AS INTEGER) AS batch, batch = 0 AS ok, CASE batch WHEN 0 THEN '' ELSE '1 merchant(s) invented that were never asked about;1 merchant(s) dropped from the answer;category value(s) outside the fixed set: Nonsense' END AS problems FROM b GROUP BY batch""")
def _(g):
    asked = gate.payloads(gate.batches(g.lines))
    names = F.when(F.col("batch") == 0, F.col("asked")).otherwise(F.concat(F.slice("asked", 2, 1000), F.array(F.lit("nobody"))))
    items = F.transform(names, lambda k: F.struct(k.alias("merchant"), F.when(k == "nobody", "Nonsense").otherwise("Dining").alias("category")))
    return gate.gate(asked.withColumn("raw", F.to_json(F.struct(items.alias("assignments"))))).select("batch", "ok", F.array_join("problems", ";").alias("problems"))


@query("eval_score", """WITH t AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS t, CASE WHEN d.n_chars < 100 THEN 'Unknown' WHEN d.n_chars < 5000 THEN 'good' WHEN d.n_chars < 12000 THEN 'poor' END AS a FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
  SELECT COUNT(*) FILTER (a = t AND a <> 'Unknown') AS correct, COUNT(*) FILTER (a <> t AND a <> 'Unknown') AS wrong, COUNT(*) FILTER (a = 'Unknown') AS abstained, COUNT(*) FILTER (a IS NULL) AS missing, COUNT(*) AS total, (SELECT MAX(c) FROM (SELECT COUNT(*) AS c FROM t GROUP BY t)) AS baseline FROM t""", ledger=False)
def _(g):
    truth = g.table("labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    n = F.col("n_chars")
    answers = g.table("documents").select("doc_id", F.when(n < 100, "Unknown").when(n < 5000, "good").when(n < 12000, "poor").alias("label")).where("label IS NOT NULL")
    return gate.grade(truth, answers, "doc_id")

from ledgerstone.plans import stored, upkeep  # noqa: E402, F401  register their queries
