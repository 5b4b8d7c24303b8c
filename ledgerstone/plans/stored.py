"""Queries over tables that are kept on disk and changed in steps, and over rules of any number; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerstone.functions.sql import register
from ledgerstone.operators import coverage, kept
from ledgerstone.operators.rules import with_rule
from ledgerstone.plans.catalog import COVER, LINEAGE, NET, REPORT, WINDOWS, _flow_sql, query
from ledgerstone.sources import ingest, site
from ledgerstone.sources.shared import shared_folder
from ledgerstone.sources.store import Store


@query("kept_report", f""", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT} SELECT month, CAST(n AS BIGINT) AS n, CAST(spend AS BIGINT) AS spend_minor, CAST(spend_comparable AS BIGINT) AS spend_comparable, not_comparable,
  CASE WHEN not_comparable IS NULL THEN CAST(spend_comparable - base AS BIGINT) END AS delta_minor FROM rep JOIN (SELECT strftime(txn_date, '%Y-%m') AS month, COUNT(*) AS n FROM txn GROUP BY 1) USING (month)""")
def _(g):
    """The report from a cube that grew in steps: a card's whole past comes late, a year is taken out and put back, rows are replaced by corrected ones."""
    store = Store(g.spark, shared_folder(g.spark))
    year, late = F.year("txn_date"), F.col("account_id") == 3
    wrong = g.txn.where((F.col("account_id") == 2) & (year == 1996))
    off = wrong.withColumn("amount_minor", F.col("amount_minor") + 1)
    kept.build_cube(store, g.txn.where((year < 1997) & ~late & ~((F.col("account_id") == 2) & (year == 1996))).unionByName(off))
    kept.refresh_cube(store, came=g.txn.where((year >= 1997) & ~late), went=g.txn.where((F.col("account_id") == 1) & (year == 1995)))
    kept.refresh_cube(store, came=g.txn.where(late))
    kept.refresh_cube(store, came=g.txn.where((F.col("account_id") == 1) & (year == 1995)).unionByName(wrong), went=off)
    return g.report(kept.read_cube(store)).select("month", "n", "spend_minor", "spend_comparable", "not_comparable", "delta_minor")


@query("stored_changes", """, new AS (SELECT id, account_id, txn_date, CASE WHEN account_id = 2 AND year(txn_date) = 1996 THEN amount_minor + 1 ELSE amount_minor END AS amount_minor FROM txn WHERE NOT (account_id = 4 AND year(txn_date) = 1993)
  UNION ALL SELECT id + 1000000000000, account_id, CAST(txn_date + INTERVAL 40 DAY AS DATE), amount_minor FROM txn WHERE account_id = 5 AND year(txn_date) = 1997)
  SELECT id, account_id, CASE WHEN account_id = 1 AND year(txn_date) = 1994 THEN CAST(txn_date + INTERVAL 400 DAY AS DATE) ELSE txn_date END AS txn_date, amount_minor FROM new""")
def _(g):
    """Transactions on disk after amounts were corrected, rows were added and taken out, and rows moved to another month."""
    store = Store(g.spark, shared_folder(g.spark))
    month = F.date_format("txn_date", "yyyy-MM")
    rows = g.txn.select("id", "account_id", "txn_date", "amount_minor")
    of = lambda account, year: rows.where((F.col("account_id") == account) & (F.year("txn_date") == year))
    store.write(rows.withColumn("month", month))
    put = lambda changes, gone=None: store.upsert(changes.withColumn("month", month), "id", gone)
    put(of(2, 1996).withColumn("amount_minor", F.col("amount_minor") + 1), of(4, 1993))
    put(of(5, 1997).select((F.col("id") + 1_000_000_000_000).alias("id"), "account_id", F.date_add("txn_date", 40).alias("txn_date"), "amount_minor"))
    put(of(1, 1994).withColumn("txn_date", F.date_add("txn_date", 400)))
    return store.read().select("id", "account_id", "txn_date", "amount_minor")


_PARTS = "lower(p_name || ' ' || p_brand)"
_RULES = f""", r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN {_PARTS} ELSE substr({_PARTS}, CAST(1 + p_partkey % 7 AS INTEGER), CAST(2 + p_partkey % 9 AS INTEGER)) END AS pattern, p_partkey % 3 = 0 AS exact, 'C' || CAST(p_partkey % 20 AS VARCHAR) AS category, p_partkey % 50 AS priority FROM part),
  u AS (SELECT DISTINCT description_raw, merchant_normalized FROM txn_lines),
  h AS (SELECT u.description_raw, u.merchant_normalized, r.id, r.category, ROW_NUMBER() OVER (PARTITION BY u.description_raw, u.merchant_normalized ORDER BY r.priority DESC, r.id) AS k FROM u JOIN r ON trim(r.pattern) <> '' AND CASE WHEN r.exact THEN trim(r.pattern) IN (lower(u.merchant_normalized), lower(u.description_raw)) ELSE contains(lower(u.merchant_normalized), trim(r.pattern)) OR contains(lower(u.description_raw), trim(r.pattern)) END)
  SELECT u.description_raw, u.merchant_normalized, CAST(h.id AS BIGINT) AS rule_id, h.category FROM u LEFT JOIN h ON h.k = 1 AND h.description_raw = u.description_raw AND h.merchant_normalized = u.merchant_normalized"""


@query("many_rules", _RULES)
def _(g):
    """A rule for each part, of a piece of its description or all of it, over every distinct pair of key and description."""
    text = F.lower(F.concat("p_name", F.lit(" "), "p_brand"))
    k = F.col("p_partkey")
    part = F.substring(text, (1 + k % 7).cast("int"), (2 + k % 9).cast("int"))
    rules = g.table("part").select(k.alias("id"), F.when(k % 3 == 0, text).otherwise(part).alias("pattern"), F.when(k % 3 == 0, "exact").otherwise("contains").alias("match_type"), F.concat(F.lit("C"), (k % 20).cast("string")).alias("category"), F.lit(None).cast("string").alias("flow_type"), (k % 50).alias("priority"))
    return with_rule(g.lines.select("description_raw", "merchant_normalized").distinct(), rules).select("description_raw", "merchant_normalized", F.col("rule.id").alias("rule_id"), F.col("rule.category").alias("category"))




@query("window_overlaps", f""", {LINEAGE}, {WINDOWS}, days AS (SELECT DISTINCT txn_date AS d FROM txn),
  span AS (SELECT DISTINCT 'week' AS grain, CAST(date_trunc('week', d) AS DATE) AS s, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS e FROM days UNION ALL SELECT DISTINCT 'quarter', CAST(date_trunc('quarter', d) AS DATE), CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) FROM days
    UNION ALL SELECT 'whole', MIN(d), MAX(d) FROM days UNION ALL SELECT 'day', d, d FROM days)
  SELECT grain, span.s AS span_start, card, CAST(SUM(date_diff('day', GREATEST(win.s, span.s), LEAST(win.e, span.e)) + 1) AS BIGINT) AS covered_days, COUNT(*) AS pieces FROM win JOIN span ON win.s <= span.e AND win.e >= span.s GROUP BY 1, 2, 3""")
def _(g):
    """Days that each card's statements cover of every day, week and quarter with transactions, and of the whole ledger."""
    s, _ = g.carded()
    days = g.txn.select(F.col("txn_date").alias("d")).distinct()
    trunc = lambda unit: F.trunc("d", unit)
    spans = days.select(F.lit("week").alias("grain"), trunc("WEEK").alias("start"), F.date_add(trunc("WEEK"), 6).alias("end")).distinct()
    spans = spans.unionAll(days.select(F.lit("quarter"), trunc("QUARTER"), F.date_sub(F.add_months(trunc("QUARTER"), 3), 1)).distinct()).unionAll(days.agg(F.min("d").alias("s"), F.max("d").alias("e")).select(F.lit("whole"), "s", "e")).unionAll(days.select(F.lit("day"), "d", "d"))
    met = coverage.overlaps(coverage.statement_windows(s), spans)
    return met.groupBy(F.col("span_grain").alias("grain"), "span_start", "card").agg(F.sum(F.datediff("shared_end", "shared_start") + 1).alias("covered_days"), F.count("*").alias("pieces"))


@query("dumped_statements", " SELECT CAST(id AS VARCHAR) AS key, 'key=' || id AS file, CAST(octet_length(encode('{\"id\":' || id || ',\"account_id\":' || account_id || '}')) + 1 AS BIGINT) AS bytes, '{\"id\":' || id || ',\"account_id\":' || account_id || '}' AS text FROM statement")
def _(g):
    """A file for each statement, and the text that stands in it."""
    path = shared_folder(g.spark)
    told = ingest.dump_files(g.statement.select("id", "account_id"), "id", path)
    there = g.spark.read.option("basePath", path).text(f"{path}/key=*").select("value", F.col("key").cast("string").alias("key"))
    return told.join(there, "key").select("key", F.substring_index("file", "/", -1).alias("file"), "bytes", F.col("value").alias("text"))


@query("sql_flows", f" SELECT split_part(merchant_normalized, ' ', 1) AS root, {_flow_sql().replace('(d, ', '(description_raw, ')} AS flow, strftime(txn_date, '%Y-%m') AS month, COUNT(*) AS n, CAST(SUM({NET}) AS BIGINT) AS spend_minor FROM txn_lines GROUP BY 1, 2, 3")
def _(g):
    """Rows and net spend by first word, flow and month, written in SQL over the registered functions."""
    register(g.spark)
    return g.spark.sql("SELECT merchant_root(merchant_normalized) AS root, flow_of(description_raw, direction) AS flow, month_of(txn_date) AS month, count(*) AS n, sum(net_value(amount_minor, flow_type)) AS spend_minor FROM {lines} GROUP BY ALL", lines=g.lines)


@query("sql_windows", f""", {LINEAGE}, {WINDOWS} SELECT card, s AS start, e AS "end" FROM win""")
def _(g):
    """Statement windows, merged by the registered function over each card's group."""
    register(g.spark)
    s, _ = g.carded()
    w = Window.partitionBy("card").orderBy(F.coalesce("period_end", "statement_date"), "id")
    dated = s.withColumn("end", F.coalesce("period_end", "statement_date")).withColumn("start", F.coalesce("period_start", F.date_add(F.lag("end").over(w), 1), "first_txn"))
    return g.spark.sql("SELECT card, w.start, w.end FROM (SELECT card, explode(merged_windows(collect_list(struct(start, end)))) AS w FROM {dated} GROUP BY card)", dated=dated)


_LINK = r'\b(href|src)="([^"]*)"'
_SITE = rf"""WITH RECURSIVE a AS (SELECT page_id, lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) AS host, COALESCE(NULLIF(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query, COALESCE(html, '') AS html FROM pages WHERE regexp_matches(url, '(?i)^https?://')),
s AS (SELECT *, host || path || CASE WHEN len(query) > 1 THEN query ELSE '' END AS key FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY host || path || CASE WHEN len(query) > 1 THEN query ELSE '' END ORDER BY page_id) = 1),
l AS (SELECT key, host, n, names[n] AS name, replace(replace(replace(replace(replace(raws[n], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM (SELECT key, host, names, raws, unnest(range(1, len(raws) + 1)) AS n FROM (SELECT key, host, regexp_extract_all(html, '{_LINK}', 1) AS names, regexp_extract_all(html, '{_LINK}', 2) AS raws FROM s))),
e AS (SELECT *, regexp_extract(t, '^([^?#]*)', 1) AS to_path, regexp_extract(t, '^[^?#]*([?][^#]*)', 1) AS to_query, regexp_extract(t, '(#.*)$', 1) AS fragment FROM l),
k AS (SELECT *, host || to_path || CASE WHEN len(to_query) > 1 THEN to_query ELSE '' END AS to_key FROM e),
r AS (SELECT key, 0 AS depth FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY host ORDER BY page_id) = 1 UNION SELECT k.to_key, r.depth + 1 FROM r JOIN k ON k.key = r.key JOIN s ON s.key = k.to_key WHERE r.depth < 50),
d AS (SELECT key, MIN(depth) AS depth FROM r GROUP BY key),
f AS (SELECT s.*, d.depth, rtrim(path, '/') || CASE WHEN len(query) > 1 THEN '/q/' || sha1(query[2:])[1:12] ELSE '' END || '/' AS file FROM s JOIN d ON d.key = s.key),
w AS (SELECT k.key, list(name || '="' || replace(replace(replace(replace(replace('/base' || COALESCE(f.file, to_path) || fragment, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '"' ORDER BY n) AS links FROM k LEFT JOIN f ON f.key = k.to_key GROUP BY k.key)
SELECT page_id, host, CAST(depth AS INTEGER) AS depth, file, md5(array_to_string(list_transform(range(1, len(string_split_regex(html, '{_LINK}')) + 1), lambda i: string_split_regex(html, '{_LINK}')[i] || COALESCE(w.links[i], '')), '')) AS html_md5 FROM f LEFT JOIN w ON w.key = f.key"""


@query("site_pages", _SITE, ledger=False)
def _(g):
    """Snapshots of all hosts, each from its page of smallest id. All links of the given pages begin with a slash, so the SQL resolves no others; tests do."""
    pages = g.table("pages")
    first = site.addressed(pages).groupBy("host").agg(F.min("page_id").alias("page_id"))
    return site.site_snapshot(pages, first.select("page_id"), base="/base").select("page_id", "host", "depth", "file", F.md5("html").alias("html_md5"))
