"""Queries of ingest, deletes, replay, ordered lists and whole reports; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions.merchants import merchant_root
from ledgerstone.operators import display, grouping, lineage, listing, replay, reports, statements
from ledgerstone.plans.catalog import _ASSIGNED, _COMPLETE, _MARKED, _MERCHANT, COVER, LINEAGE, MONTH, NET, REPORT, WINDOWS, query
from ledgerstone.sources import documents as D
from ledgerstone.sources import ingest, seeds

_CARD = "issuer || COALESCE(' ····' || last4, '')"


def _rows(g) -> DataFrame:
    """Transactions with their statement, and the columns that ingest writes."""
    t = listing.assign_statements(g.txn, g.statement)
    return t.withColumns({"currency": F.when(F.col("account_id") == 5, "USD").otherwise("SGD"), "fx_rate": F.when(F.col("id") % 50 != 0, "1.35"), "amount_ambiguous": F.col("id") % 9 == 0, "source_page": (F.col("id") % 3 + 1).cast("int")})


# ---- ingest and deletes


@query("txn_accounts", f" SELECT t.id, {_CARD} AS label, amount_minor FROM txn t JOIN account a ON a.id = t.account_id")
def _(g):
    return listing.with_account(g.txn, g.account).select("id", "label", "amount_minor")


_WANTED = [("North Bank", "1111", "SGD"), ("New Bank", None, "USD"), ("New Bank", None, None), ("South Bank", None, "SGD"), ("Alpha Bank", "0009", None)]


@query("found_accounts", """, w AS (SELECT * FROM (VALUES ('North Bank', '1111', 'SGD'), ('New Bank', NULL, 'USD'), ('New Bank', NULL, NULL), ('South Bank', NULL, 'SGD'), ('Alpha Bank', '0009', NULL)) AS v(issuer, last4, currency)),
  n AS (SELECT issuer, last4, MIN(currency) AS currency FROM w WHERE NOT EXISTS (SELECT 1 FROM account a WHERE a.issuer = w.issuer AND a.last4 IS NOT DISTINCT FROM w.last4) GROUP BY 1, 2)
  SELECT id, issuer, last4, 'SGD' AS currency FROM account UNION ALL SELECT (SELECT MAX(id) FROM account) + ROW_NUMBER() OVER (ORDER BY issuer, last4 NULLS FIRST), issuer, last4, COALESCE(currency, 'SGD') FROM n""")
def _(g):
    every, _ = ingest.find_or_create(g.account, g.spark.createDataFrame(_WANTED, "issuer string, last4 string, currency string"))
    return every.select("id", "issuer", "last4", "currency")


def _files(g) -> tuple[DataFrame, DataFrame]:
    """Generated statements as files: some of another kind, empty, damaged, or already known."""
    d = D.generate_statements(listing.assign_statements(g.txn, g.statement), g.statement, g.account)
    k = F.col("id") % 10
    f = d.select(
        F.concat(F.lit("stmt-"), F.col("id").cast("string"), F.when(k == 1, ".txt").otherwise(".pdf")).alias("filename"), F.when(k == 2, 0).otherwise(1000).cast("long").alias("length"),
        F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.when(k != 3, F.col("pages")).alias("pages"), F.when(k == 3, "damaged file: ValueError").alias("error"))
    twin = f.where("filename LIKE '%9.pdf'").withColumn("filename", F.concat(F.lit("z-"), "filename"))
    return f.unionAll(twin), d.where("id % 10 = 4").select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))


_KINDS = "CASE WHEN id % 10 IN (1, 2, 3) THEN 'failed' WHEN id % 10 = 4 THEN 'duplicate' ELSE 'stored' END"


@query("file_outcomes", f"""{_ASSIGNED}, s AS (SELECT DISTINCT statement_id AS id FROM asg), o AS (SELECT {_KINDS} AS kind, CASE id % 10 WHEN 1 THEN 'only .pdf files are read' WHEN 2 THEN 'the file is empty' WHEN 3 THEN 'damaged file: ValueError' WHEN 4 THEN 'this file is already there' ELSE '' END AS message FROM s
  UNION ALL SELECT 'duplicate', 'this file is already there' FROM s WHERE id % 10 = 9) SELECT kind, message, COUNT(*) AS n FROM o GROUP BY 1, 2""")
def _(g):
    files, known = _files(g)
    return ingest.ingest(files, g.account, known)["outcomes"].groupBy("kind", "message").agg(F.count("*").alias("n"))


@query("ingested_statements", f"""{_ASSIGNED} SELECT 'stmt-' || CAST(statement_id AS VARCHAR) || '.pdf' AS filename, 'pass' AS verdict, COUNT(*) AS n, CAST(COALESCE(SUM(amount_minor) FILTER (direction = 'debit'), 0) AS BIGINT) AS debits, MIN(txn_date) AS first_row
  FROM asg WHERE statement_id % 10 NOT IN (1, 2, 3, 4) GROUP BY 1, 2""")
def _(g):
    files, known = _files(g)
    got = ingest.ingest(files, g.account, known)
    r = got["txns"].groupBy("statement_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("direction") == "debit", F.col("amount_sgd_minor"))), F.lit(0)).alias("debits"), F.min("txn_date").alias("first_row"))
    return got["statements"].join(r, F.col("id") == F.col("statement_id")).select("filename", "verdict", "n", "debits", "first_row")


_GONE = [100000 + 1998 * 12 + k for k in range(1, 13)]


@query("deleted_cascade", f"""{_ASSIGNED}, left_s AS (SELECT account_id FROM statement WHERE id NOT IN ({", ".join(map(str, _GONE))})), left_t AS (SELECT account_id FROM asg WHERE statement_id NOT IN ({", ".join(map(str, _GONE))}))
  SELECT 'statement' AS kind, account_id, COUNT(*) AS n FROM left_s GROUP BY 2 UNION ALL SELECT 'txn', account_id, COUNT(*) FROM left_t GROUP BY 2""")
def _(g):
    s, t = ingest.delete_statements(g.statement, listing.assign_statements(g.txn, g.statement), _GONE)
    n = lambda x, kind: x.groupBy("account_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "account_id", "n")
    return n(s, "statement").unionAll(n(t, "txn"))


@query("deleted_entries", " SELECT 'rule' AS kind, CAST(id AS VARCHAR) AS key FROM merchant_rule WHERE id <> 2 UNION ALL SELECT 'memory', merchant_normalized FROM merchant_memory WHERE merchant_normalized <> 'red' UNION ALL SELECT 'group', merchant_normalized FROM merchant_group WHERE group_name <> 'Hot Company'")
def _(g):
    keys = lambda t, kind, c: t.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
    memory, groups = ingest.delete_rows(g.memory, "merchant_normalized", "red"), ingest.delete_rows(g.groups, "group_name", "Hot Company")
    return keys(ingest.delete_rows(g.rules, "id", 2), "rule", "id").unionAll(keys(memory, "memory", "merchant_normalized")).unionAll(keys(groups, "group", "merchant_normalized"))


@query("evolved_rules", " SELECT CAST(id AS INTEGER) AS id, pattern, 'never' AS created_at, CAST(priority AS BIGINT) AS priority, match_type FROM merchant_rule")
def _(g):
    return ingest.evolve(g.rules, {"id": ("int", None), "pattern": ("string", None), "created_at": ("string", "never"), "priority": ("bigint", 0)}).select("id", "pattern", "created_at", "priority", "match_type")


@query("statement_json", " SELECT CAST(id AS VARCHAR) AS key, CAST(account_id AS VARCHAR) AS account, CAST(period_start AS VARCHAR) AS start FROM statement")
def _(g):
    d = ingest.dumps(g.statement, "id")
    return d.select("key", F.get_json_object("json", "$.account_id").alias("account"), F.get_json_object("json", "$.period_start").alias("start"))


@query("decoded_text", " SELECT id, CASE id % 4 WHEN 0 THEN 'café' WHEN 1 THEN '€ “x” – ' || chr(252) WHEN 2 THEN 'plain' ELSE 'a' || chr(65533) || 'b' END AS text FROM statement")
def _(g):
    raw = F.when(F.col("id") % 4 == 0, F.unhex(F.lit("EFBBBF636166C3A9"))).when(F.col("id") % 4 == 1, F.unhex(F.lit("802093789420962" + "0FC"))).when(F.col("id") % 4 == 2, F.unhex(F.lit("706C61696E"))).otherwise(F.unhex(F.lit("618162")))
    return g.statement.select("id", D.decode_text(raw).alias("text"))


@query("scanned_pages", f"SELECT doc_id, length(trim(COALESCE(text, ''), {' || '.join(f'chr({ord(c)})' for c in D.WHITE)})) < 100 AS scanned FROM documents", ledger=False)
def _(g):
    return g.table("documents").select("doc_id", D.looks_scanned(F.col("text")).alias("scanned"))


@query("demo_statements", " SELECT COUNT(*) FILTER (id % 4 = 0) AS n FROM statement")
def _(g):
    return listing.named_like(g.statement.withColumn("filename", F.concat(F.when(F.col("id") % 4 == 0, "demo-").otherwise("Demo-"), F.col("id").cast("string"))), "demo-")


_SEED, _CYCLES = 20240817, 48


def _draw_sql(seed: int, *parts: str) -> str:
    x = f"CAST({seed} AS BIGINT)"
    for p in parts:
        x = f"(({x} * 48271 + CAST({p} AS BIGINT) * 16807 + 11) % 2147483647)"
    return f"(({x} * 48271 + 7) % 2147483647)"


@query("seeded_rows", f"""WITH h AS (SELECT * FROM (VALUES (0, 'GROCER', 4, 5, 4200), (1, 'COFFEE BAR', 6, 7, 650), (2, 'BUS RIDE', 8, 9, 190), (3, 'STREAMING', 1, 1, 1598), (4, 'BOOKSHOP', 0, 3, 2700)) AS v(habit, name, lo, more, usual)),
  c AS (SELECT CAST(range AS INTEGER) AS cycle, CAST(DATE '2024-01-01' + to_months(CAST(range AS INTEGER)) AS DATE) AS first FROM range({_CYCLES})),
  n AS (SELECT cycle, first, h.*, lo + {_draw_sql(_SEED, "cycle", "habit")} % more AS n FROM c, h), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n),
  r AS (SELECT cycle, habit, CAST(k AS INTEGER) AS k, CAST(first + CAST({_draw_sql(_SEED + 1, "cycle", "habit", "k")} % 28 AS INTEGER) AS DATE) AS txn_date, name AS description_raw,
    CAST(floor(usual * [100, 96, 98, 100, 102, 110, 104, 100, 98, 102, 118, 130][month(first)] / 100) + {_draw_sql(_SEED + 2, "cycle", "habit", "k")} % 300 AS BIGINT) AS amount_minor FROM k)
  SELECT *, CAST(SUM(amount_minor) OVER (ORDER BY cycle, txn_date, habit, k) AS BIGINT) AS balance_minor FROM r""", ledger=False)
def _(g):
    return seeds.generate_rows(g.spark, _SEED, _CYCLES)


@query("seeded_memory", f", s AS (SELECT unnest(string_split('{seeds.SEEDS['Groceries']}', ' ')) AS k) SELECT merchant_normalized, category, source FROM merchant_memory UNION ALL SELECT k, 'Groceries', 'seed' FROM s WHERE k NOT IN (SELECT merchant_normalized FROM merchant_memory)")
def _(g):
    return D.fill_gaps(g.memory, seeds.seeds(g.spark).where("category = 'Groceries'"), "merchant_normalized")


# ---- verdicts of every kind

_PAD = "Meridian Bank card statement for the household account, printed for your records only and kept with care\\nStatement period 15 MAY 2026 to 14 JUN 2026\\n".replace("\\n", "\n")


@query("reconcile_verdicts", """, x AS (SELECT id, id % 6 AS k, amount_minor FROM txn) SELECT id, CASE WHEN k IN (0, 2, 5) THEN 'pass' WHEN k IN (1, 3) THEN 'fail' ELSE 'unverified' END AS verdict, CASE k WHEN 0 THEN 'matches printed totals' WHEN 1 THEN 'debits off by 1.00' WHEN 2 THEN 'balance rolls forward (card convention)'
  WHEN 3 THEN 'balance off by 93.00' WHEN 5 THEN 'balance rolls forward (deposit convention)' ELSE 'statement prints no totals or balances to check against' END AS detail, CASE WHEN k IN (0, 2, 5) THEN 'parsed' ELSE 'needs_review' END AS status FROM x""")
def _(g):
    from ledgerstone.functions.money import money_text

    a, k = F.col("amount_minor"), F.col("id") % 6
    m = lambda c: money_text(c.cast("long"))
    tail = (
        F.when(k == 0, F.concat(F.lit("Total purchases "), m(a))).when(k == 1, F.concat(F.lit("Total purchases "), m(a + 100))).when(k == 2, F.concat(F.lit("PREVIOUS BALANCE 10.00\nNEW BALANCE "), m(a + 1000)))
        .when(k == 3, F.concat(F.lit("PREVIOUS BALANCE 10.00\nNEW BALANCE "), m(a + 10300))).when(k == 5, F.concat(F.lit("OPENING BALANCE "), m(2 * a), F.lit("\nCLOSING BALANCE "), m(a))).otherwise("the end")
    )
    page = F.concat(F.lit(_PAD + "16 MAY 17 MAY CORNER SHOP "), m(a), F.lit("\n"), tail)
    return statements.reconcile(statements.parse_statements(g.txn.select("id", F.array(page).alias("pages")))).select("id", "verdict", "detail", "status")


# ---- replay


def _reread(g) -> DataFrame:
    """What the pages say now: another description for some rows, foreign charges and flags for others; k is a row's place."""
    r = _rows(g)
    return r.select("statement_id", "txn_date", "amount_minor", F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("NEW "), "description_raw")).otherwise(F.col("description_raw")).alias("description_raw"), (F.col("id") % 6 == 0).alias("amount_ambiguous"),
        F.when(F.col("id") % 20 == 0, "HKD").alias("foreign_currency"), (F.col("amount_minor") * 6).alias("foreign_minor"), F.lit("0.1655").alias("fx_rate"))


_LAST = f"{_ASSIGNED}, lastr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY statement_id, txn_date, amount_minor ORDER BY id DESC) AS o FROM asg) WHERE o = 1), m AS (SELECT a.id, a.account_id, a.description_raw AS old, a.amount_minor, l.id AS lid, l.description_raw AS now FROM asg a JOIN lastr l USING (statement_id, txn_date, amount_minor))"


@query("replayed_descriptions", f"{_LAST} SELECT id, 'NEW ' || now AS description_raw FROM m WHERE lid % 3 = 0 UNION ALL SELECT id, now FROM m WHERE lid % 3 <> 0 AND now <> old")
def _(g):
    return replay.descriptions(_rows(g), _reread(g)).select("id", "description_raw")


@query("replayed_flags", f"{_LAST} SELECT id, lid % 6 = 0 AS amount_ambiguous FROM m WHERE (lid % 6 = 0) <> (id % 9 = 0)")
def _(g):
    return replay.flags(_rows(g), _reread(g)).select("id", "amount_ambiguous")


@query("replayed_foreign", f"{_LAST} SELECT id, CAST(amount_minor * 6 AS BIGINT) AS amount_minor, 'HKD' AS currency, '0.1655' AS fx_rate FROM m WHERE lid % 20 = 0 AND account_id <> 5")
def _(g):
    return replay.foreign(_rows(g), _reread(g)).select("id", "amount_minor", "currency", "fx_rate")


@query("replayed_periods", " SELECT id, CAST(statement_date - INTERVAL 30 DAY AS DATE) AS period_start, statement_date AS period_end FROM statement WHERE (period_start IS NULL OR period_end IS NULL) AND id % 2 = 0")
def _(g):
    s = g.statement
    return replay.periods(s, s.select("id", F.when(F.col("id") % 2 == 0, F.date_sub("statement_date", 30)).alias("period_start"), F.when(F.col("id") % 2 == 0, F.col("statement_date")).alias("period_end"), "statement_date")).select("id", "period_start", "period_end")


@query("fx_less_statements", f"{_ASSIGNED} SELECT DISTINCT statement_id AS id FROM asg WHERE account_id = 5 AND id % 50 = 0")
def _(g):
    return replay.without_rate(g.statement, _rows(g)).select("id")


@query("redacted_rows", f"SELECT doc_id FROM documents WHERE regexp_matches(chr(1) || regexp_replace(text, '([^0-9])', chr(1) || '\\1' || chr(1), 'g') || chr(1), '{_MARKED}')", ledger=False)
def _(g):
    return replay.redacted(g.table("documents").where("doc_id IS NOT NULL"), "doc_id", ["text"]).select("doc_id")


@query("renormalized_rows", " SELECT id FROM txn WHERE id % 5 = 0")
def _(g):
    from ledgerstone.functions.merchants import normalize

    stale = F.when(F.col("id") % 5 == 0, F.lit("stale key")).otherwise(normalize("description_raw"))
    return replay.renormalized(g.txn.withColumn("merchant_normalized", stale)).select("id")


# ---- lists in order


@query("statement_rows", f"{_ASSIGNED} SELECT id, statement_id, CAST(ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY txn_date, id) AS INTEGER) AS place FROM asg")
def _(g):
    return listing.statement_rows(_rows(g)).select("id", "statement_id", "place")


@query("page_rows", f"{_ASSIGNED}, p AS (SELECT id, statement_id, CAST(id % 3 + 1 AS INTEGER) AS source_page FROM asg), q AS (SELECT *, MAX(source_page) OVER (PARTITION BY statement_id) AS m FROM p) SELECT id, statement_id, source_page FROM q WHERE source_page = m")
def _(g):
    return listing.statement_rows(_rows(g), source_page=9).select("id", "statement_id", "source_page")


@query("memory_list", " SELECT merchant_normalized, len(merchant_normalized) % 3 AS hit_count, CAST(ROW_NUMBER() OVER (ORDER BY len(merchant_normalized) % 3 DESC, source, merchant_normalized) AS BIGINT) AS position FROM merchant_memory")
def _(g):
    return listing.memory_list(g.memory.withColumn("hit_count", (F.length("merchant_normalized") % 3).cast("long"))).select("merchant_normalized", "hit_count", "position")


@query("merchant_page", f""", {_MERCHANT}, r AS (SELECT merchant_normalized, split_part(merchant_normalized, ' ', 1) AS root, abs(value_minor) AS weight FROM m), t AS (SELECT *, SUM(weight) OVER (PARTITION BY root) AS total FROM r),
  o AS (SELECT merchant_normalized, CAST(ROW_NUMBER() OVER (ORDER BY total DESC, root, weight DESC, merchant_normalized) AS BIGINT) AS position FROM t) SELECT *, 7 AS page FROM o WHERE position BETWEEN 61 AND 70""")
def _(g):
    m = listing.cluster_order(listing.merchant_summary(g.lines, g.memory)).select("merchant_normalized", "position")
    return listing.page_of(m, 99, 10).select("merchant_normalized", "position", "page")


@query("undecided", f", {_MERCHANT} SELECT COUNT(*) FILTER (unknown > 0) AS merchants, CAST(COALESCE(SUM(value_minor) FILTER (unknown > 0), 0) AS BIGINT) AS value_minor, (SELECT COUNT(*) FROM merchant_group) AS grouped_keys FROM m")
def _(g):
    return listing.undecided(listing.merchant_summary(g.lines, g.memory), g.groups)


@query("group_order", f""", e AS (SELECT group_name, CAST(COALESCE(SUM({NET}), 0) AS BIGINT) AS v FROM merchant_group LEFT JOIN txn_lines USING (merchant_normalized) GROUP BY 1) SELECT group_name, v, CAST(ROW_NUMBER() OVER (ORDER BY abs(v) DESC, group_name) AS BIGINT) AS position FROM e""")
def _(g):
    from ledgerstone.sources.shared import positions

    return positions(listing.group_list(g.groups, g.lines), F.desc(F.abs("v")), "group_name").select("group_name", "v", "position")


@query("suggestion_prices", f""", k AS (SELECT DISTINCT merchant_normalized AS k, split_part(merchant_normalized, ' ', 1) || ' ' || split_part(merchant_normalized, ' ', 2) AS two, split_part(merchant_normalized, ' ', 1) AS one FROM txn_lines WHERE merchant_normalized <> ''),
  b AS (SELECT k || ' #' || CAST(n AS VARCHAR) AS k, k AS prefix FROM (SELECT DISTINCT k FROM k) CROSS JOIN (SELECT unnest([1, 2]) AS n)),
  s AS (SELECT b.prefix, CAST(SUM({NET}) AS BIGINT) AS v, COUNT(*) AS rows_total FROM b JOIN txn_lines t ON t.merchant_normalized || ' #' || CAST(t.account_id % 2 + 1 AS VARCHAR) = b.k GROUP BY 1)
  SELECT prefix, rows_total, v, CAST(ROW_NUMBER() OVER (ORDER BY abs(v) DESC, prefix) AS BIGINT) AS place FROM s""")
def _(g):
    t = g.lines.withColumn("merchant_normalized", F.concat("merchant_normalized", F.lit(" #"), (F.col("account_id") % 2 + 1).cast("string")))
    keys = g.lines.select("merchant_normalized").distinct().withColumn("n", F.explode(F.array(F.lit("1"), F.lit("2")))).select(F.concat_ws(" #", "merchant_normalized", "n").alias("merchant_normalized"))
    return grouping.priced(grouping.suggest(keys), t).select("prefix", "rows_total", "v", "place")


@query("card_order", f" SELECT id AS account_id, {_CARD} AS card_name, CAST(ROW_NUMBER() OVER (ORDER BY issuer, last4 NULLS FIRST, id) AS BIGINT) AS position FROM account")
def _(g):
    from ledgerstone.sources.shared import positions

    cards = listing.card_list(g.account, g.statement, g.txn, g.lineage).join(g.account.select(F.col("id").alias("account_id"), "issuer", "last4"), "account_id")
    return positions(cards, "issuer", F.asc_nulls_first("last4"), "account_id").select("account_id", "card_name", "position")


@query("merchant_root", " SELECT DISTINCT merchant_normalized, split_part(merchant_normalized, ' ', 1) AS root FROM txn_lines")
def _(g):
    return g.lines.select("merchant_normalized").distinct().withColumn("root", merchant_root("merchant_normalized"))


# ---- lineages and whole reports

_CHAIN = 100


@query("lineage_chain", f"""WITH RECURSIVE a AS (SELECT range AS id, CASE WHEN range < {_CHAIN} THEN range + 1 END AS by FROM range(1, {_CHAIN + 1}) UNION ALL SELECT * FROM (VALUES (201, 202), (202, 203), (203, 201), (204, 201), (205, 999), (206, 206))),
  w AS (SELECT id, id AS top, [id] AS seen FROM a UNION ALL SELECT w.id, a.by, list_append(w.seen, a.by) FROM w JOIN a ON a.id = w.top JOIN a n ON n.id = a.by WHERE NOT list_contains(w.seen, a.by))
  SELECT CAST(id AS BIGINT) AS id, CAST(MAX_BY(top, len(seen)) AS BIGINT) AS head_id FROM w GROUP BY id""", ledger=False)
def _(g):
    rows = [(i, i + 1 if i < _CHAIN else None) for i in range(1, _CHAIN + 1)] + [(201, 202), (202, 203), (203, 201), (204, 201), (205, 999), (206, 206)]
    return lineage.heads(g.spark.createDataFrame(rows, "id long, replaced_by_id long")).select("id", F.col("head").alias("head_id"))


@query("card_options", """, h AS (SELECT * FROM account WHERE replaced_by_id IS NULL) SELECT a.id AS account_id, h.id AS by_id FROM account a JOIN h ON h.issuer = a.issuer AND h.id <> a.id""")
def _(g):
    return lineage.card_options(g.account).select("account_id", "by_id")


@query("month_detail", f""", {LINEAGE}, t AS (SELECT * FROM txn_lines WHERE strftime(txn_date, '%Y-%m') = '{MONTH}'),
  co AS (SELECT COALESCE(g.group_name, t.merchant_normalized) AS label, COUNT(*) AS n, SUM({NET}) AS v FROM t LEFT JOIN merchant_group g ON g.merchant_normalized = t.merchant_normalized GROUP BY 1 HAVING SUM({NET}) > 0 ORDER BY v DESC, label LIMIT 12),
  p AS (SELECT 'category' AS part, COALESCE(category, '(uncategorized)') AS label, COUNT(*) AS n, SUM({NET}) AS v FROM t GROUP BY 2 UNION ALL SELECT 'card', label, COUNT(*), SUM({NET}) FROM t JOIN lab ON lab.account_id = t.account_id GROUP BY 2
    UNION ALL SELECT 'company', label, n, v FROM co UNION ALL SELECT 'held out', flow_type, COUNT(*), SUM(amount_minor) FROM t WHERE flow_type <> 'spend' GROUP BY 2)
  SELECT part, label, n, CAST(v AS BIGINT) AS v, CASE WHEN MAX(v) OVER (PARTITION BY part) > 0 THEN CAST(round_even(100 * CAST(v AS DOUBLE) / MAX(v) OVER (PARTITION BY part), 0) AS BIGINT) END AS width FROM p""")
def _(g):
    return reports.month_detail(g.lines, g.lineage, g.groups, MONTH)


_FULL = f", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT}, {_COMPLETE}"


@query("analytics_report", f"""{_FULL}, k AS (SELECT COUNT(*) AS c FROM full_m), t AS (SELECT txn.*, strftime(txn_date, '%Y-%m') AS month FROM txn WHERE strftime(txn_date, '%Y-%m') IN (SELECT month FROM full_m)),
  p AS (SELECT 'by_category' AS part, COALESCE(category, '(uncategorized)') AS label, COUNT(*) AS n, SUM({NET}) AS total FROM t GROUP BY 2 UNION ALL SELECT 'by_card', label, COUNT(*), SUM({NET}) FROM t JOIN lab ON lab.account_id = t.account_id GROUP BY 2
    UNION ALL (SELECT 'by_company', merchant_normalized, COUNT(*), SUM({NET}) FROM t GROUP BY 2 ORDER BY SUM({NET}) DESC, 2 LIMIT 12) UNION ALL SELECT 'held_out', flow_type, COUNT(*), SUM(amount_minor) FROM t WHERE flow_type <> 'spend' GROUP BY 2)
  SELECT part, label, n, CAST(total AS BIGINT) AS total, CAST(round_even(CAST(total AS DOUBLE) / c, 0) AS BIGINT) AS avg FROM p, k""")
def _(g):
    got = reports.analytics(g.report(), g.txn, g.lineage, g.groups)
    rows = None
    for part in ("by_category", "by_card", "by_company", "held_out"):
        one = got[part].select(F.lit(part).alias("part"), "label", "n", "total", "avg")
        rows = one if rows is None else rows.unionAll(one)
    return rows


@query("series_extremes", f""", s AS (SELECT strftime(txn_date, '%Y-%m') AS month, CAST(SUM({NET}) AS BIGINT) AS v FROM txn GROUP BY 1) SELECT COUNT(*) AS n, CAST(round_even(CAST(SUM(v) AS DOUBLE) / COUNT(*), 0) AS BIGINT) AS average,
  MAX(v) AS highest, (SELECT month FROM s ORDER BY v DESC, month LIMIT 1) AS highest_month, MIN(v) AS lowest, (SELECT month FROM s ORDER BY v, month LIMIT 1) AS lowest_month FROM s""")
def _(g):
    return reports.extremes(reports.month_totals(g.txn))


@query("year_runs", f"""{_FULL}, y AS (SELECT month[1:4] AS year, month, spend AS v, CAST(month[1:4] AS INTEGER) * 12 + CAST(month[6:7] AS INTEGER) AS i FROM full_m), r AS (SELECT *, dense_rank() OVER (ORDER BY year DESC) AS back FROM y), d AS (SELECT * FROM r WHERE back <= 3),
  j AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY year ORDER BY month) AS island FROM d) SELECT year, MIN(month) AS run, string_agg(month || ':' || CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY month) AS points FROM j WHERE (SELECT COUNT(DISTINCT year) FROM d) >= 2 GROUP BY year, island""")
def _(g):
    from ledgerstone.plans.catalog import _complete

    return reports.year_runs(_complete(g))


@query("top_pivot", f""", p AS (SELECT merchant_normalized AS label, SUM({NET}) AS total, COUNT(*) AS n FROM txn_lines WHERE strftime(txn_date, '%Y-%m') IN ('1998-03', '1998-04', '1998-05') GROUP BY 1) SELECT label, CAST(total AS BIGINT) AS total, n FROM p ORDER BY p.total DESC, label LIMIT 12""")
def _(g):
    return reports.top_rows(reports.pivot(g.lines, F.col("merchant_normalized"), ["1998-03", "1998-04", "1998-05"])).select("label", "total", "n")


@query("months_by_year", " SELECT strftime(txn_date, '%Y') AS year, string_agg(DISTINCT strftime(txn_date, '%Y-%m'), ',' ORDER BY strftime(txn_date, '%Y-%m')) AS months FROM txn GROUP BY 1")
def _(g):
    return display.months_by_year(g.txn.select(reports.month_key().alias("month")))


@query("report_order", f", {LINEAGE}, {WINDOWS}, {COVER}, {REPORT} SELECT month, CAST(ROW_NUMBER() OVER (ORDER BY month DESC) AS BIGINT) AS position FROM rep")
def _(g):
    from ledgerstone.sources.shared import positions

    return positions(g.report().select("month"), F.desc("month"))
