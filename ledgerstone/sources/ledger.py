"""Ledger views over the driver's tables: accounts, transactions, statements and the small user tables.

Orders are transactions with a unique id; line items are transactions with a merchant. Both have the
columns of TXN. Statements are derived from the orders' billing cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.functions.dates import close_on_or_after

TXN = ("id", "account_id", "txn_date", "description_raw", "merchant_normalized", "amount_minor", "direction", "flow_type", "category", "category_source")
#: id, issuer, last4, replaced_by_id, segment, day the cycle closes, whether its statements print a start.
ACCOUNTS = [
    (1, "North Bank", "1111", None, "AUTOMOBILE", 13, True),
    (2, "North Bank", "2222", 1, "BUILDING", 15, True),
    (3, "South Bank", "3333", None, "FURNITURE", 16, True),
    (4, "South Bank", None, None, "HOUSEHOLD", 17, False),
    (5, "East Bank", "5555", None, "MACHINERY", 20, True),
    (6, "East Bank", "6666", 5, None, 20, True),
]
#: Billing cycles for which there is no statement: account and closing month.
MISSING_CYCLES = [(3, "1997-05"), (5, "1999-11"), (5, "1999-12")]
GROUPS = [("red", "Red Holdings"), ("hot", "Hot Company")]
#: key, category, source
MEMORY = [("red widget", "Groceries", "memory"), ("red", "Dining", "seed"), ("hot ring", "Travel", "llm"), ("blue bolt", "Health", "memory"), ("cold", "Shopping", "seed"), ("small gear", "Education", "memory")]
#: id, pattern, match type, category, flow, priority
RULES = [(1, "blue gizmo", "exact", "Entertainment", None, 5), (2, "plate", "contains", "Shopping", "spend", 1), (3, "^old (rod|ring)$", "regex", None, "transfer", 3), (4, "widget brand#1", "contains", "Other", None, 9), (5, "  ", "contains", "Dining", None, 99), (6, "old rod", "exact", "Transport", None, 3)]


def account(spark: SparkSession) -> DataFrame:
    rows = [(i, issuer, "credit", last4, None, "SGD", by) for i, issuer, last4, by, *_ in ACCOUNTS]
    return spark.createDataFrame(rows, "id long, issuer string, kind string, last4 string, nickname string, currency string, replaced_by_id long")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, pairs, other=None) -> Column:
    out = F.lit(other)
    for k, v in reversed(list(pairs)):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order."""
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        _case(F.col("c_mktsegment"), [(a[4], a[0]) for a in ACCOUNTS if a[4]]).cast("long").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.concat(F.lit("ORDER "), priority).alias("description_raw"),
        F.concat(F.lit("shop "), (F.col("o_custkey") % 40).cast("string")).alias("merchant_normalized"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"),
        F.when(status == "P", "credit").otherwise("debit").alias("direction"),
        F.when(status == "P", "refund").otherwise("spend").alias("flow_type"),
        F.when(priority != "4-NOT SPECIFIED", priority).alias("category"),
        F.when(priority == "4-NOT SPECIFIED", None).when(priority == "1-URGENT", "user").when(priority == "2-HIGH", "rule").otherwise("memory").alias("category_source"),
    )


def txn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per line item. Line items have no key; id is their order's."""
    line, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part")
    flag, kind = F.col("l_returnflag"), F.col("p_type")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_suppkey") % 5 + 1).cast("long").alias("account_id"),
        F.col("l_shipdate").cast("date").alias("txn_date"),
        F.concat(F.upper("p_name"), F.lit(" "), F.upper("p_brand")).alias("description_raw"),
        F.col("p_name").alias("merchant_normalized"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount_minor"),
        F.when(flag == "R", "credit").otherwise("debit").alias("direction"),
        F.when(flag == "N", "spend").when(flag == "R", "refund").otherwise("transfer").alias("flow_type"),
        F.when(kind != "ECONOMY", kind).alias("category"),
        F.when(kind == "ECONOMY", None).when(kind == "PROMO", "user").when(kind == "SMALL", "seed").otherwise("memory").alias("category_source"),
    )


def statement(txns: DataFrame) -> DataFrame:
    """One statement per account and billing cycle with transactions: id, account_id, period_start, period_end, statement_date, first_txn."""
    day = _case(F.col("account_id"), [(a[0], a[5]) for a in ACCOUNTS])
    rows = txns.withColumn("cycle", close_on_or_after(F.col("txn_date"), day)).groupBy("account_id", "cycle").agg(F.min("txn_date").alias("first_txn"))
    missing = F.lit(False)
    for a, m in MISSING_CYCLES:
        missing = missing | ((F.col("account_id") == a) & (F.col("cycle") == m))
    end = F.date_add(F.to_date(F.concat("cycle", F.lit("-01"))), day - 1)
    prints = _case(F.col("account_id"), [(a[0], a[6]) for a in ACCOUNTS])
    index = F.substring("cycle", 1, 4).cast("long") * 12 + F.substring("cycle", 6, 2).cast("long")
    return rows.where(~missing).select(
        (F.col("account_id") * 100000 + index).alias("id"),
        "account_id",
        F.when(prints, F.date_add(F.add_months(end, -1), 1)).alias("period_start"),
        F.when(F.col("account_id") == 4, None).otherwise(end).alias("period_end"),
        end.alias("statement_date"),
        "first_txn",
    )


def merchant_group(spark: SparkSession, txns: DataFrame) -> DataFrame:
    """(merchant_normalized, group_name) of the merchants whose first word names a group; one that no transaction has, too."""
    name = _case(F.substring_index("merchant_normalized", " ", 1), GROUPS)
    return txns.select("merchant_normalized").distinct().withColumn("group_name", name).where("group_name IS NOT NULL").unionAll(spark.createDataFrame([("gone shop", "Gone")], "merchant_normalized string, group_name string"))


def merchant_memory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMORY, "merchant_normalized string, category string, source string")


def merchant_rule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "id long, pattern string, match_type string, category string, flow_type string, priority int")


def _values(rows, names: str) -> str:
    sql = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(sql(v) for v in r) + ')' for r in rows)}) AS t({names}))"


#: The same views for DuckDB, as common table expressions.
SQL = f"""
acc AS {_values(ACCOUNTS, "id, issuer, last4, replaced_by_id, segment, day, prints")},
account AS (SELECT CAST(id AS BIGINT) AS id, issuer, last4, CAST(replaced_by_id AS BIGINT) AS replaced_by_id FROM acc),
txn AS (SELECT o_orderkey AS id, CAST(acc.id AS BIGINT) AS account_id, CAST(o_orderdate AS DATE) AS txn_date, 'ORDER ' || o_orderpriority AS description_raw, 'shop ' || CAST(o_custkey % 40 AS VARCHAR) AS merchant_normalized,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, CASE WHEN o_orderstatus = 'P' THEN 'credit' ELSE 'debit' END AS direction, CASE WHEN o_orderstatus = 'P' THEN 'refund' ELSE 'spend' END AS flow_type,
  NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS category,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '1-URGENT' THEN 'user' WHEN '2-HIGH' THEN 'rule' ELSE 'memory' END AS category_source
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN acc ON acc.segment = c_mktsegment),
txn_lines AS (SELECT l_orderkey AS id, CAST(l_suppkey % 5 + 1 AS BIGINT) AS account_id, CAST(l_shipdate AS DATE) AS txn_date, upper(p_name) || ' ' || upper(p_brand) AS description_raw, p_name AS merchant_normalized,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor, CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
  CASE l_returnflag WHEN 'N' THEN 'spend' WHEN 'R' THEN 'refund' ELSE 'transfer' END AS flow_type, NULLIF(p_type, 'ECONOMY') AS category,
  CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'PROMO' THEN 'user' WHEN 'SMALL' THEN 'seed' ELSE 'memory' END AS category_source
  FROM lineitem JOIN part ON l_partkey = p_partkey),
missing_cycle AS {_values(MISSING_CYCLES, "account_id, cycle")},
cyc AS (SELECT t.account_id, acc.day, acc.prints, strftime(CASE WHEN day(t.txn_date) <= acc.day THEN t.txn_date ELSE CAST(date_trunc('month', t.txn_date) + INTERVAL 1 MONTH AS DATE) END, '%Y-%m') AS cycle, MIN(t.txn_date) AS first_txn
  FROM txn t JOIN acc ON acc.id = t.account_id GROUP BY 1, 2, 3, 4),
statement AS (SELECT account_id * 100000 + CAST(cycle[1:4] AS BIGINT) * 12 + CAST(cycle[6:7] AS BIGINT) AS id, account_id,
  CASE WHEN prints THEN CAST(CAST(CAST(cycle || '-01' AS DATE) + INTERVAL (day - 1) DAY AS DATE) - INTERVAL 1 MONTH + INTERVAL 1 DAY AS DATE) END AS period_start,
  CASE WHEN account_id <> 4 THEN CAST(CAST(cycle || '-01' AS DATE) + INTERVAL (day - 1) DAY AS DATE) END AS period_end,
  CAST(CAST(cycle || '-01' AS DATE) + INTERVAL (day - 1) DAY AS DATE) AS statement_date, first_txn
  FROM cyc WHERE NOT EXISTS (SELECT 1 FROM missing_cycle m WHERE m.account_id = cyc.account_id AND m.cycle = cyc.cycle)),
grp AS {_values(GROUPS, "word, group_name")},
merchant_group AS (SELECT DISTINCT merchant_normalized, group_name FROM txn_lines JOIN grp ON split_part(merchant_normalized, ' ', 1) = word UNION ALL SELECT 'gone shop', 'Gone'),
merchant_memory AS {_values(MEMORY, "merchant_normalized, category, source")},
merchant_rule AS {_values(RULES, "id, pattern, match_type, category, flow_type, priority")}
"""
