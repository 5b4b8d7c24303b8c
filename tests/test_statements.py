import datetime as dt
import time
from decimal import Decimal as M

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import issuers
from ledgerstone.operators import statements as S
from ledgerstone.sources import documents as D

PAGE = """Meridian Bank                      Card number **** **** **** 4821
Statement period 15 MAY 2026 to 14 JUN 2026                 SGD
PREVIOUS BALANCE  1,204.55
DATE  DESCRIPTION  AMOUNT
16 MAY 17 MAY SHENG SIONG 45.20
BOOKSHOP HONG KONG
18 MAY 19 MAY 102.67 HKD 16.99
Foreign currency rate 1 HKD = 0.1655 SGD
20 MAY 21 MAY PAYMENT - THANK YOU 1,204.55 CR
22 MAY 23 MAY GRAB 10.00 110.00
25 MAY 26 MAY FAIRPRICE 8.10
Ref No: AB123456
Total purchases 180.29
Total payments 1,204.55
NEW BALANCE 180.29
"""


def test_page():
    c, r = S.read_statement([PAGE])
    assert (c.start, c.end) == (dt.date(2026, 5, 15), dt.date(2026, 6, 14))
    assert (r.last4, r.currency) == ("4821", "SGD")
    assert r.figures == {"opening_balance": M("1204.55"), "closing_balance": M("180.29"), "total_debits": M("180.29"), "total_credits": M("1204.55")}
    rows = [(x["txn_date"].day, x["description"], x["amount"], x["direction"], x["ambiguous"]) for x in r.rows]
    assert rows == [(16, "SHENG SIONG", M("45.20"), "debit", False), (18, "BOOKSHOP HONG KONG", M("16.99"), "debit", False), (20, "PAYMENT - THANK YOU", M("1204.55"), "credit", False), (22, "GRAB 10.00", M("110.00"), "debit", True), (25, "FAIRPRICE", M("8.10"), "debit", False)]
    assert (r.rows[1]["foreign_amount"], r.rows[1]["foreign_currency"], r.rows[1]["fx_rate"]) == (M("102.67"), "HKD", "0.1655")
    assert r.rows[4]["reference"] == "AB123456"


def test_summary_grid():
    f = dict.fromkeys(("opening_balance", "closing_balance", "total_debits", "total_credits"))
    S.read_grid(["Previous Balance  -  Payments  +  Purchases  =  Total Outstanding", "1,000.00  -  1,000.00  +  250.00  =  250.00"], f)
    assert (f["opening_balance"], f["closing_balance"]) == (M("1000.00"), M("250.00"))
    f = dict.fromkeys(f)
    S.read_grid(["Previous  New", "Balance  Balance", "1.00  2.00"], f)
    assert f["opening_balance"] is None


def test_date_grid():
    assert S.date_grid(["Statement Date   Payment Due Date", "14 Jun 2026      09 Jul 2026"]) == dt.date(2026, 6, 14)
    assert S.date_grid(["Statement Date", "14 Jun 2026  09 Jul 2026"]) is None


def test_wrapped_period():
    assert S.wrapped_period("Statement Cycle\n15 Dec 2025 - 14 Jan") == (dt.date(2025, 12, 15), dt.date(2026, 1, 14))
    assert S.wrapped_period("15 Dec 2025 - 14 Jan") == (None, None)


@pytest.mark.parametrize(("c", "want"), [(S.Context(dt.date(2025, 12, 15), dt.date(2026, 1, 14)), 2025), (S.Context(closing=dt.date(2026, 1, 14)), 2025), (S.Context(year=2026), 2026)])
def test_year(c, want):
    assert c.year_of(20, 12) == want


def test_card_sections():
    page = "x" * 100 + "\nPREVIOUS BALANCE 10.00\nTOTAL BALANCE FOR A 3.47 CR\nPREVIOUS BALANCE 603.54\nTOTAL BALANCE FOR B 939.22\n"
    _, r = S.read_statement([page])
    assert (r.figures["opening_balance"], r.figures["closing_balance"]) == (M("613.54"), M("935.75"))


CASES = [
    ((M("10.00"), None, None, None), "pass", "matches printed totals"), ((M("11.00"), None, None, None), "fail", "debits off by 1.00"), ((M("10.00"), M("9.00"), M("0.00"), M("6.00")), "fail", "credits off by 5.00"),
    ((None, None, M("0.00"), M("6.00")), "pass", "balance rolls forward (card convention)"), ((None, None, M("10.00"), M("4.00")), "pass", "balance rolls forward (deposit convention)"), ((None, None, M("1.00"), M("100.00")), "fail", "balance off by 93.00"), ((None, None, M("1.00"), None), "unverified", "statement prints no totals or balances to check against"),
]


@pytest.mark.parametrize(("figures", "verdict", "detail"), CASES)
def test_reconcile(spark, figures, verdict, detail):
    row = dict.fromkeys("txn_date posted_date description amount direction reference foreign_amount foreign_currency fx_rate ambiguous source_page".split())
    rows = [{**row, "amount": M("10.00"), "direction": "debit"}, {**row, "amount": M("4.00"), "direction": "credit"}]
    td, tc, ob, cb = figures
    df = spark.createDataFrame([(1, None, None, None, None, None, ob, cb, td, tc, 0, 0, 2, 1, 0, rows)], S.OUT)
    r = S.reconcile(df).first()
    assert (r.verdict, r.detail) == (verdict, detail)


def test_warnings(spark):
    docs = spark.createDataFrame([(1, [PAGE, "scan"]), (2, []), (3, None)], "id long, pages array<string>")
    w = {r.id: r.warnings for r in S.warnings(S.parse_statements(docs)).collect()}
    assert w[1] == ["1 row(s) carried more than one amount — a running-balance column may have been read as the transaction amount", "1/2 page(s) have no text layer — skipped (a scan needs OCR before this can read it)"]
    assert w[2] == w[3] == ["no transactions found"]


def test_warnings_of_a_long_statement(spark):
    """Identical rows are counted without comparing every pair; references that are null are alike."""
    row = F.expr("named_struct('txn_date', date'2026-05-16', 'posted_date', CAST(NULL AS DATE), 'description', concat('SHOP ', n % 79998), 'amount', CAST(1 AS DECIMAL(18,2)), 'direction', 'debit', 'reference', CAST(if(n % 2 = 0, 'AB123456', NULL) AS STRING), 'foreign_amount', CAST(NULL AS DECIMAL(18,2)), 'foreign_currency', CAST(NULL AS STRING), 'fx_rate', CAST(NULL AS STRING), 'ambiguous', false, 'source_page', 1)")
    rows = spark.range(80_000).select(F.col("id").alias("n")).select(row.alias("r")).agg(F.collect_list("r").alias("rows"))
    nothing = dict.fromkeys("period_start period_end statement_date last4 currency opening_balance closing_balance total_debits total_credits".split())
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], S.OUT).schema}
    given = nothing | {"id": 1, "sections": 0, "section_openings": 0, "rows_expected": 80_000, "page_count": 1, "scanned_pages": 0}
    parsed = rows.select(*[F.lit(given[c]).cast(t).alias(c) if c in given else F.col(c) for c, t in kinds.items()])
    began = time.time()
    assert S.warnings(parsed).first().warnings == ["2 identical row(s) — genuine repeats, or a page read twice"]
    assert time.time() - began < 20  # a pairwise comparison of 80,000 rows takes minutes


def test_issuer_reads_the_lines_once(spark):
    d = spark.createDataFrame([(1, ["16 MAY DBS 1.00\nUOB\nUOB\nDBS Bank Ltd", "x"], "a_b.pdf"), (2, ["x", "Meridian", "Bank"], "a.pdf"), (3, None, "my-bank.pdf"), (4, [], "b.pdf")], "id long, pages array<string>, filename string")
    got = issuers.detect(d)
    assert {r.id: r.issuer for r in got.collect()} == {1: "DBS", 2: "Meridian Bank", 3: "My Bank", 4: "B"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4


def test_pages_of_a_long_statement(spark):
    """Statements of one card are read from their transactions: pages in order, balances carried forward, no window over their lines."""
    t = spark.range(25_000).selectExpr("id", "1L AS account_id", "id % 5 AS statement_id", "date_add(date'2026-01-01', CAST(id % 5 * 30 + id / 5 % 28 AS INT)) AS txn_date", "concat('SHOP ', id) AS description_raw", "id % 100 + 1 AS amount_minor", "if(id % 3 = 0, 'credit', 'debit') AS direction")
    s = spark.range(5).selectExpr("id", "1L AS account_id", "date_add(date'2026-01-01', CAST(id * 30 + 29 AS INT)) AS statement_date")
    a = spark.createDataFrame([(1, "North Bank", "1111")], "id long, issuer string, last4 string")
    docs = D.generate_statements(t, s, a, per_page=20)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window" in x and ("rows#" in x or "bodies#" in x)]
    assert "filter(rows" not in plan
    got = {r.id: r.pages for r in docs.collect()}
    balance = 0
    for i in range(5):
        mine = sorted((x for x in t.where(F.col("statement_id") == i).collect()), key=lambda x: (x.txn_date, x.id))
        assert len(got[i]) == 250
        named = [[line.split("  ")[2] for line in p.splitlines() if "SHOP" in line] for p in got[i]]
        assert named == [[x.description_raw for x in mine[k : k + 20]] for k in range(0, 5000, 20)]
        assert f"PREVIOUS BALANCE  {abs(balance) / 100:,.2f}" in got[i][0]
        balance += sum(x.amount_minor if x.direction == "debit" else -x.amount_minor for x in mine)
        assert f"NEW BALANCE  {abs(balance) / 100:,.2f}" in got[i][-1] and "BALANCE" not in "".join(got[i][1:-1])


def test_batches_are_handed_on(spark):
    """A worker never holds what all documents of an Arrow batch say at once, and no document is lost."""
    page = "x" * 100 + "\nStatement period 15 MAY 2026 to 14 JUN 2026\n" + "16 MAY 17 MAY SHOP 1.00\n" * 2_000
    few = pa.record_batch({"id": pa.array(range(12), pa.int64()), "pages": pa.array([[page]] * 12)})
    many = pa.record_batch({"id": pa.array(range(12, 1_212), pa.int64()), "pages": pa.array([["x", None], None] * 600)})
    got = list(S.read_batches([few, few.slice(0, 0), many]))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(1_212))
    assert max(b.num_rows for b in got) <= S.BATCH_DOCUMENTS
    assert max(sum(map(len, b.column("rows").to_pylist())) for b in got) < S.BATCH_ROWS + 2_000
    assert sum(len(x) for b in got for x in b.column("rows").to_pylist()) == 24_000


def test_documents_of_one_file_are_dealt_out(spark):
    docs = spark.range(200).select("id", F.array(F.lit(PAGE)).alias("pages")).coalesce(1)
    got = S.parse_statements(docs).select("id", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.id for r in got) == list(range(200)) and len({r.part for r in got}) > 4
