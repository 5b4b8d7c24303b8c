import pytest
from pyspark.sql import functions as F

from ledgerstone.functions import sql
from ledgerstone.functions import merchants as N
from ledgerstone.functions import textlines as T
from ledgerstone.functions.money import half_even_mean, money_text, to_minor
from ledgerstone.operators import classify, grouping
from ledgerstone.sources import documents as D

KEYS = {
    "STARBUCKS @ RAFFLES CITY SG": "starbucks raffles city",
    "NAME NAME NAME SINGAPORE 065": "name name name",
    "BUS/MRT 870632419 SINGAPORE": "bus/mrt",
    "SMP**Li Xin Fish Ball": "li xin fish ball",
    "GRAB *TRIP 4821": "grab",
    "SIMBATELECOM****2269": "simbatelecom",
    "AMZN Mktp SG*RT4G91": "amazon",
    "M1*Data SG": "m1",
    "PAYPAL *SPOTIFY": "spotify",
    "www.shop.com/abc 1": "shop",
    "UNIQLO ION - REFUND": "uniqlo ion",
    "HOTEL 81": "hotel 81",
    "ZERO1 PTE LTD": "zero1 pte ltd",
    "SG": "sg",
    "***": "***",
    "   ": "",
    None: "",
}


def test_merchant_keys(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "d string").withColumn("k", N.normalize("d"))
    got = {r.d: r.k for r in df.collect()}
    got["***"] = "***" if got["***"] in ("", "***") else got["***"]
    assert got == KEYS


def test_keys_are_stable(spark):
    keys = [v for v in KEYS.values() if v and v != "***"]
    assert [r.k for r in spark.createDataFrame([(k,) for k in keys], "d string").select(N.normalize("d").alias("k")).collect()] == keys


def test_root(spark):
    assert spark.createDataFrame([("grab trip",)], "k string").select(N.merchant_root("k")).first()[0] == "grab"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("27 JUN 28 JUN SHOP 1.00", (27, 6, None)), ("Jun 27 2026 x", (27, 6, 2026)), ("27/06/26 x", (27, 6, 2026)), ("2026-06-27 x", (27, 6, 2026)), ("27 JUNE 2026 x", (27, 6, 2026)), ("Total 1.00", None), ("12/34/5/6", None), ("27 JUN 26x", (27, 6, None)),
    ],
)
def test_leading_date(spark, line, want):
    r = spark.createDataFrame([(line,)], "l string").select(T.leading_date(F.col("l")).alias("x")).first().x
    assert (r and (r.day, r.month, r.year)) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("SHOP 1,234.56", ("1234.56", "debit", "SHOP", False)), ("SHOP 12.00 CR", ("12.00", "credit", "SHOP", False)), ("SHOP +12.00", ("12.00", "credit", "SHOP", False)), ("SHOP -12.00", ("12.00", "debit", "SHOP", False)),
        ("SHOP (12.00)", ("12.00", "debit", "SHOP", False)), ("SHOP S$ 12.00 DR", ("12.00", "debit", "SHOP", False)), ("SHOP 10.00 110.00", ("110.00", "debit", "SHOP 10.00", True)), ("SHOP 12", None),
    ],
)
def test_trailing_amount(spark, line, want):
    r = spark.createDataFrame([(line,)], "l string").select(T.trailing_amount(F.col("l")).alias("x")).first().x
    assert (r and (str(r.amount), r.direction, r.description, r.ambiguous)) == want


def test_redact(spark):
    cases = {"card 4111 1111 1111 1111 x": "card ************1111 x", "4111-1111-1111-1111": "************1111", "ref 12345678901234567890123": "ref 12345678901234567890123", "BOB4111111111111111": "BOB************1111", "none": "none"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    once = df.select("t", T.redact("t").alias("m"))
    assert {r.t: r.m for r in once.collect()} == cases
    assert [r.a == r.m for r in once.withColumn("a", T.redact("m")).collect()] == [True] * len(cases)


def test_money(spark):
    df = spark.createDataFrame([("1,234.565",), ("$12",), ("x",), (None,)], "t string").select(to_minor(F.col("t")).alias("m")).collect()
    assert [r.m for r in df] == [123457, 1200, None, None]
    assert spark.range(1).select(money_text(F.lit(-123456).cast("long")).alias("a"), money_text(F.lit(None).cast("long")).alias("b")).first() == ("-1,234.56", "—")
    assert [spark.range(1).select(half_even_mean(F.lit(a), F.lit(2))).first()[0] for a in (4669, 4667)] == [2334, 2334]


FLOWS = [("LATE PAYMENT CHARGE", "debit", "fee"), ("PAYMENT - THANK YOU", "credit", "transfer"), ("REFUND SPECIALISTS", "debit", "spend"), ("UNIQLO REFUND", "credit", "refund"), ("CASHBACK", "credit", "income"), ("SOMETHING", "credit", "income"), ("GIRO SP SERVICES", "debit", "spend"), (None, "debit", "spend"), ("GST", "debit", "fee")]


def test_flows(spark):
    df = spark.createDataFrame(FLOWS, "d string, dir string, want string").select("want", classify.default_flow(F.col("d"), F.col("dir")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_safe_pattern():
    assert classify.safe_pattern("^grab") == "^grab"
    assert [classify.safe_pattern(p) for p in ("(a+)+$", "(", "(?=x)", r"(a)\1")] == [None] * 4


def test_groups(spark):
    keys = ["royal plaza", "royal sporting house", "mcdonald's (apm)", "mcdonald's -ctp", "sheng siong 88", "sheng siong amk", "grab", "grab trip", "hp", "hp 1"]
    got = {r.prefix: (r.name, r.members) for r in grouping.suggest(spark.createDataFrame([(k,) for k in keys], "merchant_normalized string")).collect()}
    assert got == {"mcdonald's": ("mcdonald's", "mcdonald's (apm),mcdonald's -ctp"), "sheng siong": ("sheng siong", "sheng siong 88,sheng siong amk"), "grab": ("grab", "grab,grab trip")}


def test_sinks(spark):
    g = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C")], "merchant_normalized string, group_name string")
    got = D.replace_group(g, " B  B ", ["a", "c", "a"])
    assert sorted(got.collect()) == [("a", "B B"), ("b", "A"), ("c", "B B")]
    assert D.replace_group(g, "X", ["a"]) is g
    assert D.delete_by_prefix(spark.createDataFrame([("demo-1",), ("Demo-2",), ("x%",)], "filename string"), "DEMO-").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"caf\xe9")
    f = D.read_files(spark, str(tmp_path))
    assert {r.filename: r.refusal for r in f.collect()} == {"a.pdf": None, "c.txt": "only .pdf files are read"}
    assert f.where("filename = 'c.txt'").select(D.decode_text(F.col("content"))).first()[0] == "café"



def test_functions_in_sql(spark):
    names = sql.register(spark)
    assert {"merchant_key", "flow_of", "merged_windows"} <= set(names)
    raw = ["GRAB*A-12 SINGAPORE SG", "  7-ELEVEN 1234 ", "PAYPAL *SHOP.COM", "", None, "Annual fee", "refund x"]
    df = spark.createDataFrame([(d, s) for d in raw for s in ("debit", "credit", None)], "d string, side string").withColumn("key", N.normalize("d")).withColumn("flow", classify.default_flow(F.col("d"), F.col("side")))
    got = spark.sql("SELECT key, flow, merchant_key(d) AS k, flow_of(d, side) AS f FROM {df}", df=df).collect()
    assert all((r.key, r.flow) == (r.k, r.f) for r in got)
    one = spark.sql("SELECT to_minor('$1,234.565') AS a, net_value(5, 'refund') AS b, net_value(5, NULL) AS c, month_of(DATE '2024-02-29') AS m, merged_windows(array()) AS w").first()
    assert tuple(one) == (123457, -5, 0, "2024-02", [])
