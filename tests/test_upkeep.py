import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerstone.functions.patterns import safe_pattern
from ledgerstone.functions.textlines import redact
from ledgerstone.operators import classify, gate, lineage, listing, replay, reports
from ledgerstone.plans import catalog
from ledgerstone.sources import documents, ingest, seeds

REFUSED = ["((a+))+$", "(a|a)*b", "(a|aa)+$", "(a*)*", "(b(a?)?)*c", "(a{2,5})+x", "(a|b|ab)*c", "(.*a){20}", r"(?=a)b", r"(a)\1", "(", "(?i:a)", "a.*b.*c.*d.*e"]
TAKEN = ["(ab+c)+", "^old (rod|ring)$", "grab.*food", r"\bshell\b", r"(\d+,)+\d+", "(foo|bar)+", "[^a-c]+x?", "é+", r"a{2,5}\.", "a#b-c"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_without_a_bound_are_refused(pattern):
    assert safe_pattern(pattern) is None
    assert classify.rule_refusal(pattern, "regex", "Dining", None)


@pytest.mark.parametrize("pattern", TAKEN)
def test_other_patterns_mean_the_same_on_the_jvm(spark, pattern):
    safe = safe_pattern(pattern)
    texts = ["abc", "abbcabc", "old rod", "old ring", "grab a food", "shell", "xshell", "1,22,3", "foobarfoo", "dx", "aé", "aaa.", "a#b-c", "", "éé", "abd"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(safe).alias("hit")).collect()
    assert [r.hit for r in got] == [bool(re.search(pattern, r.t)) for r in got]


def test_hostile_texts_end_soon(spark):
    texts = spark.createDataFrame([("a" * 60 + "!",), ("1,2" * 40,), ("abc" * 40,)], "t string").cache()
    texts.count()
    began = time.time()
    for p in TAKEN:
        texts.where(F.col("t").rlike(safe_pattern(p))).count()
    assert time.time() - began < 10


def test_card_numbers_are_masked_where_they_stand(spark):
    text = "card 4111111111111111 ref 99941111111111111119999, 4111-1111 1111 1111"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(redact("t").alias("m")).collect()
    assert [r.m for r in got] == ["card ************1111 ref 99941111111111111119999, ************1111", None, ""]
    again = spark.createDataFrame([(got[0].m,)], "t string").select(redact("t").alias("m")).first().m
    assert again == got[0].m


def test_windows_code_page(spark):
    rows = [(b"\x80 \x93q\x94 caf\xe9",), (b"a\x81b",), ("﻿é".encode(),), (None,)]
    got = spark.createDataFrame(rows, "b binary").select(documents.decode_text(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == ["€ “q” café", "a�b", "é", None]


def test_files_are_refused_with_a_reason(spark, tmp_path):
    for name, data in (("a.pdf", b"x"), ("b.txt", b"x"), ("c.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.filename: r.refusal for r in documents.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.pdf"] is None
    assert got["b.txt"] == "only .pdf files are read"
    assert got.get("c.pdf", "the file is empty") == "the file is empty"


def test_page_texts(spark):
    def extract(data, password):
        if data == b"locked" and password != "s3":
            raise PermissionError
        if data == b"bad":
            raise ValueError
        return data.decode().split("\f")

    files = spark.createDataFrame([("1", b"x\fy"), ("2", b"locked"), ("3", b"bad")], "filename string, content binary")
    read = lambda *p: {r.filename: (r.pages, r.error) for r in ingest.page_texts(files, extract, p).collect()}
    assert read() == {"1": (["x", "y"], None), "2": (None, "the file needs a password"), "3": (None, "damaged file: ValueError")}
    assert read("no")["2"] == (None, "the password does not open this file")
    assert read("no", "s3")["2"] == (["locked"], None)


def test_ingest_twice_stores_once(spark):
    from tests.test_statements import PAGE

    accounts = spark.createDataFrame([], "id long, issuer string, kind string, last4 string, nickname string, currency string, replaced_by_id long")
    files = spark.createDataFrame([("m.pdf", 10, "h1", [PAGE], None), ("n.pdf", 10, "h1", [PAGE], None), ("o.pdf", 0, "h2", [PAGE], None)], "filename string, length long, sha256 string, pages array<string>, error string")
    got = ingest.ingest(files, accounts, files.where("false").select("sha256"))
    assert sorted((r.filename, r.kind) for r in got["outcomes"].collect()) == [("m.pdf", "stored"), ("n.pdf", "duplicate"), ("o.pdf", "failed")]
    assert [(r.id, r.issuer, r.last4) for r in got["accounts"].collect()] == [(1, "Meridian Bank", "4821")]
    rows = sorted((r.txn_date.day, r.amount_minor, r.currency, r.amount_sgd_minor, r.fx_rate) for r in got["txns"].collect())
    assert (18, 10267, "HKD", 1699, "0.1655") in rows
    assert len(rows) == 5
    again = ingest.ingest(files, got["accounts"], got["statements"].select("sha256"))
    assert again["txns"].count() == 0
    assert replay.renormalized(got["txns"]).count() == 0


def test_replay_is_idempotent(spark, sf):
    from ledgerstone.plans import upkeep

    g = catalog.Ledger(spark, sf)
    stored, reread = upkeep._rows(g), upkeep._reread(g)
    new = replay.descriptions(stored, reread)
    assert new.count() > 0
    assert replay.descriptions(documents.upsert(stored, new, "id"), reread).count() == 0


def test_delete_all(spark):
    s, t = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, statement_id long")
    assert [x.count() for x in ingest.delete_statements(s, t, None)] == [0, 1]
    assert [x.count() for x in ingest.delete_statements(s, t, [1, 9])] == [1, 2]
    assert ingest.delete_rows(s, "id", None).count() == 2


def test_filters():
    assert listing.bad_filters("2026-13", "Snacks", "gift", "size") == ["month", "category", "flow", "order"]
    assert listing.bad_filters(["2026-01", "2026-12"], "(uncategorized)", "spend", "card") == []


def test_fallback_model_and_quota(spark):
    payload = spark.createDataFrame([(i, [f"k{i}"], f"k{i}") for i in range(5)], "batch int, asked array<string>, payload string").coalesce(1)

    def first(p):
        if p == "k1":
            raise OSError
        if p == "k3":
            raise gate.QuotaSpent
        return "first"

    def second(p):
        if p == "k4":
            raise gate.QuotaSpent
        return "second"

    got = {r.batch: (r.raw, r.model, r.stopped) for r in gate.ask(payload, first, second).collect()}
    assert got == {0: ("first", 0, False), 1: ("second", 1, False), 2: ("first", 0, False), 3: ("second", 1, False), 4: (None, None, False)}


def test_taken_keys_are_left_out_of_suggestions(spark):
    from ledgerstone.operators.grouping import suggest

    keys = spark.createDataFrame([("acme #1",), ("acme #2",), ("acme north hall",), ("zen bar",), ("zen bar 2",)], "merchant_normalized string")
    taken = spark.createDataFrame([("acme #1",)], "merchant_normalized string")
    assert {r.prefix for r in suggest(keys, taken).collect()} == {"zen bar"}


def test_generator_overlaps(spark):
    few, many = (sorted(tuple(r) for r in seeds.generate_rows(spark, 7, n).collect()) for n in (5, 9))
    assert few == [r for r in many if r[0] < 5]


def test_extremes_of_nothing(spark):
    r = reports.extremes(spark.createDataFrame([], "month string, spend_minor long")).first()
    assert (r.n, r.average, r.highest, r.highest_month) == (0, None, None, None)


def test_heads_stop_at_cycles(spark):
    rng = random.Random(9)
    graphs = [[(1, 2), (2, 3), (3, 1), (4, 4), (5, 99), (6, 1)], [(i, i + 1) for i in range(1, 40)] + [(40, None)], [(1, None), (2, None)]]
    graphs += [[(i, rng.choice([None, i, 77, *range(1, 25)])) for i in range(1, 25)] for _ in range(3)]
    for rows in graphs:
        to, want = dict(rows), {}
        for i in to:
            seen = [i]
            while to[seen[-1]] in to and to[seen[-1]] not in seen:
                seen.append(to[seen[-1]])
            want[i] = seen[-1]
        assert {r.id: r.head for r in lineage.heads(spark.createDataFrame(rows, "id long, replaced_by_id long")).collect()} == want


def test_scanned_pages_strip_all_white_space(spark):
    text = "a" * 99
    pages = [None, "", text, text + "b", *[c + text + c for c in documents.WHITE], *[c + text + "b" + c for c in documents.WHITE], "​" + text, text[:50] + " " * 40 + text[:20]]
    got = spark.createDataFrame(list(enumerate(pages)), "k int, t string").select("k", documents.looks_scanned(F.col("t")).alias("scanned")).collect()
    assert {r.k: r.scanned for r in got} == {k: len((t or "").strip()) < 100 for k, t in enumerate(pages)}


def test_values_of_no_known_kind_are_no_filter(spark):
    rows = [(1, "2026-01-05", "Dining", "spend"), (2, "2026-02-05", None, "fee"), (3, "2026-02-06", "Travel", "refund")]
    t = spark.createDataFrame(rows, "id long, d string, category string, flow_type string").withColumn("txn_date", F.col("d").cast("date"))
    ids = lambda **given: sorted(r.id for r in listing.txn_slice(t, **given).select("id").collect())
    assert ids(month="soon", category="Snacks", flow="gift") == ids(month=["", None], category="") == [1, 2, 3]
    assert ids(month=["2026-02", "x"]) == [2, 3] and ids(month="2026-13") == [] and ids(month=["2026-13", "2026-01"]) == [1]
    assert ids(category="(uncategorized)") == [2] and ids(category="Travel", flow="gift") == [3] and ids(flow="fee") == [2]
