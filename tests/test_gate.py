import json

import pytest

from ledgerstone.operators import classify, display, gate, listing


def reply(*pairs):
    return json.dumps({"assignments": [{"merchant": m, "category": c} for m, c in pairs]})


CASES = [
    (reply(("a", "Dining"), ("b", "Travel")), []),
    ("sorry, I can't", ["the response is not JSON"]),
    ("[]", ["no 'assignments' array in the response"]),
    (reply(("a", "Dining"), ("a", "Travel"), ("b", "Dining")), ["1 merchant(s) answered more than once"]),
    (reply(("a", "Dining"), ("c", "Dining")), ["1 merchant(s) invented that were never asked about", "1 merchant(s) dropped from the answer"]),
    (reply(("a", "Dining"), ("b", "Snacks")), ["category value(s) outside the fixed set: Snacks"]),
    ('{"assignments": [{"merchant": "a"}, {"merchant": "b", "category": "Dining"}]}', ["1 entr(ies) missing merchant or category", "1 merchant(s) dropped from the answer"]),
]


@pytest.mark.parametrize(("raw", "problems"), CASES)
def test_gate(spark, raw, problems):
    r = gate.gate(spark.createDataFrame([(["a", "b"], raw)], "asked array<string>, raw string")).first()
    assert (r.ok, r.problems) == (not problems, problems)


def test_ask_goes_on_after_a_failure(spark):
    keys = spark.createDataFrame([(f"k{i:03}",) for i in range(90)], "merchant_normalized string")

    def model(payload):
        names = payload.split("\n")
        if "k000" in names:
            raise OSError("quota")
        return json.dumps({"assignments": [{"merchant": n, "category": "Dining"} for n in names]})

    gated = gate.gate(gate.ask(gate.payloads(gate.batches(keys)), model))
    assert {r.batch: r.ok for r in gated.collect()} == {0: False, 1: True, 2: True}
    assert gate.accepted(gated).count() == 50


def test_pages(spark):
    rows = [(i, "2026-01-01", 100, "spend") for i in range(250)] + [(250, "2026-01-02", 100, "refund")]
    t = spark.createDataFrame(rows, "id long, txn_date string, amount_minor long, flow_type string").selectExpr("id", "CAST(txn_date AS DATE) AS txn_date", "amount_minor", "flow_type")
    pages = [listing.page(t, k).collect() for k in (1, 2, 3)]
    assert [len(p) for p in pages] == [100, 100, 51]
    assert {(p.total, p.shown_minor, p.pages) for p in pages[0]} == {(251, 24900, 3)}
    assert [r.id for p in pages for r in p] == [250, *range(249, -1, -1)]
    assert listing.page(t, 99).first().page == 3
    assert listing.page(t, -1).first().page == 1


def test_rules(spark):
    rules = spark.createDataFrame([], "id long, pattern string, match_type string, category string, flow_type string, priority int")
    assert classify.add_rule(rules, "grab", "contains", "Transport").count() == 1
    for bad in (("", "contains", "Dining", None), ("x", "like", "Dining", None), ("x", "exact", None, None), ("x", "exact", "Snacks", None), ("(", "regex", "Dining", None)):
        with pytest.raises(ValueError):
            classify.add_rule(rules, *bad)


def test_run_summary(spark):
    o = spark.createDataFrame([("stored", None), ("failed", "b"), ("failed", "a"), ("failed", "a"), ("duplicate", None)], "kind string, message string")
    assert display.run_summary(o).first() == (1, 1, 3, "a ×2; b")


def test_grade(spark):
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "x")], "k long, label string")
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "Unknown")], "k long, label string")
    assert gate.grade(t, a, "k").first().asDict() == {"correct": 1, "wrong": 1, "abstained": 1, "missing": 2, "total": 5, "baseline": 3}


def test_a_spent_quota_stops_later_waves(spark, tmp_path):
    """Calls are counted in files: after the wave in which a model's quota ends nothing calls it again, in any task."""
    keys = spark.createDataFrame([(f"k{i:04}",) for i in range(40 * 40)], "merchant_normalized string")
    calls, put = str(tmp_path), lambda name, payload: open(f"{name}-{payload.split(chr(10))[0]}", "w").close()  # noqa: SIM115

    def first(payload):
        put(f"{calls}/first", payload)
        if payload.split("\n")[0] >= "k0200":  # from batch 5 on
            raise gate.QuotaSpent
        return "one"

    def second(payload):
        put(f"{calls}/second", payload)
        if payload.split("\n")[0] >= "k0800":  # from batch 20 on
            raise gate.QuotaSpent
        return "two"

    got = {r.batch: r for r in gate.ask_in_waves(gate.payloads(gate.batches(keys)), first, second, wave=8, tasks=4).collect()}
    asked = lambda name: {int(p.name.split("-k")[1]) // 40 for p in tmp_path.iterdir() if p.name.startswith(name)}
    assert sorted(got) == list(range(40))
    assert [got[b].raw for b in range(20)] == ["one"] * 5 + ["two"] * 15
    assert all(got[b].raw is None for b in range(20, 40)) and all(got[b].stopped for b in range(24, 40))
    assert asked("first") <= set(range(8)) and len(asked("first") - set(range(5))) <= 4
    assert asked("second") <= set(range(5, 24)) and len(asked("second") - set(range(20))) <= 4
    empty = gate.payloads(gate.batches(keys.limit(0)))
    assert gate.ask_in_waves(empty, first).collect() == []
