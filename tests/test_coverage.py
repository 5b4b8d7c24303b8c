import datetime as dt
import random

from ledgerstone.operators import coverage, lineage


def d(s):
    return s and dt.date.fromisoformat(s)


def windows(spark, rows):
    return spark.createDataFrame([(c, d(a), d(b)) for c, a, b in rows], "card string, start date, end date")


def test_windows_fill_starts_and_merge(spark):
    rows = [(1, "A", "2026-01-05", "2026-01-31", None, None), (2, "A", None, None, "2026-02-28", "2026-02-03"), (3, "A", None, "2026-05-10", None, "2026-05-01"), (4, "A", None, None, None, "2026-06-01"), (5, "B", None, None, "2026-03-01", "2026-02-10")]
    s = spark.createDataFrame([(i, c, d(a), d(b), d(e), d(f)) for i, c, a, b, e, f in rows], "id long, card string, period_start date, period_end date, statement_date date, first_txn date")
    got = sorted((r.card, str(r.start), str(r.end)) for r in coverage.statement_windows(s).collect())
    assert got == [("A", "2026-01-05", "2026-05-10"), ("B", "2026-02-10", "2026-03-01")]


def test_merge_is_idempotent(spark):
    w = windows(spark, [("A", "2026-01-01", "2026-01-10"), ("A", "2026-01-11", "2026-01-20"), ("A", "2026-01-15", "2026-01-16"), ("A", "2026-02-01", "2026-02-02")])
    once = coverage.merge_windows(w)
    assert sorted(once.collect()) == sorted(coverage.merge_windows(once).collect())
    assert once.count() == 2


def test_month_states(spark):
    w = windows(spark, [("A", "2026-06-13", "2026-08-14"), ("B", "2026-06-17", "2026-08-17"), ("C", "2026-06-01", "2026-07-10"), ("C", "2026-07-20", "2026-08-31")])
    months = spark.createDataFrame([("2026-06",), ("2026-07",), ("2026-08",), ("2026-09",)], "month string")
    cm = coverage.card_months(w, w.select("card"), months)
    state = {(r.card, r.month): (r.state, r.gap) for r in cm.collect()}
    assert state["A", "2026-07"] == ("complete", False)
    assert state["C", "2026-07"] == ("partial", True)
    assert state["B", "2026-09"] == ("missing", False)
    m = {r.month: r for r in coverage.month_completeness(cm).collect()}
    assert (str(m["2026-06"].covered_from), str(m["2026-06"].covered_through), m["2026-06"].day_lo, m["2026-06"].day_hi) == ("2026-06-17", "2026-06-30", 17, 30)
    assert m["2026-07"].covered_from is None
    assert m["2026-07"].gaps == ["C"]
    assert m["2026-09"].missing == ["A", "B", "C"]


def test_timeline(spark):
    w = windows(spark, [("A", "2026-01-05", "2026-03-14"), ("A", "2026-05-16", "2026-08-14"), ("B", "2026-01-18", "2026-08-17")])
    rows = coverage.timeline(w, "2026-09-10").collect()
    assert {(str(r.axis_start), str(r.axis_end)) for r in rows} == {("2025-12-01", "2026-09-30")}
    assert [r.days for r in rows if r.kind == "gap"] == [62]
    assert coverage.timeline_ticks(w, "2026-09-10").count() == 10


def test_lineage_stops_at_cycles(spark):
    a = spark.createDataFrame([(1, "X", "1111", 2), (2, "X", None, 1), (3, "Y", "3333", None), (4, "Y", "4444", 3)], "id long, issuer string, last4 string, replaced_by_id long")
    got = {r.account_id: (r.head_id, r.label) for r in lineage.lineages(a).collect()}
    assert got[3] == got[4] == (3, "Y ····3333 (was ····4444)")
    assert got[1][0] in (1, 2)


def test_link_flattens(spark):
    a = spark.createDataFrame([(1, "X", "1", None), (2, "X", "2", None), (3, "X", "3", None)], "id long, issuer string, last4 string, replaced_by_id long")
    b = lineage.link(lineage.link(a, 1, 2), 2, 3)
    assert {r.id: r.replaced_by_id for r in b.collect()} == {1: 3, 2: 3, 3: None}
    assert lineage.link(b, 3, 1) is b


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(12)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)

    def some(n):
        out = []
        for i in range(n):
            s = rng.randint(-2000, 2000)
            out.append((i, rng.choice("ab"), day(s), day(s + rng.choice([0, 0, 1, 3, 6, 30, 31, 32, 400, 3000, -1]))))
        return out + [(n, "a", None, day(0)), (n + 1, "b", day(0), None)]

    a, b = some(70), some(60)
    df = lambda rows: spark.createDataFrame(rows, "k long, card string, start date, end date")
    for by in ([], ["card"]):
        met = coverage.overlaps(df(a), df(b), by)
        got = sorted((r.k, r.span_k, r.shared_start, r.shared_end) for r in met.collect())
        good = [[r for r in x if r[2] and r[3] and r[2] <= r[3]] for x in (a, b)]
        want = sorted((x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in good[0] for y in good[1] if max(x[2], y[2]) <= min(x[3], y[3]) and (not by or x[1] == y[1]))
        assert got == want and len(want) > 100
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert coverage.overlaps(df([]), df(b)).collect() == []
