import random

import pytest

from ledgerstone.functions.patterns import safe_pattern
from ledgerstone.operators import classify
from ledgerstone.operators.rules import first_rules, with_rule

RULES = "id long, pattern string, match_type string, category string, flow_type string, priority int"


def covers(rule, text):
    import re

    p = (rule[1] or "").strip().lower()
    if not p or not text:
        return False
    safe = safe_pattern(p) if rule[2] == "regex" else None
    return {"exact": text == p, "contains": p in text, "regex": bool(safe and re.search(safe, text))}.get(rule[2], False)


def first(rules, *texts):
    hits = [r for r in rules if any(covers(r, t) for t in texts)]
    return min(hits, key=lambda r: (-(r[5] if r[5] is not None else -(1 << 30)), r[0]), default=(None,))[0]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    texts = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(150)})
    rules = []
    for i in range(400):
        t = rng.choice(texts)
        a = rng.randrange(len(t))
        p, kind = (t, "exact") if i % 5 == 0 else (t[a : a + rng.randint(1, 9)].upper(), "contains")
        rules.append((i, rng.choice(["", " ", "\t"]) + p, kind, rng.choice([None, "Dining"]), rng.choice([None, "fee"]), rng.choice([None, *range(6)])))
    odd = [("^a+b", "regex"), ("(a+)+$", "regex"), ("(", "regex"), ("é.c$", "regex"), ("", "contains"), (None, "exact"), ("a", "prefix"), ("zzzz", "contains"), ("é", "contains")]
    return texts, rules + [(1000 + k, p, m, "Dining", None, 9 - k % 3) for k, (p, m) in enumerate(odd)]


def test_first_rules(spark, many):
    texts, rules = many
    got = first_rules(spark.createDataFrame([(t,) for t in [*texts, "", texts[0], None]], "text string"), spark.createDataFrame(rules, RULES))
    by_id = {r[0]: r for r in rules}
    rows = {r.text: r.rule for r in got.collect()}
    assert {t: r.id for t, r in rows.items()} == {t: first(rules, t) for t in texts if first(rules, t) is not None}
    assert all((r.category, r.flow_type) == by_id[r.id][3:5] for r in rows.values())


def test_rows(spark, many):
    texts, rules = many
    rng = random.Random(5)
    rules = [r for r in rules if r[2] == "exact" or len((r[1] or "").strip()) > 4]
    rows = [(i, rng.choice([*texts, None]), rng.choice([*texts, None, ""])) for i in range(300)]
    t = spark.createDataFrame([(i, m, (d or "").upper() if d is not None else None, "x", "y") for i, m, d in rows], "id long, merchant_normalized string, description_raw string, text string, _rule0 string")
    got = {r.id: r.rule and r.rule.id for r in with_rule(t.drop("_rule0"), spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: first(rules, m or "", (d or "").lower()) for i, m, d in rows}
    assert {r.rule for r in with_rule(t.drop("_rule0"), spark.createDataFrame([], RULES)).collect()} == {None}


def test_ten_thousand_rules(spark):
    """The plan does not grow with the rules, and no rule comes to the driver."""
    texts = spark.range(2000).selectExpr("concat('shop ', id, ' street') AS merchant_normalized", "concat('SHOP ', id) AS description_raw", "'debit' AS direction")
    rules = spark.range(10_000).selectExpr("id", "concat('shop ', id) AS pattern", "IF(id % 2 = 0, 'exact', 'contains') AS match_type", "'Dining' AS category", "CAST(NULL AS STRING) AS flow_type", "CAST(id % 7 AS INT) AS priority")
    memory = spark.createDataFrame([], "merchant_normalized string, category string, source string")
    out = classify.resolve(texts, rules, memory)
    few = classify.resolve(texts, rules.limit(3), memory)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 1.2 * len(few._jdf.queryExecution().optimizedPlan().toString())
    got = {int(r.description_raw[5:]): r.rule_id for r in out.collect()}
    held = lambda n: [k for k in {int(str(n)[:j]) for j in range(1, len(str(n)) + 1)} if k % 2]  # noqa: E731  "shop 12" is in "shop 123 street"
    want = {n: min([*held(n), *([n] if n % 2 == 0 else [])], key=lambda k: (-(k % 7), k), default=None) for n in range(2000)}
    assert got == want


def test_rules_of_one_pattern_meet_a_text_once(spark):
    """Very many rules that look for the same few parts: the first of each counts, and texts do not meet the others."""
    import time

    texts = spark.range(3000).selectExpr("concat('shop ', id, ' street') AS text")
    rules = spark.range(150_000).selectExpr("id", "IF(id % 2 = 0, 'sh', ' Street') AS pattern", "IF(id % 5 = 0, 'exact', 'contains') AS match_type", "concat('C', id % 7) AS category", "CAST(NULL AS STRING) AS flow_type", "CAST(id % 9 AS INT) AS priority")
    began = time.time()
    got = first_rules(texts, rules).selectExpr("rule.id", "rule.category").groupBy("id", "category").count().collect()
    assert [tuple(r) for r in got] == [(8, "C1", 3000)]
    assert time.time() - began < 20  # 360 million pairs take minutes
