"""Flow types and categories by ordered tiers: user rules, learned memory, flow, nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions.merchants import merchant_root
from ledgerstone.functions.patterns import safe_pattern
from ledgerstone.operators.rules import with_rule

# What a description says about the kind of movement, in order.
FLOW_PATTERNS = [
    ("fee", r"\b(?:interest\s+(?:charge|on|charged)|finance\s+charge|late\s+payment\s+(?:charge|fee)|annual\s+(?:fee|membership)|service\s+(?:charge|fee)|cash\s+advance\s+fee|(?:foreign|overseas)\s+(?:transaction|currency)\s+fee|over(?:\s|-)?limit\s+(?:charge|fee)|admin(?:istrative)?\s+fee|card\s+replacement|minimum\s+charge|\bgst\b)"),
    ("transfer", r"(?:payment\s*-?\s*thank\s+you|payment\s+received|(?:credit\s+)?card\s+payment|\bccrd\b|balance\s+transfer|funds?\s+transfer|\btransfer\s+(?:to|from)\b|payment\s+via\b|\bautopay\s+(?:to\s+)?card\b)"),
    ("refund", r"\b(?:refund(?:ed)?|reversal|reversed|chargeback|credit\s+voucher|goods\s+returned)\b"),
    ("income", r"\b(?:cash\s?back|rebate|rewards?\s+(?:redemption|credit)|interest\s+earned|salary|payroll|dividend)\b"),
]
CATEGORY_FOR_FLOW = {"transfer": "Cash & Transfers", "fee": "Fees & Interest", "income": "Income/Refunds"}


def default_flow(description: Column, direction: Column) -> Column:
    """Refund and income words need a credit, else the search goes on; an unknown credit is income, an unknown debit spend."""
    text = F.coalesce(description, F.lit(""))
    out = F.when(direction == "credit", "income").otherwise("spend")
    for flow, pattern in reversed(FLOW_PATTERNS):
        hit = text.rlike("(?i)" + pattern)
        if flow in ("refund", "income"):
            hit = hit & F.coalesce(direction == "credit", F.lit(False))
        out = F.when(hit, flow).otherwise(out)
    return out


def rule_refusal(pattern: str | None, match_type: str, category: str | None, flow: str | None) -> str:
    """Why a rule can't be saved; '' if it can."""
    from ledgerstone.operators.listing import CATEGORIES, FLOW_TYPES

    if not (pattern or "").strip():
        return "A rule needs a pattern"
    if match_type not in ("exact", "contains", "regex"):
        return "Unknown match type"
    if not category and not flow:
        return "A rule sets a category or a flow"
    if (category and category not in CATEGORIES) or (flow and flow not in FLOW_TYPES):
        return "Unknown category or flow"
    return "That pattern does not compile, or could run without end" if match_type == "regex" and safe_pattern(pattern) is None else ""


def add_rule(rules: DataFrame, pattern: str, match_type: str, category: str | None = None, flow: str | None = None, priority: int = 0) -> DataFrame:
    """Rules and the new one; raises ValueError with the reason if it is refused."""
    if why := rule_refusal(pattern, match_type, category, flow):
        raise ValueError(why)
    top = (rules.agg(F.max("id")).first()[0] or 0) + 1
    return rules.unionByName(rules.sparkSession.createDataFrame([(top, pattern, match_type, category, flow, priority)], rules.schema))


def resolve(txns: DataFrame, rules: DataFrame, memory: DataFrame, merchant: str = "merchant_normalized", description: str = "description_raw") -> DataFrame:
    """Adds rule_id, new_flow, new_category, new_source. A matching rule wins even without a category; its flow counts only if set. Memory is asked for the key, then its first word."""
    flow = default_flow(F.col(description), F.col("direction"))
    t = with_rule(txns, rules, merchant, description, "_rule").withColumn("rule_id", F.col("_rule.id")).withColumn("_flow", flow).withColumn("_root", merchant_root(merchant))
    m = memory.select("merchant_normalized", F.col("category").alias("c"), F.col("source").alias("s"))
    exact = m.select(F.col("merchant_normalized").alias("_k1"), F.col("c").alias("_c1"), F.col("s").alias("_s1"))
    root = m.select(F.col("merchant_normalized").alias("_k2"), F.col("c").alias("_c2"), F.col("s").alias("_s2"))
    t = t.join(exact, F.col(merchant) == F.col("_k1"), "left").join(root, F.col("_root") == F.col("_k2"), "left")
    implied = F.expr("CASE _flow " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_FOR_FLOW.items()) + " END")
    ruled, k1, k2 = F.col("rule_id").isNotNull(), F.col("_k1").isNotNull(), F.col("_k2").isNotNull()
    t = t.withColumn("new_category", F.when(ruled, F.col("_rule.category")).when(k1, F.col("_c1")).when(k2, F.col("_c2")).otherwise(implied))
    t = t.withColumn("new_source", F.when(ruled, "rule").when(k1, F.col("_s1")).when(k2, F.col("_s2")).when(implied.isNotNull(), "flow"))
    t = t.withColumn("new_flow", F.when(ruled, F.coalesce("_rule.flow_type", "_flow")).otherwise(F.col("_flow")))
    return t.withColumn("memory_key", F.when(~ruled & k1, F.col("_k1")).when(~ruled & k2, F.col("_k2"))).drop("_rule", "_flow", "_root", "_k1", "_c1", "_s1", "_k2", "_c2", "_s2")


def recategorize(txns: DataFrame, rules: DataFrame, memory: DataFrame) -> DataFrame:
    """All rows with category, flow_type and category_source resolved again, except those a user decided; moved says which changed."""
    r = resolve(txns, rules, memory)
    user = F.coalesce(F.col("category_source") == "user", F.lit(False))
    new = {c: F.when(user, F.col(c)).otherwise(F.col(n)) for c, n in (("category", "new_category"), ("flow_type", "new_flow"), ("category_source", "new_source"))}
    moved = ~(F.col("category").eqNullSafe(new["category"]) & F.col("flow_type").eqNullSafe(new["flow_type"]) & F.col("category_source").eqNullSafe(new["category_source"]))
    return r.select(*[c for c in txns.columns if c not in new], *[v.alias(f"_{c}") for c, v in new.items()], moved.alias("moved"), "memory_key").withColumnsRenamed({f"_{c}": c for c in new})


def hit_counts(txns: DataFrame, rules: DataFrame, memory: DataFrame) -> DataFrame:
    """Per memory key the rows it decides: 0 for none, and for keys that did not come from memory or seeds."""
    r = resolve(txns, rules, memory).where(~F.coalesce(F.col("category_source") == "user", F.lit(False)))
    n = r.where(F.col("new_source").isin("memory", "seed")).groupBy("memory_key").agg(F.count("*").alias("n"))
    return memory.join(n, F.col("merchant_normalized") == F.col("memory_key"), "left").select("merchant_normalized", "source", F.coalesce("n", F.lit(0)).alias("hit_count"))


def set_category(txns: DataFrame, txn_id: int, category: str | None, flow: str | None = None, to_matching: bool = False) -> DataFrame:
    """A user's decision on one row, and on other rows of its merchant that no user decided; a flow never spreads. Clearing the category without a flow gives the row back to the tiers."""
    key = txns.where(F.col("id") == txn_id).select("merchant_normalized").first()
    if key is None:
        return txns
    this = F.col("id") == txn_id
    same = F.lit(bool(to_matching and category and key[0])) & (F.col("merchant_normalized") == F.lit(key[0])) & ~F.col("category_source").eqNullSafe("user") & ~this
    source = "user" if category or flow else None
    out = txns.withColumn("_c", F.when(this, F.lit(category)).when(same, F.lit(category)).otherwise(F.col("category")))
    out = out.withColumn("_s", F.when(this, F.lit(source)).when(same, F.lit("memory")).otherwise(F.col("category_source")))
    out = out.withColumn("_f", F.when(this & F.lit(flow is not None), F.lit(flow)).otherwise(F.col("flow_type")))
    return out.drop("category", "category_source", "flow_type").withColumnsRenamed({"_c": "category", "_s": "category_source", "_f": "flow_type"}).select(*txns.columns)
