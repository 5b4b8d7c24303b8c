"""Which user rule covers a text: rules of any number as a table that meets the distinct texts by joins.

* An exact rule meets its text by equality.
* A rule that looks for a part is found by its rarest piece of three characters: pieces that no text has rule it out at once, and only texts that have the rarest one
  are searched. Texts and rules meet by that piece, so work follows the candidates and not texts times rules.
* Regular expressions have no piece that is sure to be there. They are one row, an array, that each distinct text walks: few are written, by hand.

Of the rules that cover a text the first by priority, then id, counts; so of rules of one type and pattern only the first meets texts, however many there are. Nothing comes to the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerstone.functions.patterns import safe_pattern
from ledgerstone.sources.shared import snapshot

#: Characters of a piece.
PIECE = 3


@F.pandas_udf(StringType())
def _safe(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: safe_pattern(p) if p else None)


def _pieces(text: str, sizes: tuple[int, ...]) -> Column:
    """The distinct pieces of these sizes; of a text that is shorter than a size, the text."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def first_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, rule) of each distinct text (lower case, column ``text``) that a rule covers; rule has place, id, category and flow_type. The least rule of several texts is the first.

    rules: id, pattern, match_type, category, flow_type, priority. Patterns are trimmed and lower-cased. Blank ones, regular expressions that could run without end, and
    rules of another type cover nothing; so does a null. An empty text is covered by no rule. A null priority comes last.
    """
    texts = snapshot(texts.where("text <> ''").select("text").distinct())
    r = rules.select(F.lower(F.regexp_replace("pattern", r"(?U)^\s+|\s+$", "")).alias("pattern"), "match_type", F.struct((-F.coalesce("priority", F.lit(-(1 << 30))).cast("long")).alias("place"), F.col("id").cast("long").alias("id"), "category", "flow_type").alias("rule")).where("pattern <> ''")
    r = snapshot(r.groupBy("match_type", "pattern").agg(F.min("rule").alias("rule")))  # of rules that look for the same, only the first can count
    exact = r.where("match_type = 'exact'").join(texts, F.col("pattern") == F.col("text")).select("text", "rule")

    part = r.where("match_type = 'contains'")
    wanted = part.select("pattern").distinct().select("pattern", F.explode(_pieces("pattern", (PIECE,))).alias("piece"))
    pieces = texts.select("text", F.explode(_pieces("text", tuple(range(1, PIECE + 1)))).alias("piece")).join(wanted.select("piece").distinct(), "piece", "left_semi")
    common = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    anchors = wanted.join(common, "piece", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest")).where("rarest.n > 0")
    held = pieces.join(anchors.select("pattern", F.col("rarest.piece").alias("piece")), "piece").where(F.contains("text", "pattern")).select("text", "pattern")
    contains = held.join(part, "pattern").select("text", "rule")

    regex = r.where("match_type = 'regex'").select(_safe("pattern").alias("pattern"), "rule").where("pattern IS NOT NULL")
    every = regex.agg(F.collect_list(F.struct("pattern", "rule")).alias("all")).scalar()
    hits = texts.select("text", every.alias("every")).select("text", F.array_min(F.transform(F.filter("every", lambda x: F.rlike("text", x["pattern"])), lambda x: x["rule"])).alias("rule")).where("rule IS NOT NULL")
    return exact.unionAll(contains).unionAll(hits).groupBy("text").agg(F.min("rule").alias("rule"))


def with_rule(txns: DataFrame, rules: DataFrame, merchant: str = "merchant_normalized", description: str = "description_raw", out: str = "rule") -> DataFrame:
    """Adds the first rule that covers a row's merchant key or its description, null if none does. Texts are searched once each, however many rows have them."""
    side = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    found = snapshot(first_rules(txns.select(side(merchant).alias("text")).unionAll(txns.select(side(description).alias("text"))), rules))
    t = txns
    for k, c in enumerate((merchant, description)):
        t = t.join(found.select(F.col("text").alias(f"_text{k}"), F.col("rule").alias(f"_rule{k}")), side(c) == F.col(f"_text{k}"), "left")
    least = F.when(F.col("_rule0").isNull() | (F.col("_rule1") < F.col("_rule0")), F.col("_rule1")).otherwise(F.col("_rule0"))
    return t.select(*[F.col(f"`{c}`") for c in txns.columns], least.alias(out))
