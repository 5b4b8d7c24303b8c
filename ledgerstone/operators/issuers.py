"""Which bank issued a statement, from its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.functions import textlines as T

# Name, mention, identity mark (a domain or legal name); ties go to the earlier one.
ISSUERS = [
    ("DBS", r"\bDBS\b|\bPOSB\b", r"\bdbs\.com\b|\bposb\.com\b|DBS Bank Ltd"),
    ("UOB", r"\bUOB\b|United Overseas Bank", r"\buob\.com\b|\buobgroup\.com\b|United Overseas Bank Limited"),
    ("OCBC", r"\bOCBC\b|Oversea-Chinese", r"\bocbc\.com\b|Oversea-Chinese Banking Corporation"),
    ("Standard Chartered", r"Standard Chartered|\bSCB\b", r"\bsc\.com\b|Standard Chartered Bank \(Singapore\)"),
    ("Citibank", r"\bCiti(?:bank)?\b", r"\bcitibank\.com\b|Citibank Singapore Limited"),
    ("HSBC", r"\bHSBC\b", r"\bhsbc\.com\b|HSBC Bank \(Singapore\) Limited"),
    ("Maybank", r"\bMaybank\b", r"\bmaybank(?:2u)?\.com\b|Malayan Banking Berhad|Maybank Singapore Limited"),
    ("American Express", r"American Express|\bAMEX\b", r"\bamericanexpress\.com\b|American Express International"),
    ("Trust", r"\bTrust Bank\b|\bTrust\b", r"\btrustbank\.sg\b|Trust Bank Singapore Limited"),
    ("MariBank", r"\bMari ?Bank\b|\bMARI CREDIT\b", r"\bmaribank\.sg\b|MariBank Singapore"),
    ("Meridian Bank", r"\bMeridian\s+Bank\b", None),
    ("Harbour Bank", r"\bHarbour\s+Bank\b", None),
    ("Northgate Bank", r"\bNorthgate\s+Bank\b", None),
]
MARK_WEIGHT = 5


def best_issuer(text: Column) -> Column:
    """The issuer of most mentions, identity marks counting five, outside lines that look like transactions; null if none is named."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: ~(x.rlike(T.ROW_DATE) & x.rlike(T.ROW_AMOUNT)))
    kept = F.array_join(lines, "\n")

    def best(kept: Column) -> Column:
        count = lambda p: F.regexp_count(kept, F.lit("(?i)" + p))
        scores = [F.struct((count(m) + (MARK_WEIGHT * count(k) if k else 0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, m, k) in enumerate(ISSUERS)]
        top = F.array_max(F.filter(F.array(*scores), lambda x: x["score"] > 0))
        return top["name"]

    return F.transform(F.array(kept), best)[0]  # as a function's argument the lines are filtered once, not once a count


def detect(documents: DataFrame) -> DataFrame:
    """(id, pages, filename) with issuer: by the first page, else by all pages, else the file's name in title case."""
    stem = F.initcap(F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), "[-_]", " "))
    d = documents.withColumn("_first", best_issuer(F.try_element_at("pages", F.lit(1))))
    return d.withColumn("issuer", F.coalesce("_first", best_issuer(F.array_join("pages", "\n")), stem)).drop("_first")
