"""Replay: what stored page text says now, held against what is stored. Every function returns the rows that change, so that a writer writes nothing else; a second run finds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions import textlines as T
from ledgerstone.functions.merchants import normalize
from ledgerstone.sources.documents import changed_rows


def match(stored: DataFrame, reread: DataFrame) -> DataFrame:
    """Stored rows beside the re-read row of the same statement, date and amount, as ``new``. Of several re-read ones the last (by its place k) stands for all."""
    key = ["statement_id", "txn_date", "amount_minor"]
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("k"))) == 1
    r = reread.withColumn("_last", last).where("_last").select(*key, F.struct(*[c for c in reread.columns if c not in key]).alias("new"))
    return stored.join(r, key)


def descriptions(stored: DataFrame, reread: DataFrame) -> DataFrame:
    """Rows whose description reads otherwise now, with the new description and merchant key."""
    m = match(stored, reread).withColumn("description_raw", F.col("new.description_raw")).withColumn("merchant_normalized", normalize("description_raw"))
    return changed_rows(stored, m.select(*stored.columns), "id", ["description_raw"])


def flags(stored: DataFrame, reread: DataFrame) -> DataFrame:
    """Rows whose ambiguity is read otherwise now."""
    m = match(stored, reread).withColumn("amount_ambiguous", F.col("new.amount_ambiguous"))
    return changed_rows(stored, m.select(*stored.columns), "id", ["amount_ambiguous"])


def without_rate(statements: DataFrame, txns: DataFrame, home: str = "SGD") -> DataFrame:
    """Statements that have a row in another currency without a rate."""
    rows = txns.where((F.col("currency") != home) & F.col("fx_rate").isNull()).select(F.col("statement_id").alias("id"))
    return statements.join(rows, "id", "left_semi")


def foreign(stored: DataFrame, reread: DataFrame, home: str = "SGD") -> DataFrame:
    """Home-currency rows that read as foreign charges now, with the foreign amount, currency and rate; what was billed is kept."""
    m = match(stored, reread).where(F.col("new.foreign_currency").isNotNull() & (F.col("currency") == home))
    new = {"amount_minor": F.col("new.foreign_minor"), "currency": F.col("new.foreign_currency"), "fx_rate": F.col("new.fx_rate")}
    return m.select(*[new.get(c, F.col(c)).alias(c) for c in stored.columns])


def periods(statements: DataFrame, reread: DataFrame) -> DataFrame:
    """Statements without a period for which one is read now."""
    r = reread.select("id", F.struct("period_start", "period_end", "statement_date").alias("new")).where("new.period_start IS NOT NULL AND new.period_end IS NOT NULL")
    new = {c: F.coalesce(F.col(c), F.col(f"new.{c}")) for c in ("period_start", "period_end", "statement_date")}
    return statements.where("period_start IS NULL OR period_end IS NULL").join(r, "id").select(*[new.get(c, F.col(c)).alias(c) for c in statements.columns])


def redacted(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows in which a full card number still stands, masked."""
    new = table
    for c in columns:
        new = new.withColumn(c, T.redact(c))
    return changed_rows(table, new, key, columns)


def renormalized(txns: DataFrame) -> DataFrame:
    """Rows whose merchant key differs from what its description gives now; keys are computed once per distinct description."""
    keys = txns.select("description_raw").distinct().withColumn("_key", normalize("description_raw"))
    new = txns.join(keys, "description_raw", "left").withColumn("merchant_normalized", F.col("_key")).select(*txns.columns)
    return changed_rows(txns, new, "id", ["merchant_normalized"])
