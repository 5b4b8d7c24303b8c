"""Sources and sinks: statement files, generated statements, snapshots of small tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerstone.functions.money import to_major

MOST_BYTES = 25 << 20
#: White space at the ends of a page, as Python's ``strip`` takes it.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def read_files(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """Files (path, filename, content, length, sha256, refusal): refusal is why a file isn't taken, or null. Spark's file source leaves empty files out by itself; from any other listing, a length of 0 is refused."""
    from ledgerstone.sources.ingest import refusal

    f = spark.read.format("binaryFile").load(path)
    name = file_name(F.col("path"))
    why = refusal(name, F.col("length"), extension)
    return f.select("path", name.alias("filename"), "content", "length", F.sha2("content", 256).alias("sha256"), why.alias("refusal"))


def file_name(path: Column) -> Column:
    """The last part of a path, by either slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def only_new(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not among the known sha256, each content once: nothing is parsed twice."""
    return files.join(known.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def decode_text(content: Column) -> Column:
    """UTF-8 (a byte order mark dropped) where the bytes are valid, else Windows-1252; its five unassigned bytes give the replacement character."""
    text, high = content.cast("string"), range(0x80, 0xA0)  # elsewhere the code page is Latin-1
    windows = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, high)), "".join(bytes([b]).decode("cp1252", "replace") for b in high))
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(windows), "^\ufeff", "")


def looks_scanned(text: Column) -> Column:
    """Whether a page has fewer than 100 characters between its outer white space, of any kind; the statement parser counts pages alike. A null page has none."""
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))) < 100


def generate_statements(txns: DataFrame, statements: DataFrame, accounts: DataFrame, per_page: int = 60) -> DataFrame:
    """Statement text from transactions with a statement_id: (id, pages). Balances carry forward from one statement of a card to the next.

    Each line is a transaction date, a posting date, a description and an amount; the first page has the card, the period and the balances, the last the totals.
    """
    d = lambda c: F.upper(F.date_format(c, "dd MMM yyyy"))
    money = lambda c: F.format_number(to_major(c), 2)
    total = lambda x: F.coalesce(F.sum(F.when(F.col("direction") == x, F.col("amount_minor"))), F.lit(0))
    sums = txns.groupBy("statement_id").agg(total("debit").alias("debits"), total("credit").alias("credits"))
    # Balances run over a card's statements, so only a short row of each is in that window; the lines stay where their statement is.
    s = statements.join(sums, F.col("id") == F.col("statement_id")).join(accounts.select(F.col("id").alias("account_id"), "issuer", "last4"), "account_id")
    closing = F.sum(F.col("debits") - F.col("credits")).over(Window.partitionBy("account_id").orderBy("statement_date").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("closing", closing).withColumn("opening", F.col("closing") - F.col("debits") + F.col("credits"))
    signed = lambda c: F.concat(money(F.abs(c)), F.when(c < 0, " CR").otherwise(""))
    start = F.date_add(F.add_months("statement_date", -1), 1)
    head = F.concat(F.col("issuer"), F.lit("\nCard number **** **** **** "), F.coalesce("last4", F.lit("0000")), F.lit(" SGD\nStatement period "), d(start), F.lit(" to "), d(F.col("statement_date")), F.lit("\nPREVIOUS BALANCE  "), signed(F.col("opening")), F.lit("\n\n"))
    tail = F.concat(F.lit("\n\nTotal purchases  "), money(F.col("debits")), F.lit("\nTotal payments  "), money(F.col("credits")), F.lit("\nNEW BALANCE  "), signed(F.col("closing")))
    s = s.select("id", head.alias("head"), tail.alias("tail"))
    t = txns.withColumn("line", F.concat(d("txn_date"), F.lit("  "), d("txn_date"), F.lit("  "), F.col("description_raw"), F.lit("  "), money(F.col("amount_minor")), F.when(F.col("direction") == "credit", " CR").otherwise("")))
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy("txn_date", "id"))
    t = t.withColumn("k", place).withColumn("p", F.floor((F.col("k") - 1) / per_page))
    inner = lambda kept: F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"])
    bodies = t.groupBy("statement_id", "p").agg(F.array_join(inner(F.struct("k", F.col("line").alias("text"))), "\n").alias("body"))
    g = bodies.groupBy("statement_id").agg(inner(F.struct("p", F.col("body").alias("text"))).alias("bodies"))
    of = g.join(s, F.col("statement_id") == F.col("id"))
    pages = F.transform("bodies", lambda x, i: F.concat(F.when(i == 0, F.col("head")).otherwise(F.lit("")), x, F.when(i == F.size("bodies") - 1, F.col("tail")).otherwise(F.lit(""))))
    return of.select("id", pages.alias("pages"))


def fill_gaps(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and the rows of new whose key it lacks."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").dropDuplicates([key]).select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with new's rows in place of those of the same key."""
    return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def replace_group(groups: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Groups after one is given these members: white space in the name is squeezed, keys count once, a key leaves its former group. A blank name or fewer than two keys change nothing."""
    name = re.sub(r"\s+", " ", name or "").strip()
    keys = list(dict.fromkeys(k for k in keys if k))
    if not name or len(keys) < 2:
        return groups
    rows = groups.sparkSession.createDataFrame([(k, name) for k in keys], "merchant_normalized string, group_name string")
    return upsert(groups.where(F.col("group_name") != name), rows, "merchant_normalized")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new that differ from old in a column, nulls compared as values: what a writer has to write."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.join(o, F.col(key) == F.col("_k")).where(differs).select(*new.columns)


def delete_by_prefix(statements: DataFrame, prefix: str, column: str = "filename") -> DataFrame:
    """Statements whose name does not start with the prefix, letter case aside."""
    return statements.where(~F.coalesce(F.lower(column).startswith(prefix.lower()), F.lit(False)))


def without_accounts(accounts: DataFrame, statements: DataFrame, issuers: list[str]) -> DataFrame:
    """Accounts but for those of the issuers that have no statement."""
    empty = accounts.where(F.col("issuer").isin(issuers)).join(statements.select(F.col("account_id").alias("id")), "id", "left_anti").select("id")
    return accounts.join(empty, "id", "left_anti")
