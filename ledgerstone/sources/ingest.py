"""From files to the ledger's tables: refusals, page text, accounts, statements and rows, outcomes per file; deletes and schema changes. Tables are DataFrames, each step returns what to write."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.functions.merchants import normalize
from ledgerstone.operators.issuers import detect
from ledgerstone.operators.statements import parse_statements, reconcile, warnings
from ledgerstone.sources.documents import MOST_BYTES
from ledgerstone.sources.shared import snapshot


def refusal(name: Column, length: Column, extension: str = "pdf") -> Column:
    """Why a file isn't taken; null if it is."""
    return F.when(~F.lower(name).endswith(f".{extension}"), f"only .{extension} files are read").when(F.coalesce(length, F.lit(0)) == 0, "the file is empty").when(length > MOST_BYTES, "the file is larger than 25 MiB")


def page_texts(files: DataFrame, extract: Callable[[bytes, str], list[str]], passwords: tuple[str, ...] = ("",)) -> DataFrame:
    """files with pages (array<string>) and error: the extractor is asked with each password in turn.

    It raises PermissionError where a password is wrong; the error then says whether one is needed or none fits. Anything else it raises is a
    damaged file: an error value, never a failed job. The extractor is handed in: the library has none for PDF.
    """

    def read(data: bytes | None) -> tuple[list[str] | None, str | None]:
        for password in dict.fromkeys(("", *passwords)):
            try:
                return [p or "" for p in extract(data or b"", password)], None
            except PermissionError:
                continue
            except Exception as e:
                return None, f"damaged file: {type(e).__name__}"
        return None, "the password does not open this file" if any(passwords) else "the file needs a password"

    kind = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])

    @F.arrow_udf("pages array<string>, error string")
    def run(content: pa.Array) -> pa.Array:
        got = [read(x.as_py()) for x in content]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], kind.field(0).type), pa.array([g[1] for g in got], pa.string())], fields=list(kind))

    return files.withColumn("_read", run("content")).select(*files.columns, "_read.*")


def find_or_create(accounts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts with the new ones, wanted with account_id). wanted has issuer, last4 and currency; a null last4 is a value like any other. New ids follow the largest, by issuer and last4 (null first)."""
    mine = wanted.groupBy("issuer", "last4").agg(F.min("currency").alias("currency"))
    known = accounts.select("id", F.col("issuer").alias("i"), F.col("last4").alias("l"))
    same = lambda t: t["issuer"].eqNullSafe(known["i"]) & t["last4"].eqNullSafe(known["l"])
    top = accounts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = mine.join(known, same(mine), "left_anti")
    rank = F.row_number().over(Window.orderBy("issuer", F.asc_nulls_first("last4")))  # new cards of one ingest: a few
    made = {"id": (F.lit(top) + rank).cast("long"), "issuer": F.col("issuer"), "kind": F.lit("credit"), "last4": F.col("last4"), "currency": F.coalesce("currency", F.lit("SGD"))}
    new = new.select(*[made.get(c, F.lit(None).cast(accounts.schema[c].dataType)).alias(c) for c in accounts.columns])
    every = accounts.unionByName(new)
    k = every.select(F.col("id").alias("account_id"), F.col("issuer").alias("i"), F.col("last4").alias("l"))
    return every, wanted.join(k, wanted["issuer"].eqNullSafe(k["i"]) & wanted["last4"].eqNullSafe(k["l"])).drop("i", "l")


def ingest(files: DataFrame, accounts: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """accounts, statements, txns and outcomes after a batch of files (filename, length, sha256, pages, error); each file stands by itself.

    An outcome is stored, duplicate (its content is known, or came earlier in the batch by filename) or failed, with a message. Only stored files give statements and rows.
    """
    why = F.coalesce(refusal(F.col("filename"), F.col("length")), F.col("error"))
    f = files.withColumn("why", why).join(known.select("sha256").distinct().withColumn("seen", F.lit(True)), "sha256", "left")
    again = F.row_number().over(Window.partitionBy("sha256", F.col("why").isNull()).orderBy("filename")) > 1
    f = f.withColumn("kind", F.when(F.col("why").isNotNull(), "failed").when(F.col("seen") | again, "duplicate").otherwise("stored")).withColumn("id", F.xxhash64("sha256"))
    f = snapshot(f.select("id", "filename", "sha256", "pages", "kind", "why"))
    fresh = f.where("kind = 'stored'")
    parsed = snapshot(warnings(reconcile(parse_statements(fresh))).join(detect(fresh.select("id", "pages", "filename")).select("id", "issuer"), "id").join(fresh.select("id", "filename", "sha256", F.col("pages").alias("page_text")), "id"))
    every, owned = find_or_create(accounts, parsed.select("id", "issuer", "last4", "currency"))
    s = parsed.join(owned.select("id", "account_id"), "id")
    minor = lambda c: F.round(F.col(c) * 100).cast("long")
    r = s.select("account_id", F.col("id").alias("statement_id"), F.col("currency").alias("home"), F.posexplode("rows").alias("k", "r")).select("account_id", "statement_id", "home", "k", "r.*").withColumnRenamed("description", "description_raw")
    t = r.select(
        F.xxhash64("statement_id", "k").alias("id"), "account_id", "statement_id", "txn_date", "posted_date", "description_raw", normalize("description_raw").alias("merchant_normalized"),
        F.coalesce(minor("foreign_amount"), minor("amount")).alias("amount_minor"), F.coalesce("foreign_currency", "home", F.lit("SGD")).alias("currency"), minor("amount").alias("amount_sgd_minor"), "fx_rate", "direction", "source_page", "reference",
        F.sha2(F.concat_ws("|", "txn_date", F.col("amount").cast("string"), "description_raw", F.coalesce("reference", F.lit(""))), 256).alias("dedup_key"), F.col("ambiguous").alias("amount_ambiguous"),
    )
    keep = ("id", "account_id", "filename", "sha256", "period_start", "period_end", "statement_date", "status", "verdict", F.col("detail").alias("verdict_detail"), "rows_expected", F.size("rows").alias("rows_parsed"), "page_count", "scanned_pages", "warnings", "page_text")
    outcomes = f.select("filename", "kind", F.when(F.col("kind") == "failed", F.col("why")).when(F.col("kind") == "duplicate", "this file is already there").otherwise("").alias("message"))
    return {"accounts": every, "statements": s.select(*keep, minor("opening_balance").alias("opening_balance_minor"), minor("closing_balance").alias("closing_balance_minor")), "txns": t, "outcomes": outcomes}


def delete_statements(statements: DataFrame, txns: DataFrame, ids: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """Statements and rows without the given statements; without any at all for None. A row goes with its statement, rows of no statement stay."""
    if ids is None:
        return statements.where(F.lit(False)), txns.where(F.col("statement_id").isNull())
    gone = statements.where(F.col("id").isin(list(ids))).select("id")
    return statements.join(gone, "id", "left_anti"), txns.join(gone.withColumnRenamed("id", "statement_id"), "statement_id", "left_anti").select(*txns.columns)


def delete_rows(table: DataFrame, key: str, value) -> DataFrame:
    """A small table without the rows of one key: a rule, a memory entry or a whole group. A null or unknown key deletes nothing."""
    return table.where(~F.col(key).eqNullSafe(F.lit(value))) if value is not None else table


def evolve(table: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """The table with all wanted columns (name: type and default): missing ones get the default, present ones the type, further ones stay at the end."""
    have = {c.lower(): c for c in table.columns}
    new = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in wanted.items()]
    return table.select(*new, *[c for c in table.columns if c.lower() not in {w.lower() for w in wanted}])


def dumps(table: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as one JSON text, nulls left out, to be written with ``write.text``."""
    return table.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*table.columns)).alias("json"))


def dump_files(table: DataFrame, key: str, path: str, dry_run: bool = False) -> DataFrame:
    """Write each row as a JSON text to the folder of its key below path; a row (key, file, bytes) for each, sorted by key, also where nothing is written (dry_run).

    The folder is key=<value>, percent-encoded as Spark does. Files stand there only once the whole job has ended well: a failed task leaves none. Folders of keys that
    are written again are replaced, others stay. Rows of one key share its file, a line each; a null key is not written.
    """
    texts = dumps(table.where(F.col(key).isNotNull()), key)
    told = texts.groupBy("key").agg(F.sum(F.octet_length("json") + 1).cast("long").alias("bytes")).select("key", F.concat(F.lit(f"{path.rstrip('/')}/key="), "key").alias("file"), "bytes").orderBy("key")
    if not dry_run:
        texts.repartition("key").sortWithinPartitions("key", "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").text(path)
    return told
