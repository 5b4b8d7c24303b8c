"""Kept aggregates: the daily cube on disk, brought up to date from the rows that came and went.

Counts and sums can be added to and taken from, so a change of the ledger is a change of the cube's days: the rows that came are summed by account and day, those
that went are summed with the opposite sign, and only months in which one of them falls are read and rewritten. The ledger itself is never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.reports import daily_cube, month_key
from ledgerstone.sources.store import Store

_SUMS = ("n", "v", "u")


def _of_rows(txns: DataFrame) -> DataFrame:
    return daily_cube(txns).withColumn("month", month_key())


def build_cube(store: Store, txns: DataFrame) -> int:
    """Keep the cube of a whole ledger. Returns its version."""
    return store.write(_of_rows(txns))


def refresh_cube(store: Store, came: DataFrame | None = None, went: DataFrame | None = None) -> list[str | None]:
    """Bring the cube up to date; returns the months rewritten.

    came and went are ledger rows: new ones of any date, removed ones, and for a changed row its new and its old form. A day without rows leaves the cube. Taking out more rows of
    a day than it has is an error, and the cube stays as it was. Rows without a date are a month of their own (null). A second writer's refresh of the same version raises Conflict.
    """
    since = store.version()
    parts = [_of_rows(t).select("account_id", "txn_date", "month", *[(F.col(c) * sign).alias(c) for c in _SUMS]) for t, sign in ((came, 1), (went, -1)) if t is not None]
    if not parts:
        return []
    change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    change = change.groupBy("account_id", "txn_date", "month").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n <> 0 OR v <> 0 OR u <> 0")
    months = sorted((r[0] for r in change.select("month").distinct().collect()), key=lambda m: (m is not None, m))  # a row a month
    if not months:
        return []
    rows = store.read(since, months).unionByName(change).groupBy("account_id", "txn_date", "month").agg(*[F.sum(c).alias(c) for c in _SUMS])
    short = F.raise_error(F.concat(F.lit("more rows taken out than there are on "), F.coalesce(F.col("txn_date").cast("string"), F.lit("no date"))))
    rows = rows.withColumn("n", F.when(F.col("n") < 0, short).otherwise(F.col("n"))).where("n <> 0")
    store.commit(rows.select("account_id", "txn_date", *_SUMS, "month"), months, since)
    return months


def read_cube(store: Store) -> DataFrame:
    return store.read().drop("month")
