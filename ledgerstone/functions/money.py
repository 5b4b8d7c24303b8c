"""Money and number columns: integer minor units, half-up parsing, half-even averages, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def net_value(amount: Column, flow: Column) -> Column:
    """What a row adds to net spend: spend counts, refunds count against, other flows do not."""
    return F.when(flow == "spend", amount).when(flow == "refund", -amount).otherwise(F.lit(0)).cast("long")


def net_spend(amount: str = "amount_minor", flow: str = "flow_type") -> Column:
    """Net spend over a group; 0 for none."""
    return F.coalesce(F.sum(net_value(F.col(amount), F.col(flow))), F.lit(0)).cast("long")


def to_minor(text: Column) -> Column:
    """'1,234.565' or '$12' to minor units, rounded half up; NULL if it is no number."""
    plain = F.regexp_replace(F.trim(text), r"[,$]", "")
    return F.round(plain.try_cast("decimal(18,3)") * 100).cast("long")


def to_major(minor: Column) -> Column:
    return (minor.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")


def money_text(minor: Column) -> Column:
    """Two decimals with thousands separators; NULL is a dash."""
    return F.coalesce(F.format_number(to_major(minor), 2), F.lit("—"))


def half_even_mean(total: Column, n: Column) -> Column:
    """Mean of whole numbers, rounded half to even; NULL for no rows."""
    return F.when(n > 0, F.bround(total.cast("double") / n)).cast("long")
