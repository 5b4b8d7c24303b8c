"""The library's column functions by name in SQL: temporary functions of a session, each an expression that Spark puts in place of the call, so plans and pushdown are those of the DataFrame forms."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerstone.functions.merchants import _normalize, lit

WINDOWS = "ARRAY<STRUCT<start: DATE, end: DATE>>"


def _flow() -> str:
    from ledgerstone.operators.classify import FLOW_PATTERNS

    whens = (f"WHEN coalesce(description, '') RLIKE {lit('(?i)' + p)}" + (" AND direction = 'credit'" if f in ("refund", "income") else "") + f" THEN '{f}'" for f, p in FLOW_PATTERNS)
    return f"CASE {' '.join(whens)} WHEN direction = 'credit' THEN 'income' ELSE 'spend' END"


def _merged() -> str:
    """Sorted windows folded to one list: a window that overlaps or touches the last one makes that longer."""
    last = "element_at(done, -1)"
    longer = f"concat(slice(done, 1, size(done) - 1), array(struct({last}.start AS start, greatest({last}.end, w.end) AS end)))"
    sound = "array_sort(filter(windows, w -> w.start <= w.end))"
    return f"aggregate({sound}, CAST(array() AS {WINDOWS}), (done, w) -> IF(size(done) > 0 AND w.start <= date_add({last}.end, 1), {longer}, concat(done, array(w))))"


def functions() -> dict[str, tuple[str, str, str]]:
    """Name: parameters, type and body."""
    return {
        "merchant_key": ("d STRING", "STRING", _normalize("d")),
        "merchant_root": ("merchant STRING", "STRING", "substring_index(coalesce(merchant, ''), ' ', 1)"),
        "flow_of": ("description STRING, direction STRING", "STRING", _flow()),
        "net_value": ("amount BIGINT, flow STRING", "BIGINT", "CASE flow WHEN 'spend' THEN amount WHEN 'refund' THEN -amount ELSE 0L END"),
        "to_minor": ("amount STRING", "BIGINT", "CAST(round(try_cast(regexp_replace(trim(amount), '[,$]', '') AS DECIMAL(18, 3)) * 100) AS BIGINT)"),
        "month_of": ("day DATE", "STRING", "date_format(day, 'yyyy-MM')"),
        "merged_windows": (f"windows {WINDOWS}", WINDOWS, _merged()),
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, and return their names. merged_windows takes what collect_list gives over a group's struct(start, end)."""
    for name, (parameters, kind, body) in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(functions())
