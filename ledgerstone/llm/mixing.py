"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells, one per combination of the dimensions' values. Cell weights start as
token counts and are scaled to each dimension's target marginal in turn (raking) until all marginals agree. A cell's weight per
token, times a scale, is the rate at which its documents are drawn, so expected tokens match every target at once. The scale is set by a
token budget, a share of the input's tokens, and not by the cell of highest weight. A rate above 1 is written as repeats: rate 2.3 gives a document twice, and a third time with probability 0.3.

Everything is DataFrame operations. Iterations run over cells only, and each is written to the shared checkpoint folder, so the plan
stays short and a lost executor costs one iteration. The driver sees one scalar per iteration.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.llm._shared import free, shared_table

#: Up to so many cells, at some 100 bytes each, the cells are broadcast; beyond, documents meet them by a salted shuffle.
BROADCAST_CELLS, SALTS = 20_000, 16
DIMS = ("source", "lang", "topic")
#: Expected tokens drawn, as a share of the input's, where targets are the tempered shares.
BUDGET = 1.0


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def layout_topic(text: Column) -> Column:
    """A topic for tables that have none: how the text is laid out."""
    lines = F.regexp_count(text, F.lit("\n"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(text.contains(" | "), "table").when(text.rlike(r"[#*$%&<>]{3}"), "markup").when(lines == 0, "line").when(F.length(text) > 400 * (lines + 1), "long lines").otherwise("prose")


def fit_cells(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict] | None = None, temperature: float = 0.7, iterations: int = 30, tolerance: float = 1e-4) -> DataFrame:
    """Rake cells (the dims, tokens) to the targets: adds weight, whose sums over each dim's values are the target shares.

    targets: {dim: {value: share}}; a dim without one gets its own token shares to the power ``temperature``. Shares are
    normalised; a value without a share gets 0, so its cells' weight is 0. No cells give no rows; a null value is a value. Where marginals contradict
    each other (a source of one language that no other source has, say), no weights meet them all: raking ends after ``iterations``, the last dim is met, the
    others as nearly as its last round left them, and the largest deviation is logged as a warning.
    """
    spark = cells.sparkSession
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in dims:
        if targets and d in targets:
            given = [F.when(F.col(d).eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in targets[d].items()]
            share = F.coalesce(*given, F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(Window.partitionBy(d)).cast("double"), F.lit(temperature))
        cells = cells.withColumn(f"_t_{d}", share)
    cells = shared_table(spark, cells)
    for d in dims:  # the sum over a dim's values, each once
        total = cells.groupBy(d).agg(F.max(f"_t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
        cells = cells.withColumn(f"_t_{d}", F.col(f"_t_{d}") / F.lit(float(total) or 1.0))
    for _ in range(iterations):
        off = []
        for d in dims:
            have = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("_have", have)
            off.append(f"_off_{d}")
            cells = cells.withColumn(off[-1], F.when(F.col("_have") > 0, F.abs(F.col("_have") - F.col(f"_t_{d}"))).otherwise(0.0))
            cells = cells.withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_t_{d}") / F.col("_have")).otherwise(0.0))
        cells = shared_table(spark, cells.drop("_have"))
        worst = cells.agg(F.max(F.greatest(*off)) if len(off) > 1 else F.max(off[0])).first()[0]
        cells = cells.drop(*off)
        if worst is None or worst < tolerance:
            break
    else:
        logging.getLogger(__name__).warning("raking ended after %d rounds, a marginal is off by %.2g", iterations, worst)
    return cells.drop(*(f"_t_{d}" for d in dims))


def _draw(seed: int, id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11) / F.lit(float(1 << 53))


def copies(seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """How often a row of mix is drawn: its rate rounded down, and once more by its draw against the rest. Positive where mix_kept is true."""
    whole = F.floor("mix_probability")
    return (whole + (_draw(seed, id_col, text_col) < F.col("mix_probability") - whole).cast("long")).cast("long")


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, dims: tuple[str, ...] = DIMS, temperature: float = 0.7, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", iterations: int = 30, budget: float | None = None) -> DataFrame:
    """All documents with ``mix_tokens``, ``mix_probability`` and ``mix_kept``; columns of these names are replaced.

    budget: expected tokens drawn as a share of the input's. mix_probability is the rate that follows from it: above 1, it is the expected number of
    times a document is drawn (``copies``), and the document is always kept. Without a budget it is BUDGET; with given
    targets, which may be far from the input's shares, the rates are scaled so that the largest is 1 and nothing is repeated.

    A missing ``topic`` column is derived from the text's layout and not returned. Nulls in a dimension are a value of
    their own. A text without words (null, empty, blank) has probability 0. Documents are drawn by a hash of id and text: the same rows on every run;
    equal rows are drawn alike, a null id by its text alone. A text of any length is one row, whose words are counted in place. An empty table gives no rows.
    """
    own = docs.columns
    t = docs.drop("mix_tokens", "mix_probability", "mix_kept")
    keep = [c for c in own if c not in ("mix_tokens", "mix_probability", "mix_kept")]
    value = {d: F.col(d).cast("string") if d in own else layout_topic(F.col(text_col)) for d in dims}
    cell = F.struct(*[value[d].alias(d) for d in dims])
    own_cell, key, rate, salted = (free([*own, "mix_tokens"], c) for c in ("_cell", "_key", "_p", "_salt"))
    t = t.select(*keep, token_count(F.col(text_col)).alias("mix_tokens"), cell.alias(own_cell))
    cells = t.groupBy(own_cell).agg(F.sum("mix_tokens").alias("tokens")).where("tokens > 0").select(f"{own_cell}.*", "tokens")
    cells = fit_cells(cells, tuple(dims), targets, temperature, iterations)
    top = cells.agg(F.max(F.col("weight") / F.col("tokens")), F.count("*"), F.sum("tokens"), F.sum("weight")).first()
    if budget is None and not targets:
        budget = BUDGET
    unit = (top[0] if budget is None else (top[3] or 0.0) / (budget * (top[2] or 1))) or 1.0
    # One string per cell: a length before each value keeps different cells apart, and nulls are "-".
    name = lambda get: F.concat(*[F.coalesce(F.concat(F.length(get(d)).cast("string"), F.lit(":"), get(d)), F.lit("-")) for d in dims])
    rates = cells.select(name(lambda d: F.col(d)).alias(key), (F.col("weight") / F.col("tokens") / F.lit(unit)).alias(rate))
    t = t.withColumn(key, name(lambda d: F.col(f"{own_cell}.{d}"))).drop(own_cell)
    if top[1] <= BROADCAST_CELLS:
        t = t.join(F.broadcast(rates), key, "left")
    else:
        salt = F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS))
        rates = rates.withColumn(salted, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        t = t.withColumn(salted, salt).join(rates, [key, salted], "left").drop(salted)
    draw = _draw(seed, id_col, text_col)
    t = t.withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.coalesce(F.col(rate), F.lit(0.0))).otherwise(0.0))
    return t.select(*keep, "mix_tokens", "mix_probability", (draw < F.col("mix_probability")).alias("mix_kept"))


def sample(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of docs, every row as often as it is drawn; columns of any name keep their values."""
    names = {c: free(docs.columns, f"_own_{c}") for c in docs.columns if c in ("mix_tokens", "mix_probability", "mix_kept")}
    t = mix(docs.withColumnsRenamed(names), seed=seed, id_col=id_col, text_col=text_col, **options)
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return t.where("mix_kept").withColumn(free(t.columns, "_copy"), F.explode(F.sequence(F.lit(1).cast("long"), copies(seed, id_col, text_col)))).select(*back)
