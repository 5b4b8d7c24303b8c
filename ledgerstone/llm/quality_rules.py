"""Quality rules: text statistics, and decision lists learned from labels by sequential covering.

Statistics are Spark expressions over one row, so texts are never shuffled. They are written once as a small table.
A labelled sample of at most ``train_rows`` rows (by a hash of the id) is cut to bins; every growing step is one aggregation to
counts per feature, bin and label, from which the driver (at most a few hundred counts) picks the threshold of largest information gain:

1. grow: add threshold conditions to a rule for poor documents until no poor-free gain is left;
2. prune: drop last conditions while the rule's worth on the pruning third of the sample does not fall;
3. keep the rule if it is precise enough there, drop the rows it covers, and start the next.

The result is an ordered list of conjunctions, emitted as one Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerstone.llm._shared import free, shared_table

_WS = r"[\x20\x09-\x0D]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the rules, from the statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the statistics of the whole text: STATS, n_lines (lines with a word), n_digits and n_capitals, all long.

    Null is empty. Columns of these names are replaced, others keep their values. Repeated rows are treated one by one. An empty table gives no rows.
    """
    t = f"coalesce(CAST(`{text_col}` AS STRING), '')"
    words = f"filter(split({t}, '{_WS.replace(chr(92), chr(92) * 2)}'), w -> w != '')"
    lines = f"filter(split({t}, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    # Places of equal 3-word windows are neighbours once (hash, place) pairs are sorted; windows found twice cover up to three words each.
    repeated = (
        "element_at(transform(array(words), w -> IF(size(w) < 4, 0, element_at(transform(array(array_sort(transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i)))), "
        "s -> size(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> IF(a.h = b.h, array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2), CAST(array() AS array<int>))))))), 1))), 1)"
    )
    stats = (
        f"named_struct('n_words', CAST(size(words) AS BIGINT), 'word_chars', CAST(length(translate({t}, ' \\t\\n\\u000B\\u000C\\r', '')) AS BIGINT), 'n_symbols', CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS BIGINT), "
        f"'n_dup_lines', CAST(size(x) - size(array_distinct(x)) AS BIGINT), 'n_repeat_words', CAST({repeated} AS BIGINT), 'n_lines', CAST(size(x) AS BIGINT), "
        f"'n_digits', CAST(length({t}) - length(translate({t}, '0123456789', '')) AS BIGINT), 'n_capitals', CAST(size(filter(words, w -> w RLIKE '^\\\\p{{Lu}}')) AS BIGINT))"
    )
    stats = _bind("x", lines, stats)
    names = [*STATS, "n_lines", "n_digits", "n_capitals"]
    own = [c for c in docs.columns if c not in names]
    s = free(docs.columns, "_stats")
    return docs.select(*own, F.expr(_bind("words", words, stats)).alias(s)).select(*own, *[F.col(f"{s}.{n}") for n in names])


def _bind(var: str, value: str, body: str) -> str:
    """SQL that evaluates value once and names it."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return "(" + " AND ".join(c.sql() for c in self.conditions) + ")"


def learn(stats: DataFrame, labels: DataFrame, train_rows: int = 20_000, bins: int = 16, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.75, z: float = 1.28, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Ordered rules for poor documents (label 0) from the labelled rows of stats that pass the base rules.

    A rule counts if its precision is at least ``precision`` with confidence (z = 1.28: 90 %, one-sided) on labelled rows that it was not grown on, so few rows can be enough if none
    speaks against it: 5 of 5, or 11 of 12. Where one does not count, its rows are set aside and covering goes on, ``most_rules`` times in all.

    Labels other than 0 and 1, nulls and ids without statistics teach nothing; an id labelled twice counts with its smallest label. Without rows of both labels there are no rules.
    """
    spark = stats.sparkSession
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    total = y.count()
    if not total:
        return []
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    y = y.where(u < train_rows / total).withColumn("_prune", F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(3)) == 0)
    features = [F.expr(e).alias(f) for f, e in FEATURES.items()]
    train = shared_table(spark, stats.where(~base_failed()).join(y, id_col).select("_y", "_prune", *features))
    probs = [i / bins for i in range(1, bins)] + [0.005, 0.02, 0.98, 0.995]
    cuts = train.agg(*[F.percentile_approx(f, sorted(probs), 10_000).alias(f) for f in FEATURES]).first().asDict()
    cuts = {f: sorted(set(v or [])) for f, v in cuts.items()}
    if not any(cuts.values()):
        return []
    binned = F.array(*[F.struct(F.lit(f).alias("f"), F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> c <= {f}))").alias("b")) for f in FEATURES if cuts[f]])

    def counts(rows: DataFrame) -> dict[str, list[list[int]]]:
        """Per feature, bin and label: rows."""
        out = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items() if c}
        for r in rows.select("_y", F.explode(binned).alias("x")).groupBy("_y", "x.f", "x.b").count().collect():
            out[r.f][r.b][r["_y"]] += r["count"]
        return out

    grow, prune = train.where(~F.col("_prune")), train.where("_prune")
    rules: list[Rule] = []
    for _ in range(most_rules):
        live, conditions = grow, []
        while len(conditions) < most_conditions:
            best = _best(counts(live), cuts)
            if best is None:
                break
            conditions.append(best[0])
            live = live.where(_at(best[0]))
            if best[1] == 0:
                break
        if not conditions:
            break
        tested = prune.agg(*[F.sum(F.when(_all(conditions[: k + 1]) & (F.col("_y") == v), 1).otherwise(0)).alias(f"c{k}_{v}") for k in range(len(conditions)) for v in (0, 1)]).first()
        worth = [(((tested[f"c{k}_0"] or 0) - (tested[f"c{k}_1"] or 0)) / max(1, (tested[f"c{k}_0"] or 0) + (tested[f"c{k}_1"] or 0)), -k) for k in range(len(conditions))]
        k = -max(worth)[1]
        bad, good = tested[f"c{k}_0"] or 0, tested[f"c{k}_1"] or 0
        rule = Rule(tuple(conditions[: k + 1]), lower_limit(bad, bad + good, z), bad + good)
        grow = grow.where(~_all(rule.conditions))
        if rule.precision >= precision:
            rules.append(rule)
            prune = prune.where(~_all(rule.conditions))
    return rules


def lower_limit(hits: int, n: int, z: float) -> float:
    """Lower limit of a share of which ``hits`` of ``n`` were seen (Wilson's interval)."""
    if not n:
        return 0.0
    share = hits / n
    return (share + z * z / (2 * n) - z * math.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def _at(c: Condition) -> Column:
    return F.col(c.feature) >= c.cut if c.at_least else F.col(c.feature) < c.cut


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & _at(c)
    return out


def _best(counts: dict[str, list[list[int]]], cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of largest FOIL gain for label 0, and the good rows it still covers; None if none gains."""
    best = None
    for f, hist in sorted(counts.items()):
        bad, good = sum(h[0] for h in hist), sum(h[1] for h in hist)
        if not bad or not good:
            continue
        before = math.log2(bad / (bad + good))
        below = [0, 0]
        for j, cut in enumerate(cuts[f]):
            below = [below[0] + hist[j][0], below[1] + hist[j][1]]
            for at_least, (p, n) in ((False, below), (True, (bad - below[0], good - below[1]))):
                if p and (p, n) != (bad, good):
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, at_least, float(cut)), n)
    return best and best[1:]


def verdict(rules: list[Rule]) -> Column:
    """True where no rule fires: one conditional expression, first match decides."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN false" for r in rules) + " ELSE true END")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document the id, all statistics, base_failed, kept and rule (the number of the first rule that fires, from 1, or null).

    Null and empty texts have zero statistics and fail the base rules. Rows of equal or null id are judged one by one. A text of any length is one row, whose arrays of words and lines must fit a task. Columns but the id and the text are ignored, whatever their names. An empty table gives no rows.
    """
    stats = shared_table(docs.sparkSession, with_stats(docs.select(id_col, text_col), text_col).drop(text_col))
    rules = learn(stats, labels, id_col=id_col, **options)
    which = F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i + 1}" for i, r in enumerate(rules)) + " END") if rules else F.lit(None)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", which.cast("int")).withColumn("kept", ~F.col("base_failed") & verdict(rules))
