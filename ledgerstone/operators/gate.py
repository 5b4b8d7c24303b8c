"""Suggestions from an outside model: payloads, the all-or-nothing gate, batches, grades. The model itself is a callable that is handed in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerstone.operators.listing import CATEGORIES
from ledgerstone.sources.shared import positions, snapshot

BATCH = 40
REPLY = "struct<assignments:array<struct<merchant:string,category:string>>>"


def batches(keys: DataFrame, size: int = BATCH, key: str = "merchant_normalized") -> DataFrame:
    """Distinct keys with a batch number, in key order."""
    return positions(keys.select(key).distinct(), key, name="_at").select(key, F.floor((F.col("_at") - 1) / size).cast("int").alias("batch"))


def payloads(numbered: DataFrame, examples: DataFrame | None = None, key: str = "merchant_normalized") -> DataFrame:
    """(batch, asked, payload): a line per key, its example line after a bar where it has one."""
    t = numbered if examples is None else numbered.join(examples, key, "left")
    line = F.col(key) if examples is None else F.concat_ws(" | ", key, "example")
    return t.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda s: s["l"]).alias("ls"), F.sort_array(F.collect_list(key)).alias("asked")).select("batch", "asked", F.array_join("ls", "\n").alias("payload"))


def gate(replies: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Replies (asked array<string>, raw) with ok and problems: an answer that is malformed, repeated, invented, dropped or outside the set refuses the whole reply."""
    allowed = allowed or CATEGORIES
    r = replies.withColumn("doc", F.from_json("raw", REPLY)).withColumn("items", F.col("doc.assignments"))
    r = r.withColumn("good", F.filter("items", lambda e: e["merchant"].isNotNull() & e["category"].isNotNull())).withColumn("names", F.transform("good", lambda e: e["merchant"]))
    n = lambda c: F.size(c).cast("string")
    malformed, repeated = F.size("items") - F.size("good"), F.size("names") - F.size(F.array_distinct("names"))
    invented, dropped = F.array_except("names", "asked"), F.array_except("asked", "names")
    outside = F.array_sort(F.array_except(F.transform("good", lambda e: e["category"]), F.array(*[F.lit(c) for c in allowed])))
    problems = F.array_compact(F.array(
        F.when(malformed > 0, F.concat(malformed.cast("string"), F.lit(" entr(ies) missing merchant or category"))),
        F.when(repeated > 0, F.concat(repeated.cast("string"), F.lit(" merchant(s) answered more than once"))),
        F.when(F.size(invented) > 0, F.concat(n(invented), F.lit(" merchant(s) invented that were never asked about"))),
        F.when(F.size(dropped) > 0, F.concat(n(dropped), F.lit(" merchant(s) dropped from the answer"))),
        F.when(F.size(outside) > 0, F.concat(F.lit("category value(s) outside the fixed set: "), F.array_join(F.slice(outside, 1, 4), ", "))),
    ))
    is_json = F.expr("try_parse_json(raw)").isNotNull()
    problems = F.when(~F.coalesce(is_json, F.lit(False)), F.array(F.lit("the response is not JSON"))).when(F.col("items").isNull(), F.array(F.lit("no 'assignments' array in the response"))).otherwise(problems)
    return r.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0).drop("doc", "names", "good")


class QuotaSpent(Exception):
    """What a model raises when it will not answer again today."""


def ask(payload: DataFrame, model: Callable[[str], str], *fallback: Callable[[str], str]) -> DataFrame:
    """Replies (batch, asked, raw, model, stopped), batch by batch: each goes to the first model that answers, by its place from 0.

    One that raises does not stop the others; a batch that no model answers has a null reply. A model whose quota is spent is not asked again by the same task;
    where all are, the task's further batches are marked stopped and cost no call.
    """
    return _asked(payload, list(enumerate((model, *fallback)))).drop("spent")


def _asked(payload: DataFrame, models: list[tuple[int, Callable[[str], str]]]) -> DataFrame:
    """Replies, and the places of the models that the task had found spent by then."""

    def run(rows):
        import pyarrow as pa

        spent: set[int] = set()
        for b in rows:
            out = []
            for p in b.column(2).to_pylist():
                got = (None, None, len(spent) == len(models))
                for k, f in models:
                    if k in spent:
                        continue
                    try:
                        got = (f(p), k, False)
                        break
                    except QuotaSpent:
                        spent.add(k)
                    except Exception:  # the model is not ours: whatever it raises is a missing answer
                        continue
                out.append((*got, sorted(spent)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.bool_()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], names=["batch", "asked", "raw", "model", "stopped", "spent"])

    return payload.select("batch", "asked", "payload").mapInArrow(run, "batch int, asked array<string>, raw string, model int, stopped boolean, spent array<int>")


def ask_in_waves(payload: DataFrame, model: Callable[[str], str], *fallback: Callable[[str], str], wave: int = 16, tasks: int = 4) -> DataFrame:
    """Replies as of ``ask``, for a run whose quota is one for all tasks: batches go out ``wave`` at a time, each wave over ``tasks`` tasks.

    After a wave the driver reads which models were found spent, a number each, and no later wave asks them. Within the wave in which a quota ends, every task finds that
    out by itself, so at most ``tasks`` calls are lost on it. When all models are spent, the remaining batches are marked stopped in one step. Replies of a wave are written before the next goes out, so a
    lost executor repeats calls of the current wave only. Batches are numbered from 0, as ``batches`` does.
    """
    models, spent, parts, at = (model, *fallback), set(), [], 0
    payload = snapshot(payload.select("batch", "asked", "payload"))
    last = payload.agg(F.max("batch")).first()[0]
    while last is not None and at <= last:
        left = [k for k in range(len(models)) if k not in spent]
        if not left:
            parts.append(payload.where(F.col("batch") >= at).select("batch", "asked", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("int").alias("model"), F.lit(True).alias("stopped")))
            break
        rows = payload.where(F.col("batch").between(at, at + wave - 1)).repartitionById(min(tasks, wave), (F.col("batch") % tasks).cast("int")).sortWithinPartitions("batch")
        got = snapshot(_asked(rows, [(k, models[k]) for k in left]))
        spent |= {r[0] for r in got.select(F.explode("spent")).distinct().collect()}
        parts.append(got.drop("spent"))
        at += wave
    none = payload.limit(0).select("batch", "asked", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("int").alias("model"), F.lit(True).alias("stopped"))
    return reduce(DataFrame.unionByName, parts, none)


def accepted(gated: DataFrame, abstain: str = "Unknown") -> DataFrame:
    """(merchant_normalized, category) of replies that passed; abstentions are left out."""
    return gated.where("ok").select(F.explode("items").alias("e")).select(F.col("e.merchant").alias("merchant_normalized"), F.col("e.category").alias("category")).where(F.col("category") != abstain)


def grade(truth: DataFrame, answers: DataFrame, key: str, abstain: str = "Unknown") -> DataFrame:
    """One row: correct, wrong, abstained and missing answers, total, and baseline: the most frequent true label's count."""
    t = truth.select(key, F.col("label").alias("t")).join(answers.select(key, F.col("label").alias("a")), key, "left")
    modal = t.groupBy("t").count().agg(F.max("count").alias("baseline"), F.lit(1).alias("one"))
    got = t.agg(F.count_if((F.col("a") == F.col("t")) & (F.col("a") != abstain)).alias("correct"), F.count_if((F.col("a") != F.col("t")) & (F.col("a") != abstain)).alias("wrong"), F.count_if(F.col("a") == abstain).alias("abstained"), F.count_if(F.col("a").isNull()).alias("missing"), F.count("*").alias("total"), F.lit(1).alias("one"))
    return got.join(F.broadcast(modal), "one").drop("one")
