"""Card lineages: a card replaced by another reports under the newest one's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerstone.sources.shared import snapshot

def card_label(issuer, last4):
    return F.concat(issuer, F.coalesce(F.concat(F.lit(" ····"), last4), F.lit("")))


def _follow(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, at): where links (id, next) lead from each id: to an end, or onto a circle. By doubling: a round doubles the links that all have gone; ids that have arrived stay."""
    at = ids.join(links, "id", "left").select("id", F.coalesce("next", "id").alias("at"))
    gone, most = 1, links.count()
    while gone <= most:
        hop = at.select(F.col("id").alias("at"), F.col("at").alias("far"))
        at = snapshot(at.join(hop, "at").select("id", F.col("far").alias("at"), (F.col("far") != F.col("at")).alias("moved")))
        if not at.where("moved").limit(1).count():
            break
        at, gone = at.drop("moved"), 2 * gone
    return at.select("id", "at")


def heads(accounts: DataFrame) -> DataFrame:
    """id and head: the last card that replacements lead to, or the one before a card would come again. A replacement that is no account, or the card itself, ends them.

    Rows hold two ids, however long a chain is. Where all ids have gone as many links as there are, those not at an end stand on circles, and on all cards of these; the rest
    then go to the first card of a circle that they meet, whose head is the card that links to it there.
    """
    ids = accounts.select("id")
    links = accounts.select("id", F.col("replaced_by_id").alias("next")).join(ids.withColumnRenamed("id", "next"), "next", "left_semi").where("next <> id").select("id", "next")
    at = _follow(ids, links)
    circle = snapshot(at.select(F.col("at").alias("id")).distinct().join(links, "id").select("id", "next"))
    if not circle.limit(1).count():
        return at.withColumnRenamed("at", "head")
    ends = _follow(ids, links.join(circle, "id", "left_anti"))
    before = circle.select(F.col("next").alias("at"), F.col("id").alias("before"))
    return ends.join(before, "at", "left").select("id", F.coalesce("before", "at").alias("head"))


def lineages(accounts: DataFrame) -> DataFrame:
    """account_id, head_id, label, lineage_size for every account: replacements are followed to the last card, stopping where one would be met again."""
    ends = heads(accounts).select(F.col("id").alias("account_id"), F.col("head").alias("head_id"))
    a = accounts.select("id", "issuer", "last4")
    rows = ends.join(a.withColumnRenamed("id", "account_id"), "account_id").join(a.select(F.col("id").alias("head_id"), F.col("issuer").alias("hi"), F.col("last4").alias("hl")), "head_id")
    was = F.when(F.col("account_id") != F.col("head_id"), F.struct("account_id", F.coalesce(F.concat(F.lit("····"), F.col("last4")), F.col("issuer")).alias("w")))
    w = Window.partitionBy("head_id")
    olds = F.array_join(F.transform(F.array_sort(F.collect_list(was).over(w)), lambda s: s["w"]), ", ")
    label = F.concat(card_label(F.col("hi"), F.col("hl")), F.when(olds != "", F.concat(F.lit(" (was "), olds, F.lit(")"))).otherwise(""))
    return rows.select("account_id", "head_id", label.alias("label"), F.count("*").over(w).alias("lineage_size"))


def replacement_refusal(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (account_id, by_id) with the reason for refusing each; '' if it may be linked, head_id the card to link to."""
    known = accounts.select("id", "issuer")
    head = lineages(accounts).select(F.col("account_id").alias("h"), "head_id")
    r = requests.join(known.select(F.col("id").alias("k1"), F.col("issuer").alias("i1")), F.col("account_id") == F.col("k1"), "left")
    r = r.join(known.select(F.col("id").alias("k2"), F.col("issuer").alias("i2")), F.col("by_id") == F.col("k2"), "left").join(head, F.col("by_id") == F.col("h"), "left")
    reason = (
        F.when(F.col("k1").isNull(), "No such card").when(F.col("by_id").isNull(), "").when(F.col("k2").isNull(), "No such card").when(F.col("by_id") == F.col("account_id"), "A card cannot replace itself")
        .when(F.col("i1") != F.col("i2"), "A replacement card is issued by the same bank").when(F.col("head_id") == F.col("account_id"), "That card is already part of this one's history").otherwise("")
    )
    return r.select("account_id", "by_id", reason.alias("reason"), F.when(reason == "", F.col("head_id")).alias("head_id"))


def link(accounts: DataFrame, account_id: int, by_id: int | None) -> DataFrame:
    """Accounts after a replacement: chains are flattened, so every old card points to the newest. Refused requests change nothing."""
    spark = accounts.sparkSession
    got = replacement_refusal(accounts, spark.createDataFrame([(account_id, by_id)], "account_id long, by_id long")).first()
    if got.reason:
        return accounts
    moved = F.col("id") == account_id
    if by_id is not None:
        moved = moved | (F.col("replaced_by_id") == account_id)
    return accounts.withColumn("replaced_by_id", F.when(moved, F.lit(got.head_id).cast("long")).otherwise(F.col("replaced_by_id")))


def card_options(accounts: DataFrame) -> DataFrame:
    """account_id, by_id, label: the cards that each card may be linked to: those a request for would not be refused, newest cards of their lineage only."""
    heads = lineages(accounts).where("account_id = head_id").select(F.col("account_id").alias("by_id"), "label")
    a = accounts.select(F.col("id").alias("account_id"), F.col("issuer").alias("_i"))
    b = accounts.select(F.col("id").alias("by_id"), F.col("issuer").alias("_i")).join(heads, "by_id")
    pairs = a.join(b, "_i").select("account_id", "by_id", "label")  # cards of one bank
    ok = replacement_refusal(accounts, pairs.select("account_id", "by_id")).where("reason = ''").select("account_id", "by_id")
    return pairs.join(ok, ["account_id", "by_id"])
