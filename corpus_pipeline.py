"""Corpus pipeline: identify languages, drop near copies, mask secrets, mix to target weights, pack to sequences.

Each stage takes all that its predecessor kept and returns the columns of its input; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerstone.llm import language_id
from ledgerstone.llm._shared import free, shared_table
from ledgerstone.llm.jaccard_join import jaccard_join
from ledgerstone.llm.mixing import sample
from ledgerstone.llm.packing import pack
from ledgerstone.llm.secrets import redact


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of the languages of these documents. Null texts, texts without letters and far ones go; an empty table stays empty. Columns of any name keep their values."""
    names = {c: free(docs.columns, f"_own_{c}") for c in docs.columns if c in ("lang_pred", "lang_score", "lang_rejected")}
    rows = language_id.identify(docs.withColumnsRenamed(names), language_id.learn(docs))
    return rows.where(~F.col("lang_rejected")).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies (five-word shingles, similarity of 0.75 or more), rows being told apart by id and text.

    Rows of equal id and text become one, the first by their other columns (nulls first). Rows of null id and documents without words are in no group; rows of null id stay as they are.
    """
    h, rank = free(docs.columns, "_h"), free(docs.columns, "_rank")
    groups = jaccard_join(docs.select("doc_id", "text"), n=5, percent=75)
    copies = groups.where("component_id <> doc_id OR component_hash <> text_hash").select(F.col("doc_id").alias(f"{h}_id"), F.col("text_hash").alias(f"{h}_text")).distinct()
    rows = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(copies, (rows["doc_id"] == copies[f"{h}_id"]) & (rows[h] == copies[f"{h}_text"]), "left_anti")
    others = [F.col(f"`{c}`").cast("string").asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")] or [F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(*others))
    named = rows.where(F.col("doc_id").isNotNull()).withColumn(rank, first).where(F.col(rank) == 1)
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by <SECRET>; n_chars follows where a text changed. Columns of any name keep their values."""
    before = free(docs.columns, "_before")
    rows = redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text") == F.col(before), F.col("n_chars")).otherwise(F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of as many expected tokens as came in, which by source, language and layout are their shares to the power 0.7; rates above 1 are repeats. A text without words is never drawn, a null id is drawn by its text alone, repeated rows are drawn alike. An empty table stays empty, and columns of any name keep their values."""
    return sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their ids. Null and empty texts are one end id; rows of equal or null id, and repeated rows, are documents of their own; a long text is cut over sequences; an empty table gives no rows; other columns are ignored."""
    return pack(docs, length=4096)


STAGES = [("language id", known_language), ("n-gram Jaccard join", one_of_each_group), ("secret scans", without_secrets), ("mixing", mixed), ("packing", packed)]
#: Centroids, searches and hashed draws have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that the stages make of documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared_table(spark, docs)
    return docs
