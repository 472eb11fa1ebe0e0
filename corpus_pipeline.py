"""A training corpus from raw documents: language, boilerplate, near copies, mixture, tokens.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
the next stage's documents. ``run`` writes each stage's result as Parquet to the shared
folder and reads it back, so that a stage is computed once and a lost executor costs
its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, language_id, line_dedup, minhash, mixing
from evalspark.llm.common import WORD, keep_table, packed, read_table, unpacked
from evalspark.llm.queries import tokenizer
from evalspark.session import pin_utc


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; no letters, no fitting label, or no language above one half, rejects one.

    Every row is judged by itself: rows with one id, or without one, do not share a decision unless they are equal.
    NULL and empty texts go; columns of any name stay.
    """
    names = ("doc_id", "text", "lang", "source")
    key = F.struct(F.xxhash64(*names).alias("a"), F.xxhash64(F.lit("row"), *names).alias("b"))
    model = language_id.train(language_id.labelled_documents(docs))
    judged = language_id.identify(language_id.document_evidence(docs.select(key.alias("doc_id"), *names[1:])), model)
    gone = judged.filter("not kept").select(F.col("id").alias("gone")).distinct()
    return unpacked(packed(docs, key=key).join(gone, F.col("key") == F.col("gone"), "left_anti"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that consisted of such lines alone goes, as do those without words.

    ``n_chars``, where there is such a column, follows the text. Equal texts count once, equal rows are treated alike.
    """
    cleaned = line_dedup.drop_recurring_lines(docs).filter(F.col("text").isNotNull() & F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Rows with one id are one document; rows without an id are none of a group and stay, as do those without words.
    """
    found = minhash.near_duplicates(docs)
    gone = found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return unpacked(packed(docs, id=F.col("doc_id")).join(gone, F.col("id") == F.col("gone"), "left_anti"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A NULL source is one of its own; texts without words are never taken; of equal rows the first ones get the copies.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document: one row per row, a NULL text has none."""
    return bpe.encode_documents(docs, tokenizer("byte_bpe_50k.json"), ["doc_id", "source", "lang"])


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

# Model scores, signatures and encodings cannot be expressed in SQL; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(pin_utc(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
