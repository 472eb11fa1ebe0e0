"""The registered queries of these operators, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, cross_polytope, embedding_dedup, hard_negatives, language_id, line_dedup, minhash, mixing, order_minhash, phrases, substring_dedup, token_counts, token_files
from evalspark.llm.common import read_table, text_or_empty
from evalspark.session import pin_utc

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(pin_utc(spark), sf_dir)

    REGISTRY[query.__name__] = run
    return query


def tokenizer(name: str) -> str:
    """Where the public vocabulary files are; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@registered
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, tokenizer("byte_bpe_50k.json"), ["doc_id"])


@registered
def op2_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, tokenizer("byte_bpe_50k.json"), ["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@registered
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    cleaned = line_dedup.drop_recurring_lines(docs)
    value, rest = text_or_empty("text"), F.coalesce(F.col("text"), F.lit(""))
    return cleaned.select("doc_id", F.char_length(value).alias("n_chars_kept"), F.size(F.split(rest, "\n")).alias("n_lines_kept"), F.md5(rest).alias("kept_md5"))


@registered
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@registered
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_probe(read_table(spark, sf_dir, "documents"))


@registered
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.read_documents(token_files.write_token_files(docs, tokenizer("word_bpe_49k.json"), end_id=2))


@registered
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.drop_repeats(read_table(spark, sf_dir, "documents")))


@registered
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


@registered
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


@registered
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.identify(language_id.document_evidence(docs), language_id.train(language_id.labelled_documents(docs)))
    return found.withColumnRenamed("id", "doc_id")


@registered
def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@registered
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh label is the next one, as if labelled wrongly; each fiftieth row is an anchor."""
    vec_id, label = F.col("vec_id"), F.col("label")
    noisy = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=noisy)


@registered
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


@registered
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.labelled_documents(read_table(spark, sf_dir, "documents")))
    found = language_id.identify(language_id.page_evidence(read_table(spark, sf_dir, "pages")), model)
    return found.withColumnRenamed("id", "page_id")
