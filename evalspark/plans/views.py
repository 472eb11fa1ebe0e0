"""Evaluation inputs as views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read with its explicit schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def third(key: str) -> Column:
    """The difficulty of a row by its key."""
    rest = F.col(key) % 3
    return F.when(rest == 0, "simple").when(rest == 1, "moderate").otherwise("challenging")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-inference metrics out of ``events``."""
    k, cents = F.col("k"), F.col("cents")
    clock = F.concat(
        F.expr("string(cents div 360000)"), F.lit(":"), F.expr("lpad(string(cents div 6000 % 60), 2, '0')"), F.lit(":"),
        F.expr("lpad(string(cents div 100 % 60), 2, '0')"), F.lit("."), F.expr("lpad(string(cents % 100), 2, '0')"),
        F.lit("0000"),
    )
    host = F.col("user_id") % 3
    sizes = F.floor(F.col("user_id") / 3) % 5
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return events.select(
        F.col("event_id").alias("question_id"),
        third("event_id").alias("hardness"),
        F.when(host == 0, "self-hosted").when(host == 1, "open-ai").otherwise("anthropic").alias("environment"),
        F.when(host == 0, "CodeLlama-34b-Instruct-hf")
        .when((host == 1) & (F.col("event_id") % 2 == 0), "gpt-4-turbo-preview")
        .when(host == 1, "gpt-3.5-turbo-16k")
        .otherwise("claude-3-haiku-20240307").alias("model"),
        F.when(sizes == 0, 0).when(sizes == 1, 5).when(sizes == 2, 7).when(sizes == 3, 9).otherwise(11).alias("instruction"),
        F.when(F.col("event_type") == "error", "0").otherwise(clock).alias("response_time"),
        (k + 100).alias("llm_prompt_tokens"),
        (k + 100 + F.col("event_id") % 50).alias("llm_response_tokens"),
    )


def questions_of(documents: DataFrame) -> DataFrame:
    """The question set as columns over ``documents``, also of a stream."""
    doc, source = F.col("doc_id"), F.col("source")
    return documents.select(
        doc.alias("question_id"),
        source.alias("db_id"),
        third("doc_id").alias("difficulty"),
        F.col("text").alias("question"),
        F.when(doc % 4 != 0, F.concat(F.lit("hint "), F.col("n_chars").cast("string"))).alias("evidence"),
        F.concat(F.lit("SELECT "), doc.cast("string"), F.lit(" AS v FROM "), source).alias("sql_query"),
        F.when(doc % 11 == 0, F.concat(F.lit("-- phpMyAdmin SQL Dump "), F.col("lang")))
        .otherwise(F.concat(F.lit("CREATE TABLE "), source, F.lit(" (v INT)"))).alias("schema"),
    )


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question set out of ``documents``."""
    return questions_of(table(spark, sf_dir, "documents"))


def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table texts of 18 databases out of ``benchmark``."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), (item % 18).cast("string")).alias("db_id"),
        item.cast("int").alias("table_ord"),
        F.concat(F.lit("CREATE TABLE t"), item.cast("string"), F.lit(" (a INT)")).alias("ddl"),
    )


def shot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of samples out of ``conversations``: a user turn and the assistant's answer to it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    conv = F.col("conv_id")
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat(F.lit("src"), (conv % 20).cast("string")).alias("db_id"),
        (conv * 100 + F.col("turn")).alias("ord"),
        F.col("asked").alias("question"),
        F.col("answer").alias("sql_query"),
        F.when(conv % 2 == 0, F.col("answer")).alias("cot"),
    )


def reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies of seven kinds over ``documents``."""
    doc, source = F.col("doc_id"), F.col("source")
    case = doc % 7
    statement = F.concat(F.lit("SELECT "), doc.cast("string"), F.lit(" AS v FROM "), source)
    reply = (
        F.when(case == 0, "I do not know")
        .when(case == 1, F.concat(F.lit("```sql\n"), statement, F.lit(";\n```")))
        .when(case == 2, F.concat(F.lit("Sure: select v from "), source, F.lit(" Explanation: it reads v")))
        .when(case == 3, F.concat(F.lit("WITH q AS (SELECT 1) SELECT v FROM "), source, F.lit(" ;")))
        .when(case == 4, F.concat(F.lit("selection of "), source))
        .when(case == 5, F.concat(F.lit("SELECT v\tFROM "), source, F.lit("   This query returns v")))
    )
    return table(spark, sf_dir, "documents").select(
        doc.alias("question_id"), reply.alias("reply"), F.when(case == 6, "timeout").alias("error")
    )


def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of gold and predicted results of 50 pairs out of ``orders``."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    case = (F.col("o_custkey") % 50) % 4
    changed = (
        F.when((case == 1) & (key % 97 == 0), F.lit("X"))
        .when((case == 2) & (key % 89 == 0), F.lit(None).cast("string"))
        .otherwise(status)
    )
    dropped = (case == 3) & (key % 101 == 0)

    def cell(side: str, position: int, value: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(position).alias("col_pos"), value.alias("value"))

    kept = F.array(
        cell("gold", 0, key.cast("string")), cell("gold", 1, status), cell("predicted", 1, key.cast("string"))
    )
    extra = F.when(dropped, F.array().cast(kept_type())).otherwise(F.array(cell("predicted", 0, changed)))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("pair_id"), key.alias("row_id"), F.explode(F.concat(kept, extra)).alias("c")
    ).select("pair_id", "row_id", "c.*")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results as whole rows, the predicted ones in gold order; where a predicted cell is dropped, its row is shorter."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    case = (F.col("o_custkey") % 50) % 4
    changed = F.when((case == 1) & (key % 97 == 0), F.lit("X")).when((case == 2) & (key % 89 == 0), F.lit(None).cast("string")).otherwise(status)
    whole = F.array(key.cast("string"), changed)
    predicted = F.when((case == 3) & (key % 101 == 0), F.slice(whole, 1, 1)).otherwise(whole)
    row = lambda side, cells: F.struct(F.lit(side).alias("side"), cells.alias("cells"))
    both = F.array(row("gold", F.array(key.cast("string"), status)), row("predicted", predicted))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("pair_id"), F.explode(both).alias("r")).select("pair_id", "r.*")


def kept_type() -> str:
    return "array<struct<side:string,col_pos:int,value:string>>"


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores ``(question_id, res, model)``: the quality label of a document, one model per language."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").alias("res"))
    models = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), F.concat(F.lit("model-"), F.col("lang")).alias("model")
    )
    return labels.join(models, "question_id")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set out of ``benchmark``."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("question_id"), F.concat(F.lit("src"), (item % 20).cast("string")).alias("db_id"),
        third("item_id").alias("difficulty"), F.col("text").alias("question"),
        F.when(item % 4 != 0, F.concat(F.lit("hint "), item.cast("string"))).alias("evidence"),
    )


def long_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold whole texts of ``documents`` around the statement, or nothing else."""
    doc, text, source = F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), F.col("source")
    statement = F.concat(F.lit("SELECT "), doc.cast("string"), F.lit(" AS v FROM "), source)
    reply = (
        F.when(doc % 4 == 0, text)
        .when(doc % 4 == 1, F.concat(text, F.lit("\n```sql\n"), statement, F.lit(";\n```\n"), text))
        .when(doc % 4 == 2, F.concat(F.lit("WITH q AS (SELECT 1) SELECT v\tFROM "), source, F.lit("  Explanation: "), text))
        .otherwise(F.concat(statement, F.lit(" WHERE t = 'it''s \"so\"'\r\nAND u IS NULL; "), text))
    )
    return table(spark, sf_dir, "documents").select(doc.alias("question_id"), reply.alias("reply"))


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two runs over the labelled documents: one by quality, one by toxicity."""
    labels = table(spark, sf_dir, "labels")

    def run(environment: str, model: str, size: int, shot: str, res: str) -> Column:
        return F.struct(
            F.lit(environment).alias("environment"), F.lit(model).alias("model"), F.lit(size).alias("instruction"),
            F.lit(shot).alias("shot"), F.col(res).alias("res"),
        )

    runs = F.array(run("open-ai", "gpt-4-turbo-preview", 5, "0_shot", "quality"), run("anthropic", "claude-3-haiku-20240307", 11, "4_shot_cot", "toxic"))
    return labels.select(F.col("doc_id").alias("question_id"), F.explode(runs).alias("r")).select("question_id", "r.*")
