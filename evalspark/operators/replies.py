"""From raw replies to predictions, metric rows and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.functions import durations, lines, prompts, replies
from evalspark.operators import ranking

REPLY_KEYS = ["run_id", "question_id"]
RUN_COLUMNS = ["environment", "model", "instruction", "shot", "dataset_length"]


def latest_replies(raw: DataFrame) -> DataFrame:
    """One reply per (run, question): an answer before an error, then the earliest.

    Nearly every reply is the only one, so reducing before the shuffle would
    sort the texts for nothing: the rows are brought together first.
    """
    order = F.struct(F.col("error").isNotNull(), F.col("started"))
    whole = F.struct(*[name for name in raw.columns if name not in REPLY_KEYS])
    together = raw.repartition(*REPLY_KEYS)
    return together.groupBy(*REPLY_KEYS).agg(F.min_by(whole, order).alias("_r")).select(*REPLY_KEYS, "_r.*")


def pending(prompts: DataFrame, answered: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Prompts that have no reply yet; with ``retry_errors`` a failed reply does not count."""
    done = answered.filter(F.col("error").isNull()) if retry_errors else answered
    return prompts.join(done.select(*REPLY_KEYS), REPLY_KEYS, "left_anti")


def with_outcome(replies_df: DataFrame, reply: str = "reply", keep_with: bool = False) -> DataFrame:
    """Add ``severity, is_sql, predicted_sql, message``."""
    return replies_df.withColumns(replies.reply_outcome(F.col(reply), F.col("error"), keep_with))


def with_provider_reply(bodies: DataFrame, shape: str = "shape", body: str = "body") -> DataFrame:
    """Add ``text, prompt_tokens, response_tokens`` out of a provider's JSON."""
    return bodies.withColumns(replies.provider_reply(F.col(shape), F.col(body)))


def metric_rows(outcomes: DataFrame, hardness: str = "difficulty", with_run: bool = False) -> DataFrame:
    """The per-inference metric: response time (``0`` without an answer), tokens, hardness.

    Errors count no tokens; a reply without SQL keeps its tokens. With
    ``with_run`` the run's columns come along, the model under its report name.
    """
    named = [prompts.report_model(F.col(n)).alias(n) if n == "model" else F.col(n) for n in RUN_COLUMNS]
    failed = F.col("severity") == "error"

    def tokens(name: str) -> Column:
        return F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col(name), F.lit(0))).cast("bigint")

    micros = F.unix_micros("stopped") - F.unix_micros("started")
    return outcomes.select(
        *REPLY_KEYS,
        F.when(F.col("severity") == "info", durations.duration_text(micros)).otherwise(F.lit("0")).alias("response_time"),
        tokens("prompt_tokens").alias("llm_prompt_tokens"),
        tokens("response_tokens").alias("llm_response_tokens"),
        F.col(hardness).alias("hardness"),
        *(named if with_run else []),
    )


def log_records(outcomes: DataFrame) -> DataFrame:
    """Log records of replies that carry the run's columns; times only for answers."""
    answered = F.col("severity") == "info"
    return outcomes.select(
        "environment", "model", F.col("instruction").alias("instruction_size"), "dataset_length",
        "severity", "is_sql", F.col("messages").alias("request"), F.col("text").alias("response"),
        F.when(answered, durations.log_time(F.col("started"))).alias("response_time_start"),
        F.when(answered, durations.log_time(F.col("stopped"))).alias("response_time_stop"),
        F.when(answered, F.col("predicted_sql")).alias("sql_response"), "message",
    )


def log_status_counts(records: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Number of log records per severity and SQL flag."""
    return records.groupBy(*keys, "severity", "is_sql").agg(F.count("*").alias("records"))


def parse_predictions(
    rows: DataFrame, run: str = "run_id", text: str = "prediction", default_db: str = fixed.DEFAULT_DB,
    ranked_rows: int = ranking.RANGE_ROWS,
) -> DataFrame:
    """Prediction texts -> ``predicted_sql, db_id, pair_index``.

    Blank lines are left out, a missing text gets the default statement and
    database, and the rest is numbered from 0 within its run; rows without an id come last.
    """
    kept = rows.filter(F.col(text).isNull() | (lines.strip(F.col(text)) != ""))
    split = kept.withColumns(lines.split_prediction(lines.strip(F.col(text)), default_db))
    by_id = F.col("question_id")
    return ranking.ranged_positions(split.drop(text), [run], by_id, [by_id], "pair_index", ranked_rows)
