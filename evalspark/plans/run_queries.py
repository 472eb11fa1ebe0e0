"""Registered queries over whole runs, from grid to report, and over the files of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark.functions import lines, prompts as prompt_functions, replies as reply_functions
from evalspark.operators import accuracy, context, inference, metrics, prompts, replies, reports, sampling
from evalspark.plans import queries, views
from evalspark.plans.queries import registered
from evalspark.session import new_table_path
from evalspark.sources import readers, writers

ALL_MODELS = [(environment, model) for environment, model, _ in fixed.MODEL_FAMILIES]
RUN = ["environment", "model", "instruction", "shot", "dataset_length"]
GRID_KEYS = ["environment", "model", "instruction", "shot", "question_id"]
ACCURACY_KEYS = ["environment", "model", "instruction", "shot", "dataset_size"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark question for every model, instruction size and two shots, with its texts."""
    runs = prompts.grid(ALL_MODELS, fixed.INSTRUCTION_SIZES, ["2", "4-cot"])
    contexts = context.db_context(views.schema_catalog(spark, sf_dir))
    return prompts.with_late_texts(
        views.benchmark_questions(spark, sf_dir), contexts, queries._examples(spark, sf_dir), runs, spark.sparkContext.defaultParallelism,
    )


@registered
def prompt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every question in every run, as a digest of its text."""
    return prompts.with_prompts(_asked(spark, sf_dir)).select(*GRID_KEYS, "family", F.md5("prompt").alias("prompt_md5"))


@registered
def chat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every question in every run of a chat model, as digests."""
    chats = prompts.with_messages(_asked(spark, sf_dir)).filter(F.col("family").isin("chat", "user_chat"))
    turns = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return chats.select(*GRID_KEYS, F.md5(F.concat_ws("\n--\n", turns)).alias("chat_md5"))


@registered
def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the request bodies of every run whose endpoint takes one; prompts as digests."""
    rows = prompts.with_prompts(_asked(spark, sf_dir)).filter(F.col("environment").isin(fixed.BEDROCK, fixed.HOSTED_ENDPOINT))
    body = F.parse_json(prompt_functions.request_body(F.col("family"), F.col("prompt")))
    field = lambda kind, *paths: F.coalesce(*[F.try_variant_get(body, path, kind) for path in paths])
    return rows.select(
        *GRID_KEYS,
        F.md5(field("string", "$.prompt", "$.inputs", "$.messages[0].content[0].text")).alias("prompt_md5"),
        field("int", "$.max_tokens", "$.max_tokens_to_sample", "$.parameters.max_new_tokens").alias("token_limit"),
        F.array_join(field("array<string>", "$.parameters.stop"), "|").alias("stops"),
        field("string", "$.anthropic_version").alias("version"), field("string", "$.messages[0].role").alias("role"),
        field("string", "$.messages[0].content[0].type").alias("content_type"),
    )


@registered
def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, prompts, replies, outcomes, metrics, cost and short names of every model over the benchmark."""
    runs = prompts.grid(ALL_MODELS, fixed.INSTRUCTION_SIZES, ["2", "4-cot"])
    asked = prompts.with_prompts(_asked(spark, sf_dir))
    path = new_table_path(spark, "pipeline-replies")
    answered = inference.infer_into(asked, queries._client, path)
    # The stand-in client answers at once; a reply takes a time that its prompt gives.
    answered = answered.withColumns({
        "started": F.timestamp_seconds(F.lit(0)), "stopped": F.timestamp_micros(F.col("prompt_tokens") % 97 * 250_000),
    })
    questions = views.benchmark_questions(spark, sf_dir).select("question_id", "difficulty")
    outcomes = replies.with_outcome(answered, "text").join(prompts.run_table(spark, runs), "run_id").join(questions, "question_id")
    wide = metrics.metrics_by_hardness(replies.metric_rows(outcomes, with_run=True), RUN)
    named = reports.model_names(metrics.with_cost(wide, metrics.price_list(spark)), reports.short_names(spark))
    return named.withColumns(queries._round("usable_seconds", "latency", "throughput", "psr", "cost"))


@registered
def run_grid_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lengths, each over the question set of its length."""
    questions = views.question_rows(spark, sf_dir)
    sets = {size: sampling.head_per_difficulty(questions, size).select("question_id") for size in (60, 360)}
    runs = prompts.grid([("open-ai", "gpt-4-turbo-preview")], [0, 11], ["0"], [60, 360])
    return prompts.with_sized_runs(sets, runs)


@registered
def head_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_per_difficulty(views.question_rows(spark, sf_dir), 4500).select("question_id", "difficulty", "question")


@registered
def pivot_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with every instruction size from 0 to 11."""
    rows = views.metric_rows(spark, sf_dir).withColumn("instruction", (F.col("question_id") % 12).cast("int"))
    wide = metrics.with_cost(metrics.metrics_by_hardness(rows), metrics.price_list(spark))
    long = reports.metrics_long(wide.withColumn("dataset_size", F.lit(fixed.FULL_SIZE)), queries.SIZED_KEYS)
    return reports.pivot_metrics(long)


@registered
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in replies that hold whole documents before, between and behind them."""
    rows = views.long_replies(spark, sf_dir)
    return rows.select("question_id", reply_functions.sql_extract(F.col("reply")).alias("sql_text"),
                       reply_functions.mentions_select(F.col("reply")).alias("answered"))


@registered
def database_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.question_rows(spark, sf_dir)
    return rows.select("question_id", lines.database_name(F.col("db_id"), "eval_").alias("database"))


# --- files -------------------------------------------------------------------


@registered
def question_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "question-arrays")
    rows = views.question_rows(spark, sf_dir).withColumnRenamed("sql_query", "SQL").drop("schema")
    writers.write_question_arrays(rows, path)
    return readers.read_questions(spark, f"{path}/part=*", part_bytes=1 << 18)


@registered
def shot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "shots")
    samples = prompts.take_shots(views.shot_rows(spark, sf_dir), ["2_shot", "4_shot_cot"])
    writers.write_shot_samples(samples, path)
    return readers.read_shot_samples(spark, path, per_line=True)


@registered
def log_record_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full log record, with whole documents as requests."""
    path = new_table_path(spark, "log-records")
    started = F.col("question_id") * 60
    asked = views.question_rows(spark, sf_dir).select("question_id", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("messages"))
    rows = views.reply_rows(spark, sf_dir).join(asked, "question_id").withColumns({
        "environment": F.lit("open-ai"), "model": F.lit("gpt-4-turbo-preview"), "instruction": F.lit(5), "dataset_length": F.lit(fixed.FULL_SIZE),
        "started": F.timestamp_seconds(started), "stopped": F.timestamp_seconds(started + 5), "text": F.col("reply"),
    })
    writers.append_log(replies.log_records(replies.with_outcome(rows)), path)
    request = F.concat_ws("\n", F.transform("request", lambda m: F.concat(m["role"], F.lit(": "), m["content"])))
    return readers.read_log(spark, path).withColumn("request", request)


def _accuracy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of runs at every data set size, in the columns of the consolidated report."""
    questions = views.question_rows(spark, sf_dir)
    scores = accuracy.with_difficulty(views.run_scores(spark, sf_dir), questions)
    sized = sampling.bucket_rows(scores, sampling.question_buckets(questions))
    found = accuracy.accuracy_report(accuracy.accuracy_by_difficulty(sized, ACCURACY_KEYS), ACCURACY_KEYS)
    return found.select(*schemas.LONG_ACCURACY.fieldNames())


@registered
def accuracy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "accuracy")
    writers.write_report(_accuracy_rows(spark, sf_dir), path, order=[*ACCURACY_KEYS, "hardness"])
    return readers.read_long_accuracy(spark, path).withColumns(queries._round("value"))


def _pivot_file(spark: SparkSession, pivot: DataFrame, name: str) -> DataFrame:
    path = new_table_path(spark, name)
    writers.write_report(pivot, path, order=["model", "environment"])
    return readers.read_pivot(spark, path, pivot.schema)


@registered
def pivot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivot_file(spark, reports.pivot_metrics(queries._long_report(spark, sf_dir)), "pivot")


@registered
def pivot_cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = _pivot_file(spark, reports.pivot_cost_total(queries._long_report(spark, sf_dir)), "pivot-cost")
    return pivot.withColumns(queries._round(*[name for name, kind in pivot.dtypes if kind == "double"]))


@registered
def results_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric files under the names of their runs, found again by their paths."""
    path = new_table_path(spark, "results")
    q = F.col("question_id")
    rows = views.metric_rows(spark, sf_dir).withColumns({
        "shot": F.when(q % 2 == 0, "0_shot").otherwise("4_shot_cot"), "dataset_length": F.lit(fixed.FULL_SIZE),
        "dataset_size": F.when(q % 4 == 1, 60).otherwise(fixed.FULL_SIZE),
    })
    writers.write_results_tree(rows, path)
    return readers.read_metrics(spark, path).drop("path")


@registered
def line_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and gold lines of three runs; blank predictions leave their pair out."""
    path = new_table_path(spark, "bundle")
    q = F.col("question_id")
    pairs = views.question_rows(spark, sf_dir).select(
        F.concat(F.lit("run/"), (q % 3).cast("string")).alias("folder"), q.alias("line"), "db_id", F.col("sql_query").alias("gold_sql"),
        F.when(q % 7 != 0, F.concat(F.col("sql_query"), F.lit("\n\tLIMIT "), (q % 5).cast("string"))).alias("predicted_sql"),
    )
    writers.write_line_bundle(pairs, path)
    run = F.regexp_extract("folder", "run/([^/]+)$", 1)
    return readers.read_line_bundle(spark, path).withColumn("folder", run)


@registered
def run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the first of them written a second time: every row is there once."""
    path = new_table_path(spark, "run-store")
    dims = ["environment", "model", "instruction", "shot"]
    rows = views.metric_rows(spark, sf_dir).withColumns({"shot": F.lit("0_shot"), "run_id": F.concat(F.lit("r"), (F.col("question_id") % 2).cast("string"))})
    for some in (rows, rows.filter("run_id = 'r0'")):
        writers.append_rows(some, path, dims, run="run_id")
    return readers.read_partitioned_metrics(spark, path).select("run_id", "question_id", "environment", "model", "instruction", "response_time", "hardness")


@registered
def log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of two batches, each written twice, counted."""
    path = new_table_path(spark, "log-batches")
    outcomes = replies.with_outcome(views.reply_rows(spark, sf_dir))
    records = outcomes.select("question_id", "severity", "is_sql", "message", F.col("reply").alias("response"))
    for number in (0, 1, 0, 1):
        writers.append_log(records.filter(F.col("question_id") % 2 == number).drop("question_id"), path, batch=f"b{number}")
    return replies.log_status_counts(readers.read_log(spark, path))


@registered
def prediction_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction map per run, read back in parts."""
    path = new_table_path(spark, "prediction-maps")
    writers.write_prediction_map_files(queries._predictions(spark, sf_dir), path)
    entries = readers.read_prediction_map(spark, f"{path}/run_id=*", part_bytes=1 << 14)
    return entries.withColumn("run_id", F.regexp_extract("path", "run_id=([^/]+)/", 1)).drop("path")
