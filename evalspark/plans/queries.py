"""One query per operator, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark.functions import durations, lines, prompts, replies as reply_functions
from evalspark.operators import accuracy, context, inference, matching, metrics, replies, reports, sampling, scoring
from evalspark.operators import prompts as prompt_operators
from evalspark.plans import views
from evalspark.plans.clients import CountingClient
from evalspark.session import new_table_path, pin_utc
from evalspark.sources import readers, writers
from evalspark.streaming.resume import answer_stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Grid of the registered prompt queries: one model for each layout of an environment.
GRID_MODELS = [
    (environment, model)
    for (environment, _), model in {(env, family): model for env, model, family in reversed(fixed.MODEL_FAMILIES)}.items()
]
# The environments and models of the metric view.
METRIC_MODELS = [
    ("CodeLlama-34b-Instruct-hf", "self-hosted"),
    ("gpt-4-turbo-preview", "open-ai"),
    ("gpt-3.5-turbo-16k", "open-ai"),
    ("claude-3-haiku-20240307", "anthropic"),
]
SIZED_KEYS = [*metrics.RUN_KEYS, "dataset_size"]


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(pin_utc(spark), sf_dir)

    REGISTRY[query.__name__] = run
    return query


def _round(*names: str, digits: int = 6) -> dict[str, Column]:
    return {name: F.bround(name, digits) for name in names}


# --- metrics and reports ---------------------------------------------------


@registered
def duration_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metric_rows(spark, sf_dir)
    return rows.select("question_id", "response_time", durations.duration_seconds(F.col("response_time")).alias("seconds"))


@registered
def elapsed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metric_rows(spark, sf_dir)
    seconds = durations.duration_seconds(F.col("response_time")) * 61
    return rows.select("question_id", durations.elapsed_label(seconds).alias("elapsed"))


@registered
def response_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.col("ts").cast("timestamp")
    stopped = F.timestamp_micros(F.unix_micros(started) + F.round(F.col("value") * 1_000_000).cast("bigint"))
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        durations.response_seconds(started, stopped).alias("seconds"),
        durations.log_time(started).alias("response_time_start"),
        durations.log_time(stopped).alias("response_time_stop"),
    )


@registered
def metrics_by_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_by_hardness(views.metric_rows(spark, sf_dir)).withColumns(
        _round("usable_seconds", "latency", "throughput", "psr")
    )


@registered
def cost_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.metrics_by_hardness(views.metric_rows(spark, sf_dir))
    priced = metrics.cost_api(wide, metrics.price_list(spark))
    return priced.select(*metrics.RUN_KEYS, "hardness", F.bround("api_cost", 6).alias("api_cost"))


@registered
def cost_self_hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.cost_self_hosted(metrics.metrics_by_hardness(views.metric_rows(spark, sf_dir)))
    return wide.select(*metrics.RUN_KEYS, "hardness", F.bround("hosting_cost", 6).alias("hosting_cost"))


def _long_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.with_cost(
        metrics.metrics_by_hardness(views.metric_rows(spark, sf_dir)), metrics.price_list(spark)
    ).withColumn("dataset_size", F.lit(fixed.FULL_SIZE))
    return reports.metrics_long(wide, SIZED_KEYS)


@registered
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_report(spark, sf_dir).withColumns(_round("value"))


@registered
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.model_names(_long_report(spark, sf_dir), reports.short_names(spark)).withColumns(_round("value"))


@registered
def cost_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost_total(_long_report(spark, sf_dir)).withColumns(_round("value"))


@registered
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_metrics(_long_report(spark, sf_dir))


@registered
def pivot_metrics_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_metrics_transposed(_long_report(spark, sf_dir), METRIC_MODELS)


@registered
def pivot_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_cost(_long_report(spark, sf_dir))


@registered
def distinct_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_dims(views.metric_rows(spark, sf_dir))


def _bucketed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metric_rows(spark, sf_dir)
    return sampling.bucket_rows(rows, sampling.question_buckets(rows, "hardness"))


@registered
def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed_metrics(spark, sf_dir).select("question_id", "hardness", "response_time", "dataset_size")


@registered
def bucket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_by_hardness(_bucketed_metrics(spark, sf_dir), SIZED_KEYS).withColumns(
        _round("usable_seconds", "latency", "throughput", "psr")
    )


@registered
def path_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.metric_rows(spark, sf_dir)
    q = F.col("question_id")
    path = F.concat(
        F.lit("file:/results/"), F.col("environment"), F.lit("/"), (q % 5).cast("string"),
        F.when(q % 2 == 0, "_shot").otherwise("_shot_cot"), F.when(q % 3 == 0, "/org/").otherwise("/"),
        F.col("model"), F.lit("/"), F.col("instruction").cast("string"), F.lit("_Instructions/360_Inferences/"),
        F.when(q % 4 == 0, "60_size/").otherwise(""), F.lit("metrics.csv"),
    )
    paths = rows.select("question_id", path.alias("path"))
    return paths.withColumns(lines.path_dimensions(F.col("path"))).drop("path")


# --- replies ---------------------------------------------------------------


@registered
def sql_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.reply_rows(spark, sf_dir)
    return rows.select(
        "question_id",
        reply_functions.sql_extract(F.col("reply")).alias("sql_text"),
        reply_functions.sql_extract(F.col("reply"), keep_with=True).alias("sql_with"),
    )


@registered
def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.with_outcome(views.reply_rows(spark, sf_dir)).drop("reply", "error")


@registered
def reply_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, text = F.col("question_id"), F.col("reply")
    prompt, response = (q + 10).alias("a"), (q + 20).alias("b")

    def body(**parts: Column) -> Column:
        return F.to_json(F.struct(*[part.alias(name) for name, part in parts.items()]))

    headers = F.struct(
        prompt.cast("string").alias("x-amzn-bedrock-input-token-count"),
        response.cast("string").alias("x-amzn-bedrock-output-token-count"),
    )
    bodies = {
        "choices": body(
            choices=F.array(F.struct(F.struct(text.alias("content")).alias("message"))),
            usage=F.struct(prompt.alias("prompt_tokens"), response.alias("completion_tokens")),
        ),
        "content": body(
            content=F.array(F.struct(text.alias("text"))),
            usage=F.struct(prompt.alias("input_tokens"), response.alias("output_tokens")),
        ),
        "completion": body(completion=text, headers=headers),
        "outputs": body(outputs=F.array(F.struct(text.alias("text"))), headers=headers),
        "generation": body(generation=text, headers=headers),
        "generated_text": F.to_json(F.array(F.struct(text.alias("generated_text")))),
    }
    shape, whole = None, None
    for number, (name, value) in enumerate(bodies.items()):
        here = q % len(bodies) == number
        shape = F.when(here, name) if shape is None else shape.when(here, name)
        whole = F.when(here, value) if whole is None else whole.when(here, value)
    rows = views.reply_rows(spark, sf_dir).select("question_id", shape.alias("shape"), whole.alias("body"))
    return replies.with_provider_reply(rows).drop("body")


@registered
def log_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = replies.with_outcome(views.reply_rows(spark, sf_dir))
    written = outcomes.select(F.to_json(F.struct("severity", "is_sql", "message", F.col("reply").alias("response"))).alias("line"))
    records = written.select(F.from_json("line", schemas.LOG_RECORD).alias("r")).select("r.*")
    return replies.log_status_counts(records)


@registered
def gold_line_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.question_rows(spark, sf_dir)
    return rows.select("question_id", lines.gold_line(F.col("sql_query"), F.col("db_id")).alias("line"))


@registered
def gold_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold_line_render(spark, sf_dir)
    return rows.select("question_id", *[c.alias(n) for n, c in lines.split_gold_line(F.col("line")).items()])


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question_id")
    text = F.concat(F.lit("  "), lines.prediction_text(F.col("sql_query"), F.col("db_id")), F.lit("\n"))
    rows = views.question_rows(spark, sf_dir).select(
        (q % 3).cast("string").alias("run_id"), "question_id",
        F.when(q % 7 == 0, "\n").when(q % 7 == 6, F.lit(None)).otherwise(text).alias("prediction"),
    )
    return replies.parse_predictions(rows)


@registered
def prediction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir)


@registered
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = replies.with_outcome(views.reply_rows(spark, sf_dir)).select("question_id", "predicted_sql")
    gold = views.question_rows(spark, sf_dir).select("question_id", "db_id", F.col("sql_query").alias("gold_sql"))
    return accuracy.pair_join(predicted, gold)


# --- question sets and prompts ----------------------------------------------


@registered
def difficulty_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sampling.keep_levels(views.question_rows(spark, sf_dir))
    return kept.select("question_id", "difficulty", "db_id", "sql_query")


@registered
def head_per_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_per_difficulty(views.question_rows(spark, sf_dir), 360)


@registered
def equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = sampling.exclude_schemas(views.question_rows(spark, sf_dir))
    return sampling.equal_split(usable, 360, seed=7)


@registered
def exclude_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exclude_schemas(views.question_rows(spark, sf_dir)).select("question_id", "schema")


@registered
def db_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema_texts = context.db_context(views.schema_catalog(spark, sf_dir))
    return context.with_context(views.question_rows(spark, sf_dir), schema_texts).select("question_id", "db_id", "schema")


@registered
def run_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    spec = F.concat(
        F.lit("m"), user, F.lit("="), (event % 12).cast("string"), F.lit(","), (event % 5).cast("string"),
        F.lit("/"), F.col("event_type"), F.lit("="), (event % 7).cast("string"),
    )
    specs = views.table(spark, sf_dir, "events").select("event_id", spec.alias("spec"))
    return prompt_operators.run_spec(specs)


@registered
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = prompt_operators.grid(
        [("open-ai", "gpt-4-turbo-preview"), ("amazon-bedrock", "mistral.mixtral-8x7b-instruct-v0:1")],
        [0, 11], ["0", "4-cot"], [360], {"gpt-4-turbo-preview": [5]},
    )
    questions = views.question_rows(spark, sf_dir).select("question_id", "db_id")
    return prompt_operators.with_runs(questions, runs)


@registered
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = ("open-ai", "gpt-4-turbo-preview", 5, "0", 360), ("open-ai", "gpt-3.5-turbo-16k", 5, "0", 360)
    questions = views.question_rows(spark, sf_dir).select("question_id")
    prompts_df = prompt_operators.with_runs(questions, [first, second]).select("run_id", "question_id")
    # The first run has answered the labelled documents, the second those of good quality.
    labels = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "quality")
    answered = (
        prompt_operators.with_runs(views.reply_rows(spark, sf_dir).join(labels, "question_id"), [first, second])
        .filter((F.col("model") == first[1]) | (F.col("quality") == 1))
    )
    return replies.pending(prompts_df, answered, retry_errors=True)


@registered
def instruction_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = prompt_operators.grid([("open-ai", "gpt-4-turbo-preview")])
    rows = prompt_operators.with_runs(views.question_rows(spark, sf_dir).select("question_id"), runs)
    return rows.select("question_id", "instruction", prompts.system_prompt(F.col("instruction")).alias("system_prompt"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = prompt_operators.take_shots(views.shot_rows(spark, sf_dir), ["2_shot", "4_shot_cot"])
    return prompt_operators.few_shot_examples(samples)


@registered
def few_shot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.when(F.col("question_id") % 3 == 0, "0_shot").when(F.col("question_id") % 3 == 1, "2_shot").otherwise("4_shot_cot")
    rows = views.question_rows(spark, sf_dir).select("question_id", "db_id", shot.alias("shot"))
    return prompt_operators.with_examples(rows, _examples(spark, sf_dir))


def _prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question for every model of the grid; the instruction size goes by the question."""
    runs = prompt_operators.grid(GRID_MODELS, [0], ["2"])
    contexts = context.db_context(views.schema_catalog(spark, sf_dir))
    questions = views.question_rows(spark, sf_dir)
    # As many files as cores are read by enough tasks: their texts need not move.
    spread = spark.sparkContext.defaultParallelism
    asked = prompt_operators.with_late_texts(
        questions, contexts, _examples(spark, sf_dir), runs, spread if len(questions.inputFiles()) < spread else None,
    )
    sizes = F.array(*[F.lit(size) for size in fixed.INSTRUCTION_SIZES])
    return asked.withColumn("instruction", F.get(sizes, (F.col("question_id") % 5).cast("int")))


@registered
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_operators.with_prompts(_prompt_rows(spark, sf_dir)).select(
        "environment", "model", "family", "question_id", "prompt"
    )


@registered
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = prompt_operators.with_messages(_prompt_rows(spark, sf_dir)).filter(F.col("family").isin("chat", "user_chat"))
    return chats.select(
        "environment", "model", "question_id",
        F.concat_ws("\n--\n", F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))).alias("chat"),
    )


@registered
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_body = F.col("environment").isin(fixed.BEDROCK, fixed.HOSTED_ENDPOINT)
    rows = prompt_operators.with_prompts(_prompt_rows(spark, sf_dir)).filter(with_body)
    body = prompts.request_body(F.col("family"), F.col("prompt"))
    parsed = F.parse_json("body")

    def either(kind: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(parsed, path, kind) for path in paths])

    prompt = either("string", "$.prompt", "$.inputs", "$.messages[0].content[0].text")
    limit = either("int", "$.max_tokens", "$.max_tokens_to_sample", "$.parameters.max_new_tokens")
    return rows.withColumn("body", body).select(
        "model", "question_id", F.length(prompt).alias("prompt_length"), limit.alias("token_limit")
    )


# --- matching and accuracy ---------------------------------------------------


@registered
def result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_results(views.result_cells(spark, sf_dir))


@registered
def result_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_results(views.result_cells(spark, sf_dir), exact=True)


@registered
def result_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_rows(views.result_rows(spark, sf_dir))


@registered
def result_match_row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Predicted columns are swapped; put them in gold order to compare rows.
    cells = views.result_cells(spark, sf_dir).withColumn(
        "col_pos", F.when(F.col("side") == "predicted", 1 - F.col("col_pos")).otherwise(F.col("col_pos"))
    )
    return matching.match_results(cells, mode="rows")


@registered
def accuracy_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = accuracy.with_difficulty(views.score_rows(spark, sf_dir), views.question_rows(spark, sf_dir))
    return accuracy.accuracy_by_difficulty(scores, ["model"]).withColumns(_round("accuracy"))


@registered
def accuracy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = views.question_rows(spark, sf_dir)
    scores = accuracy.with_difficulty(views.score_rows(spark, sf_dir), questions)
    sized = sampling.bucket_rows(scores, sampling.question_buckets(questions))
    return accuracy.accuracy_by_difficulty(sized, ["dataset_size"]).withColumns(_round("accuracy"))


@registered
def consolidated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and accuracy of all models in one long report."""
    measured = _long_report(spark, sf_dir).select("environment", "model", "instruction", "hardness", "metric", "value")
    scores = accuracy.with_difficulty(views.score_rows(spark, sf_dir), views.question_rows(spark, sf_dir))
    right = accuracy.accuracy_report(accuracy.accuracy_by_difficulty(scores, ["model"]), ["model"])
    return sampling.append_frames(measured, right).withColumns(_round("value"))


# --- files: written, then read back through the readers ------------------------


@registered
def question_set_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "question-set")
    writers.write_question_set(equal_split(spark, sf_dir), path)
    return readers.read_question_set(spark, path, indexed=False)


@registered
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "questions")
    rows = views.question_rows(spark, sf_dir).withColumnRenamed("sql_query", "SQL").drop("schema")
    writers.write_questions(rows, path)
    return readers.read_questions(spark, path, array=False)


@registered
def difficulty_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "by-difficulty")
    writers.write_by_difficulty(difficulty_split(spark, sf_dir), path)
    split = sampling.split_by_difficulty(spark.read.parquet(path))
    return sampling.append_frames(*split.values())


@registered
def gold_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "gold")
    writers.write_gold_lines(views.question_rows(spark, sf_dir).withColumnRenamed("sql_query", "gold_sql"), path)
    return readers.read_gold_lines(spark, path)


@registered
def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "predictions")
    writers.write_prediction_maps(_predictions(spark, sf_dir), path)
    entries = readers.read_prediction_map(spark, path, per_line=True)
    return entries.withColumn("run_id", F.regexp_extract("path", "run_id=([^/]+)/", 1)).drop("path")


@registered
def log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "log")
    outcomes = replies.with_outcome(views.reply_rows(spark, sf_dir))
    writers.append_log(outcomes.select("severity", "is_sql", "message", F.col("reply").alias("response")), path)
    return readers.read_log(spark, path).select("severity", "is_sql", "message", "response")


@registered
def metric_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "metrics")
    rows = views.metric_rows(spark, sf_dir).withColumns({"shot": F.lit("0_shot"), "run_id": F.lit("r")})
    writers.append_rows(rows, path, ["environment", "model", "instruction", "shot"])
    return metrics.metrics_by_hardness(readers.read_partitioned_metrics(spark, path)).withColumns(
        _round("usable_seconds", "latency", "throughput", "psr")
    )


@registered
def bucket_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "buckets")
    writers.write_buckets(_bucketed_metrics(spark, sf_dir).select("question_id", "hardness", "dataset_size"), path)
    return spark.read.schema("question_id bigint, hardness string, dataset_size int").parquet(path)


@registered
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "report")
    columns = schemas.LONG_METRICS.fieldNames()
    writers.write_report(_long_report(spark, sf_dir).select(*columns), path)
    return reports.pivot_metrics(readers.read_long_metrics(spark, path))


# --- actions -----------------------------------------------------------------


def _client() -> CountingClient:
    return CountingClient()


def _simple_prompts(questions: DataFrame) -> DataFrame:
    return questions.select(
        F.col("db_id").alias("run_id"), "question_id",
        F.concat(F.lit("Question: "), F.col("question"), F.lit(" Hint: "), F.coalesce("evidence", F.lit(""))).alias("prompt"),
    )


@registered
def infer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inference.infer(_simple_prompts(views.question_rows(spark, sf_dir)), _client)
    return raw.select("run_id", "question_id", "text", "prompt_tokens", "response_tokens", "error")


@registered
def stream_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, so that the table may be one file or a folder of files.
    documents = spark.readStream.schema(views.SCHEMAS["documents"]).parquet(f"{sf_dir}/documents.parquet*")
    path = new_table_path(spark, "replies")
    query = answer_stream(
        _simple_prompts(views.questions_of(documents)), _client, path, new_table_path(spark, "replies-checkpoint"), by_batch=True
    )
    query.awaitTermination()
    return inference.read_replies(spark, path).select(
        "run_id", "question_id", "text", "prompt_tokens", "response_tokens", "error"
    )


@registered
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair per nation; gold and predicted both scan the customers."""
    nation = F.col("n_nationkey")
    where = F.concat(F.lit(" FROM customer WHERE c_nationkey = "), nation.cast("string"))
    predicted = (
        F.when(nation % 5 == 0, F.concat(F.lit("SELECT c_acctbal AS a, c_custkey AS b"), where))
        .when(nation % 5 == 1, F.concat(F.lit("SELECT c_custkey, c_acctbal"), where, F.lit(" AND c_acctbal > 0")))
        .when(nation % 5 == 2, F.concat(F.lit("SELECT c_custkey, no_such_column"), where))
        .when(nation % 5 == 3, F.lit("DELETE FROM customer"))
        .otherwise(F.concat(F.lit("SELECT c_custkey, c_acctbal"), where, F.lit(" AND c_mktsegment <> 'BUILDING'")))
    )
    pairs = views.table(spark, sf_dir, "nation").select(
        nation.cast("bigint").alias("pair_id"), F.lit("shop").alias("db_id"), predicted.alias("predicted_sql"),
        F.concat(F.lit("SELECT c_custkey, c_acctbal"), where).alias("gold_sql"),
    )

    def prepare(session: SparkSession, _: str) -> None:
        views.table(session, sf_dir, "customer").createOrReplaceTempView("customer")

    return scoring.score_sql(spark, pairs, prepare=prepare, parallelism=8, batch=16)


@registered
def score_many_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair per supplier with statements of its own over the orders: many more pairs than jobs."""
    key = F.col("s_suppkey")
    where = F.concat(F.lit(" FROM orders WHERE o_custkey % 977 = "), key.cast("string"), F.lit(" % 977"))
    predicted = (
        F.when(key % 4 == 0, F.concat(F.lit("SELECT o_totalprice * 1, o_orderkey AS k"), where, F.lit(" ORDER BY 1")))
        .when(key % 4 == 1, F.concat(F.lit("SELECT o_orderkey, o_totalprice"), where, F.lit(" AND o_totalprice > 50000")))
        .when(key % 4 == 2, F.concat(F.lit("SELECT o_orderkey, o_total"), where))
        .otherwise(F.concat(F.lit("WITH o AS (SELECT *"), where, F.lit(") SELECT o_orderkey, o_totalprice FROM o")))
    )
    pairs = views.table(spark, sf_dir, "supplier").select(
        key.cast("bigint").alias("pair_id"), F.lit("shop").alias("db_id"), predicted.alias("predicted_sql"),
        F.concat(F.lit("SELECT o_orderkey, o_totalprice"), where).alias("gold_sql"),
    )

    def prepare(session: SparkSession, _: str) -> None:
        views.table(session, sf_dir, "orders").createOrReplaceTempView("orders")

    return scoring.score_sql(spark, pairs, prepare=prepare)
