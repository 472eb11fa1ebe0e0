"""Run grids, few-shot blocks and prompts."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.functions import prompts
from evalspark.operators import ranking
from evalspark.tables import kept

SHOT_KEYS = ["shot", "db_id"]
# Places where a database's texts meet its questions.
_TEXT_SALTS = 16


def _literal(value: str | int) -> str:
    """A SQL literal."""
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def run_spec(specs: DataFrame, column: str = "spec") -> DataFrame:
    """``a=7,9/b=5`` -> rows ``(model_key, instruction)`` next to the other columns."""
    others = [name for name in specs.columns if name != column]
    pairs = specs.select(*others, F.explode(F.split(column, "/")).alias("_item"))
    sizes = F.split(F.substring_index("_item", "=", -1), ",")
    return pairs.select(
        *others, F.substring_index("_item", "=", 1).alias("model_key"), F.explode(sizes).alias("_size")
    ).select(*others, "model_key", F.trim("_size").cast("int").alias("instruction"))


def grid(
    models: list[tuple[str, str]],
    instructions: list[int] = fixed.INSTRUCTION_SIZES,
    shots: list[str] = ("0",),
    lengths: list[int] = (fixed.FULL_SIZE,),
    per_model: dict[str, list[int]] | None = None,
) -> list[tuple]:
    """The runs to make: (environment, model, instruction, shots, length).

    ``per_model`` gives single models their own instruction sizes.
    """
    runs = []
    for environment, model in models:
        sizes = (per_model or {}).get(model, instructions)
        runs += [(environment, model, *rest) for rest in product(sizes, shots, lengths)]
    return runs


def with_runs(questions: DataFrame, runs: list[tuple], partitions: int | None = None) -> DataFrame:
    """Every question once per run, with the run's columns and its ``run_id``.

    The grid is a parameter, so it rides along as an array that each row
    unfolds, without a join. Unfolding multiplies the rows of a task;
    ``partitions`` spreads the questions first, while they are still narrow.
    """
    if partitions:
        questions = questions.repartition(partitions, "question_id")
    names = ["environment", "model", "instruction", "shots", "dataset_length"]
    entries = ", ".join(
        "named_struct({})".format(", ".join(f"'{name}', {_literal(value)}" for name, value in zip(names, run)))
        for run in runs
    )
    unfolded = questions.withColumn("_run", F.explode(F.expr(f"array({entries})"))).select(
        *questions.columns, *[F.col(f"_run.{name}").alias(name) for name in names]
    )
    shot = prompts.shot_label(F.col("shots"))
    model = prompts.path_safe(F.col("model"))
    run_id = F.concat_ws(
        "/", "environment", shot, model,
        F.concat(F.col("instruction").cast("string"), F.lit("_Instructions")),
        F.concat(F.col("dataset_length").cast("string"), F.lit("_Inferences")),
    )
    return unfolded.withColumns({"shot": shot, "run_id": run_id}).drop("shots")


def with_sized_runs(sets: dict[int, DataFrame], runs: list[tuple], partitions: int | None = None) -> DataFrame:
    """As :func:`with_runs`, with a question set per length: a run asks the set of its own length."""
    if missing := sorted({run[-1] for run in runs} - set(sets)):
        raise ValueError(f"no question set of length {missing}")
    parts = [
        with_runs(questions, [run for run in runs if run[-1] == length], partitions)
        for length, questions in sets.items()
        if any(run[-1] == length for run in runs)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_table(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """The grid as a table ``(environment, model, instruction, dataset_length, shot, run_id)``."""
    return with_runs(spark.range(1).toDF("_one"), runs).drop("_one")


def take_shots(pool: DataFrame, shots: list[str]) -> DataFrame:
    """The samples of some shot labels out of a pool: the first n per database, as each label says.

    The pool is ranked once, for the largest n.
    """
    counts = {shot: int(shot.split("_")[0]) for shot in shots}
    first = ranking.first_per_group(pool, ["db_id"], [F.col("ord"), F.col("question")], max(counts.values()))
    labels = F.array(*[F.when(F.col("position") <= count, F.lit(shot)) for shot, count in counts.items()])
    return first.withColumn("shot", F.explode(F.array_compact(labels))).drop("position")


def few_shot_examples(samples: DataFrame) -> DataFrame:
    """``(shot, db_id, examples)``: the samples of a database in order, in the shot's layout.

    A shot label names how many samples a database has, so a group is as long
    as the prompt it becomes.
    """
    values = {name: F.col(name) for name in ("question", "sql_query", "cot")}
    sample = F.when(F.col("shot").contains("cot"), prompts.lay_out(fixed.COT_SAMPLE_LAYOUT, values)).otherwise(
        prompts.lay_out(fixed.SAMPLE_LAYOUT, values)
    )
    laid_out = samples.filter(F.col("shot") != fixed.NO_SHOT).select(*SHOT_KEYS, "ord", sample.alias("_sample"))
    return laid_out.groupBy(*SHOT_KEYS).agg(
        F.concat(
            F.lit(fixed.EXAMPLES_HEAD), F.expr("listagg(_sample, '') WITHIN GROUP (ORDER BY ord, _sample)")
        ).alias("examples")
    )


def with_examples(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """Add ``examples`` by (shot, db_id); no samples give an empty text."""
    return questions.join(examples, SHOT_KEYS, "left").withColumn("examples", F.coalesce("examples", F.lit("")))


def with_late_texts(
    questions: DataFrame, contexts: DataFrame, examples: DataFrame, runs: list[tuple], partitions: int | None = None,
    salts: int = _TEXT_SALTS, missing: str = fixed.NO_DATABASE,
) -> DataFrame:
    """Every question once per run, with ``schema`` and ``examples``, for grids of many runs.

    What moves is each question once, and the texts of each database (its schema, and its examples of all
    shots) once per salt: they meet by (database, salt), where a question is one row, and runs are unfolded
    behind that, without another shuffle. So neither is multiplied by runs or questions before it is used, and
    a hot database is many tasks. The texts are written once, so that their size is known: while they are small, Spark
    broadcasts them, and questions move only to be spread over ``partitions``.
    """
    shots = examples.groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct("shot", "examples"))).alias("_by_shot"))
    texts = kept(contexts.join(shots, "db_id", "full"), "prompt-texts").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = questions.drop("schema").withColumn("_salt", F.pmod(F.xxhash64("question_id"), F.lit(salts)).cast("int"))
    if partitions:
        asked = asked.repartition(partitions, "db_id", "_salt")
    unfolded = with_runs(asked.join(texts, ["db_id", "_salt"], "left").drop("_salt"), runs)
    return unfolded.withColumns({
        "schema": F.coalesce("schema", F.lit(missing)),
        "examples": F.coalesce(F.element_at("_by_shot", F.col("shot")), F.lit("")),
    }).drop("_by_shot")


def family_of(environment: str = "environment", model: str = "model") -> Column:
    """The layout family of a model, from the columns of these names."""
    models: dict[str, list[str]] = {}
    for env, name, family in fixed.MODEL_FAMILIES:
        models.setdefault(family, []).append(f"({_literal(env)}, {_literal(name)})")
    cases = " ".join(
        f"WHEN ({environment}, {model}) IN ({', '.join(members)}) THEN '{family}'" for family, members in models.items()
    )
    return F.expr(f"CASE {cases} ELSE 'plain' END")


def prompt_values() -> dict[str, Column]:
    """The values a prompt is made of, from columns of the question rows."""
    return {
        "instructions": prompts.instructions(F.col("instruction")),
        "question": F.col("question"),
        "hint": F.coalesce(F.col("evidence"), F.lit("")),
        "context": F.col("schema"),
        "examples": F.col("examples"),
    }


def with_prompts(questions: DataFrame) -> DataFrame:
    """Add ``family`` and the ``prompt`` text in the layout of each row's model."""
    return questions.withColumn("family", family_of()).withColumn(
        "prompt", prompts.prompt_text(F.col("family"), prompt_values())
    )


def with_messages(questions: DataFrame) -> DataFrame:
    """Add ``family`` and the chat ``messages``."""
    return questions.withColumn("family", family_of()).withColumn(
        "messages", prompts.chat_messages(F.col("family"), prompt_values())
    )
