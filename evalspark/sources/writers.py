"""Writers of question sets, predictions, metrics, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions import lines
from evalspark.sources.named_files import write_named


# Text of one JSON array, if its writer may choose.
ARRAY_BYTES = 32 << 20


def _csv(writer, path: str) -> None:
    # By default the writer would cut blanks at both ends of a text.
    kept = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    kept.option("header", True).option("escape", '"').csv(path)


def _partitioned(df: DataFrame, columns: list[str]):
    # Rebalancing gathers each folder's rows into few files and splits hot ones.
    return df.hint("rebalance", *[F.col(column) for column in columns]).write.partitionBy(*columns)


def write_by_difficulty(questions: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder per difficulty, in one pass."""
    writer = _partitioned(questions, ["difficulty"]).mode("overwrite")
    _csv(writer, path) if form == "csv" else writer.format(form).save(path)


def write_question_set(question_set: DataFrame, path: str) -> None:
    """A question set as CSV."""
    _csv(question_set.write.mode("overwrite"), path)


def write_questions(questions: DataFrame, path: str) -> None:
    """Questions as JSON lines."""
    questions.write.mode("overwrite").json(path)


def write_question_arrays(questions: DataFrame, path: str, parts: int | None = None, order: str = "question_id") -> None:
    """Questions as JSON arrays, ``part=N/questions.json``; an export for tools that read whole arrays.

    An array is written by one task, line by line, so it may be of any size, and ``read_questions`` reads it in several
    tasks. Unless ``parts`` says otherwise, there are as many arrays as hold some ``ARRAY_BYTES`` of text each.
    """
    if parts is None:
        n_bytes = questions.select(F.sum(F.octet_length(F.concat_ws("", *questions.columns)).cast("bigint"))).first()[0] or 0
        parts = n_bytes // ARRAY_BYTES + 1
    # By all columns: ids may be missing or repeat.
    part = F.pmod(F.xxhash64(*questions.columns), F.lit(parts)).cast("string")
    name = F.concat(F.lit("part="), part, F.lit("/questions.json"))
    line = F.to_json(F.struct(*questions.columns))
    write_named(questions.select(name.alias("path"), F.col(order).alias("ord"), line.alias("line")), path, parts, header="[", between=",", footer="]")


def write_shot_samples(samples: DataFrame, path: str) -> None:
    """Few-shot samples in a folder per shot label, one object ``{db_id: [sample, ...]}`` per line.

    A label names how many samples a database has, so a line is as long as the prompt block it becomes.
    """
    entry = F.struct("ord", F.struct("question", "sql_query", "cot").alias("sample"))
    listed = samples.groupBy("shot", "db_id").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    line = F.to_json(F.create_map("db_id", F.transform("_list", lambda e: e["sample"])))
    _partitioned(listed.select("shot", line.alias("value")), ["shot"]).mode("overwrite").text(path)


def write_gold_lines(pairs: DataFrame, path: str) -> None:
    """Lines ``sql <tab> db_id``; an export, so line breaks and tabs in a statement become blanks."""
    flat = F.translate("gold_sql", "\n\r\t", "   ")
    pairs.select(lines.gold_line(flat, F.col("db_id")).alias("value")).write.mode("overwrite").text(path)


def prediction_maps(predictions: DataFrame, run: str = "run_id", single_map: bool = False) -> DataFrame:
    """``(run, part, value)``: prediction maps as JSON text, keyed by ``pair_index``.

    Each entry is a map of its own, at any number of entries. ``single_map``
    exports a run as one map, in one row, for consumers that read a whole object.
    """
    entry = F.struct(
        "pair_index", lines.prediction_text(F.col("predicted_sql"), F.col("db_id")).alias("text")
    )
    part = F.lit(0) if single_map else F.col("pair_index")
    entries = F.transform(
        F.array_sort("_entries"), lambda e: F.struct(e["pair_index"].cast("string").alias("key"), e["text"].alias("value"))
    )
    return (
        predictions.groupBy(run, part.alias("part"))
        .agg(F.collect_list(entry).alias("_entries"))
        .select(run, "part", F.to_json(F.map_from_entries(entries)).alias("value"))
    )


def write_prediction_maps(predictions: DataFrame, path: str, run: str = "run_id", single_map: bool = False) -> None:
    """Prediction maps, a folder per run and a map per line."""
    maps = prediction_maps(predictions, run, single_map)
    _partitioned(maps.select(run, "value"), [run]).mode("overwrite").text(path)


def write_results_tree(rows: DataFrame, root: str, order: str = "question_id") -> None:
    """Metric rows as ``env/shot/model/N_Instructions/M_Inferences[/K_size]/metrics.csv``, as ``read_metrics`` reads them.

    ``rows`` hold the run's columns ``environment, shot, model, instruction, dataset_length, dataset_size`` and the metric's.
    """
    names = schemas.METRIC.fieldNames()
    path = F.concat_ws("/", lines.result_folder(), F.lit("metrics.csv"))
    line = F.to_csv(F.struct(*names), {"escape": '"'})
    write_named(rows.select(path.alias("path"), F.col(order).alias("ord"), line.alias("line")), root, header=",".join(names))


def write_line_bundle(pairs: DataFrame, root: str, folder: str = "folder", line: str = "line") -> None:
    """``predicted.txt`` and ``gold.txt`` per folder, in step line by line, as ``read_line_bundle`` reads them.

    Line breaks and tabs in a statement become blanks; a missing prediction is an empty line.
    """
    flat = lambda name: F.translate(F.coalesce(name, F.lit("")), "\n\r\t", "   ")
    files = F.array(
        F.struct(F.lit("predicted.txt").alias("name"), flat("predicted_sql").alias("text")),
        F.struct(F.lit("gold.txt").alias("name"), lines.gold_line(flat("gold_sql"), F.col("db_id")).alias("text")),
    )
    each = pairs.select(F.col(folder).alias("folder"), F.col(line).alias("ord"), F.explode(files).alias("file"))
    write_named(each.select(F.concat_ws("/", "folder", "file.name").alias("path"), "ord", F.col("file.text").alias("line")), root)


def write_prediction_map_files(predictions: DataFrame, path: str, run: str = "run_id") -> None:
    """Prediction maps as one JSON object per run, ``run_id=R/predict.json``, written entry by entry."""
    text = lines.prediction_text(F.col("predicted_sql"), F.col("db_id"))
    # An entry is its own map without the braces: Spark writes key and value as JSON needs them.
    entry = F.to_json(F.create_map(F.col("pair_index").cast("string"), text))
    line = F.substring(entry, F.lit(2), F.length(entry) - 2)
    name = F.concat(F.lit(f"{run}="), F.col(run), F.lit("/predict.json"))
    write_named(predictions.select(name.alias("path"), F.col("pair_index").alias("ord"), line.alias("line")), path, header="{", between=",", footer="}")


def append_rows(rows: DataFrame, path: str, dims: list[str], run: str | None = None) -> None:
    """Add predictions or metric rows to a table with the run dimensions as folders.

    With ``run``, the column that names a run, each run has a folder of its own below its
    dimensions, and writing it again replaces it: a repeated job leaves every row once. New folders are staged
    and take their places when all tasks have ended, so a broken job changes nothing.
    """
    if run is None:
        _partitioned(rows, dims).mode("append").parquet(path)
    else:
        _replaced(_partitioned(rows, [*dims, run])).parquet(path)


def _replaced(writer):
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def append_log(records: DataFrame, path: str, batch: str | None = None) -> None:
    """Add log records as JSON lines; a named ``batch`` has a folder of its own and replaces what it has written before.

    A log is written either with batches or without.
    """
    if batch is None:
        records.write.mode("append").json(path)
    else:
        _replaced(records.withColumn("batch", F.lit(batch)).write.partitionBy("batch")).json(path)


def write_report(report: DataFrame, path: str, order: list[str] = ()) -> None:
    """A long or pivoted report as CSV, range-sorted by ``order`` if given: files in name order hold rows in order."""
    _csv((report.orderBy(*order) if order else report).write.mode("overwrite"), path)


def write_buckets(rows: DataFrame, path: str) -> None:
    """Rows in a folder per data set size."""
    _partitioned(rows, ["dataset_size"]).mode("overwrite").parquet(path)
