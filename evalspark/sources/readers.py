"""Readers of every input file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas
from evalspark.functions import lines
from evalspark.sources.json_parts import PART_BYTES, read_elements


def _csv(spark: SparkSession, schema: T.StructType):
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')


def read_questions(spark: SparkSession, path: str, array: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """Source questions from JSON arrays, or from one object per line with ``array=False``.

    An array of any size is read in parts of ``part_bytes`` by several tasks.
    """
    if array:
        texts = read_elements(spark, path, part_bytes)
        rows = texts.select(F.from_json("value", schemas.SOURCE_QUESTION).alias("q")).select("q.*")
    else:
        rows = spark.read.schema(schemas.SOURCE_QUESTION).json(path)
    return rows.withColumnRenamed("SQL", "sql_query")


def read_question_set(spark: SparkSession, path: str, indexed: bool = True) -> DataFrame:
    """A question-set CSV, with a leading unnamed index column if ``indexed``.

    Texts hold line breaks, so a file is not split; keep large sets as Parquet.
    """
    schema = schemas.QUESTION_SET if indexed else T.StructType(schemas.QUESTION_SET.fields[1:])
    return _csv(spark, schema).option("multiLine", True).csv(path)


def read_schema_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Table texts per database, one JSON object per line."""
    return spark.read.schema(schemas.SCHEMA_CATALOG).json(path)


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All ``metrics.csv`` files under a results tree, with the run dimensions of their paths."""
    reader = _csv(spark, schemas.METRIC).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.csv")
    files = reader.csv(root).select("*", F.col("_metadata.file_path").alias("path"))
    return files.withColumns(lines.path_dimensions(F.col("path")))


def read_partitioned_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows written by this library: run dimensions are partition columns, pruned before reading."""
    dims = [
        T.StructField("environment", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("instruction", T.IntegerType()), T.StructField("shot", T.StringType()),
    ]
    keyed = [T.StructField("run_id", T.StringType()), T.StructField("question_id", T.LongType())]
    return spark.read.schema(T.StructType([*keyed, *schemas.METRIC.fields, *dims])).parquet(path)


def read_long_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated metrics report."""
    return _csv(spark, schemas.LONG_METRICS).csv(path)


def read_long_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated accuracy report."""
    return _csv(spark, schemas.LONG_ACCURACY).csv(path)


def read_pivot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A pivoted report; its columns go by the values it shows, so the schema is the caller's."""
    return _csv(spark, schema).csv(path)


def _whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if glob:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def read_shot_samples(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Few-shot samples ``(shot, db_id, ord, question, sql_query, cot)``.

    One JSON object per shot label, in a file whose name holds the label. With
    ``per_line`` a folder ``shot=label`` has one object per line, for any number
    of databases.
    """
    if per_line:
        texts = spark.read.schema("value string, shot string").text(path)
    else:
        texts = _whole_files(spark, path).withColumn("shot", F.regexp_extract("path", r"(\d+_shot(?:_cot)?)[^/]*$", 1))
    files = texts.select("shot", F.from_json("value", schemas.SHOT_FILE).alias("samples"))
    databases = files.select("shot", F.explode("samples").alias("db_id", "list"))
    return databases.select("shot", "db_id", F.posexplode("list").alias("ord", "sample")).select(
        "shot", "db_id", "ord", "sample.*"
    )


def read_gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(gold_sql, db_id)`` from lines ``sql <tab> db_id``; blank lines are left out."""
    kept = spark.read.text(path).filter(lines.strip(F.col("value")) != "")
    return kept.select(*[column.alias(name) for name, column in lines.split_gold_line(F.col("value")).items()])


def _prediction_entries(text: Column) -> Column:
    # A value that is not a string arrives as NULL through the variant cast.
    parsed = F.parse_json(text).cast("map<string,variant>")
    return F.transform_values(
        parsed, lambda _, value: F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))
    )


def read_prediction_map(spark: SparkSession, path: str, per_line: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(pair_index, predicted_sql, db_id, path)`` from prediction maps.

    A file holds one JSON map, which several tasks read in parts of ``part_bytes``, or with ``per_line``
    one map per line. A value that is not text gets the default statement
    and database.
    """
    if per_line:
        texts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    else:
        entry = F.concat(F.lit("{"), F.col("value"), F.lit("}"))
        texts = read_elements(spark, path, part_bytes).select("path", entry.alias("value"))
    entries = texts.filter(lines.strip(F.col("value")) != "").select(
        "path", F.explode(_prediction_entries(F.col("value"))).alias("key", "text")
    )
    return entries.select(F.col("key").cast("bigint").alias("pair_index"), "path", "text").withColumns(
        lines.split_prediction(F.col("text"))
    ).drop("text")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Execution-log records, one JSON object per line."""
    return spark.read.schema(schemas.LOG_RECORD).json(path).select(*schemas.LOG_RECORD.fieldNames())


def read_line_bundle(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, line, predicted_sql, gold_sql, db_id)`` of result folders that hold
    ``predicted.txt`` and ``gold.txt``.

    The two files belong together line by line, so each file (one run's
    questions) is read as a whole; folders are spread over the cluster.
    """

    def numbered(name: str, column: str) -> DataFrame:
        files = _whole_files(spark, root, name)
        folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
        return files.select(folder.alias("folder"), F.posexplode(F.split("value", "\n")).alias("line", column)).filter(
            lines.strip(F.col(column)) != ""
        )

    pairs = numbered("predicted.txt", "predicted").join(numbered("gold.txt", "gold"), ["folder", "line"])
    gold = lines.split_gold_line(F.col("gold"))
    return pairs.select("folder", "line", lines.strip(F.col("predicted")).alias("predicted_sql"), *[c.alias(n) for n, c in gold.items()])
