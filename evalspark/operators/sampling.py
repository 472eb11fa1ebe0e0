"""Building question sets: filters, per-difficulty heads and samples, buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.operators import ranking
from evalspark.tables import kept

QUESTION_SET_COLUMNS = ["index_in_original", "difficulty", "db_id", "sql_query", "question", "schema", "evidence"]


def keep_levels(questions: DataFrame, levels: list[str] = fixed.LEVELS) -> DataFrame:
    """Questions of the known difficulties, in one pass; write with partitionBy to split them."""
    return questions.filter(F.col("difficulty").isin(levels))


def split_by_difficulty(questions: DataFrame, levels: list[str] = fixed.LEVELS) -> dict[str, DataFrame]:
    """One lazy frame per difficulty; the filter reaches the scan of each."""
    return {level: questions.filter(F.col("difficulty") == level) for level in levels}


def append_frames(*frames: DataFrame) -> DataFrame:
    """Frames one below the other, aligned by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def exclude_schemas(questions: DataFrame, patterns: list[str] = fixed.BAD_SCHEMA_PATTERNS) -> DataFrame:
    """Questions whose schema matches none of the patterns; a missing schema is kept."""
    bad = reduce(lambda a, b: a | b, [F.col("schema").rlike(pattern) for pattern in patterns], F.lit(False))
    return questions.filter(~F.coalesce(bad, F.lit(False)))


def _take_per_difficulty(
    questions: DataFrame, k: int, order: list[Column], value: Column, levels: list[str], rows: int
) -> DataFrame:
    taken = keep_levels(questions, levels)
    # Only ids are ranked; the texts are read once more for the chosen ones. An id
    # that several rows have is taken as often as it was chosen. The keys travel as one
    # struct, as its equality also matches missing ids.
    key = F.struct("difficulty", "question_id").alias("_key")
    narrow = taken.select("difficulty", "question_id")
    chosen = ranking.first_by_range(narrow, ["difficulty"], value, order, k, rows)
    times = chosen.select(key).groupBy("_key").agg(F.count("*").alias("_times"))
    repeat = Window.partitionBy("_key").orderBy(F.lit(0))
    found = taken.select("*", key).join(times, "_key").withColumn("_repeat", F.row_number().over(repeat))
    return found.filter(F.col("_repeat") <= F.col("_times")).select(*questions.columns)


def head_per_difficulty(
    questions: DataFrame, size: int, levels: list[str] = fixed.LEVELS, rows: int = ranking.RANGE_ROWS
) -> DataFrame:
    """The first ``size // len(levels)`` questions of each difficulty, by id; those without an id come last."""
    by_id = F.col("question_id")
    return _take_per_difficulty(questions, size // len(levels), [by_id], by_id, levels, rows)


def sample_order(seed: int) -> Column:
    """A repeatable random order of the questions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string")))


def equal_split(
    questions: DataFrame, size: int = 360, seed: int = 0, levels: list[str] = fixed.LEVELS, rows: int = ranking.RANGE_ROWS
) -> DataFrame:
    """A random sample of exactly ``size / len(levels)`` questions per difficulty, repeatable by seed.

    A difficulty with fewer questions contributes all it has; questions without an id come last.
    """
    draw = sample_order(seed)
    sample = _take_per_difficulty(
        questions, size // len(levels), [draw, F.col("question_id")], ranking.hash_value(draw), levels, rows
    )
    return sample.withColumnsRenamed({"question_id": "index_in_original", "SQL": "sql_query"}).select(
        *QUESTION_SET_COLUMNS
    )


def bucket_level(difficulty: Column) -> Column:
    """The difficulty used for bucketing: anything unknown counts as the last level."""
    return F.when(difficulty.isin(fixed.LEVELS), difficulty).otherwise(F.lit(fixed.OTHER_LEVEL))


def question_buckets(questions: DataFrame, difficulty: str = "difficulty") -> DataFrame:
    """``(question_id, dataset_size)`` of the questions in the small buckets.

    At most 120 positions in each of three levels: never more than 360 rows, written
    once. A question counts once, however many rows (runs) it has.
    """
    last = max(end for _, _, end in fixed.BUCKETS)
    once = questions.groupBy("question_id").agg(F.min(bucket_level(F.col(difficulty))).alias("_level"))
    ranked = ranking.first_per_group(once, ["_level"], [F.col("question_id")], last)
    size = None
    for label, start, end in fixed.BUCKETS:
        inside = (F.col("position") > start) & (F.col("position") <= end)
        size = F.when(inside, F.lit(label)) if size is None else size.when(inside, F.lit(label))
    return kept(ranked.select("question_id", size.alias("dataset_size")), "buckets")


def bucket_rows(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Every row once for the full set and once more for the bucket its question is in.

    Spark knows the size of the table that :func:`question_buckets` has written, and broadcasts it: the rows
    themselves are not shuffled. Any other table is joined as its size suggests.
    """
    small = buckets.withColumnRenamed("dataset_size", "_bucket")
    sizes = F.array_compact(F.array(F.lit(fixed.FULL_SIZE), F.col("_bucket")))
    return rows.join(small, "question_id", "left").withColumn("dataset_size", F.explode(sizes)).drop("_bucket")
