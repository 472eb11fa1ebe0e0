"""Pairing predictions with gold and accuracy per difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed


def pair_join(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predicted and gold statement of each question, by ``question_id``."""
    return predictions.join(gold, "question_id")


def with_difficulty(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores with the difficulty of their question, by ``question_id``."""
    return scores.join(questions.select("question_id", "difficulty"), "question_id")


def accuracy_by_difficulty(scores: DataFrame, keys: list[str] = (), levels: list[str] = fixed.LEVELS) -> DataFrame:
    """``(keys, hardness, questions, accuracy)``: percent of right answers per level and in total.

    One conditional aggregation gives every level, so a level without
    questions has accuracy 0.0 and count 0. The total covers all rows.
    """
    right = F.coalesce(F.col("res"), F.lit(0))
    counted = []
    for level in levels:
        inside = F.col("difficulty") == level
        counted += [
            F.count(F.when(inside, 1)).alias(f"n_{level}"),
            F.coalesce(F.sum(F.when(inside, right)), F.lit(0)).alias(f"r_{level}"),
        ]
    reduced = scores.groupBy(*keys).agg(
        *counted, F.count("*").alias(f"n_{fixed.TOTAL}"), F.coalesce(F.sum(right), F.lit(0)).alias(f"r_{fixed.TOTAL}")
    )
    entries = F.array(*[
        F.struct(
            F.lit(level).alias("hardness"),
            F.col(f"n_{level}").alias("questions"),
            F.coalesce(F.try_divide(F.col(f"r_{level}") * 100.0, F.col(f"n_{level}")), F.lit(0.0)).alias("accuracy"),
        )
        for level in [*levels, fixed.TOTAL]
    ])
    return reduced.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def accuracy_report(accuracy: DataFrame, keys: list[str]) -> DataFrame:
    """Long accuracy rows in the report's column order."""
    return accuracy.select(*keys, "hardness", F.lit(fixed.ACCURACY).alias("metric"), F.col("accuracy").alias("value"))
