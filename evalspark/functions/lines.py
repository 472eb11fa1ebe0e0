"""Line formats of the evaluation bundle and dimensions kept in paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed


def strip(text: Column) -> Column:
    """Text without surrounding blanks, tabs and line breaks."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def gold_line(sql: Column, db_id: Column) -> Column:
    """``sql <tab> db_id``."""
    return F.concat_ws("\t", strip(sql), db_id)


def split_gold_line(line: Column) -> dict[str, Column]:
    """Columns ``gold_sql, db_id`` of a gold line."""
    parts = F.split(strip(line), "\t", 2)
    return {"gold_sql": F.get(parts, F.lit(0)), "db_id": F.get(parts, F.lit(1))}


def prediction_text(sql: Column, db_id: Column) -> Column:
    """Statement and database in the prediction map's value format."""
    # The text of a missing prediction is a blank, which must come back.
    kept = F.when(sql == fixed.MISSING_PREDICTION, sql).otherwise(strip(sql))
    return F.concat(kept, F.lit(fixed.PREDICTION_DELIMITER), db_id)


def split_prediction(text: Column, default_db: str = fixed.DEFAULT_DB) -> dict[str, Column]:
    """Columns ``predicted_sql, db_id``; a missing prediction gets the defaults."""
    named = text.contains(fixed.PREDICTION_DELIMITER)
    return {
        "predicted_sql": F.when(text.isNull(), F.lit(fixed.MISSING_PREDICTION)).otherwise(
            F.substring_index(text, fixed.PREDICTION_DELIMITER, 1)
        ),
        "db_id": F.when(named, F.substring_index(text, fixed.PREDICTION_DELIMITER, -1)).otherwise(F.lit(default_db)),
    }


def database_name(db_id: Column, prefix: str = "") -> Column:
    """The Spark database that holds a question's tables."""
    return F.concat(F.lit(prefix), db_id)


def result_folder() -> Column:
    """``env/shot/model/N_Instructions/M_Inferences[/K_size]`` out of the run's columns."""
    size = F.when(F.col("dataset_size") != F.col("dataset_length"), F.concat(F.col("dataset_size").cast("string"), F.lit("_size")))
    length = F.concat(F.col("dataset_length").cast("string"), F.lit("_Inferences"))
    size_of = F.concat(F.col("instruction").cast("string"), F.lit("_Instructions"))
    return F.concat_ws("/", "environment", "shot", "model", size_of, length, size)


def path_dimensions(path: Column) -> dict[str, Column]:
    """Run dimensions out of ``env/shot/[org/]model/N_Instructions/M_Inferences[/K_size]/file``."""

    def segment(text: Column, from_end: int) -> Column:
        return F.substring_index(F.substring_index(text, "/", -from_end), "/", 1)

    shot = F.regexp_extract(path, r"[^/]+/[^/]+_shot(?:_cot)?/", 0)
    known = path.contains("_Instructions/")
    # ".../model/N" before the mark, "M_Inferences[/K_size]/file" behind it.
    head, tail = F.substring_index(path, "_Instructions/", 1), F.substring_index(path, "_Instructions/", -1)
    length = F.substring_index(tail, "_Inferences", 1).try_cast("int")
    size = F.when(tail.contains("_size/"), segment(F.substring_index(tail, "_size/", 1), 1).try_cast("int"))
    return {
        "environment": F.substring_index(shot, "/", 1),
        "shot": segment(shot, 2),
        "model": F.when(known, segment(head, 2)),
        "instruction": F.when(known, segment(head, 1).try_cast("int")),
        "dataset_length": F.when(known, length),
        "dataset_size": F.when(known, F.coalesce(size, length)),
    }
