"""Explicit schemas of every file the readers accept; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _LONG, _INT, _DBL, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# Source questions carry the statement under "SQL" and may carry their position.
SOURCE_QUESTION = _struct(
    ("question_id", _LONG), ("db_id", _STR), ("difficulty", _STR),
    ("question", _STR), ("evidence", _STR), ("SQL", _STR),
)
QUESTION = _struct(
    ("question_id", _LONG), ("db_id", _STR), ("difficulty", _STR),
    ("question", _STR), ("evidence", _STR), ("sql_query", _STR),
)
# The first CSV column is the unnamed row index.
QUESTION_SET = _struct(
    ("row_index", _LONG), ("index_in_original", _LONG), ("difficulty", _STR), ("db_id", _STR),
    ("sql_query", _STR), ("question", _STR), ("schema", _STR), ("evidence", _STR),
)
SCHEMA_CATALOG = _struct(("db_id", _STR), ("table_ord", _INT), ("ddl", _STR))
SAMPLE = _struct(("question", _STR), ("sql_query", _STR), ("cot", _STR))
SHOT_FILE = T.MapType(_STR, T.ArrayType(SAMPLE))
PREDICTION_MAP = T.MapType(_STR, _STR)
METRIC = _struct(
    ("response_time", _STR), ("llm_prompt_tokens", _LONG), ("llm_response_tokens", _LONG), ("hardness", _STR),
)
MESSAGE = _struct(("role", _STR), ("content", _STR))
LOG_RECORD = _struct(
    ("environment", _STR), ("model", _STR), ("instruction_size", _INT), ("dataset_length", _INT),
    ("severity", _STR), ("is_sql", _INT), ("request", T.ArrayType(MESSAGE)), ("response", _STR),
    ("response_time_start", _STR), ("response_time_stop", _STR), ("sql_response", _STR), ("message", _STR),
)
RAW_REPLY = _struct(
    ("run_id", _STR), ("question_id", _LONG), ("body", _STR), ("text", _STR),
    ("prompt_tokens", _LONG), ("response_tokens", _LONG),
    ("started", _TS), ("stopped", _TS), ("error", _STR),
)
SCORE = _struct(("pair_id", _LONG), ("res", _INT), ("status", _STR))
# A statement of a job, and what is stored of it.
STATEMENT = _struct(("number", _LONG), ("key", _STR), ("width", _INT))
SIGNATURE = _struct(("key", _STR), ("status", _STR), ("signature", T.ArrayType(T.ArrayType(_LONG))))
LONG_METRICS = _struct(
    ("environment", _STR), ("model", _STR), ("instruction", _INT), ("dataset_size", _INT),
    ("metric", _STR), ("hardness", _STR), ("value", _DBL),
)
LONG_ACCURACY = _struct(
    ("environment", _STR), ("model", _STR), ("instruction", _INT), ("hardness", _STR),
    ("shot", _STR), ("dataset_size", _INT), ("metric", _STR), ("value", _DBL),
)
PRICE = _struct(
    ("environment", _STR), ("model", _STR), ("input_cost", _DBL), ("output_cost", _DBL), ("per_tokens", _LONG),
)
SHORT_NAME = _struct(("model", _STR), ("short_name", _STR))
