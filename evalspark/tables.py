"""Small parameter tables with a size Spark knows, and results that are written once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.session import new_table_path


def parameter_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local table. Its exact size is in the plan, so Spark broadcasts it while it
    is under spark.sql.autoBroadcastJoinThreshold and shuffles it beyond."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(values), field.type) for values, field in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: every use sees the same rows."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
