"""Schema context of each database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed

# Tables whose texts are put together in one step.
TABLES_PER_PART = 1_000


def db_context(catalog: DataFrame) -> DataFrame:
    """``(db_id, schema)``: all table texts of a database in order, with no separator.

    A database with very many tables is put together in parts first, so that
    no task sorts all of its texts at once.
    """
    part = F.floor(F.col("table_ord") / TABLES_PER_PART)
    parts = catalog.groupBy("db_id", part.alias("_part")).agg(
        F.expr("listagg(ddl, '') WITHIN GROUP (ORDER BY table_ord, ddl)").alias("_text")
    )
    return parts.groupBy("db_id").agg(F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _part)").alias("schema"))


def with_context(questions: DataFrame, context: DataFrame, missing: str = fixed.NO_DATABASE) -> DataFrame:
    """Add ``schema`` to every question; a database without one gets the ``missing`` text.

    No hint: Spark broadcasts the context while it is small by its statistics
    and otherwise joins by key, where adaptive execution splits hot databases.
    """
    plain = questions.drop("schema")
    return plain.join(context, "db_id", "left").withColumn("schema", F.coalesce("schema", F.lit(missing)))
