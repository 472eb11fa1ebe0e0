"""Long and pivoted reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark.functions import prompts
from evalspark.tables import parameter_table

# Column of the wide metrics table -> metric name in the report.
METRIC_COLUMNS = {
    "cost": fixed.COST,
    "output_tokens": fixed.OUTPUT_TOKENS,
    "input_tokens": fixed.INPUT_TOKENS,
    "throughput": fixed.THROUGHPUT,
    "psr": fixed.PSR,
    "latency": fixed.LATENCY,
}

# How a column names a missing size, hardness or model.
NONE = "none"


def short_names(spark: SparkSession) -> DataFrame:
    """The fixed short model names."""
    return parameter_table(spark, fixed.SHORT_NAMES, schemas.SHORT_NAME)


def metrics_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, hardness, metric)."""
    named = wide.select(
        *keys, "hardness", *[F.col(column).cast("double").alias(name) for column, name in METRIC_COLUMNS.items()]
    )
    return named.unpivot([*keys, "hardness"], list(METRIC_COLUMNS.values()), "metric", "value")


def model_names(report: DataFrame, names: DataFrame, drop_unmapped: bool = False) -> DataFrame:
    """Replace the model by its short name.

    A model without one keeps its own name, or is left out with ``drop_unmapped``.
    """
    named = names.select(prompts.report_model(F.col("model")).alias("_name"), "short_name")
    joined = report.join(named, prompts.report_model(F.col("model")) == F.col("_name"), "inner" if drop_unmapped else "left")
    return joined.withColumn("model", F.coalesce("short_name", "model")).select(*report.columns)


def rounded(report: DataFrame) -> DataFrame:
    """Values to three digits, halves to even."""
    return report.withColumn("value", F.bround("value", 3))


def report_rows(
    report: DataFrame,
    dataset_size: int | None = fixed.FULL_SIZE,
    without: list[str] = (),
    hardness: str | None = None,
) -> DataFrame:
    """Rows of one data set size, without some metrics, of one hardness."""
    if dataset_size is not None and "dataset_size" in report.columns:
        report = report.filter(F.col("dataset_size") == dataset_size)
    if without:
        report = report.filter(~F.col("metric").isin(list(without)))
    if hardness is not None:
        report = report.filter(F.col("hardness") == hardness)
    return report


def _shown(report: DataFrame, columns: list[str], given: list | None) -> list[tuple]:
    """The values to show: all there are, or those given, if they cover the rows.

    Reports are reduced already, and each value becomes a column of the result.
    """
    there = sorted(map(tuple, report.select(*columns).distinct().collect()), key=lambda row: [(part is None, part) for part in row])
    if given is None:
        return there
    given = [value if isinstance(value, tuple) else (value,) for value in given]
    if missing := [row for row in there if row not in given]:
        raise ValueError(f"the report also has {missing} in {columns}")
    return given


def _levels(report: DataFrame) -> list[str | None]:
    """The known levels and the total, and behind them whatever else the report holds."""
    known = [*fixed.LEVELS, fixed.TOTAL]
    return [*known, *(level for (level,) in _shown(report, ["hardness"], None) if level not in known)]


def pivot_mean(report: DataFrame, index: list[str], columns: list[str], values: list[tuple]) -> DataFrame:
    """Mean value per index row and column combination.

    ``values`` lists the combinations to show; their parts joined by ``_`` name
    the columns, with ``none`` for a missing part.
    """
    labels = ["_".join(NONE if part is None else str(part) for part in value) for value in values]
    key = F.concat_ws("_", *[F.coalesce(F.col(column).cast("string"), F.lit(NONE)) for column in columns])
    return report.withColumn("_column", key).groupBy(*index).pivot("_column", labels).agg(F.avg("value"))


def pivot_metrics(report: DataFrame, instructions: list[int] | None = None, by: list[str] = ()) -> DataFrame:
    """Throughput and token counts: a row per model, metric and environment, a column per instruction size and hardness.

    Every size and hardness that occurs has its columns, a missing one as ``none``.

    ``by`` keeps further keys apart, such as ``shot``; cells are averaged over the rest.
    """
    rows = report_rows(rounded(report), without=[fixed.COST, fixed.PSR, fixed.LATENCY])
    sizes = _shown(rows, ["instruction"], instructions)
    values = [(size, level) for (size,) in sizes for level in _levels(rows)]
    return pivot_mean(rows, ["model", "metric", "environment", *by], ["instruction", "hardness"], values)


def pivot_metrics_transposed(report: DataFrame, models: list[tuple[str, str]] | None = None) -> DataFrame:
    """The same figures the other way round; ``models`` lists (model, environment)."""
    rows = report_rows(rounded(report), without=[fixed.COST, fixed.PSR, fixed.LATENCY])
    metrics = [fixed.OUTPUT_TOKENS, fixed.INPUT_TOKENS, fixed.THROUGHPUT]
    values = [(model, metric, environment) for model, environment in _shown(rows, ["model", "environment"], models) for metric in metrics]
    return pivot_mean(rows, ["instruction", "hardness"], ["model", "metric", "environment"], values)


def cost_rows(report: DataFrame) -> DataFrame:
    """Total cost and token counts of the full set."""
    return report_rows(
        rounded(report), without=[fixed.THROUGHPUT, fixed.PSR, fixed.LATENCY], hardness=fixed.TOTAL
    )


def pivot_cost(report: DataFrame, instructions: list[int] | None = None, by: list[str] = ()) -> DataFrame:
    """Cost and token totals: a column per instruction size."""
    rows = cost_rows(report)
    values = [(size, fixed.TOTAL) for (size,) in _shown(rows, ["instruction"], instructions)]
    return pivot_mean(rows, ["model", "metric", "environment", *by], ["instruction", "hardness"], values)


def cost_total(report: DataFrame) -> DataFrame:
    """Cost and token totals added up over all instruction sizes."""
    return (
        cost_rows(report)
        .groupBy("environment", "model", "metric")
        .agg(F.sum("value").alias("value"))
        .select(
            "environment", "model", F.lit(fixed.ALL_INSTRUCTIONS).alias("instruction"),
            F.lit(fixed.FULL_SIZE).alias("dataset_size"), "metric", F.lit(fixed.TOTAL).alias("hardness"), "value",
        )
    )


def pivot_cost_total(report: DataFrame) -> DataFrame:
    """Cost and token totals over all instruction sizes: a column per metric."""
    return pivot_mean(cost_total(report), ["model", "environment"], ["instruction", "metric"], [
        (fixed.ALL_INSTRUCTIONS, metric) for metric in (fixed.COST, fixed.OUTPUT_TOKENS, fixed.INPUT_TOKENS)
    ])


def distinct_dims(metrics: DataFrame) -> DataFrame:
    """``(dim, value)``: the distinct environments, models per environment, instructions and hardness values.

    The rows are reduced to their distinct combinations first; only those are
    turned into (dim, value) rows.
    """

    def entry(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"))

    combinations = metrics.select("environment", "model", "instruction", "hardness").distinct()
    entries = F.array(
        entry("environment", F.col("environment")),
        entry("model", F.concat_ws("/", "environment", "model")),
        entry("instruction", F.col("instruction")),
        entry("hardness", F.col("hardness")),
    )
    return combinations.select(F.explode(entries).alias("e")).select("e.dim", "e.value").distinct()
