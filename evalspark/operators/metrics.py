"""Latency, throughput, success rate, tokens and cost per group of inferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark.functions import durations, prompts
from evalspark.tables import parameter_table

RUN_KEYS = ["environment", "model", "instruction"]


def price_list(spark: SparkSession) -> DataFrame:
    """The fixed prices; pass any table with these columns instead."""
    rows = [(*row, fixed.PRICE_PER_TOKENS) for row in fixed.PRICES]
    return parameter_table(spark, rows, schemas.PRICE)


def with_usage(metrics: DataFrame) -> DataFrame:
    """Add ``micros`` and ``output_tokens``.

    Self-hosted engines count the prompt among the response tokens, so it is
    taken off; a boolean column ``response_includes_prompt`` overrides that
    rule per row.
    """
    includes: Column = F.col("environment") == fixed.SELF_HOSTED
    if "response_includes_prompt" in metrics.columns:
        includes = F.coalesce(F.col("response_includes_prompt"), includes)
    output = F.when(includes, F.col("llm_response_tokens") - F.col("llm_prompt_tokens")).otherwise(
        F.col("llm_response_tokens")
    )
    return metrics.withColumns(
        {"micros": durations.duration_micros(F.col("response_time")), "output_tokens": output}
    )


def usage_totals(metrics: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Additive totals per (keys, hardness) and per keys (``is_total`` = 1).

    Rows are read and reduced once; the totals are added up from the reduced
    rows, so no input row is copied for them. Unusable rows (no time) add
    tokens but neither seconds nor ratios.
    """
    usable = F.coalesce(F.col("micros") != 0, F.lit(False))
    ratio = F.col("output_tokens") / (F.col("micros") / float(durations.MICROS))
    per_hardness = (
        with_usage(metrics)
        .groupBy(*keys, "hardness")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.when(usable, 1).otherwise(0)).alias("usable"),
            F.coalesce(F.sum("llm_prompt_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.coalesce(F.sum("micros"), F.lit(0)).alias("micros"),
            F.sum(F.when(usable, ratio)).alias("ratio_sum"),
        )
    )
    group = [F.col(key) for key in keys]
    sums = ["rows", "usable", "input_tokens", "output_tokens", "micros", "ratio_sum"]
    return per_hardness.groupingSets(
        [[*group, F.col("hardness")], group], *group, F.col("hardness")
    ).agg(F.grouping("hardness").cast("int").alias("is_total"), *[F.sum(name).alias(name) for name in sums])


def metrics_by_hardness(
    metrics: DataFrame, keys: list[str] = RUN_KEYS, levels: list[str] | None = fixed.LEVELS
) -> DataFrame:
    """Tokens, latency, throughput and PSR per known hardness and for ``total``.

    The total covers every row, also of hardness values outside ``levels``;
    ``levels=None`` reports every hardness. Groups without a usable row have
    NULL latency and throughput. ``usable_seconds`` feeds the hourly cost.
    """
    totals = usage_totals(metrics, keys)
    if levels is not None:
        totals = totals.filter((F.col("is_total") == 1) | F.col("hardness").isin(levels))
    seconds = F.col("micros") / float(durations.MICROS)
    some = F.nullif(F.col("usable"), F.lit(0))
    return totals.select(
        *keys,
        F.when(F.col("is_total") == 1, F.lit(fixed.TOTAL)).otherwise(F.col("hardness")).alias("hardness"),
        "rows",
        "input_tokens",
        "output_tokens",
        seconds.alias("usable_seconds"),
        F.try_divide(seconds, some).alias("latency"),
        F.try_divide(F.col("ratio_sum"), some).alias("throughput"),
        F.try_divide(F.col("usable") * 100.0, F.col("rows")).alias("psr"),
    )


def cost_api(by_hardness: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``api_cost``: token prices of the model; NULL for a model without a price.

    Both sides are small; which one is broadcast is left to Spark's size check.
    """
    dollars = (
        F.col("input_tokens") * F.col("input_cost") + F.col("output_tokens") * F.col("output_cost")
    ) / F.col("per_tokens")
    priced = prices.withColumnsRenamed({"environment": "_environment", "model": "_model"})
    priced = priced.withColumn("_model", prompts.report_model(F.col("_model")))
    named = (F.col("environment") == F.col("_environment")) & (prompts.report_model(F.col("model")) == F.col("_model"))
    joined = by_hardness.join(priced, named, "left")
    return joined.select(*by_hardness.columns, dollars.alias("api_cost"))


def cost_self_hosted(by_hardness: DataFrame, dollars_per_hour: float = fixed.SELF_HOSTED_DOLLARS_PER_HOUR) -> DataFrame:
    """Add ``hosting_cost``: hours of usable answers times the hourly rate; NULL elsewhere."""
    hours = F.col("usable_seconds") / 3600.0
    return by_hardness.withColumn(
        "hosting_cost", F.when(F.col("environment") == fixed.SELF_HOSTED, hours * dollars_per_hour)
    )


def with_cost(
    by_hardness: DataFrame, prices: DataFrame, dollars_per_hour: float = fixed.SELF_HOSTED_DOLLARS_PER_HOUR
) -> DataFrame:
    """Add ``cost``: hourly for self-hosted runs, by tokens for the rest."""
    both = cost_self_hosted(cost_api(by_hardness, prices), dollars_per_hour)
    cost = F.when(F.col("environment") == fixed.SELF_HOSTED, F.col("hosting_cost")).otherwise(F.col("api_cost"))
    return both.withColumn("cost", cost).drop("api_cost", "hosting_cost")
