"""Positions and first rows per group that never put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.tables import kept

# Rows of a range that one task sorts, and ranges of a group at most (a power of two).
RANGE_ROWS = 1_000_000
MOST_RANGES = 4096
_SALTS = 512


def first_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "position") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based position.

    Two rounds of row_number: input partitions are folded into salted groups,
    then the survivors are ranked. Spark's group limit cuts each map task to
    ``k`` rows per group before either shuffle (up to the rank in
    spark.sql.optimizer.windowGroupLimitThreshold), so a group of any size reaches
    the last task as at most ``k`` rows per salt. The salt decides only where
    a row is compared, not whether it is kept.
    """
    salted = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", F.spark_partition_id() % _SALTS)
        .withColumn("_round", F.row_number().over(salted))
        .filter(F.col("_round") <= k)
        .withColumn(name, F.row_number().over(final))
        .filter(F.col(name) <= k)
        .drop("_salt", "_round")
    )


def block_offsets(df: DataFrame, by: list[str], block: Column) -> DataFrame:
    """Rows per (group, block) and the number of rows in the group's earlier blocks."""
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.groupBy(*by, block.alias("_block"))
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )


def positions(df: DataFrame, by: list[str], order: list[Column], block: Column, name: str = "position") -> DataFrame:
    """The 0-based position of every row in its group.

    Rows are numbered inside (group, block) and shifted by the rows of the
    earlier blocks. The offsets are joined on the partitioning the numbering
    already has, so the rows move once. (The keys travel as one struct: its
    plain equality also matches NULL keys and keeps that partitioning.)
    """
    keyed = df.select(*df.columns, F.struct(*by).alias("_group"), block.alias("_block"))
    offsets = block_offsets(keyed, ["_group"], F.col("_block")).select("_group", "_block", "_before")
    in_block = Window.partitionBy("_group", "_block").orderBy(*order)
    numbered = keyed.withColumn("_in_block", F.row_number().over(in_block))
    return numbered.join(offsets, ["_group", "_block"]).select(
        *df.columns, (F.col("_before") + F.col("_in_block") - 1).alias(name)
    )


def measured_cuts(df: DataFrame, by: list[str], value: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """``(_group, _cuts, _parts)``: the values that cut each group into ranges of about ``rows`` rows.

    A quantile sketch per group, reduced where the rows are read, gives the cuts, so that
    ranges follow the rows and not the values: hashed ids take no more of them than
    dense ones. ``_parts`` is how many ranges rows without a value need. The result has one row
    per group and a number per range; it is written, as a sketch may come out
    differently when it is computed again.
    """
    with_value, without = F.count("_value"), F.count(F.when(F.col("_value").isNull(), 1))
    quantiles = F.percentile_approx("_value", [i / MOST_RANGES for i in range(1, MOST_RANGES)], 4 * MOST_RANGES)
    counted = df.select(F.struct(*by).alias("_group"), value.alias("_value")).groupBy("_group").agg(
        F.least(F.ceil(with_value / rows), F.lit(MOST_RANGES)).cast("int").alias("_ranges"),
        F.greatest(F.least(F.ceil(without / rows), F.lit(MOST_RANGES)), F.lit(1)).cast("int").alias("_parts"),
        quantiles.alias("_q"),
    )
    cut = lambda i: F.get("_q", F.floor(i * MOST_RANGES / F.col("_ranges")).cast("int") - 1)
    cuts = F.when(F.col("_ranges") > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_ranges") - 1), cut)))
    cuts = F.coalesce(cuts, F.array().cast("array<bigint>"))
    return kept(counted.select("_group", cuts.alias("_cuts"), "_parts"), "range-cuts")


def _ranged(df: DataFrame, by: list[str], value: Column, rows: int) -> DataFrame:
    """``df`` with ``_group`` and ``_range``. Where no group has more rows than a range, there is nothing to cut."""
    group = F.struct(*by).alias("_group")
    largest = df.select(group).groupBy("_group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is None or largest <= rows:
        return df.select("*", group, F.when(value.isNull(), 1).otherwise(0).alias("_range"))
    return _with_range(df, by, value, measured_cuts(df, by, value, rows))


def _with_range(df: DataFrame, by: list[str], value: Column, cuts: DataFrame) -> DataFrame:
    """``df`` with ``_group`` and ``_range``: a binary search in the cuts, and ranges behind all others for rows without a value."""
    spread = F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(MOST_RANGES.bit_length() - 1))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("_value"), at + step).otherwise(at))
    place = F.when(F.col("_value").isNull(), F.size("_cuts") + 1 + spread).otherwise(found)
    keyed = df.select("*", F.struct(*by).alias("_group"), value.alias("_value")).join(cuts, "_group")
    return keyed.select(*df.columns, "_group", place.alias("_range"))


def _range_offsets(ranged: DataFrame) -> DataFrame:
    """Rows per (group, range) and in the group's earlier ranges; a group has at most twice MOST_RANGES ranges."""
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_group", "_range").agg(F.count("*").alias("_rows"))
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def ranged_positions(
    df: DataFrame, by: list[str], value: Column, order: list[Column], name: str = "position", rows: int = RANGE_ROWS
) -> DataFrame:
    """The 0-based position of every row in its group; rows without a value come last.

    ``value`` is a bigint that rises with ``order``. Rows are numbered inside measured ranges and
    shifted by the rows of the earlier ones, so a group of any size and any
    values is many tasks. The offsets meet the rows on the partitioning the numbering already
    has. Rows with equal values are in one range.
    """
    ranged = _ranged(df, by, value, rows)
    in_range = Window.partitionBy("_group", "_range").orderBy(*order)
    numbered = ranged.withColumn("_in_range", F.row_number().over(in_range))
    offsets = _range_offsets(ranged).select("_group", "_range", "_before")
    return numbered.join(offsets, ["_group", "_range"]).select(*df.columns, (F.col("_before") + F.col("_in_range") - 1).alias(name))


def first_by_range(df: DataFrame, by: list[str], value: Column, order: list[Column], k: int, rows: int = RANGE_ROWS) -> DataFrame:
    """The first ``k`` rows of each group for any ``k``; rows without a value come last.

    The range where each group reaches ``k`` is found from counts, and only rows up to it are
    shuffled, by (group, range).
    """
    ranged = _ranged(df, by, value, rows)
    cut = _range_offsets(ranged).filter(F.col("_before") < k).groupBy("_group").agg(
        F.max("_range").alias("_cut"), F.max("_before").alias("_cut_before")
    )
    in_range = Window.partitionBy("_group", "_range").orderBy(*order)
    return (
        ranged.join(cut, "_group").filter(F.col("_range") <= F.col("_cut"))
        .withColumn("_in_range", F.row_number().over(in_range))
        .filter((F.col("_range") < F.col("_cut")) | (F.col("_in_range") <= k - F.col("_cut_before")))
        .select(*df.columns)
    )


def hash_value(text: Column) -> Column:
    """The first 15 digits of a hexadecimal hash as a number that rises with it."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")
