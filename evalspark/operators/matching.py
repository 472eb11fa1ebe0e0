"""Comparing query results without looking at row or column order.

Two results match when they have the same number of columns and the columns
of one can be paired with equal columns of the other, a column being the
multiset of its values. Columns are compared through an order-free signature:
row count, NULL count and sums of two independent 64-bit hashes of the values.
Sums are partially aggregated where the data is read, so no cell is shuffled
and a hot value, column or result costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.canonical import cell_text

GOLD, PREDICTED = "gold", "predicted"
_HASHES = (17, 91)
# A hash is summed in three parts of 21, 21 and 22 bits: 2^41 rows fit a bigint.
_PART_BITS = 21
SIGNATURE = ["n_rows", "n_nulls", *[f"h{seed}_{part}" for seed in _HASHES for part in range(3)]]


def signature_parts(value: str) -> list[str]:
    """SQL of what a signature sums of one ``value``: 1 if it is NULL, and both hashes in parts, in SIGNATURE order."""
    low = (1 << _PART_BITS) - 1
    parts = [f"CASE WHEN {value} IS NULL THEN 1L END"]
    for seed in _HASHES:
        # The seed goes first, so the two hashes are independent of each other.
        code = f"xxhash64({seed}, {value})"
        shares = (
            f"{code} & {low}L",
            f"shiftrightunsigned({code}, {_PART_BITS}) & {low}L",
            f"shiftrightunsigned({code}, {2 * _PART_BITS})",
        )
        parts += [f"CASE WHEN {value} IS NOT NULL THEN {share} END" for share in shares]
    return parts


def _signature(value: str) -> list[str]:
    """SQL aggregates of one column, in SIGNATURE order."""
    return ["count(1)", *[f"coalesce(sum({part}), 0L)" for part in signature_parts(value)]]


def _named(aggregates: list[str]) -> list[Column]:
    return [F.expr(f"{aggregate} AS {name}") for name, aggregate in zip(SIGNATURE, aggregates)]


def column_signatures(cells: DataFrame) -> DataFrame:
    """Signature of every ``(pair_id, side, col_pos)`` of long-form cells."""
    return cells.groupBy("pair_id", "side", "col_pos").agg(*_named(_signature("value")))


def _by_position(result: DataFrame) -> DataFrame:
    """The result with canonical text columns named by position, so equal names do no harm."""
    named = result.toDF(*[f"c{position}" for position in range(len(result.columns))])
    return named.selectExpr(*[f"{cell_text(field.name, field.dataType)} AS {field.name}" for field in named.schema.fields])


def result_cells(result: DataFrame, pair_id: int, side: str) -> DataFrame:
    """A result as long-form cells ``(pair_id, side, col_pos, value)``, values in canonical text."""
    canonical = _by_position(result)
    return canonical.select(F.posexplode(F.array(*canonical.columns)).alias("col_pos", "value")).select(
        F.lit(pair_id).cast("bigint").alias("pair_id"), F.lit(side).alias("side"), "col_pos", "value"
    )


def result_rows(result: DataFrame, pair_id: int, side: str) -> DataFrame:
    """A result as whole rows ``(pair_id, side, cells)``, cells in canonical text in their order."""
    canonical = _by_position(result)
    return canonical.select(F.lit(pair_id).cast("bigint").alias("pair_id"), F.lit(side).alias("side"), F.array(*canonical.columns).alias("cells"))


def row_signatures(rows: DataFrame) -> DataFrame:
    """Signature of the rows of every ``(pair_id, side)``: a row is one value, summed where it is read; no cell moves."""
    texts = rows.select("pair_id", "side", F.to_json("cells", {"ignoreNullFields": "false"}).alias("_row"))
    return texts.groupBy("pair_id", "side").agg(*_named(_signature("_row")))


def match_rows(rows: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """``(pair_id, res)`` of whole rows ``(pair_id, side, cells)``: 1 where both sides hold the same rows, equally often."""
    return match_signatures(row_signatures(rows), shapes)


def match_signatures(signatures: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """``(pair_id, res)``: 1 where gold and predicted have the same signatures, counted.

    Signatures are weighed +1 for gold and -1 for predicted; a pair matches
    when every signature's weights cancel out. ``shapes(pair_id, side, n_cols,
    n_rows)`` adds results that have no cells: columns without rows count as
    empty columns, and a pair missing on either side does not match.
    """
    weight = F.when(F.col("side") == GOLD, 1).otherwise(-1)
    weighed = signatures.select("pair_id", *SIGNATURE, weight.alias("weight"))
    if shapes is not None:
        empty = shapes.filter(F.col("n_rows") == 0)
        weighed = weighed.unionByName(
            empty.select("pair_id", *[F.lit(0).cast("bigint").alias(name) for name in SIGNATURE],
                         (weight * F.col("n_cols")).alias("weight"))
        )
    balance = weighed.groupBy("pair_id", *SIGNATURE).agg(F.sum("weight").alias("balance"))
    matched = balance.groupBy("pair_id").agg(
        F.when(F.max(F.abs("balance")) == 0, 1).otherwise(0).alias("res")
    )
    if shapes is None:
        return matched
    sides = shapes.groupBy("pair_id").agg(F.count_distinct("side").alias("sides"))
    both = sides.join(matched, "pair_id", "left")
    return both.select("pair_id", F.when(F.col("sides") == 2, F.coalesce("res", F.lit(0))).otherwise(0).alias("res"))


def match_results(
    cells: DataFrame, shapes: DataFrame | None = None, mode: str = "columns", exact: bool = False
) -> DataFrame:
    """``(pair_id, res)`` for all pairs of long-form cells in one job.

    ``mode="columns"`` compares each column on its own; ``mode="rows"`` is
    stricter: the rows, read by column position, must be the same multiset
    (needs ``row_id``; the cells of a row are brought together first, so results that are still
    whole go through :func:`match_rows`). ``exact`` checks every verdict against full value
    counts and gives NULL where two different columns share a signature.
    """
    if mode == "rows":
        return match_signatures(_row_signatures(cells), shapes)
    if mode != "columns":
        raise ValueError(f"unknown mode {mode!r}")
    signatures = column_signatures(cells)
    matched = match_signatures(signatures, shapes)
    if not exact:
        return matched
    doubtful = signature_collisions(cells, signatures).select("pair_id").distinct().withColumn("_doubt", F.lit(True))
    return matched.join(doubtful, "pair_id", "left").select(
        "pair_id", F.when(F.col("_doubt").isNull(), F.col("res")).alias("res")
    )


def _row_signatures(cells: DataFrame) -> DataFrame:
    """One signature per result side over its rows."""
    tagged = cells.withColumn(
        "_cell", F.concat_ws(":", F.col("col_pos").cast("string"), F.coalesce(F.concat(F.lit("v"), "value"), F.lit("n")))
    )
    rows = tagged.groupBy("pair_id", "side", "row_id").agg(*_named(_signature("_cell")))
    row_text = rows.select("pair_id", "side", F.concat_ws(",", *SIGNATURE).alias("_row"))
    return row_text.groupBy("pair_id", "side").agg(*_named(_signature("_row")))


def signature_collisions(cells: DataFrame, signatures: DataFrame) -> DataFrame:
    """Signatures of a pair that are shared by columns with different value counts.

    Values are counted per column, then compared among the columns of one
    signature: every value must be in all of them, equally often. The work is
    spread by value; no two columns are joined with each other.
    """
    keys = ["pair_id", "side", "col_pos"]
    group = F.xxhash64(*SIGNATURE)
    grouped = signatures.select(*keys, group.alias("_sig"))
    width = grouped.groupBy("pair_id", "_sig").agg(F.count("*").alias("_width"))
    counts = cells.groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    compared = (
        counts.join(grouped, keys)
        .groupBy("pair_id", "_sig", "value")
        .agg(F.min("_n").alias("_least"), F.max("_n").alias("_most"), F.count("*").alias("_columns"))
    )
    differs = (F.col("_least") != F.col("_most")) | (F.col("_columns") != F.col("_width"))
    return compared.join(width, ["pair_id", "_sig"]).filter(differs).select("pair_id", "_sig", "value")
