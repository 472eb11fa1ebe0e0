"""Comparing rows of a group with those that ask about it, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import sorted_groups

_BLOCK_BYTES = 1 << 24


def rows_per_block(width: int, item_bytes: int) -> int:
    """How many vectors of a width one side of a block holds."""
    return max(16, _BLOCK_BYTES // max(1, width * item_bytes))


def finite(values: Column) -> Column:
    """Whether an array of doubles has components, all of them finite; NULL arrays and components give false."""
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) > 0) & usable, F.lit(False))


def paired_blocks(rows: DataFrame, askers: DataFrame, keys: list[str], most: int, tasks: int = 1) -> DataFrame:
    """Rows (kind 0) and askers (kind 1) of every key that has both, dealt to blocks (i, j).

    Each row meets each asker of its key in exactly one block. A block holds about ``most``
    of either; a key with more is cut in chunks of rows (i) and of askers (j), so that
    a hot key is many blocks. ``tasks`` asks for at least so many blocks of a key.
    Both sides have a column ``id``; the result is sorted by key, block, kind and id.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).join(askers.groupBy(*keys).agg(F.count("*").alias("n_askers")), keys)
    n_j = F.ceil(F.col("n_askers") / most).cast("int")
    n_i = F.greatest(F.ceil(F.col("n_rows") / most), F.least(F.ceil(F.lit(tasks) / n_j), "n_rows")).cast("int")
    sizes = sizes.select(*[F.col(k).alias(f"s_{k}") for k in keys], n_i.alias("n_i"), n_j.alias("n_j"))

    def dealt(side: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        joined = side.join(sizes, [F.col(k) == F.col(f"s_{k}") for k in keys])
        placed = joined.withColumn(own, F.pmod(F.xxhash64(*side.columns), F.col(f"n_{own}")).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        return placed.select(*side.columns, "i", "j", F.lit(kind).alias("kind"))

    both = dealt(rows, 0, "i", "j").unionByName(dealt(askers, 1, "j", "i"), allowMissingColumns=True)
    place = [*keys, "i", "j"]
    # A given number of partitions is one that adaptive execution leaves alone: blocks are work, not bytes.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(partitions, *place).sortWithinPartitions(*place, "kind", "id")


def blocks(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The rows and the askers of each block of a partition that ``paired_blocks`` made."""
    for table, bounds in sorted_groups(batches, [*keys, "i", "j"]):
        kind = table.column("kind").to_numpy()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            middle = lo + int(np.searchsorted(kind[lo:hi], 1))
            if lo < middle < hi:
                yield table.slice(lo, middle - lo), table.slice(middle, hi - middle)


def matrix(table: pa.Table, name: str, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(table.num_rows, -1)


def first_in_runs(group: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first ``most`` of their run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    return place < most
