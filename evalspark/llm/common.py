"""What several operators share: shared tables, word splitting, bounded memories, row packing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import new_table_path

# Words of every contract are runs of other characters than these (bytes.split() splits on the same).
WORD = r"[^\x20\x09-\x0D]+"
_SLICE_BYTES = 2_000_000
_ENTRY_BYTES = 150  # of a dictionary's entry besides what its key and value hold


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: later steps do not
    compute it again, and lost executors take no part of it with them."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class Memory(dict):
    """A dictionary that computes missing values and holds at most two generations of them.

    A generation is full at ``room`` bytes of keys and values (texts or bytes), whatever their number. Then
    it becomes the old one, and what is still in use moves over again. Only speed depends on the size.
    """

    def __init__(self, compute, room: int = 40_000_000):
        super().__init__()
        self.compute, self.room, self.old, self.held = compute, room, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.held >= self.room:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += len(key) + len(value) + _ENTRY_BYTES

    def unknown(self, keys: Iterable) -> list:
        """The distinct keys without a value."""
        return list(set(keys).difference(self, self.old))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, np.uint64)
_BYTE[_SPACE] = 0
_PLACE = np.multiply.accumulate(np.full(1024, np.uint64(0x9E3779B97F4A7C15)))


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word of every text, one text after the other, and each text's number of words.

    All bytes are worked on at once: a word's hash is the mixed sum of its bytes'
    random values, each times a power for its place in the word.
    """
    global _PLACE
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = raw[starts[0] :]
    at = starts - starts[0]
    reach = np.diff(np.concatenate([at, [len(raw)]]))
    place = np.arange(len(raw)) - np.repeat(at, reach)
    if reach.max() > len(_PLACE):
        _PLACE = np.multiply.accumulate(np.full(int(reach.max()) * 2, _PLACE[0]))
    value = _BYTE[(_LOWER if lower else _AS_IS)[raw]]
    value *= _PLACE[place]
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    return mix(np.add.reduceat(value, at)), np.diff(np.concatenate([[0], upto]))


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as places in a list of distinct words, each text's number of words, and that list.

    Blanks are squeezed out, and what is left is an Arrow array of words that its dictionary encoding
    numbers: no word is an object of its own.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    data = raw[~space]
    offsets = np.append(np.flatnonzero(begins[~space]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(np.flatnonzero(begins), ends)
    return words.indices.to_numpy(), np.diff(np.concatenate([[0], upto])), words.dictionary


def slices(batch: pa.RecordBatch, text: str, size: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a few megabytes of text each, so that what a task holds stays small."""
    column = batch.column(text)
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one column ``row`` beside ``columns``: own names cannot clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, names: list[str], **replaced: str) -> DataFrame:
    """The columns that ``packed`` put away, with those in ``replaced`` taken from another column."""
    return df.select(*[F.col(replaced[n]).alias(n) if n in replaced else F.col("row").getField(n).alias(n) for n in names])


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the bounds of each group, from a partition sorted by ``keys`` (integers)."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        waiting = table.slice(bounds[-2]).combine_chunks()
    if waiting is not None:
        yield waiting, _bounds(waiting, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
