"""Hard negatives by exact integer inner products, several rows to one multiplication.

Components become integers, floor(scale * x). For a block of rows every component is
biased to be non-negative, and the components of several rows are packed into separated
fields of one wide integer (Kronecker substitution). An anchor's biased component is
multiplied with a packed one once, for all rows in it; the sums of these products,
unpacked and with the bias taken off, are the rows' exact scores.

A field has the bits that the largest possible sum needs. While one or more fields
fit 53 bits, the wide integers are kept in doubles, which add and multiply such
integers exactly, so that the sums are matrix products. Larger components
use Python's integers of any width, with the same packing.

The positives of an anchor are searched among the rows of its label, then the
negatives among all rows, each time in blocks: an asked set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.blocks import blocks, finite, matrix, paired_blocks, rows_per_block
from evalspark.llm.common import keep_table

SCALE = 256
_DOUBLE_BITS = 53
_PLACE_BITS = 17  # a block's rows; scores are ordered together with the place
_SCORE_BITS = 62 - _PLACE_BITS
_WIDE_FIELDS = 8
_PART = 1 << 22  # scores held at once
_LONG = 2**63 - 1


def field_bits(width: int, low: int, high: int) -> int:
    """Bits of the largest sum of ``width`` products of biased components."""
    return max(1, (width * (high - low) ** 2).bit_length())


def packed_products(anchors: np.ndarray, rows: np.ndarray, low: int, high: int) -> np.ndarray:
    """The inner product of every anchor with every row, exactly.

    Components are integers from ``low`` to ``high``. The result holds 64-bit integers, or Python's where
    a score may pass 45 bits (the rest is for the order of ties)."""
    width = rows.shape[1]
    bits = field_bits(width, low, high)
    narrow = bits <= _DOUBLE_BITS and width * max(abs(low), abs(high)) ** 2 < 2**_SCORE_BITS
    fields = _DOUBLE_BITS // bits if narrow else _WIDE_FIELDS
    kind = np.int64 if narrow else object
    whole = lambda m: m.astype(np.int64) if narrow else np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    a, c = whole(anchors), whole(rows)
    room = -(-len(c) // fields) * fields
    biased = np.zeros((room, width), kind)
    biased[: len(c)] = c - low
    packed = biased[0::fields]
    for f in range(1, fields):
        packed = packed + biased[f::fields] * (1 << (bits * f))
    if narrow:
        wide = ((a - low).astype(np.float64) @ packed.astype(np.float64).T).astype(np.int64)
    else:
        wide = (a - low) @ packed.T
    out = np.empty((len(a), room), kind)
    for f in range(fields):
        out[:, f::fields] = (wide >> (bits * f)) & ((1 << bits) - 1)
    sums = a.sum(axis=1)[:, None] + c.sum(axis=1)[None, :]
    return out[:, : len(c)] + low * sums - width * low * low


def _ascending(scores: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, int]:
    """Per anchor the sorted codes of score and place (a smaller place is a larger code), barred rows in front, and a place's bits."""
    bits = max(_PLACE_BITS, int(scores.shape[1]).bit_length())
    codes = scores * (1 << bits) + ((1 << bits) - 1 - np.arange(scores.shape[1]))
    codes[barred] = -(2**62) if scores.dtype != object else -(1 << 4200)  # no score is that low
    codes.sort(axis=1)
    return codes, bits


def _slices(anchors: pa.Table, rows: pa.Table, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of some anchors at a time: where they begin, and their scores."""
    a, c = matrix(anchors, "v"), matrix(rows, "v")
    step = max(1, _PART // max(1, len(c)))
    for at in range(0, len(a), step):
        yield at, packed_products(a[at : at + step], c, low, high)


class Keys:
    """Scores as texts of one length whose order is that of the scores, for any size of score."""

    def __init__(self, width: int, low: int, high: int):
        digits = len(str(width * max(abs(low), abs(high)) ** 2))
        self.base, self.length = 10**digits, digits + 1

    def text(self, score: int) -> str:
        return str(int(score) + self.base).zfill(self.length)

    def score(self, text: str) -> int:
        return int(text) - self.base


def _long(score: int) -> int:
    return max(-_LONG, min(_LONG, int(score)))


def _batch(found: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)


_BEST = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("key", pa.string())])
_HARD = pa.schema([
    ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_score", pa.int64()), ("key", pa.string()),
])


def _best(batches, low: int, high: int, most: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    """Each anchor's first rows of a block."""
    for rows, anchors in blocks(batches, ["width", "label"]):
        ids, own = rows.column("id").to_numpy(), anchors.column("id").to_numpy()
        found = [[] for _ in _BEST]
        for at, scores in _slices(anchors, rows, low, high):
            names = own[at : at + len(scores)]
            codes, bits = _ascending(scores, names[:, None] == ids[None, :])
            last = (1 << bits) - 1
            n_others = len(ids) - (np.searchsorted(ids, names, "right") - np.searchsorted(ids, names, "left"))
            for a, name in enumerate(names.tolist()):
                for code in codes[a, len(ids) - min(most, int(n_others[a])) :].tolist():
                    for column, value in zip(found, (name, int(ids[last - (code & last)]), keys.text(code >> bits))):
                        column.append(value)
        yield _batch(found, _BEST)


def _hard(batches, low: int, high: int, most: int, least_percent: int, most_percent: int, keys: Keys) -> Iterator[pa.RecordBatch]:
    """Each anchor's and positive's first rows of a block within the bounds."""
    for rows, anchors in blocks(batches, ["width"]):
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        own, own_labels = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
        positives, limits = anchors.column("positive_ids").to_pylist(), anchors.column("keys").to_pylist()
        found = [[] for _ in _HARD]
        for at, scores in _slices(anchors, rows, low, high):
            alike = own_labels[at : at + len(scores), None] == labels[None, :]
            n_barred = alike.sum(axis=1).tolist()
            codes, bits = _ascending(scores, alike)
            last = (1 << bits) - 1
            for a in range(len(scores)):
                for positive, text in zip(positives[at + a], limits[at + a]):
                    limit = keys.score(text)
                    floor, ceiling = -(-least_percent * limit // 100), most_percent * limit // 100
                    if floor > ceiling:
                        continue
                    end = int(np.searchsorted(codes[a], _within(((ceiling + 1) << bits) - 1, codes), "right"))
                    for code in codes[a, max(n_barred[a], end - most) : end].tolist():
                        if code >> bits >= floor:
                            score = code >> bits
                            row = (int(own[at + a]), positive, int(ids[last - (code & last)]), _long(limit), _long(score), keys.text(score))
                            for column, value in zip(found, row):
                                column.append(value)
        yield _batch(found, _HARD)


def _within(code: int, codes: np.ndarray) -> int:
    """A bound that the codes' type can hold."""
    return code if codes.dtype == object else max(-(2**63), min(2**63 - 1, code))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label",
    positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``positives`` other rows of the same label by score, ties by smaller
    id. For each, the first ``negatives`` rows of other labels whose score is from ``least_percent`` to
    ``most_percent`` percent of the positive's.

    Rows with a NULL id, label or vector, an empty vector, or a component that is NULL or not
    finite (also after scaling) take no part. Equal rows count once; rows with one id and different
    contents count each as positives and negatives of others, and the first of them (by label, then vector)
    is the anchor of that id. Only vectors of equal length are compared. Scores are exact at any size, and are cut to 64 bits only in the result.
    """
    tag = F.col(f"`{label}`") if isinstance(label, str) else label
    value = F.col(f"`{embedding}`").cast("array<double>")
    scaled = F.transform(value, lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), tag.cast("long").alias("label"), scaled.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))

    def whole(batches):
        for batch in batches:
            column = batch.column("v")
            floors = np.floor(column.flatten().to_numpy()) + 0.0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), pa.int32()), pa.array(floors))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists, batch.column("is_anchor"), column.value_lengths()], names=["id", "label", "v", "is_anchor", "width"])

    rows = rows.mapInArrow(whole, "id long, label long, v array<double>, is_anchor boolean, width int")
    rows = keep_table(rows.distinct(), "scaled-vectors")
    low, high, width = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max("width")).first()
    low, high, width = int(low or 0), int(high or 0), int(width or 1)
    if max(abs(low), abs(high)) < 2**31:  # half the bytes to shuffle
        rows = rows.withColumn("v", F.col("v").cast("array<int>"))
    keys, most = Keys(width, low, high), min(1 << (_PLACE_BITS - 2), rows_per_block(width, 8))
    candidates = rows.drop("is_anchor")
    once = F.row_number().over(Window.partitionBy("id").orderBy("label", "v"))
    anchors = rows.filter("is_anchor").withColumn("once", once).filter("once = 1").drop("once", "is_anchor")

    near = paired_blocks(candidates, anchors, ["width", "label"], most).mapInArrow(
        lambda batches: _best(batches, low, high, positives, keys), "anchor_id long, positive_id long, key string"
    )
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("key").desc(), "positive_id"))
    first = near.withColumn("place", place).filter(F.col("place") <= positives)
    asked = first.groupBy("anchor_id").agg(F.collect_list("positive_id").alias("positive_ids"), F.collect_list("key").alias("keys"))
    wanted = anchors.join(keep_table(asked, "positives"), F.col("id") == F.col("anchor_id")).drop("anchor_id")

    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    hard = paired_blocks(candidates, wanted, ["width"], most, tasks).mapInArrow(
        lambda batches: _hard(batches, low, high, negatives, least_percent, most_percent, keys),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long, key string",
    )
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("key").desc(), "negative_id"))
    ranked = hard.withColumn("rank", place).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
