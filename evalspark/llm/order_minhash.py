"""Document fingerprints by Order MinHash.

The k-mers of a text (k code points) are numbered by occurrence, so that a repeated
k-mer is several elements. For each of ``sketches`` hash functions the ``picks`` elements
with the smallest values are selected, put back into the order in which they stand in
the text, and hashed as a tuple. Two texts share a tuple only if they share its
k-mers in the same order, so the share of equal tuples follows their edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import mix, slices
from evalspark.tables import parameter_table

K = 6
SKETCHES = 64
PICKS = 2
_CHUNK = 4096
_DIGITS = 4
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def elements(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit value for each k-mer with its occurrence number, in text order."""
    n = len(codes) - k + 1
    if len(codes) == 0:
        return np.zeros(0, np.uint32)
    if n <= 0:
        k, n = len(codes), 1
    wide = codes.astype(np.uint64) + np.uint64(1)
    hashed = mix(_rolled(wide, k)[:n])
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    ordered = np.sort(((hashed >> bits) << bits) | place)
    kmer = ordered >> bits
    new = np.concatenate([[True], kmer[1:] != kmer[:-1]])
    if not new.all():
        at = np.arange(n)
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        again = np.flatnonzero(nth)
        where = (ordered[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        hashed[where] = mix(hashed[where] + nth[again].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (hashed >> np.uint64(32)).astype(np.uint32)


def _rolled(wide: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer, from those of its halves."""
    if k == 1:
        return wide
    half = _rolled(wide, k // 2)
    n = len(wide) - k + 1
    both = half[:n] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    both += half[k // 2 : k // 2 + n]
    if k % 2:
        both *= np.uint64(0xD1342543DE82EF95)
        both += wide[k - 1 : k - 1 + n]
    return both


@cache
def family(sketches: int, seed: int = 6) -> np.ndarray:
    """Odd factors: each puts the 32-bit values, which are mixed already, into another order."""
    return np.random.default_rng(seed).integers(0, 2**31, sketches, np.uint32) * np.uint32(2) + np.uint32(1)


@cache
def _buffer(sketches: int) -> np.ndarray:
    return np.empty(sketches * _CHUNK, np.uint32)


def fingerprint(text: str, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> str:
    """``sketches`` tuples of four hexadecimal digits each; the empty text has the empty fingerprint."""
    values = elements(code_points(text), k)
    if not len(values):
        return ""
    factors = family(sketches)
    picks = min(picks, len(values))
    best = []
    space, rows = _buffer(sketches), np.arange(sketches)
    for at in range(0, len(values), _CHUNK):
        part = values[at : at + _CHUNK]
        n = len(part)
        order = np.multiply(part, factors[:, None], out=space[: sketches * n].reshape(sketches, n))
        for _ in range(min(picks, len(part))):
            i = order.argmin(axis=1)
            least = order[rows, i]
            best.append((least.astype(np.uint64) << np.uint64(32)) | (i + at).astype(np.uint64))
            order[rows, i] = 0xFFFFFFFF
    chosen = np.sort(np.stack(best, axis=1), axis=1)[:, :picks] & np.uint64(0xFFFFFFFF)
    chosen = np.sort(chosen, axis=1).astype(np.int64)
    out = np.zeros(sketches, np.uint64)
    for j in range(picks):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[chosen[:, j]].astype(np.uint64) + np.uint64(1))
    return (out >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal tuples; 1 for two empty fingerprints, 0 if only one is empty."""
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + _DIGITS] == b[i : i + _DIGITS] for i in range(0, len(a), _DIGITS)) / (len(a) // _DIGITS)


def fingerprints(text: Column, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> Column:
    """The fingerprint of a text column; NULL counts as empty."""
    @F.pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: fingerprint(t or "", k, sketches, picks))

    return of(F.coalesce(text.cast("string"), F.lit("")))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_probe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """Fingerprints of each text, of an edited text, and their likeness (columns of SCHEMA).

    The edited text takes its second half from the next document: documents are
    ordered by descending doc_id, NULL last and equal ids by text, and the first
    follows the last. A single document follows itself. A NULL text counts as empty.

    Texts move once: they are dealt to ranges of ids and sorted there; the first
    document of a range is copied to the range in front of it, which needs it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    # A few ranges per partition, so that their sizes even out.
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 0.1 / n)))
    # Ranges in descending order of ids; the last one is for rows without an id.
    above = F.filter(F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>"), lambda c: c >= F.col("doc_id"))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(above))
    heads = sorted((r.part, r.head) for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect())
    lenders = [(p, head, heads[i - 1][0]) for i, (p, head) in enumerate(heads)]
    lenders = parameter_table(spark, lenders, T.StructType([T.StructField("l_part", T.IntegerType()), T.StructField("head", T.LongType()), T.StructField("front", T.IntegerType())]))
    dealt = rows.withColumn("part", part).join(lenders, F.col("part") == F.col("l_part"))
    dealt = dealt.withColumn("lend", F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.col("front")))
    own, lent = F.struct(F.col("part").alias("to"), F.lit(0).alias("guest")), F.struct(F.col("lend").alias("to"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("place", F.explode(F.when(F.col("lend").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    dealt = dealt.select("place.to", "place.guest", "doc_id", "text").repartition(n, "to")
    dealt = dealt.sortWithinPartitions("to", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done = None, None
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for to, guest, i, value in zip(*[batch.column(c).to_pylist() for c in ("to", "guest", "doc_id", "text")]):
                    if waiting is None and guest or to == done:
                        continue  # a lent document behind the one that was needed
                    print_ = fingerprint(value, k, sketches, picks)
                    if waiting is not None:
                        at, before, shown = waiting
                        changed = edited(before, value)
                        other = fingerprint(changed, k, sketches, picks)
                        out.append((at, len(before), hashlib.sha256(changed.encode("utf-8")).hexdigest(), shown, other, likeness(shown, other), likeness(shown, print_)))
                    waiting, done = (None, to) if guest else ((i, value, print_), None)
                columns = list(zip(*out)) if out else [[]] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, SCHEMA)
