"""Approximate nearest neighbours by cross-polytope hashing.

A vector is centred, padded to a power of two and turned by pseudo-rotations (three rounds of
random signs and a fast Hadamard transform). The signed axis nearest to it is its hash
value; a code joins the values of a few rotations, the last of which may use some
axes only, so that the number of buckets follows the number of vectors. There
are several tables. A query looks into the buckets of its likeliest codes in each table
(those whose axes it misses by least), and what it finds there is ranked by exact cosine.

How many codes a query probes is measured, not guessed: the exact neighbours of a bounded sample of
queries tell how far down the probing order they are found, and the number of probes
is the smallest that finds ``recall`` of them, but 16 at least. Where the order ends before that, buckets are
made larger; one bucket would find everything.

Buckets are compared in blocks of bounded size, so that a bucket with most of the vectors is many
tasks. Equal vectors are one until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.blocks import blocks, finite, first_in_runs, matrix, paired_blocks, rows_per_block
from evalspark.llm.common import keep_table
from evalspark.operators.ranking import first_per_group

TABLES = 3
BUCKET = 256
RECALL = 0.96
SAMPLE = 128
_ROUNDS = 3
_LEAST_PROBES = 16
_MOST_PROBES = 4096
_CENTRED_WIDTHS = 16
_PART = 1 << 21
_WAITING = 1 << 20
_MARGIN = 1e-9
_SEED = 11


def padded(width: int) -> int:
    return 1 << max(0, (width - 1).bit_length())


def pseudo_rotation(vectors: np.ndarray, number: int) -> np.ndarray:
    """Rounds of random signs and a Hadamard transform, over vectors padded to a power of two."""
    n, width = vectors.shape
    size = padded(width)
    y = np.zeros((n, size))
    y[:, :width] = vectors
    signs = np.random.default_rng([_SEED, number, size]).choice([-1.0, 1.0], (_ROUNDS, size))
    for row in signs:
        y = y * row
        step = 1
        while step < size:
            halves = y.reshape(n, size // (2 * step), 2, step)
            y = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, size)
            step *= 2
        y /= math.sqrt(size)
    return y


def axes_for(n: int, width: int, bucket: int) -> tuple[int, ...]:
    """How many axes each rotation of a code uses, for about ``n / bucket`` different codes."""
    wanted, axes = n / bucket, []
    while wanted > 1:
        axes.append(min(padded(width), 1 << max(0, math.ceil(math.log2(wanted / 2)))))
        wanted /= 2 * axes[-1]
    return tuple(axes)


@dataclass(frozen=True)
class Tables:
    """How vectors get their codes: rotations of each table, axes used, and the point that is the origin."""

    tables: int
    axes: tuple[int, ...]
    centres: dict[int, np.ndarray]

    def _turned(self, unit: np.ndarray, table: int) -> Iterator[np.ndarray]:
        centre = self.centres.get(unit.shape[1])
        moved = unit if centre is None else unit - centre
        for f, axes in enumerate(self.axes):
            yield pseudo_rotation(moved, table * 64 + f)[:, :axes]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One code per vector and table: the nearest signed axes."""
        out = np.zeros((len(unit), self.tables), np.int64)
        for t in range(self.tables):
            for y in self._turned(unit, t):
                axis = np.argmax(np.abs(y), axis=1)
                negative = y[np.arange(len(y)), axis] < 0
                out[:, t] = out[:, t] * (2 * y.shape[1]) + 2 * axis + negative
        return out

    def probes(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` likeliest codes per vector and table, likeliest first (all codes, if there are fewer)."""
        out = []
        for t in range(self.tables):
            loss, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
            for y in self._turned(unit, t):
                n_values = 2 * y.shape[1]
                signed = np.stack([y, -y], axis=2).reshape(len(y), n_values)
                missed = (signed.max(axis=1, keepdims=True) - signed) ** 2
                values = np.argsort(missed, axis=1, kind="stable")[:, :most]
                missed = np.take_along_axis(missed, values, axis=1)
                loss = (loss[:, :, None] + missed[:, None, :]).reshape(len(y), -1)
                code = (code[:, :, None] * n_values + values[:, None, :]).reshape(len(y), -1)
                order = np.argsort(loss, axis=1, kind="stable")[:, :most]
                loss, code = np.take_along_axis(loss, order, axis=1), np.take_along_axis(code, order, axis=1)
            out.append(code)
        return np.stack(out, axis=1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def units(vectors: np.ndarray) -> np.ndarray:
    v = scaled(vectors)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows, summed component by component, so that it depends on the pair alone."""
    dot, a_square, b_square = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        dot += x * y
        a_square += x * x
        b_square += y * y
    return np.clip(dot / np.sqrt(a_square * b_square), -1.0, 1.0)


def _by_width(batches, columns: list[str]) -> Iterator[tuple[np.ndarray, list]]:
    """The vectors of a batch, those of one length at a time, with other columns."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            yield part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), [part.column(c) for c in columns]


def _lists(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    flat = pa.array(values.reshape(-1)) if values.ndim == 2 else _lists(values.reshape(-1, values.shape[2]))
    return pa.ListArray.from_arrays(offsets, flat)


def mean_units(equal: DataFrame) -> dict[int, np.ndarray]:
    """The mean unit vector of the commonest lengths, from columns width and v."""

    def sums(batches):
        total: dict[int, list] = {}
        for v, _ in _by_width(batches, []):
            kept = total.setdefault(v.shape[1], [0, np.zeros(v.shape[1])])
            kept[0] += len(v)
            kept[1] += units(v).sum(axis=0)
        for width, (n, mean) in total.items():
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * width, pa.int32()), "pos": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "s": mean})

    parts = equal.select("width", "v").mapInArrow(sums, "width int, pos int, n long, s double")
    means = parts.groupBy("width", "pos").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 4).alias("m"))
    common = means.filter("pos = 0").orderBy(F.desc("n"), "width").limit(_CENTRED_WIDTHS).select("width")
    out: dict[int, np.ndarray] = {}
    for row in means.join(common, "width").collect():
        out.setdefault(row.width, np.zeros(row.width))[row.pos] = row.m
    return out


def _sample(equal: DataFrame, size: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Some asked vectors, each with its exact nearest other vectors: a bounded number on the driver."""
    rows = equal.filter("asked").orderBy(F.xxhash64("id"), "id").limit(size).collect()
    asked = [(r.id, np.array(r.v)) for r in rows]
    by_width = {w: [i for i, (_, v) in enumerate(asked) if len(v) == w] for w in {len(v) for _, v in asked}}
    stacked = {w: (np.array(places), np.array([asked[i][0] for i in places]), units(np.array([asked[i][1] for i in places]))) for w, places in by_width.items()}

    def near(batches):
        best: dict[int, tuple] = {}
        for v, (ids,) in _by_width(batches, ["id"]):
            if v.shape[1] not in stacked:
                continue
            places, own, mine = stacked[v.shape[1]]
            score = mine @ units(v).T
            score[own[:, None] == ids.to_numpy()[None, :]] = -np.inf
            before = best.get(v.shape[1])
            if before is not None:
                score = np.concatenate([before[0], score], axis=1)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            source = [np.concatenate([old, v]) for old in before[1]] if before is not None else [v] * len(mine)
            best[v.shape[1]] = (np.take_along_axis(score, order, axis=1), [s[o] for s, o in zip(source, order)])
        for width, (score, found) in best.items():
            for place, s, vectors in zip(stacked[width][0], score, found):
                keep = s > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array([place] * int(keep.sum()), pa.int32()), pa.array(s[keep]), _lists(vectors[keep])], names=["place", "score", "v"])

    found = equal.select("id", "width", "v").mapInArrow(near, "place int, score double, v array<double>")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "v"))).filter(F.col("r") <= k)
    return [(asked[r.place][1], np.array(r.v)) for r in found.select("place", "v").collect()]


def measured_plan(pairs: list[tuple[np.ndarray, np.ndarray]], n: int, width: int, tables: int, bucket: int, recall: float, centres: dict) -> tuple[Tables, int]:
    """The tables and the number of probes that find ``recall`` of the given (query, neighbour) pairs."""
    while True:
        hashing = Tables(tables, axes_for(n, width, bucket), centres)
        ranks = []
        for a, b in pairs:
            probes, codes = hashing.probes(units(a[None]), _MOST_PROBES)[0], hashing.codes(units(b[None]))[0]
            hits = [np.flatnonzero(p == c) for p, c in zip(probes, codes)]
            ranks.append(min((int(h[0]) for h in hits if len(h)), default=_MOST_PROBES))
        ranks.sort()
        needed = ranks[max(0, math.ceil(recall * len(ranks)) - 1)] + 1 if ranks else 1
        if needed <= _MOST_PROBES:
            return hashing, max(needed, _LEAST_PROBES)
        bucket *= 4


def _first(x: np.ndarray, y: np.ndarray, score: np.ndarray, most: int) -> list[np.ndarray]:
    """The first ``most`` vectors y of each query x, each of them once."""
    order = np.lexsort((y, -score, x))
    x, y, score = x[order], y[order], score[order]
    fresh = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (score[1:] != score[:-1])]) if len(x) else np.zeros(0, bool)
    x, y, score = x[fresh], y[fresh], score[fresh]
    kept = first_in_runs(x, most)
    return [x[kept], y[kept], score[kept]]


def _compare(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Each query's first vectors by exact cosine, over the blocks of a partition.

    What is found is reduced to ``most`` a query whenever it has grown to _WAITING rows, and handed on
    if that does not halve it; so a partition tells little more than its queries, however many blocks they meet."""
    found, n = [], 0
    batch = lambda columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "near", "score"])
    for rows, askers in blocks(batches, ["width", "tab", "code"]):
        ids, own = rows.column("id").to_numpy(), askers.column("id").to_numpy()
        c, q = scaled(matrix(rows, "v")), scaled(matrix(askers, "v"))
        c_unit, q_unit = units(c), units(q)
        step = max(1, _PART // len(c))
        for at in range(0, len(q), step):
            near = q_unit[at : at + step] @ c_unit.T
            if near.shape[1] > most:  # all that may be among the first, with room for rounding
                least = np.partition(near, -most, axis=1)[:, -most][:, None] - _MARGIN
            else:
                least = np.full((len(near), 1), -np.inf)
            x, y = np.nonzero(near >= least)
            score = np.concatenate([exact_cosines(q[at + x[s : s + _PART // 16]], c[y[s : s + _PART // 16]]) for s in range(0, len(x), _PART // 16)])
            found.append(_first(own[at + x], ids[y], score, most))
            n += len(found[-1][0])
            if n >= _WAITING:
                found = [_first(*map(np.concatenate, zip(*found)), most)]
                n = len(found[0][0])
                if n >= _WAITING // 2:
                    yield batch(found[0])
                    found, n = [], 0
    if found:
        yield batch(_first(*map(np.concatenate, zip(*found)), most))


def nearest(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
    tables: int = TABLES, bucket: int = BUCKET, recall: float = RECALL, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row with ``is_query``, by cosine in double precision.

    Every row but the query's own is a candidate; ties go to the smaller id, and a query with fewer
    candidates has fewer rows. Rows without an id, and vectors that are NULL, empty, zero or have a NULL or
    non-finite component take no part. Ids are keys: of rows with one id the first vector (by its
    components) counts. Only vectors of equal length are compared.
    """
    value = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    once = F.row_number().over(Window.partitionBy("id").orderBy("v", F.desc("asked")))
    rows = rows.withColumn("once", once).filter("once = 1").drop("once")
    good = keep_table(rows.withColumn("width", F.size("v")).withColumn("h", F.xxhash64("v")), "search-vectors")
    equal = keep_table(good.groupBy("width", "h", "v").agg(F.min("id").alias("id"), F.max("asked").alias("asked")), "search-distinct")
    same = equal.select(F.col("width").alias("w"), F.col("h").alias("g"), F.col("v").alias("u"), F.col("id").alias("rep"))
    members = keep_table(good.join(same, (F.col("width") == F.col("w")) & (F.col("h") == F.col("g"))).filter("v = u").select("id", "rep", "asked"), "search-members")

    n, width = equal.agg(F.count("*"), F.max("width")).first()
    centres = mean_units(equal)
    hashing, probes = measured_plan(_sample(equal, sample, k), n, width or 1, tables, bucket, recall, centres)

    def coded(batches):
        for v, (ids, widths) in _by_width(batches, ["id", "width"]):
            yield pa.RecordBatch.from_arrays([ids, widths, _lists(v), _lists(hashing.codes(units(v)))], names=["id", "width", "v", "codes"])

    def probing(batches):
        for v, (ids, widths) in _by_width(batches, ["id", "width"]):
            for at in range(0, len(v), 64):
                part = slice(at, at + 64)
                yield pa.RecordBatch.from_arrays([ids[part], widths[part], _lists(v[part]), _lists(hashing.probes(units(v[part]), probes))], names=["id", "width", "v", "codes"])

    place = ["id", "width", "v"]
    index = equal.select(*place).mapInArrow(coded, "id long, width int, v array<double>, codes array<long>")
    index = keep_table(index, "search-index").select(*place, F.posexplode("codes").alias("tab", "code"))
    asked = equal.filter("asked").select(*place).mapInArrow(probing, "id long, width int, v array<double>, codes array<array<long>>")
    asked = keep_table(asked, "search-probes").select(*place, F.posexplode("codes").alias("tab", "some")).select(*place, "tab", F.explode("some").alias("code"))
    most = k + 1  # one may be the query itself
    dealt = paired_blocks(index, asked, ["width", "tab", "code"], rows_per_block(width or 1, 8))
    met = dealt.mapInArrow(lambda batches: _compare(batches, most), "query long, near long, score double")
    met = met.groupBy("query", "near").agg(F.max("score").alias("score"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))).filter(F.col("r") <= most)

    # Copies come back: of equal vectors, the first ids are enough.
    names = first_per_group(members.select("rep", "id"), ["rep"], [F.col("id")], most).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    spread = best.join(names, F.col("near") == F.col("rep")).select("query", "score", F.explode("ids").alias("vec_id"))
    first = spread.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= most)
    listed = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    answered = members.filter("asked").select(F.col("id").alias("query_id"), "rep").join(listed, F.col("rep") == F.col("query"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = answered.select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
