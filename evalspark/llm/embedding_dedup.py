"""Near-duplicate vectors by signs on random hyperplanes, checked by exact cosine.

Vectors are dealt to buckets by the signs of their products with random
hyperplanes, in several tables. Within a bucket all vectors are compared, in blocks
of bounded size, in double precision. A pair that meets in several tables counts in
the first of them only, which its codes tell, so no list of pairs is needed:
a block gives each vector's number of links and the components inside the block.

How many bits a table has, and whether the hyperplanes go through the origin or through the mean of the vectors, is
decided by what moving and comparing vectors cost: a bounded sample shows how often vectors
meet by chance, also those that share a direction. The number of tables follows from the bits: a pair at the
threshold is found with probability ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.blocks import rows_per_block
from evalspark.llm.common import keep_table, sorted_groups
from evalspark.llm.components import connected_components
from evalspark.llm.cross_polytope import mean_units, units

THRESHOLD = 0.95
RECALL = 0.995
SAMPLE = 1000
_MOVE, _MEET = 5.0, 0.01  # microseconds to move a vector once, and to compare it with another
_MOST_BITS, _MOST_TABLES = 30, 256
_SCORES = 1 << 22  # held at once


def agreement(angle: np.ndarray | float) -> np.ndarray | float:
    """How likely two vectors at this angle have the same sign on a random hyperplane."""
    return 1 - angle / math.pi


def plan_tables(n: int, sample: list[np.ndarray], centres: dict[int, np.ndarray], threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, bool]:
    """Bits per table, number of tables, and whether vectors are centred, for ``n`` vectors that look like the sample."""
    best = (math.inf, 0, 1, False)
    for centred in (False, True):
        by_chance, norms = [], [1.0]
        for width in {len(v) for v in sample}:
            u = units(np.array([v for v in sample if len(v) == width]))
            if centred:
                u = u - centres.get(width, 0.0)
                length = np.sqrt((u * u).sum(axis=1))
                norms.extend(length.tolist())
                u = u / np.maximum(length, 1e-300)[:, None]
            pairs = np.triu_indices(len(u), 1)
            by_chance.append(agreement(np.arccos(np.clip((u @ u.T)[pairs], -1, 1))))
        chance = np.concatenate(by_chance) if by_chance else np.zeros(0)
        # Moved by the mean, a pair at the threshold keeps its distance and loses length: short ones are the hardest.
        short = float(np.quantile(norms, 0.01)) if centred else 1.0
        cosine = 1 - (1 - threshold) / max(short, 1e-9) ** 2
        alike = agreement(math.acos(max(-1.0, min(1.0, cosine))))
        for bits in range(_MOST_BITS + 1):
            found = alike**bits
            tables = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found)) if found > 1e-4 else None
            if tables is None or tables > _MOST_TABLES:
                break
            meets = n * float((chance**bits).mean()) if len(chance) else n
            best = min(best, (tables * (_MOVE + _MEET * meets), bits, tables, centred))
    return best[1:]


def hyperplanes(width: int, bits: int, tables: int, seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, tables * bits))


def sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One code per table for each row."""
    if not bits:
        return np.zeros((len(vectors), tables), np.int32)
    signs = vectors @ hyperplanes(vectors.shape[1], bits, tables) >= 0
    return (signs.reshape(len(vectors), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per vector and block: linked vectors (with their copies) and the smallest one of its component there."""
    for table, bounds in sorted_groups(batches, ["width", "tab", "code", "i", "j"]):
        ids = table.column("vec_id").to_numpy()
        mult = table.column("copies").to_numpy()
        chunk, i, j, tab, width = (table.column(c).to_numpy() for c in ("chunk", "i", "j", "tab", "width"))
        codes = _matrix(table, "codes", np.int32)
        out_id, out_n, out_root = [], [], []
        upto = 0
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo >= upto:  # vectors of another length begin
                since, upto = lo, int(np.searchsorted(width, width[lo], "right"))
                vectors = _matrix(table.slice(since, upto - since), "unit", np.float64)
            if hi - lo < 2:
                continue
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            v, c, ch, m = vectors[order - since], codes[order, : tab[lo]], chunk[order], mult[order]
            counts, ends_a, ends_b, whole = np.zeros(len(order), np.int64), [], [], i[lo] == j[lo]
            part = max(1, _SCORES // len(order))
            for at in range(0, len(order), part):
                close = v[at : at + part] @ v.T >= threshold
                x, y = np.nonzero(close)
                x += at
                keep = (x < y) & (whole | (ch[x] != ch[y]))
                x, y = x[keep], y[keep]
                for t in range(c.shape[1]):  # met in an earlier table already
                    fresh = c[x, t] != c[y, t]
                    x, y = x[fresh], y[fresh]
                np.add.at(counts, x, m[y])
                np.add.at(counts, y, m[x])
                roots = local_components(len(order), x, y)
                moved = np.flatnonzero(roots != np.arange(len(order)))
                ends_a.append(moved)
                ends_b.append(roots[moved])
            roots = local_components(len(order), np.concatenate(ends_a), np.concatenate(ends_b))
            linked = np.flatnonzero(counts)
            out_id.append(ids[order[linked]])
            out_n.append(counts[linked])
            out_root.append(ids[order[roots[linked]]])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        yield pa.RecordBatch.from_arrays([join(out_id), join(out_n), join(out_root)], names=["vec_id", "n", "root"])


def _matrix(table: pa.Table, name: str, dtype) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(table.num_rows, -1)


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Linked are vectors with cosine >= ``threshold``; n_links counts the others
    linked directly, component_id is the smallest vec_id reachable and kept says
    that it is the vector's own. A vector that is NULL, empty, zero, or has a NULL or
    non-finite component is linked with nothing. Only vectors of equal length are
    compared. Equal vectors are one while comparing and count by their number.
    Rows with equal ids are one node; rows without an id have no component.
    """
    value = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), value.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    good = keep_table(good.withColumn("width", F.size("v")).withColumn("h", F.xxhash64("v")), "vectors")
    equal = good.groupBy("width", "h", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    equal = keep_table(equal, "distinct-vectors")
    n, widest = equal.agg(F.count("*"), F.max("width")).first()
    centres = mean_units(equal)
    sample = [np.array(r.v) for r in equal.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()]
    bits, tables, centred = plan_tables(n, sample, centres, threshold, recall)
    block = rows_per_block(widest or 1, 8)
    membership = keep_table(good.join(equal.select("width", "h", F.col("v").alias("w"), "rep", "copies"), ["width", "h"]).filter("v = w").select("vec_id", "rep", "copies"), "vector-copies")

    def code(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                raw = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                raw = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                codes = sign_codes(unit - centres[width] if centred and width in centres else unit, bits, tables)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), lists(unit), lists(codes), pa.array(np.full(len(unit), width), pa.int32())], names=["vec_id", "copies", "unit", "codes", "width"])

    coded = keep_table(equal.select("rep", "copies", "v", "width").mapInArrow(code, "vec_id long, copies long, unit array<double>, codes array<int>, width int"), "codes")
    placed = coded.select("vec_id", "width", F.posexplode("codes").alias("tab", "code"))
    full = placed.groupBy("width", "tab", "code").agg(F.count("*").alias("n")).filter("n > 1")
    busy = placed.join(full, ["width", "tab", "code"]).withColumn("chunks", F.ceil(F.col("n") / block).cast("int"))
    busy = busy.withColumn("chunk", F.pmod(F.hash("vec_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    busy = busy.select("width", "tab", "code", "vec_id", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    dealt = busy.join(coded.select("vec_id", "copies", "unit", "codes"), "vec_id").repartition("width", "tab", "code", "i", "j").sortWithinPartitions("width", "tab", "code", "i", "j")
    met = keep_table(dealt.mapInArrow(lambda batches: _compare(batches, threshold), "vec_id long, n long, root long"), "vector-links")
    counts = met.groupBy("vec_id").agg(F.sum("n").alias("n")).toDF("m_id", "m_n")
    links = met.filter("vec_id != root").select("vec_id", "root").union(membership.filter("vec_id != rep").select("vec_id", "rep"))
    ends = connected_components(links).toDF("e_id", "e")
    linked = membership.join(counts, F.col("rep") == F.col("m_id"), "left").groupBy("vec_id").agg(F.max(F.coalesce("m_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = linked.toDF("l_id", "n_links")
    out = rows.select("vec_id").join(linked, F.col("vec_id") == F.col("l_id"), "left").join(ends, F.col("vec_id") == F.col("e_id"), "left")
    component = F.coalesce("e", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
