"""Near-duplicate documents by MinHash with banding.

1. Signatures: the minima of many universal hashes over a document's word shingles.
   Documents with the same set are found by a digest of the set and become one.
2. Bands of the signature are grouped. Each document is tried with the first
   document of a group it shares most bands with, on the full sets.
3. Groups that now hold several components are compared in blocks of bounded size:
   pairs of different components whose signatures look similar enough are tried
   on the full sets, too, the most similar ones first. A pair is tried in one group.
4. Components of the links by alternating large-star and small-star.

So no link between components is lost to the choice of a group's first document,
while links inside one component need not all be tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hashed_words, keep_table, mix, slices, sorted_groups
from evalspark.llm.components import connected_components

WIDTH = 5
PERCENT = 80
BANDS = 24
ROWS = 5
_BLOCK = 512
_BLOCK_SHINGLES = 2_000_000  # of the texts in half a block
_SIGNATURES = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"


def lowered(text: str) -> list[bytes]:
    """The words with A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of a document's word hashes, sorted; fewer words than ``width`` make one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for i in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(mix(out + np.uint64(width)))


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` multiply-shift hashes, which are universal."""
    draw = np.random.default_rng(seed)
    multipliers = draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return multipliers, draw.integers(0, 2**63, n, np.uint64)


def minima(shingles: np.ndarray, starts: np.ndarray, family) -> np.ndarray:
    """One row of minima per document, for the non-empty documents that begin at ``starts``."""
    out = np.empty((len(family[0]), len(starts)), np.uint32)
    for i, (a, b) in enumerate(zip(*family)):
        out[i] = np.minimum.reduceat((shingles * a + b) >> np.uint64(32), starts)
    return out.T


def _signatures(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    family = hash_family(bands * rows)
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, counts = hashed_words([(t or "").encode("utf-8") for t in batch.column("text").to_pylist()], lower=True)
            sets = [shingle_hashes(h, width) for h in np.split(hashes, np.cumsum(counts)[:-1])]
            sizes = np.array([len(s) for s in sets])
            signature = np.zeros((len(sets), bands * rows), np.uint32)
            todo = np.flatnonzero(sizes)
            at = 0
            while at < len(todo):  # parts that fit the processor's cache
                upto = at + 1
                total = sizes[todo[at]]
                while upto < len(todo) and total + sizes[todo[upto]] <= 30_000:
                    total += sizes[todo[upto]]
                    upto += 1
                part = todo[at:upto]
                starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                signature[part] = minima(np.concatenate([sets[i] for i in part]), starts, family)
                at = upto
            keys = np.full((len(sets), bands), np.uint64(0))
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r::rows])
            set1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            set2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64)
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))),
            ], names=["doc_id", "n_shingles", "set1", "set2", "bands"])


def similar(words_a: list[bytes], words_b: list[bytes], width: int, percent: int) -> bool:
    """100 * common shingles >= percent * all shingles, on the words themselves."""
    a, b = (_shingles(w, width) for w in (words_a, words_b))
    common = len(a & b)
    return bool(a) and 100 * common >= percent * (len(a) + len(b) - common)


def _shingles(words: list[bytes], width: int) -> set:
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(width)]))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(texts.toDF("a", "text_a"), "a")
    both = left.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            hold = [similar(lowered(x or ""), lowered(y or ""), width, percent) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _block_links(batches: Iterator[pa.RecordBatch], width: int, percent: int, bands: int, rows: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links between components inside a block of a group, as few as join all that are linked.

    Pairs that share an earlier band are left to that band's group. Signatures are
    compared first; what agrees often enough is confirmed on the full sets.
    """
    family = hash_family(bands * rows)
    for table, bounds in sorted_groups(batches, ["band", "key", "i", "j"]):
        docs, comps, band = (table.column(c).to_numpy() for c in ("doc_id", "component", "band"))
        chunk, i, j = (table.column(c).to_numpy() for c in ("chunk", "i", "j"))
        texts = table.column("text")
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if len(np.unique(comps[lo:hi])) < 2:
                continue
            raw = [(t or "").encode("utf-8") for t in texts.slice(lo, hi - lo).to_pylist()]
            hashes, counts = hashed_words(raw, lower=True)
            sets = [shingle_hashes(h, width) for h in np.split(hashes, np.cumsum(counts)[:-1])]
            sizes = np.array([len(s) for s in sets])
            signature = np.zeros((hi - lo, bands * rows), np.uint32)
            signature[sizes > 0] = minima(np.concatenate(sets), (np.cumsum(sizes) - sizes)[sizes > 0], family) if sizes.any() else 0
            full, root = {}, {int(c): int(c) for c in comps[lo:hi]}

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            pairs = []
            for x in range(hi - lo - 1):
                y = np.arange(x + 1, hi - lo)
                y = y[(comps[lo + y] != comps[lo + x]) & ((i[lo] == j[lo]) | (chunk[lo + y] != chunk[lo + x]))]
                y = y[100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x])]
                if len(y):
                    same = signature[y] == signature[x]
                    share = same.mean(axis=1)
                    earlier = same.reshape(len(y), bands, rows)[:, : band[lo]].all(axis=2).any(axis=1)
                    pairs.extend((-share[k], x, int(y[k])) for k in np.flatnonzero((share >= least) & ~earlier))
            for _, x, y in sorted(pairs):
                one, other = find(int(comps[lo + x])), find(int(comps[lo + y]))
                if one == other:
                    continue
                for k in (x, y):
                    if k not in full:
                        full[k] = _shingles(raw[k].lower().split(), width)
                common = len(full[x] & full[y])
                if 100 * common >= percent * (len(full[x]) + len(full[y]) - common):
                    root[max(one, other)] = min(one, other)
                    found.append((docs[lo + x], docs[lo + y]))
        columns = list(zip(*found)) if found else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Words are runs of other characters than ASCII white space, A-Z in lower case. A
    text with fewer words than ``width`` is one shingle; one without words, or NULL,
    is empty and linked with nothing. Documents are linked when 100 * common >=
    ``percent`` * all of their distinct shingles; component_id is the smallest id
    reachable and kept says that it is the document's own. Rows with equal ids are
    one node with the links of all of them; rows without an id are linked with
    nothing and have no component.

    A pair at 80 % is found by at least one of 24 bands of 5 with probability
    0.9999; signatures rule pairs out only four standard deviations below.
    """
    ids, value = F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    plain = docs.select(ids, value)

    def sign(batches):
        return _signatures(batches, width, bands, rows)

    signed = keep_table(plain.mapInArrow(sign, _SIGNATURES), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    same = filled.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = keep_table(filled.select("doc_id", "set1", "set2", "n_shingles").join(same, ["set1", "set2", "n_shingles"]), "equal-sets")
    equal_links = same.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    one_each = same.filter("doc_id = rep").select("doc_id", "set1", "set2").distinct()
    banded = filled.join(one_each, ["doc_id", "set1", "set2"]).select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    # A group's blocks are bounded by documents and by what their texts hold.
    parts = F.greatest(F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES)).cast("int")
    first = banded.groupBy("band", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), parts.alias("chunks")).filter("n > 1")
    members = keep_table(banded.join(first, ["band", "key"]).select("band", "key", "doc_id", "first", "chunks"), "band-groups")
    involved = members.select("doc_id").distinct().withColumnRenamed("doc_id", "i_id")
    texts = keep_table(plain.join(involved, F.col("doc_id") == F.col("i_id"), "left_semi").distinct(), "candidate-texts")

    shared = members.filter("doc_id != first").groupBy("doc_id", "first").agg(F.count("*").alias("n"))
    best = shared.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("first")).alias("neg"))).alias("best"))
    tried = keep_table(best.select(F.col("doc_id").alias("a"), (-F.col("best.neg")).alias("b")), "pairs")
    links = keep_table(equal_links.unionByName(confirmed(tried, texts, width, percent)), "links")
    found = keep_table(connected_components(links), "components")

    # Groups that hold several components.
    where = found.toDF("c_id", "c")
    placed = keep_table(members.join(where, F.col("doc_id") == F.col("c_id"), "left").select("band", "key", "doc_id", "chunks", F.coalesce("c", "doc_id").alias("component")), "placed")
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band", "key")
    open_rows = placed.join(mixed, ["band", "key"], "left_semi")
    open_rows = open_rows.withColumn("chunk", F.pmod(F.hash("doc_id"), F.col("chunks")).cast("int"))
    blocks = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = blocks.select("band", "key", "doc_id", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    deviation = (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    least = percent / 100 - 4 * deviation
    dealt = blocks.join(texts, "doc_id").repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    more = keep_table(dealt.mapInArrow(lambda batches: _block_links(batches, width, percent, bands, rows, least), "a long, b long"), "links")
    found = keep_table(connected_components(links.unionByName(more)), "components")
    ends = found.toDF("e_id", "e")
    out = signed.select("doc_id", "n_shingles").join(ends, F.col("doc_id") == F.col("e_id"), "left")
    component = F.coalesce("e", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
