"""Removal of long repeated passages by recompression.

Words become symbols. Rounds then replace runs of one symbol and pairs of symbols by
new symbols: each round splits all symbols into left and right ones by a hash, and a
left one followed by a right one becomes a pair. A symbol's name is a hash of
what it stands for, so names are the same everywhere without a table of names, and
equal passages are parsed alike except at their ends.

How far "at their ends" reaches is tracked: each symbol carries the stretch of words
that decided on it. A window of words that holds this whole stretch has the
symbol wherever it occurs. Each window is represented by one of the
symbols in it, chosen by their hashes, so equal windows have equal representatives, and

- windows whose symbol occurs in one document only are settled;
- the windows of one symbol's occurrence are compared as a whole first, by the hash of
  the passage they cover: an equal passage in an earlier document settles them all;
- only for symbols with several different passages, windows are compared one by one,
  each passage by its first document alone;
- a window without a symbol of its own is compared by itself from the start.

The result does not depend on the number of rounds, only the amount of work does.
Names and window hashes have 64 bits each and are compared together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hashed_words, keep_table, mix, slices

WINDOW = 50
ROUNDS = 8
RUN_ROUNDS = (0,)
_MARKS = "name long, span long, doc_id long, tag int, start int, n int"
_WINDOWS = "h1 long, h2 long, doc_id long, tag int, start int"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"
_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 2**64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, np.uint64(base))
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``stretch`` gets the hash of any stretch."""
        self.reach(len(hashes) + 1)
        return np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)])

    def stretch(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.down[start])


def recompress(words: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int, run_rounds=RUN_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """name, lo, hi of the last round's symbols: words lo to hi decided on the symbol.

    ``first`` and ``last`` are the bounds of each word's document. What depends on
    the end of a document reaches one word beyond it.
    """
    name, lo, a, z = words.copy(), np.arange(len(words)), first, last
    hi = lo + 1
    for r in range(rounds):
        if len(name) < 2:
            break
        near = a[1:] == a[:-1]
        if r in run_rounds:
            heads = np.flatnonzero(np.concatenate([[True], ~(near & (name[1:] == name[:-1]))]))
            size = np.diff(np.concatenate([heads, [len(name)]]))
            tails = heads + size - 1
            low = np.where(heads > a_index(a, heads), lo[np.maximum(heads - 1, 0)], a[heads] - 1)
            following = np.minimum(tails + 1, len(name) - 1)
            high = np.where((following > tails) & (a[following] == a[tails]), hi[following], z[tails] + 1)
            name = np.where(size > 1, mix(name[heads] ^ mix(size.astype(np.uint64) + np.uint64(r << 40))), name[heads])
            lo, hi, a, z = low, high, a[heads], z[heads]
            if len(name) < 2:
                break
            near = a[1:] == a[:-1]
        left = (mix(name ^ np.uint64((r + 1) * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(1)).astype(bool)
        pair = np.concatenate([near & left[:-1] & ~left[1:], [False]])
        after_hi = np.concatenate([np.where(near, hi[1:], z[:-1] + 1), z[-1:] + 1])
        before_lo = np.concatenate([a[:1] - 1, np.where(near, lo[:-1], a[1:] - 1)])
        low, high = np.where(left, lo, before_lo), np.where(left, after_hi, hi)
        joined = name.copy()
        at = np.flatnonzero(pair)
        joined[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(name[at + 1] + np.uint64(r + 1)))
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, lo, hi, a, z = joined[keep], low[keep], high[keep], a[keep], z[keep]
    inside = (lo >= a) & (hi <= z)
    return name[inside], lo[inside], hi[inside]


def a_index(a: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The place of the first symbol of each head's document."""
    return np.searchsorted(a, a[heads], "left")


def representatives(name, lo, hi, first: np.ndarray, last: np.ndarray, window: int):
    """The symbol that represents each window: of those decided within it, the one with the
    smallest hash, the leftmost of equals.

    Returns name and lo of symbols with the first and last window start that each
    represents, and the window starts that have no symbol.
    """
    n = len(first)
    fits = hi - lo <= window
    name, lo, hi = name[fits], lo[fits], hi[fits]
    starts = np.flatnonzero(np.arange(n) + window <= last)
    if not len(lo) or not len(starts):
        return name[:0], lo[:0], lo[:0], lo[:0], starts
    count = lambda ends: np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n + 1))])  # noqa: E731  ends below each place
    begin, end = count(lo)[starts], count(hi)[starts + window + 1]
    some = begin < end
    alone, starts, begin, end = starts[~some], starts[some], begin[some], end[some]
    if not len(starts):
        return name[:0], lo[:0], lo[:0], lo[:0], alone
    order = mix(name ^ np.uint64(0xA0761D6478BD642F))
    least = [np.arange(len(name))]  # the best of 1, 2, 4 ... symbols from each on
    width = 1
    while 2 * width <= (end - begin).max():
        a = least[-1]
        b = np.concatenate([a[width:], a[len(a) - width :]])[: len(a)] if width < len(a) else a
        least.append(np.where(order[b] < order[a], b, a))
        width *= 2
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    pick = np.empty(len(starts), np.int64)
    for k, best in enumerate(least):
        now = np.flatnonzero(level == k)
        a, b = best[begin[now]], best[end[now] - (1 << k)]
        pick[now] = np.where(order[b] < order[a], b, a)
    head = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (np.diff(starts) != 1)]))
    tail = np.concatenate([head[1:], [len(starts)]]) - 1
    used = pick[head]
    return name[used], lo[used], starts[head], starts[tail], alone


def _words(batch: pa.RecordBatch) -> tuple:
    """Word hashes of a slice, bounds of each word's document, document of each word, tags."""
    texts = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
    hashes, sizes = hashed_words(texts)
    stops = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    tags = np.array([xxhash.xxh32_intdigest(t) for t in texts], np.uint32).view(np.int32)
    return hashes, (stops - sizes)[doc], stops[doc], doc, tags


def _marks(batches: Iterator[pa.RecordBatch], window: int, rounds: int) -> Iterator[pa.RecordBatch]:
    powers = [Powers(b) for b in _BASES]
    for whole in batches:
        for batch in slices(whole, "text"):
            words, first, last, doc, tags = _words(batch)
            name, lo, u, v, alone = representatives(*recompress(words, first, last, rounds), first, last, window)
            sums = [p.sums(words) for p in powers]
            span = mix(powers[0].stretch(sums[0], u, v + window) ^ mix((lo - u).astype(np.uint64) * np.uint64(1000003) + (v - u).astype(np.uint64)))
            name = np.concatenate([name, powers[1].stretch(sums[1], alone, alone + window)])
            span = np.concatenate([span, powers[0].stretch(sums[0], alone, alone + window)])
            start = np.concatenate([u, alone])
            at = doc[start]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(name.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[at], pa.int64()), pa.array(tags[at]),
                pa.array((start - first[start]).astype(np.int32)), pa.array(np.concatenate([v - u + 1, np.ones(len(alone), np.int64)]).astype(np.int32)),
            ], names=["name", "span", "doc_id", "tag", "start", "n"])


def _single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    powers = [Powers(b) for b in _BASES]
    for whole in batches:
        for batch in slices(whole, "text"):
            words, first, last, doc, tags = _words(batch)
            stops = np.cumsum(np.bincount(doc, minlength=batch.num_rows))
            begin = np.concatenate([[0], stops[:-1]])
            asked = [np.unique(np.concatenate([np.arange(s, s + n) for s, n in zip(*[[p[k] for p in places] for k in ("start", "n")])])) if tags[i] == tag else np.zeros(0, np.int64)
                     for i, (tag, places) in enumerate(zip(batch.column("tag").to_pylist(), batch.column("places").to_pylist()))]
            sizes = [len(x) for x in asked]
            at = np.repeat(np.arange(batch.num_rows), sizes)
            local = np.concatenate([*asked, np.zeros(0, np.int64)]).astype(np.int64)
            start = local + begin[at]
            sums = [p.sums(words) for p in powers]
            h1, h2 = (mix(p.stretch(s, start, start + window)) for p, s in zip(powers, sums))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[at], pa.int64()), pa.array(tags[at]), pa.array(local.astype(np.int32))], names=["h1", "h2", "doc_id", "tag", "start"])


def _rest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            counts, removed, kept = [], [], []
            for value, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = (value or "").encode("utf-8").split()
                if places:
                    change = np.zeros(len(words) + 1, np.int64)
                    start = np.array([p["start"] for p in places])
                    np.add.at(change, start, 1)
                    np.add.at(change, start + [p["n"] - 1 + window for p in places], -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                else:
                    removed.append(0)
                    kept.append(b" ".join(words))
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8") for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _tagged(docs: DataFrame) -> DataFrame:
    """The tag of a text as the tasks compute it."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                tags = np.array([xxhash.xxh32_intdigest((t or "").encode("utf-8")) for t in batch.column("text").to_pylist()], np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(tags)], names=["doc_id", "text", "t_tag"])

    return docs.mapInArrow(run, "doc_id long, text string, t_tag int")


def repeated_places(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, tag, places: window starts (start, n following ones) that repeat an earlier document."""
    named = docs.filter("doc_id is not null")
    marks = keep_table(named.mapInArrow(lambda b: _marks(b, window, rounds), _MARKS), "marks")
    shared = marks.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("name")
    some = keep_table(marks.join(shared, "name", "left_semi"), "shared-marks")
    spans = keep_table(some.groupBy("name", "span").agg(F.min("doc_id").alias("first")), "spans")
    counts = spans.groupBy("name").agg(F.count("*").alias("spans"))
    spans = spans.join(counts, "name")
    placed = keep_table(some.join(spans, ["name", "span"]).filter("first < doc_id or spans > 1").select("doc_id", "tag", "start", "n", (F.col("first") < F.col("doc_id")).alias("settled")), "placed-marks")
    place = F.struct("start", "n").alias("place")
    ask = placed.filter("not settled").groupBy("doc_id", "tag").agg(F.collect_list(place).alias("places"))
    single = named.join(ask, "doc_id").select("doc_id", "tag", "places", "text").mapInArrow(lambda b: _single_windows(b, window), _WINDOWS)
    single = keep_table(single, "windows")
    first = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    again = single.join(first, ["h1", "h2"]).filter("first < doc_id").select("doc_id", "tag", "start", F.lit(1).alias("n"))
    found = placed.filter("settled").select("doc_id", "tag", "start", "n").union(again)
    return found.groupBy("doc_id", "tag").agg(F.collect_list(place).alias("places"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row per row of ``docs``.

    Removed is each word covered by a window of ``window`` words whose words also
    start somewhere in a document with a smaller doc_id; windows are judged on the
    input. ``kept`` has the other words, joined by one space. A NULL text has no
    words, a shorter text no window. Rows with equal ids never repeat each other; rows
    without an id neither lose words nor take them from others.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    places = keep_table(repeated_places(plain, window, rounds), "places").withColumnRenamed("doc_id", "p_id")
    match = (F.col("doc_id") == F.col("p_id")) & (F.col("t_tag") == F.col("tag"))
    joined = _tagged(plain).join(places, match, "left").select("doc_id", "text", "places")
    return joined.mapInArrow(lambda b: _rest(b, window), _KEPT)


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


