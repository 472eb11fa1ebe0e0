"""Phrase collocations by direct-address tiles over ids in order of frequency.

Texts are cut into slices of one language and bounded size, which stay units of the work.
Words that are frequent enough get ids, the most frequent first, and a slice becomes
a sequence of ids. Neighbouring ids are counted per slice: the id space of
pairs is split into tiles; a tile with many pairs is a dense array that they address directly
(numpy's bincount), pairs of thin tiles are sorted and run-length counted (COO). As ids follow
frequency, the dense tiles lie in one corner.

The counts of a slice travel as packed arrays, one for each region of pairs that it has (a region is
a hash range; their number follows the number of words), and a region adds up its slices. Pairs that
are frequent get ids by frequency again, go back through their region to the slices that hold
them, and the slice becomes a sequence of those. Two neighbours there are a phrase of three
words, and so on: a phrase can only be frequent if its two shorter halves
are, and neighbours overlap in all words but one.

Nothing is broadcast or brought together beyond one slice with its own dictionary, or one region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hashed_words, keep_table, mix
from evalspark.operators.ranking import first_per_group, positions

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
NO_LANGUAGE = "und"
_SLICE_BYTES = 4_000_000
_TILE_BITS = 8  # a tile is 256 x 256 ids
_CORNER = 64  # tiles a side where dense ones are looked for
_DENSE = 1 << (2 * _TILE_BITS - 2)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_SALTS = 1024
_REGION_WORDS = 1_000_000
_MOST_IDS = 1 << 31


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of texts: a place in the list of distinct words for each, -1 at breaks; the list; how often each occurs.

    A-Z are lower-cased. Nothing is a Python object per word: blanks are squeezed out, and what is left
    is an Arrow array of words and breaks that its own dictionary encoding numbers.
    """
    raw = np.frombuffer(b"\n".join(texts).lower().translate(_TABLE) + b"\n", np.uint8)
    brk, blank = raw == 10, raw == 32
    after = np.concatenate([[True], (brk | blank)[:-1]])
    begins = brk | (after & ~blank)
    kept = ~blank
    data = raw[kept]
    offsets = np.append(np.flatnonzero(begins[kept]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    at = int(codes[-1])  # the text ends with a break
    counts = np.bincount(codes, minlength=len(words.dictionary))
    codes = np.where(codes == at, -1, codes - (codes > at))
    listed = words.dictionary.filter(pa.array(np.arange(len(counts)) != at))
    return codes, listed, np.delete(counts, at)


def _lines(words: pa.Array) -> bytes:
    return b"".join(w + b"\n" for w in words.cast(pa.binary()).to_pylist())


def _words(lines: bytes) -> pa.Array:
    """Words that came one a line."""
    raw = np.frombuffer(lines, np.uint8)
    ends = np.flatnonzero(raw == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10])])


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Texts -> rows of slice, lang, n (words), codes, words (one a line), counts."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    first, number, held = TaskContext.get().partitionId() << 32, 0, 0

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        codes, words, counts = tokens(waiting.pop(lang))
        sizes.pop(lang)
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([first + number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([codes.astype("<i4").tobytes()]),
             pa.array([_lines(words)], pa.binary()), pa.array([counts.astype("<u4").tobytes()])],
            names=["slice", "lang", "n", "codes", "words", "counts"],
        )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            held += len(text) + 1
            if sizes[lang] >= _SLICE_BYTES or held >= 4 * _SLICE_BYTES:  # the latter with many languages
                full = max(sizes, key=sizes.get)
                held -= sizes[full]
                yield flush(full)
    for lang in list(waiting):
        yield flush(lang)


def _runs(values: np.ndarray) -> list[slice]:
    """The runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return [slice(lo, hi) for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(values)])]


def _spread(batches) -> Iterator[pa.RecordBatch]:
    """Slices -> lang, region, slice, words, counts, local: the words of each slice by region, and their places in its list."""
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("slice", "lang", "regions", "words")]
        for row, (number, lang, regions, lines) in enumerate(zip(*names)):
            words, counts = _words(lines), _numbers(batch.column("counts"), row, "<u4")
            region = (hashed_words([lines])[0] % np.uint64(regions)).astype(np.int64)
            order = np.argsort(region, kind="stable")
            parts = [order[part] for part in _runs(region[order])]
            for at in range(0, len(parts), 1_000):
                some = parts[at : at + 1_000]
                columns = [[lang] * len(some), [region[p[0]] for p in some], [number] * len(some), [_lines(words.take(pa.array(p))) for p in some],
                           [counts[p].tobytes() for p in some], [p.astype("<i4").tobytes() for p in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WORDS)], schema=_WORDS)


_WORDS = pa.schema([("lang", pa.string()), ("region", pa.int32()), ("slice", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("local", pa.binary())])


def _word_totals(table: pa.Table, min_count: int) -> pa.Table:
    """The frequent words of a region with their counts (slice NULL), and per slice which of them it holds (places in that list)."""
    listed = table.column("words").to_pylist()
    words = _words(b"".join(listed)).dictionary_encode()
    codes = words.indices.to_numpy()
    own = [_numbers(table.column("counts"), row, "<u4") for row in range(table.num_rows)]
    sums = np.zeros(len(words.dictionary), np.int64)
    np.add.at(sums, codes, np.concatenate(own).astype(np.int64))
    frequent = np.flatnonzero(sums >= min_count)
    if not len(frequent):
        return _WORDS.empty_table()
    place = np.full(len(sums), -1)
    place[frequent] = np.arange(len(frequent))
    out = [(None, _lines(words.dictionary.take(pa.array(frequent))), sums[frequent].astype("<i8").tobytes(), b"")]
    at = 0
    for row, number in enumerate(table.column("slice").to_pylist()):
        here = place[codes[at : at + len(own[row])]]
        at += len(own[row])
        if (here >= 0).any():
            local = _numbers(table.column("local"), row, "<i4")[here >= 0]
            out.append((number, b"", here[here >= 0].astype("<i4").tobytes(), local.tobytes()))
    lang, region = table.column("lang")[0].as_py(), table.column("region")[0].as_py()
    return pa.table([[lang] * len(out), [region] * len(out), *[list(c) for c in zip(*out)]], schema=_WORDS)


def _word_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, (lang, region, lines) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("lang", "region", "words")])):
            words, counts = _words(lines), _numbers(batch.column("counts"), row, "<i8")
            n = len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(np.full(n, region), pa.int32()), pa.array(np.arange(n), pa.int32()), words, pa.array(counts)],
                names=["lang", "region", "place", "word", "f"],
            )


_LOCAL = pa.schema([("of", pa.int64()), ("local", pa.binary()), ("names", pa.binary())])


def _word_names(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each slice with words of a region, their places in its list and their ids."""
    if not left.num_rows or not right.num_rows:
        return _LOCAL.empty_table()
    names = np.zeros(right.num_rows, np.int64)
    names[right.column("place").to_numpy()] = right.column("id").to_numpy()
    held = [names[_numbers(left.column("counts"), row, "<i4")].astype("<i4").tobytes() for row in range(left.num_rows)]
    return pa.table([left.column("slice"), left.column("local"), pa.array(held, pa.binary())], schema=_LOCAL)


def count_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (x[i], y[i]) and how often each occurs."""
    side, mask = _CORNER, (1 << _TILE_BITS) - 1
    tx, ty = x >> _TILE_BITS, y >> _TILE_BITS
    corner = (tx < side) & (ty < side)
    tile = np.where(corner, tx * side + ty, side * side)
    full = np.flatnonzero(np.bincount(tile, minlength=side * side + 1)[:-1] >= _DENSE)
    place = np.full(side * side + 1, -1)
    place[full] = np.arange(len(full))
    at = place[tile]
    direct = at >= 0
    cells = (at[direct] << (2 * _TILE_BITS)) | ((x[direct] & mask) << _TILE_BITS) | (y[direct] & mask)
    dense = np.bincount(cells, minlength=1)
    hit = np.flatnonzero(dense)
    of = full[hit >> (2 * _TILE_BITS)] if len(full) else hit
    dense_x = (of // side << _TILE_BITS) | ((hit >> _TILE_BITS) & mask)
    dense_y = (of % side << _TILE_BITS) | (hit & mask)
    coo = np.sort((x[~direct] << 32) | y[~direct])
    starts = np.flatnonzero(np.concatenate([[True], coo[1:] != coo[:-1]])) if len(coo) else np.zeros(0, np.int64)
    codes = np.concatenate([(dense_x << 32) | dense_y, coo[starts]])
    counts = np.concatenate([dense[hit], np.diff(np.append(starts, len(coo)))])
    order = np.argsort(codes)
    return codes[order], counts[order]


def _packed(codes: np.ndarray) -> bytes:
    """Ascending codes as their differences, which compress well."""
    return np.diff(codes, prepend=0).astype("<i8").tobytes()


def _codes(column: pa.ChunkedArray, row: int) -> np.ndarray:
    return np.cumsum(_numbers(column, row, "<i8"))


def _numbers(column: pa.ChunkedArray, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Sequences -> slice, lang, region, codes, counts: the pairs of neighbours of each slice, by region."""
    for batch in batches:
        names = [batch.column(c).to_pylist() for c in ("slice", "lang", "regions")]
        for row, (number, lang, regions) in enumerate(zip(*names)):
            ids = _numbers(batch.column("ids"), row, "<i4").astype(np.int64)
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            codes, counts = count_pairs(ids[:-1][both], ids[1:][both])
            region = (mix(codes.astype(np.uint64)) % np.uint64(regions)).astype(np.int64)
            order = np.argsort(region, kind="stable")
            region, codes, counts = region[order], codes[order], counts[order].astype("<u4")
            parts = _runs(region)
            for at in range(0, len(parts), 1_000):
                some = parts[at : at + 1_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(some), pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array([region[p.start] for p in some], pa.int32()),
                     pa.array([_packed(codes[p]) for p in some], pa.binary()), pa.array([counts[p].tobytes() for p in some], pa.binary())],
                    names=["slice", "lang", "region", "codes", "counts"],
                )


_REGION = pa.schema([("lang", pa.string()), ("region", pa.int32()), ("slice", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _region_totals(table: pa.Table, min_count: int) -> pa.Table:
    """The frequent pairs of a region with their counts (slice NULL), and per slice which of them it holds (places in that list)."""
    listed = [_codes(table.column("codes"), row) for row in range(table.num_rows)]
    codes = np.concatenate(listed)
    counts = np.concatenate([_numbers(table.column("counts"), row, "<u4") for row in range(table.num_rows)]).astype(np.int64)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sums = np.add.reduceat(counts, starts)
    keys = codes[starts][sums >= min_count]
    if not len(keys):
        return _REGION.empty_table()
    out = [(None, _packed(keys), sums[sums >= min_count].astype("<i8").tobytes())]
    for number, own in zip(table.column("slice").to_pylist(), listed):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = at[keys[at] == own]
        if len(at):
            out.append((number, at.astype("<i4").tobytes(), b""))
    lang, region = table.column("lang")[0].as_py(), table.column("region")[0].as_py()
    slices, places, totals = zip(*out)
    return pa.table([[lang] * len(out), [region] * len(out), slices, places, totals], schema=_REGION)


def _total_rows(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, (lang, region) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("region").to_pylist())):
            codes, counts = _codes(batch.column("codes"), row), _numbers(batch.column("counts"), row, "<i8")
            for at in range(0, len(codes), 100_000):
                part = codes[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), region), pa.int32()), pa.array(part >> 32), pa.array(part & 0xFFFFFFFF), pa.array(counts[at : at + 100_000])],
                    names=["lang", "region", "x", "y", "f"],
                )


_NAMED = pa.schema([("of", pa.int64()), ("codes", pa.binary()), ("names", pa.binary())])


def _region_names(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each slice with pairs of a region, their codes and ids."""
    if not left.num_rows or not right.num_rows:
        return _NAMED.empty_table()
    codes = (right.column("x").to_numpy() << 32) | right.column("y").to_numpy()
    order = np.argsort(codes)
    codes, names = codes[order], right.column("id").to_numpy()[order]
    out = []
    for row, number in enumerate(left.column("slice").to_pylist()):
        at = _numbers(left.column("codes"), row, "<i4")
        out.append((number, _packed(codes[at]), names[at].astype("<i4").tobytes()))
    return pa.table([list(c) for c in zip(*out)], schema=_NAMED)


def trimmed(ids: np.ndarray) -> np.ndarray:
    """A sequence without what no pair can come from: ids without a neighbour, and all but one of consecutive breaks."""
    here = ids >= 0
    left, right = np.concatenate([[False], here[:-1]]), np.concatenate([here[1:], [False]])
    ids = np.where(here & (left | right), ids, -1)
    return ids[(ids >= 0) | np.concatenate([[False], ids[:-1] >= 0])]


def pair_ids(ids: np.ndarray, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The sequence of the ids that a dictionary (ascending codes -> names) gives to neighbours, -1 for others."""
    a, b = ids[:-1], ids[1:]
    wanted = np.where((a >= 0) & (b >= 0), (a << 32) | b, -1)
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, names[at], -1)


def _sequence(left: pa.Table, ids: np.ndarray) -> pa.Table:
    schema = pa.schema([("slice", pa.int64()), ("lang", pa.string()), ("ids", pa.binary())])
    ids = trimmed(ids)
    if not (ids >= 0).any():
        return schema.empty_table()
    if ids.max() >= _MOST_IDS:
        raise ValueError("a language has 2^31 frequent phrases of one length: raise min_count")
    return pa.table([left.column("slice"), left.column("lang"), pa.array([ids.astype("<i4").tobytes()], pa.binary())], schema=schema)


def _first_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice's sequence of word ids, from its codes and the ids of its frequent words."""
    if not left.num_rows or not right.num_rows:
        return _sequence(left, np.zeros(0, np.int64))
    codes = _numbers(left.column("codes"), 0, "<i4")
    local, names = (np.concatenate([_numbers(right.column(c), row, "<i4") for row in range(right.num_rows)]) for c in ("local", "names"))
    table = np.full(int(max(codes.max(), local.max())) + 2, -1)  # the last place is for breaks
    table[local] = names
    return _sequence(left, table[codes])


def _next_ids(left: pa.Table, right: pa.Table) -> pa.Table:
    """A slice's sequence of ids one word longer."""
    if not left.num_rows or not right.num_rows:
        return _sequence(left, np.zeros(0, np.int64))
    keys = np.concatenate([_codes(right.column("codes"), row) for row in range(right.num_rows)])
    names = np.concatenate([_numbers(right.column("names"), row, "<i4").astype(np.int64) for row in range(right.num_rows)])
    order = np.argsort(keys)
    return _sequence(left, pair_ids(_numbers(left.column("ids"), 0, "<i4").astype(np.int64), keys[order], names[order]))


def _met(sequences: DataFrame, dictionary: DataFrame, step) -> DataFrame:
    """Each slice with its own part of the dictionary."""
    return sequences.groupBy("slice").cogroup(dictionary.groupBy("of")).applyInArrow(step, "slice long, lang string, ids binary")


def _ranked(totals: DataFrame, names: list[str]) -> DataFrame:
    """``totals`` with an id per language: the most frequent first, in steps of an eighth of an octave."""
    band = -F.floor(F.log2(F.col("f").cast("double")) * 8).cast("long")
    spread = F.pmod(F.xxhash64(*names), F.lit(_SALTS))
    block = band * _SALTS + spread
    return positions(totals, ["lang"], [block, F.desc("f"), *[F.col(c) for c in names]], block, "id")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and a table of the frequent phrases of each length from 1:

    lang, id, f, phrase, last (its last word), heads and tails (how often its first and its last 1, 2, ... words occur),
    and from two words x and y, the ids of the phrases without the last and without the first word, and their region.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("text != ''")
    slices = keep_table(texts.mapInArrow(_slices, "slice long, lang string, n long, codes binary, words binary, counts binary"), "phrase-slices")
    sizes = slices.groupBy("lang").agg(F.sum("n").alias("n"))
    regions = sizes.select("lang", F.greatest(F.ceil(F.col("n") / _REGION_WORDS), F.lit(1)).cast("int").alias("regions"))
    region = "lang string, region int, slice long, words binary, counts binary, local binary"
    spread = slices.join(regions, "lang").select("slice", "lang", "regions", "words", "counts").mapInArrow(_spread, region)
    shared = keep_table(spread.groupBy("lang", "region").applyInArrow(lambda t: _word_totals(t, min_count), region), "phrase-regions-1")
    totals = shared.filter("slice IS NULL").mapInArrow(_word_rows, "lang string, region int, place int, word string, f long")
    first = _ranked(totals, ["word"]).select(
        "lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"), "region", "place",
    )
    levels = [keep_table(first, "phrases-1")]
    held = shared.filter("slice IS NOT NULL").select("lang", "region", "slice", "counts", "local").groupBy("lang", "region")
    named = levels[0].select(F.col("lang").alias("of_lang"), F.col("region").alias("of_region"), "place", "id").groupBy("of_lang", "of_region")
    named = held.cogroup(named).applyInArrow(_word_names, "of long, local binary, names binary")
    sequences = keep_table(_met(slices.select("slice", "lang", "codes"), named, _first_ids), "phrase-ids-1")
    for size in range(2, longest + 1):
        counted = sequences.join(regions, "lang").mapInArrow(_counted, "slice long, lang string, region int, codes binary, counts binary")
        shared = counted.groupBy("lang", "region").applyInArrow(lambda t: _region_totals(t, min_count), "lang string, region int, slice long, codes binary, counts binary")
        shared = keep_table(shared, f"phrase-regions-{size}")
        totals = shared.filter("slice IS NULL").mapInArrow(_total_rows, "lang string, region int, x long, y long, f long")
        before = levels[-1]
        front = before.select("lang", F.col("id").alias("x"), F.col("phrase").alias("front"), "heads")
        back = before.select("lang", F.col("id").alias("y"), "last", "tails")
        found = _ranked(totals, ["x", "y"]).join(front, ["lang", "x"]).join(back, ["lang", "y"])
        level = found.select(
            "lang", "id", "f", F.concat_ws(" ", "front", "last").alias("phrase"), "last",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "x", "y", "region",
        )
        levels.append(keep_table(level, f"phrases-{size}"))
        if size < longest:
            held = shared.filter("slice IS NOT NULL").select("lang", "region", "slice", "codes").groupBy("lang", "region")
            named = levels[-1].select(F.col("lang").alias("of_lang"), F.col("region").alias("of_region"), "x", "y", "id").groupBy("of_lang", "of_region")
            named = held.cogroup(named).applyInArrow(_region_names, "of long, codes binary, names binary")
            sequences = keep_table(_met(sequences, named, _next_ids), f"phrase-ids-{size}")
    return sizes, levels


def _lowest_cut() -> Column:
    """score, cut, l and r of the cut with the lowest score; decimals hold the products exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    place = lambda k: F.struct(
        F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide(F.col("f")) * wide(F.col("n"))), wide(F.get("heads", k - 1)) * wide(F.get("tails", F.size("heads") - k - 1))).alias("score"),
        k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.size("heads") - k - 1).alias("r"),
    )
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size("heads") - 1), place))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, covered_percent: int = 100,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    Words are runs of other characters than blanks and tabs, A-Z lower-cased, in pieces between ``.,;:!?`` and line
    ends. A candidate has 2 to ``longest`` words and a >= ``min_count`` occurrences. Its score is floor(1000 a n / (l r)), n being
    the words of the language and l and r the occurrences of its two parts, for the cut where this is
    lowest (the first of several). A candidate inside a longer one that occurs at least ``covered_percent`` percent as often is
    dropped; looking one word further is enough, as what lies between occurs no less often.

    A language may have 2^31 frequent phrases of one length; with more the job fails.
    A NULL language is ``und``; NULL and empty texts have no words; repeated rows count each time. Other
    columns do not matter. Phrases in order of score, a, then text.
    """
    sizes, levels = frequent_phrases(docs, text, lang, min_count, longest)
    parts = []
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:
            wider = longer.select("lang", F.col("x").alias("id"), "f").union(longer.select("lang", "y", "f"))
            wider = wider.groupBy("lang", "id").agg(F.max("f").alias("wider"))
            level = level.join(wider, ["lang", "id"], "left").filter(F.coalesce(100 * F.col("wider") < covered_percent * F.col("f"), F.lit(True)))
        parts.append(level.select("lang", "phrase", "f", "heads", "tails"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    scored = rows.join(sizes, "lang").withColumn("cut", _lowest_cut())
    scored = keep_table(scored.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"), "phrases-scored")
    first = first_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top, "rank")
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
