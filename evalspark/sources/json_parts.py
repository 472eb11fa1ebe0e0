"""Reading the elements of large JSON arrays and maps in several tasks.

A file that is one JSON value has no lines to split it by, and whether a byte is inside a text depends on
everything in front of it. So the file is read twice, in parts of some megabytes each. First every
part tells how many quotes it holds, and how deep its brackets lead in both cases, beginning inside or
outside a text. Sums over the parts in front of each give its true beginning. Then every part
cuts out the elements that begin in it; one that goes on behind the part's end is read to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_BYTES = 8 << 20
_MORE_BYTES = 1 << 18
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_TELLING = np.zeros(256, bool)
_TELLING[list(b'"{}[],')] = True
_DEPTH = np.zeros(256, np.int64)
_DEPTH[list(b"{[")] = 1
_DEPTH[list(b"}]")] = -1
ELEMENTS = "path string, start long, value string"


def _opened(path: str):
    """The file of a path as Spark names it."""
    store, inner = pa.fs.FileSystem.from_uri(path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(inner)


def _escaped(file, at: int) -> bool:
    """Whether the byte at this place has an odd number of backslashes in front of it."""
    n, end = 0, at
    while end:
        begin = max(0, end - 64)
        block = file.read_at(end - begin, begin)
        run = len(block) - len(block.rstrip(b"\\"))
        n += run
        if run < len(block):
            break
        end = begin
    return n % 2 == 1


def _marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, brackets and commas, the bytes there, and how many quotes are in front of each; escaped quotes are left out."""
    data = np.frombuffer(raw, np.uint8)
    places = np.flatnonzero(_TELLING[data])
    quotes = places[data[places] == _QUOTE]
    gone = []
    for q in quotes[(quotes == 0) | (data[np.maximum(quotes - 1, 0)] == _BACKSLASH)].tolist():
        run = _run(raw, q)
        # A run from the first byte on goes on in front of the part.
        if (run % 2 == 1) != (escaped and run == q):
            gone.append(q)
    if gone:
        places = places[~np.isin(places, gone)]
    kinds = data[places]
    return places, kinds, np.cumsum(kinds == _QUOTE) - (kinds == _QUOTE)


def _run(raw: bytes, at: int) -> int:
    """How many backslashes stand in front of a place."""
    n = 0
    while n < at and raw[at - 1 - n] == _BACKSLASH:
        n += 1
    return n


def _measured(batches) -> Iterator[pa.RecordBatch]:
    """Parts -> number of quotes, and change of depth when the part begins outside a text and inside one."""
    for batch in batches:
        found = []
        for path, start, end in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end")]):
            with _opened(path) as file:
                raw = file.read_at(end - start, start)
                _, kinds, before = _marks(raw, _escaped(file, start))
            change, even = _DEPTH[kinds], before % 2 == 0
            found.append((path, start, end, int((kinds == _QUOTE).sum()), int(change[even].sum()), int(change[~even].sum())))
        columns = list(zip(*found)) if found else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(list(c), pa.int64()) for c in columns[1:]]], names=["path", "start", "end", "quotes", "outside", "inside"])


def _delimiters(raw: bytes, escaped: bool, inside: bool, depth: int) -> tuple[list[tuple[int, bool, bool]], bool, int]:
    """Places that begin or end an element (with which of both), and the state behind the bytes."""
    places, kinds, before = _marks(raw, escaped)
    outside = (before + inside) % 2 == 0
    change = np.where(outside, _DEPTH[kinds], 0)
    after = depth + np.cumsum(change)
    comma = outside & (kinds == _COMMA) & (after == 1)
    opens, closes = (change == 1) & (after == 1), (change == -1) & (after == 0)
    telling = np.flatnonzero(comma | opens | closes)
    n_quotes = int((kinds == _QUOTE).sum())
    found = [(int(places[i]), bool(comma[i] or opens[i]), bool(comma[i] or closes[i])) for i in telling]
    return found, (n_quotes + inside) % 2 == 1, int(after[-1]) if len(after) else depth


def _elements(batches) -> Iterator[pa.RecordBatch]:
    """Parts with their beginning -> the elements that begin in them."""
    for batch in batches:
        for path, start, end, inside, depth in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "end", "in_text", "depth")]):
            with _opened(path) as file:
                size = file.size()
                raw = file.read_at(end - start, start)
                found, inside, depth = _delimiters(raw, _escaped(file, start), inside, depth)
                if found and found[-1][1]:  # the last element ends in a later part
                    while not (found[-1][2] and found[-1][0] >= end - start) and start + len(raw) < size:
                        at = len(raw)
                        more = file.read_at(min(_MORE_BYTES, size - start - at), start + at)
                        new, inside, depth = _delimiters(more, _escaped(file, start + at), inside, depth)
                        raw += more
                        found += [(p + at, b, e) for p, b, e in new[:1]]
            rows = []
            for (a, begins, _), (b, _, ends) in zip(found, found[1:]):
                if begins and ends and a < end - start and (text := raw[a + 1 : b].strip()):
                    rows.append((start + a + 1, text.decode("utf-8", "replace")))
            for at in range(0, len(rows), 1_000):
                some = rows[at : at + 1_000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.string())], names=["path", "start", "value"])


def read_elements(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, start, value)``: the elements of the JSON arrays and maps at ``path`` (files, folders or a pattern), as text.

    An element of a map is a key and its value with a colon between them. ``start`` is its place in the file, so
    it gives the order. Files are UTF-8, not compressed, and reachable for all executors; each is one array or map.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(part_bytes).cast("bigint"))
    parts = files.select("path", F.explode(starts).alias("start"), "length")
    parts = parts.select("path", "start", F.least(F.col("start") + part_bytes, F.col("length")).alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    measured = parts.repartition(tasks, "path", "start").mapInArrow(_measured, "path string, start long, end long, quotes long, outside long, inside long")
    # One row per part of some megabytes: the parts of a file are few.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = measured.withColumn("in_text", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_text"), F.col("inside")).otherwise(F.col("outside"))
    known = known.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    dealt = known.select("path", "start", "end", "in_text", "depth").repartition(tasks, "path", "start")
    return dealt.mapInArrow(_elements, ELEMENTS)
