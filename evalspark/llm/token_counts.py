"""Token counts of parts of a document, from one encoding of the whole.

Encoding every section on its own gives other tokens at the borders and costs
the same text again. Here each document is encoded once, every token keeps the
characters it stands for, and the tokens are joined to the sections by interval.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.bpe import ForcedBoundaryBpe
from evalspark.llm.common import slices

RULES = ("first", "last")
# Fixed value: the pattern that splits text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# What is left to the library: characters outside the Latin blocks, whose kind may differ between
# Unicode versions, and very long white space, which the pattern matcher of the rank encoder refuses.
OTHER = re.compile("[^\x00-\u024f]|\\s{10000}")
SECTION = T.ArrayType(T.StructType([T.StructField("section", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


class SpanEncoder(ForcedBoundaryBpe):
    """Gives the character span of each token instead of its id; texts are encoded whole.

    Tokens tile the text; when several tokens share the bytes of one character,
    each of them spans that character.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.whole = None
        if self.by_rank is not None:  # then each token forms by the same merges in both encoders, wherever it stands
            import tiktoken

            special = {int(np.frombuffer(i, np.uint32)[0]) for i in self.special.values()}
            ranks = {raw: i for i, raw in enumerate(self.token_bytes) if raw and i not in special}
            self.whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sizes = np.array([len(raw) for raw in self.token_bytes], np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token."""
        raw = text.encode("utf-8")
        if self.whole is None or OTHER.search(text) or any(token in raw for token in self.special):
            offsets = np.array(self.library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            return offsets[:, 0], offsets[:, 1]
        stops = np.cumsum(self.sizes[self.whole(text)])
        starts = np.concatenate([[0], stops[:-1]])[: len(stops)]
        if len(raw) > len(text):  # bytes to characters
            upto = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            starts, stops = upto[starts] - 1, upto[stops - 1]
        return starts, stops


@cache
def span_encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line; a line keeps the line feed that ends it."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    starts = np.concatenate([[0], at])
    stops = np.concatenate([at, [len(text)]])
    return (starts[:-1], stops[:-1]) if len(at) and at[-1] == len(text) else (starts, stops)


def attribute(starts: np.ndarray, stops: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, ...]:
    """For sections [a, b): tokens allocated by ``rule``, tokens by share of characters, tokens crossing a border."""
    b = np.maximum(a, b)
    first_in, first_after = np.searchsorted(starts, a), np.searchsorted(starts, b)
    last_in, last_after = np.searchsorted(stops, a, "right"), np.searchsorted(stops, b, "right")
    whole = first_after - first_in if rule == "first" else last_after - last_in
    inside = np.maximum(0, last_after - first_in)
    crossing = np.where(b > a, np.maximum(0, first_after - last_in) - inside, 0)
    size = int(max(stops.max(initial=0), b.max(initial=0))) + 1
    weight = 1.0 / np.maximum(1, stops - starts)
    change = np.bincount(starts, weight, size + 1) - np.bincount(stops, weight, size + 1)
    before = np.concatenate([[0.0], np.cumsum(np.cumsum(change))])
    return whole, before[b] - before[a], crossing


def field_sections(names: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """A text joined from columns, and each column's place in it (NULL counts as empty)."""
    values = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]
    text = reduce(lambda x, y: F.concat(x, F.lit(separator), y), values)
    at, places = F.lit(0).cast("long"), []
    for name, value in zip(names, values):
        places.append(F.struct(F.lit(name).alias("section"), at.alias("start"), (at + F.char_length(value)).alias("stop")))
        at = at + F.char_length(value) + len(separator)
    return text, F.array(*places)


def section_tokens(
    docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", sections: str | None = None, rule: str = "first",
) -> DataFrame:
    """One row per section: the columns in ``keep``, then

    - ``section`` (its name; lines are numbered from 0), ``start``, ``stop`` in characters,
    - ``n_tokens``: tokens allocated by ``rule``: a token that crosses a border
      belongs to the section of its "first" or of its "last" character,
    - ``token_share``: the same with crossing tokens split by characters,
    - ``n_crossing``: tokens that reach into the section from outside or out of it,
    - ``doc_tokens``: tokens of the whole text.

    ``sections`` names a column of places (type SECTION); without it the sections
    are the lines, which tile the text, so that their counts add up to
    ``doc_tokens``. Sections may leave gaps, overlap or be NULL (then there are
    none); a section that ends before it starts is empty. A NULL text has one
    empty line. Each document is worked on where it is read; no row moves.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [F.col(f"`{k}`") for k in keep]
    picked = docs.select(*columns, F.col(f"`{text}`").cast("string").alias("text"), *([F.col(f"`{sections}`").cast(SECTION).alias("sections")] if sections else []))
    made = [("section", T.StringType()), ("start", T.LongType()), ("stop", T.LongType()), ("n_tokens", T.LongType()), ("token_share", T.DoubleType()), ("n_crossing", T.LongType()), ("doc_tokens", T.LongType())]
    schema = T.StructType([*picked.schema.fields[: len(keep)], *[T.StructField(*m) for m in made]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        model = span_encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                given = batch.column("sections").to_pylist() if sections else [None] * len(texts)
                rows, parts = [], []
                for i, (value, spans, places) in enumerate(zip(texts, map(model.spans, texts), given)):
                    if sections:
                        places = [p for p in places or [] if p is not None]
                        names = [p["section"] for p in places]
                        a, b = (np.array([np.clip(p[k] or 0, 0, len(value)) for p in places], np.int64) for k in ("start", "stop"))
                    else:
                        a, b = line_bounds(value)
                        names = list(map(str, range(len(a))))
                    whole_n, share, crossing = attribute(*spans, a, b, rule)
                    rows.append(np.full(len(a), i))
                    parts.append((names, a, b, whole_n, np.round(share, 6), crossing, np.full(len(a), len(spans[0]))))
                taken = pa.array(np.concatenate(rows) if rows else [], pa.int64())
                kept = [batch.column(i).take(taken) for i in range(len(keep))]
                own = [pa.array([n for p in parts for n in p[0]], pa.string())]
                own += [pa.array(np.concatenate([p[j] for p in parts]) if parts else []) for j in range(1, 7)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*kept, *own], arrow)], schema=arrow)

    return picked.toDF(*[f"c{i}" for i in range(len(keep))], "text", *(["sections"] if sections else [])).mapInArrow(run, schema)
