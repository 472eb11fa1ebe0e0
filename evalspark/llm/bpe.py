"""Byte-pair encoding by forced boundaries, and decoding.

A merge can only join two bytes that stand side by side inside some vocabulary
token. Where a text has a byte pair that occurs inside no token, no merge ever
crosses it: the text can be cut there, the parts encoded on their own and the
ids put one after the other. Texts repeat their parts, so each distinct part is
encoded once per worker and found in memory afterwards.

A cut must also leave the splitting into pre-tokens as it is. Cuts are therefore
taken only where it cannot change:

- before white space, whatever stands in front: a run of white space is split
  before its last character at most, and no merge crosses the cut;
- behind a letter or digit, whatever follows: letters and digits are matched as
  runs without looking further;
- between an ASCII sign (not the apostrophe) and a letter or digit, and between
  two signs unless the second is the apostrophe, which may begin a contraction.

Byte pairs of the contractions count as pairs of the vocabulary. Special tokens
in a text are found first, as the library does.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import Memory, slices

# What the byte-level splitting pattern treats apart.
CONTRACTIONS = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]
SPACES = b" \t\n\r\x0b\x0c"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))

PLAIN = re.compile("[ ]?[A-Za-z]+")  # one pre-token whatever stands around it

OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself
    where it prints, the next free one from U+0100 on for the others."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its only one
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splitter = spec["pre_tokenizer"] or {}
        if (
            spec["normalizer"] is not None or splitter.get("type") != "ByteLevel"
            or splitter.get("add_prefix_space") or not splitter.get("use_regex", True)
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        self.seen = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            if token not in added:
                self.token_bytes[i] = raw = bytes(alphabet[c] for c in token)
                self._note(raw)
        for raw in CONTRACTIONS:
            self._note(raw)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.special = {t.encode(): np.array([i], np.uint32).tobytes() for t, i in added.items()}
        self.special_pattern = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.fragment_pattern = re.compile(self._coarse_pattern(), re.DOTALL)
        self.by_rank = self._ranked(spec["model"], added)
        ascii_characters = list(map(chr, range(128)))
        self.ascii_cuts = {(a, b) for a in ascii_characters for b in ascii_characters if self.cuts(a + b)}
        self.fragments = Memory(self._encode_fragment)
        self.parts = Memory(lambda part: self._encode_parts([part])[0])

    def _ranked(self, model: dict, added: dict):
        """Merging by rank for single pre-tokens of ASCII letters: only if ids are in merge order and
        every token encodes to itself; otherwise, and for all other parts, the library encodes."""
        import tiktoken

        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)):
            return None
        ranks = {self.token_bytes[i]: i for token, i in model["vocab"].items() if token not in added}
        encode = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return encode if all(encode(raw) == [i] for raw, i in ranks.items()) else None

    def _note(self, raw: bytes) -> None:
        codes = np.frombuffer(raw, np.uint8)
        self.seen[codes[:-1], codes[1:]] = True

    def _coarse_pattern(self) -> bytes:
        """Matches the stretches between cuts in front of white space."""
        of = lambda codes: b"[" + b"".join(b"\\x%02x" % b for b in codes) + b"]"
        words = [b for b in range(256) if b not in SPACES]
        if not self.seen[np.ix_(words, list(SPACES))].any():
            return of(SPACES) + b"*" + of(words) + b"+|" + of(SPACES) + b"+"
        cuts = []
        for space in SPACES:
            if free := [b for b in range(256) if not self.seen[b, space]]:
                cuts.append(b"(?<=" + of(free) + b")(?=" + of([space]) + b")")
        return b".+?(?:" + b"|".join([*cuts, rb"\Z"]) + b")"

    def cuts(self, text: str) -> list[int]:
        """Every position of ``text`` at which it may be cut."""
        kinds = [_kind(c) for c in text]
        raw = [c.encode("utf-8", "surrogatepass") for c in text]
        found = []
        for i in range(1, len(text)):
            before, after = kinds[i - 1], kinds[i]
            if self.seen[raw[i - 1][-1], raw[i][0]]:
                continue
            if (
                after == "space" or before in ("letter", "digit")
                or before == "sign" and text[i - 1] != "'" and after in ("letter", "digit")
                or before == "sign" and after == "sign" and text[i] != "'"
            ):
                found.append(i)
        return found

    def _split(self, fragment: bytes) -> list[str]:
        text = fragment.decode("utf-8")
        if fragment.isascii():  # whether there is a cut between two characters is known beforehand
            pairs = self.ascii_cuts
            at = [i for i, pair in enumerate(zip(text, text[1:]), 1) if pair in pairs]
            if not at:
                return [text]
            at = [0, *at, len(text)]
        else:
            at = [0, *self.cuts(text), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        plain = [self.by_rank is not None and bool(PLAIN.fullmatch(p)) for p in parts]
        found = iter(self.library.encode_batch([p for p, quick in zip(parts, plain) if not quick], add_special_tokens=False))
        return [np.array(self.by_rank(p.encode()) if quick else next(found).ids, np.uint32).tobytes() for p, quick in zip(parts, plain)]

    def _encode_fragment(self, fragment: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, self._split(fragment)))

    def _stretches(self, raw: bytes) -> list[bytes]:
        if self.special_pattern is None or not self.special_pattern.search(raw):
            return self.fragment_pattern.findall(raw)
        out = []
        for piece in self.special_pattern.split(raw):
            out.extend([piece] if piece in self.special else self.fragment_pattern.findall(piece))
        return out

    def _learn(self, fragments: Iterable[bytes]) -> None:
        """Encode those of the fragments that are not known."""
        unknown = [f for f in self.fragments.unknown(fragments) if f not in self.special]
        fine = [self._split(f) for f in unknown]
        parts = self.parts.unknown(p for s in fine for p in s)
        for part, ids in zip(parts, self._encode_parts(parts)):
            self.parts.put(part, ids)
        for fragment, pieces in zip(unknown, fine):
            self.fragments.put(fragment, b"".join(map(self.parts.__getitem__, pieces)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode("utf-8") for t in texts]
        if self.special_pattern is None:
            return self._encode_plain(raw)
        special = [bool(self.special_pattern.search(r)) for r in raw]
        plain = iter(self._encode_plain([r for r, s in zip(raw, special) if not s]))
        return [self._encode_special(r) if s else next(plain) for r, s in zip(raw, special)]

    def _encode_special(self, raw: bytes) -> bytes:
        """The ids of a text that holds special tokens."""
        stretches = self._stretches(raw)
        self._learn(stretches)
        return b"".join([self.special.get(s) or self.fragments[s] for s in stretches])

    def _encode_plain(self, raw: list[bytes]) -> list[bytes]:
        """The ids of texts, which are taken together and cut in front of white space: no stretch is an object of
        its own, only each distinct one."""
        whole = b"".join(raw)
        if not whole:
            return [b""] * len(raw)
        data = np.frombuffer(whole, np.uint8)
        begins = np.concatenate([[True], _IS_SPACE[data[1:]] & ~self.seen[data[:-1], data[1:]]])
        ends = np.cumsum([len(r) for r in raw])
        begins[ends[ends < len(data)]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int32)
        stretches = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = stretches.indices.to_numpy(), stretches.dictionary.to_pylist()
        self._learn(distinct)
        listed = list(map(self.fragments.__getitem__, distinct))
        sizes = np.fromiter(map(len, listed), np.int64, len(listed)) // 4
        first = np.cumsum(sizes) - sizes
        sizes = sizes[codes]
        upto = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(listed), "<u4")[np.repeat(first[codes] - upto + sizes, sizes) + np.arange(upto[-1])].tobytes()
        places = np.concatenate([[0], upto])[np.searchsorted(starts, np.concatenate([[0], ends]))] * 4
        return [ids[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@cache
def _kind(c: str) -> str:
    if c in " \t\n\r\x0b\x0c":
        return "space"
    if c < "ɐ" and unicodedata.category(c)[0] == "L":
        return "letter"
    if "0" <= c <= "9":
        return "digit"
    return "sign" if " " < c < "\x7f" else "other"


@cache
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder per worker process, with what it remembers."""
    return ForcedBoundaryBpe(path)


def _ids_column(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _outputs(batches: Iterator[pa.RecordBatch], path: str, outputs: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    for whole in batches:
        for batch in slices(whole, "text"):
            encoded = model.encode([t or "" for t in batch.column("text").to_pylist()])
            made = {"n_tokens": pa.array([len(e) // 4 for e in encoded], pa.int64())}
            if "ids" in outputs:
                made["ids"] = _ids_column(encoded)
            if "ids_sha256" in outputs:
                made["ids_sha256"] = pa.array([hashlib.sha256(e).hexdigest() for e in encoded])
            if "decoded" in outputs or "decoded_sha256" in outputs:
                decoded = [model.decode(e) for e in encoded]
                made["decoded"] = pa.array(decoded, pa.string())
                made["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays = [*kept, *[made[o] for o in outputs]]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def encode_documents(
    docs: DataFrame, tokenizer: str, keep: list[str], text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"),
) -> DataFrame:
    """The columns in ``keep`` and, per row, the ``outputs`` asked for (names of OUTPUTS).

    ``tokenizer`` is the path of a byte-level vocabulary on every worker. No row
    moves: each is encoded where it is read. A NULL text counts as empty and
    gives no token; the digest of nothing is that of the empty string. Repeated
    rows give repeated results, and other columns are not looked at. A kept
    column may have any name but those asked for as ``outputs``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    picked = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*picked.schema.fields[:-1], *[T.StructField(o, OUTPUTS[o]) for o in outputs]])
    arrow = to_arrow_schema(schema)
    names = [f"c{i}" for i in range(len(keep))]  # kept columns may be called text, too

    def run(batches):
        return _outputs(batches, tokenizer, list(outputs), arrow)

    return picked.toDF(*names, "text").mapInArrow(run, schema)
