"""Token ids in Arrow files of equal-length sequences.

The documents' ids follow one another in ascending document order and are cut
into rows of ``length`` ids. A file is an Arrow IPC file (the stream format with
a footer that tells where each batch is), one per range of documents, with

- ``input_ids``: fixed-size list of unsigned 16-bit ids (32-bit for larger vocabularies),
- ``attention_mask``: fixed-size list of bits; 0 only behind a file's last id,
- ``document_end``: fixed-size list of bits; 1 at the last id of a document,
- ``ended``: the ids of the documents that end in the row, in order.

Buffers are not compressed, so any sequence can be read in place from a memory
map. All batches but a file's last hold the same number of rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.bpe import byte_alphabet
from evalspark.llm.common import keep_table, numbered_words, slices
from evalspark.session import new_table_path

INDEX = "block int, path string, n_ids long, width int"
ROWS = "block int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
_SLICE_BYTES = 8_000_000  # texts whose distinct words are encoded together
_END = "\0"  # stands for the end of a run of characters; words that hold it are left to the library

_NOT_PLAIN = regex.compile(f"[{_END}\u0250-\U0010ffff]")


class WordBpe:
    """Encodes with a vocabulary that marks word ends and drops white space.

    White space always ends a word here, so a text's ids are those of its words
    one after the other. The distinct words of some texts are encoded
    together: those in Latin letters as one text that is normalised and split at once and
    merged directly by merge rank, the others, and any vocabulary file of another kind, by the library as it is.
    Nothing is kept from one call to the next.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = spec["model"]["vocab"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 65_536 else np.dtype("<u4")
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cutters] == ["Split", "ByteLevel"] and bool(spec["model"].get("end_of_word_suffix"))
        self.ranked = None
        if self.by_word:
            # Runs get a mark behind them; a line end, which no word holds, tells words apart.
            self.runs = regex.compile(f"{cutters[0]['pattern']['Regex']}|\n")
            self.ranked = self._ranked(spec["model"], vocab)

    def _ranked(self, model: dict, vocab: dict):
        """Merging by rank, if ids are in merge order and every token encodes to itself."""
        import tiktoken

        suffix, alphabet, end = model["end_of_word_suffix"], byte_alphabet(), _END.encode()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)):
            return None
        ranks = {}
        for token, i in vocab.items():
            if token not in self.added:
                ends = token.endswith(suffix) and token != suffix
                core = bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token))
                if end not in core or len(core) == 1:
                    ranks[core + end * ends] = i
        encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        return encoding if all(encoding._encode_single_piece(raw) == [i] for raw, i in ranks.items()) else None

    def _by_rank(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in Latin letters, one a line, and how many each has: runs and line ends go through in one call."""
        runs = self.runs.findall(lines.lower())
        ids = np.array(self.ranked.encode_ordinary(_END.join(runs) + _END), self.dtype)
        between = ids == self.ranked._encode_single_piece(f"\n{_END}".encode())[0]
        ends = np.append(np.flatnonzero(between), len(ids))
        return ids[~between], np.diff(ends, prepend=-1) - 1

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin and how many they are."""
        together = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        if self._is_plain(together):
            ids, sizes = self._by_rank(together)
            return ids, np.cumsum(sizes) - sizes, sizes
        texts = together.split("\n")
        plain = np.array([self._is_plain(t) for t in texts])
        order = np.argsort(~plain, kind="stable")  # those in Latin letters first
        ids, sizes = self._by_rank("\n".join(t for t, p in zip(texts, plain) if p)) if plain.any() else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        others = [e.ids for e in self.library.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)]
        ids = np.concatenate([ids, *[np.array(o, self.dtype) for o in others]])
        sizes = np.concatenate([sizes, [len(o) for o in others]]).astype(np.int64)
        place = np.argsort(order)
        return ids, (np.cumsum(sizes) - sizes)[place], sizes[place]

    def _is_plain(self, text: str) -> bool:
        return self.ranked is not None and not _NOT_PLAIN.search(text) and not any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text in this vocabulary's width, little-endian."""
        if not texts or not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        codes, n_words, words = numbered_words([t.encode("utf-8") for t in texts])
        if not len(words):
            return [b""] * len(texts)
        ids, starts, sizes = self._encoded(words)
        sizes = sizes[codes]
        ends = np.cumsum(sizes)  # where each word's ids end in the result
        raw = ids[np.repeat(starts[codes] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])] * self.dtype.itemsize
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@cache
def word_encoder(path: str) -> WordBpe:
    return WordBpe(path)


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
        ("attention_mask", pa.list_(pa.bool_(), length)),
        ("document_end", pa.list_(pa.bool_(), length)),
        ("ended", pa.list_(pa.int64())),
    ])


class SequenceWriter:
    """Collects ids and writes a batch whenever ``rows`` sequences are full."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.schema = file_schema(dtype, length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.dtype, self.length, self.room = dtype, length, length * rows
        self.waiting, self.n_waiting, self.ends, self.docs, self.n_ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids) // self.dtype.itemsize
        self.n_ids += len(ids) // self.dtype.itemsize
        self.ends.append(self.n_waiting - 1)
        self.docs.append(doc_id)
        while self.n_waiting >= self.room:
            self._flush(self.room)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.dtype)
        rows = -(-n // self.length)
        values = np.zeros(rows * self.length, self.dtype)
        values[:n] = ids[:n]
        done = sum(1 for e in self.ends if e < n) if len(self.ends) < 16 else int(np.searchsorted(self.ends, n))
        ends = np.zeros(len(values), bool)
        ends[self.ends[:done]] = True
        offsets = np.searchsorted(self.ends[:done], np.arange(rows + 1) * self.length).astype(np.int32)
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(values)) < n), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(ends), self.length),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.docs[:done], pa.int64())),
        ], schema=self.schema))
        self.waiting, self.n_waiting = [ids[n:].tobytes()], self.n_waiting - n
        self.ends, self.docs = [e - n for e in self.ends[done:]], self.docs[done:]

    def close(self) -> None:
        if self.n_waiting:
            self._flush(self.n_waiting)
        self.writer.close()


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader on a memory map where the folder is mounted, else on the store's own random access."""
    store, inner = pa.fs.FileSystem.from_uri(path)
    source = pa.memory_map(inner) if isinstance(store, pa.fs.LocalFileSystem) else store.open_input_file(inner)
    return pa.ipc.open_file(source)


def sequence(reader: pa.ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of one sequence, as views of the file's own buffers."""
    per_batch = reader.get_batch(0).num_rows
    batch = reader.get_batch(row // per_batch)
    place = row % per_batch
    ids, mask = batch.column("input_ids"), batch.column("attention_mask")
    length = ids.type.list_size
    return ids.values.slice((ids.offset + place) * length, length).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + place) * length, length)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    length: int = 2048, rows: int = 64, files: int | None = None, folder: str | None = None,
) -> DataFrame:
    """Write the files into a new folder below the shared one (or into ``folder``) and
    return their index: block, path, n_ids, width.

    Documents are dealt by range of ``doc_id`` (NULL first), one file per range;
    equal ids stay together, ordered by text. A NULL or empty text has the end id
    alone. Each attempt of a task writes a file of its own name and only files of
    finished tasks get into the index, so a repeated or lost task does no harm.
    The folder must be one that pyarrow can open on the executors.
    """
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "token-files")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        .repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = word_encoder(tokenizer), None
        last = np.array([end_id], model.dtype).tobytes()
        block = TaskContext.get().partitionId()
        path = f"{folder}/block-{block:06d}-{uuid.uuid4().hex}.arrow"
        for whole in batches:
            for batch in slices(whole, "text", _SLICE_BYTES):
                if out is None and batch.num_rows:
                    store, inner = pa.fs.FileSystem.from_uri(path)
                    store.create_dir(os.path.dirname(inner), recursive=True)
                    sink = store.open_output_stream(inner)
                    out = SequenceWriter(sink, model.dtype, length, rows)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for i, ids in zip(batch.column("doc_id").to_pylist(), model.encode(texts)):
                    out.add(i, ids + last)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "path": [path],
                "n_ids": pa.array([out.n_ids], pa.int64()), "width": pa.array([model.dtype.itemsize], pa.int32()),
            })

    return keep_table(ordered.mapInArrow(run, INDEX), "token-index")


def read_documents(index: DataFrame) -> DataFrame:
    """Every document as the files hold it: doc_id, start (ids in front of it over all
    files), n_tokens (with the end id), ids_crc32 (of its ids as unsigned 32-bit integers)."""
    spark: SparkSession = index.sparkSession
    n = max(1, index.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, path in zip(batch.column("block").to_pylist(), batch.column("path").to_pylist()):
                yield from _documents(block, path)

    # One row per file: a total and an offset for each, far below what one task can hold.
    before = F.sum("n_ids").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = index.select("block", F.coalesce(before, F.lit(0)).alias("base"))
    rows = index.select("block", "path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(run, ROWS)
    return rows.join(bases, "block").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _documents(block: int, path: str) -> Iterator[pa.RecordBatch]:
    reader = open_file(path)
    crc, open_n, at = 0, 0, 0
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        mask = batch.column("attention_mask").values
        n = int(mask.true_count)
        ids = batch.column("input_ids").values.to_numpy(zero_copy_only=True)[:n].astype("<u4")
        ends = np.flatnonzero(batch.column("document_end").values.to_numpy(zero_copy_only=False)) + 1
        names = batch.column("ended").values.to_pylist()
        out, begin = [], 0
        for name, end in zip(names, ends.tolist()):
            crc = zlib.crc32(ids[begin:end], crc)
            size = open_n + end - begin
            out.append((name, at, size, crc))
            at, crc, open_n, begin = at + size, 0, 0, end
        if begin < n:
            crc, open_n = zlib.crc32(ids[begin:n], crc), open_n + n - begin
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(out), block), pa.int32()), *[pa.array(list(c), pa.int64()) for c in columns]],
            names=["block", "doc_id", "local_start", "n_tokens", "ids_crc32"],
        )
