"""Asking a model for every row of a prompt table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark.operators.replies import latest_replies, pending
from evalspark.tables import parameter_table

# A client has ``complete(request, max_tokens)`` or ``complete_many(requests,
# max_tokens)``; a reply is a dict with text, prompt_tokens, response_tokens and
# perhaps body.
ClientFactory = Callable[[], Any]
_COLUMNS = schemas.RAW_REPLY.fieldNames()
# Replies that a task keeps in one file while it works.
_CHUNK = 64


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _row(key: tuple, started: datetime, reply: dict | None, error: str | None) -> dict:
    reply = reply or {}
    return {
        "run_id": key[0], "question_id": key[1], "body": reply.get("body"), "text": reply.get("text"),
        "prompt_tokens": reply.get("prompt_tokens"), "response_tokens": reply.get("response_tokens"),
        "started": started, "stopped": _now(), "error": error,
    }


def _ask_one(client: Any, key: tuple, request: Any, max_tokens: int) -> dict:
    started = _now()
    try:
        return _row(key, started, client.complete(request, max_tokens), None)
    except Exception as failure:  # one row's failure stays with that row
        return _row(key, started, None, str(failure) or type(failure).__name__)


def _plain(request: Any) -> Any:
    """A text as it is; chat messages as a list of dicts."""
    if isinstance(request, str):
        return request
    return [part if isinstance(part, dict) else part.asDict() for part in request]


def _ask_batch(client: Any, keys: list[tuple], requests: list, max_tokens: int) -> list[dict]:
    if hasattr(client, "complete_many"):
        started = _now()
        try:
            answers = list(client.complete_many(requests, max_tokens))
            if len(answers) == len(keys):
                return [_row(key, started, answer, None) for key, answer in zip(keys, answers)]
        except Exception:
            pass  # ask the rows of a failed batch one by one
        if not hasattr(client, "complete"):
            return [_row(key, started, None, "batch failed") for key in keys]
    return [_ask_one(client, key, request, max_tokens) for key, request in zip(keys, requests)]


class Progress:
    """What a task has been answered so far, in files of its own that outlive it.

    A chunk is written beside its name and moved there, so a file is whole or absent.
    """

    def __init__(self, folder: str):
        self.store, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.schema = to_arrow_schema(schemas.RAW_REPLY)
        self.store.create_dir(self.folder, recursive=True)

    def answered(self) -> dict[tuple, dict]:
        """The replies of earlier attempts, by key."""
        rows = {}
        for file in self.store.get_file_info(pa.fs.FileSelector(self.folder)):
            if file.extension == "parquet":
                with self.store.open_input_file(file.path) as source:
                    for row in pq.read_table(source).to_pylist():
                        row.update({name: row[name] and row[name].replace(tzinfo=None) for name in ("started", "stopped")})
                        rows[row["run_id"], row["question_id"]] = row
        return rows

    def keep(self, rows: list[dict]) -> None:
        name = uuid.uuid4().hex
        with self.store.open_output_stream(f"{self.folder}/_{name}") as sink:
            pq.write_table(pa.Table.from_pylist(rows, schema=self.schema), sink)
        self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}.parquet")


def _answers(
    batches: Iterator[pd.DataFrame], client: Any, request: str, max_tokens: int, progress: Progress | None, chunk: int
) -> Iterator[pd.DataFrame]:
    """Replies to a task's prompts; what an earlier attempt was answered is taken from its files."""
    known = progress.answered() if progress else {}
    for batch in batches:
        keys = list(zip(batch["run_id"], batch["question_id"]))
        requests = [_plain(item) for item in batch[request]]
        rows = [known.get(key) for key in keys]
        todo = [place for place, row in enumerate(rows) if row is None]
        for at in range(0, len(todo), chunk):
            places = todo[at : at + chunk]
            answers = _ask_batch(client, [keys[p] for p in places], [requests[p] for p in places], max_tokens)
            if progress:
                progress.keep(answers)
            for place, answer in zip(places, answers):
                rows[place] = answer
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"prompt_tokens": "Int64", "response_tokens": "Int64"})


def infer(
    prompts: DataFrame,
    client_factory: ClientFactory,
    request: str = "prompt",
    max_tokens: int = fixed.MAX_TOKENS,
    partitions: int | None = None,
    progress: str | None = None,
    chunk: int = _CHUNK,
) -> DataFrame:
    """Raw replies of all prompts, one client per partition.

    Calls are costly and not repeatable: write the result once (see
    :func:`infer_into`) before deriving anything from it, and leave
    speculation off. With a ``progress`` folder that all executors reach, a task keeps its replies there
    in chunks, and a lost task that starts again asks for no more than the chunk it was at; without one
    it asks for its whole partition. The cores limit how many clients work at once. Without a
    number, the prompts are spread over ``spark.sql.shuffle.partitions`` tasks.
    """
    rows = prompts.select("run_id", "question_id", request)
    # A given number of partitions is one that adaptive execution leaves alone, and a
    # task that starts again gets the same rows.
    tasks = partitions or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "run_id", "question_id")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Progress(f"{progress}/part-{TaskContext.get().partitionId():06d}") if progress else None
        yield from _answers(batches, client_factory(), request, max_tokens, kept, chunk)

    return rows.mapInPandas(ask, schemas.RAW_REPLY)


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """The written replies, one per (run, question)."""
    return latest_replies(spark.read.schema(schemas.RAW_REPLY).parquet(path).select(*_COLUMNS))


def _folder(path: str) -> tuple[pa.fs.FileSystem, str, bool]:
    store, inner = pa.fs.FileSystem.from_uri(path)
    return store, inner, store.get_file_info(inner).type != pa.fs.FileType.NotFound


def append_replies(
    prompts: DataFrame, client_factory: ClientFactory, path: str, retry_errors: bool = False, **options: Any
) -> None:
    """Ask for what the table at ``path`` does not answer yet, and append the replies.

    While they are asked for, replies are kept beside the table, in a folder of their own. What a call
    that was broken off has left there is appended first, so that nothing is asked again; failed
    requests of such a call do not count.
    """
    spark = prompts.sparkSession
    parent, _, name = path.rstrip("/").rpartition("/")
    progress = f"{parent}/_{name}-progress"  # a name that Spark does not read as a part of a table
    parameter_table(spark, [], schemas.RAW_REPLY).write.mode("ignore").parquet(path)
    stored = spark.read.schema(schemas.RAW_REPLY).parquet(path)
    store, inner, left = _folder(progress)
    if left:
        kept = spark.read.schema(schemas.RAW_REPLY).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(progress)
        answered = latest_replies(kept.filter(F.col("error").isNull())).select(*_COLUMNS)
        pending(answered, stored).write.mode("append").parquet(path)
        store.delete_dir(inner)
        stored = spark.read.schema(schemas.RAW_REPLY).parquet(path)
    todo = pending(prompts, stored, retry_errors)
    infer(todo, client_factory, progress=progress, **options).write.mode("append").parquet(path)
    if _folder(progress)[2]:  # all of it is in the table now
        store.delete_dir(inner)


def infer_into(
    prompts: DataFrame,
    client_factory: ClientFactory,
    path: str,
    retry_errors: bool = False,
    **options: Any,
) -> DataFrame:
    """As :func:`append_replies`, and read the table back.

    A repeated call goes on where the last one stopped.
    """
    append_replies(prompts, client_factory, path, retry_errors, **options)
    return read_replies(prompts.sparkSession, path)
