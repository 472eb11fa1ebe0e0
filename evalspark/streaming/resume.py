"""Answering prompts as they arrive, once each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.inference import ClientFactory, append_replies
from evalspark.operators.replies import REPLY_KEYS

REMEMBER = "7 days"


def once(prompts: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """A stream of prompts without those whose (run, question) has come before.

    Keys are state, spread by key, and are forgotten when ``remember`` has passed since
    a prompt came, so the state grows with what comes in that time and not with the history.
    """
    stamped = prompts.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return stamped.dropDuplicatesWithinWatermark(REPLY_KEYS).drop("_arrived")


def answer_stream(
    prompts: DataFrame,
    client_factory: ClientFactory,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    retry_errors: bool = False,
    by_batch: bool = False,
    remember: str = REMEMBER,
    **options: Any,
) -> StreamingQuery:
    """Append the replies to a stream of prompts ``(run_id, question_id, prompt)``.

    The checkpoint remembers which input was handled; a batch that is replayed
    after a failure leaves out what it has already answered, so no prompt is
    asked or stored twice. By default that holds against everything at ``path``,
    also after a lost checkpoint, and each batch reads the keys stored so far.

    With ``by_batch`` the stream's own state tells which prompts have come before (see :func:`once`), also in
    other batches, as long as it remembers them; a batch is stored in a folder of its own, and
    only its replay is compared with what is there, so its cost does not grow with the history.
    """

    def answer(batch: DataFrame, number: int) -> None:
        part = f"{path}/batch={number}" if by_batch else path
        append_replies(batch, client_factory, part, retry_errors, **options)

    source = once(prompts, remember) if by_batch else prompts
    writer = source.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
