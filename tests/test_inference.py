"""Inference, resuming and streaming with stand-in clients."""

from __future__ import annotations

import json
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import inference, replies
from evalspark.streaming.resume import answer_stream

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Echo:
    """Notes every call in a folder; fails on prompts that hold ``bad``."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, request, max_tokens):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as note:
            note.write(request)
        if "bad" in request:
            raise ValueError("refused")
        return {"text": "SELECT " + request, "prompt_tokens": len(request), "response_tokens": max_tokens, "body": "{}"}


class Batched:
    def complete_many(self, requests, max_tokens):
        if any("bad" in r for r in requests):
            raise ValueError("batch refused")
        return [{"text": r.upper()} for r in requests]

    def complete(self, request, max_tokens):
        if "bad" in request:
            raise ValueError("refused")
        return {"text": request.lower()}


def calls(folder):
    return Counter(path.read_text() for path in folder.iterdir())


def prompts(spark, texts, start=0):
    rows = [("run", start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "run_id string, question_id bigint, prompt string")


def test_one_failure_stays_with_its_row(spark, tmp_path):
    folder = str(tmp_path)
    found = inference.infer(prompts(spark, ["a", "bad", "c"]), lambda: Echo(folder), max_tokens=9, partitions=2)
    assert found.schema == schemas.RAW_REPLY
    rows = {r.question_id: r for r in found.collect()}
    assert (rows[0].text, rows[0].prompt_tokens, rows[0].response_tokens, rows[0].error) == ("SELECT a", 1, 9, None)
    assert (rows[1].text, rows[1].prompt_tokens, rows[1].error) == (None, None, "refused")
    assert rows[2].text == "SELECT c" and all(r.stopped >= r.started for r in rows.values())


class Chat:
    def complete(self, request, max_tokens):
        return {"text": " ".join(f"{m['role']}={m['content']}" for m in request)}


def test_chat_messages_arrive_as_dicts(spark):
    rows = prompts(spark, ["a"]).withColumn("messages", F.expr(
        "array(named_struct('role', 'system', 'content', 'be brief'), named_struct('role', 'user', 'content', prompt))"))
    found = inference.infer(rows, Chat, request="messages").first()
    assert (found.text, found.error) == ("system=be brief user=a", None)


def test_failed_batch_is_asked_row_by_row(spark):
    good = {r.question_id: r.text for r in inference.infer(prompts(spark, ["a", "b"]), Batched, partitions=1).collect()}
    assert good == {0: "A", 1: "B"}
    mixed = inference.infer(prompts(spark, ["X", "bad"]), Batched, partitions=1).collect()
    assert {(r.question_id, r.text, r.error) for r in mixed} == {(0, "x", None), (1, None, "refused")}


def test_resume(spark, tmp_path):
    notes, table = tmp_path / "notes", str(tmp_path / "table")
    notes.mkdir()
    folder = str(notes)
    client = lambda: Echo(folder)
    assert inference.infer_into(prompts(spark, ["a", "bad"]), client, table).count() == 2
    assert inference.infer_into(prompts(spark, ["a", "bad", "c"]), client, table).count() == 3
    assert calls(notes) == {"a": 1, "bad": 1, "c": 1}
    assert inference.infer_into(prompts(spark, ["a", "bad", "c"]), client, table, retry_errors=True).count() == 3
    assert calls(notes) == {"a": 1, "bad": 2, "c": 1}


def test_latest_replies_prefer_answers(spark):
    rows = spark.createDataFrame(
        [("r", 1, None, "late", 3, "x"), ("r", 1, "text", None, 5, "y"), ("r", 1, "other", None, 6, "z"), ("r", 2, None, "e", 1, "x")],
        "run_id string, question_id bigint, text string, error string, started int, body string")
    assert {(r.question_id, r.text, r.body) for r in replies.latest_replies(rows).collect()} == {(1, "text", "y"), (2, None, "x")}


def test_stream_answers_each_prompt_once(spark, tmp_path):
    notes, source, table, state = (tmp_path / name for name in ("notes", "source", "table", "state"))
    notes.mkdir()
    folder = str(notes)
    schema = "run_id string, question_id bigint, prompt string"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(source))
        answer_stream(stream, lambda: Echo(folder), str(table), str(checkpoint)).awaitTermination()

    prompts(spark, ["a", "bad"]).write.parquet(str(source))
    run(state)
    prompts(spark, ["c"], start=2).write.mode("append").parquet(str(source))
    run(state)
    assert calls(notes) == {"a": 1, "bad": 1, "c": 1}
    # A lost checkpoint replays everything; nothing is asked or stored again.
    run(tmp_path / "new state")
    assert calls(notes) == {"a": 1, "bad": 1, "c": 1}
    assert spark.read.parquet(str(table)).count() == 3


def test_metric_rows_and_log_records(spark):
    rows = spark.createDataFrame(
        [("r", 1, "select 1;", None, 0.0, 62.5, 5, 6), ("r", 2, "no", None, 0.0, 1.0, 7, 8), ("r", 3, None, "down", 0.0, 1.0, 9, 9)],
        "run_id string, question_id bigint, text string, error string, a double, b double, prompt_tokens bigint, response_tokens bigint"
    ).withColumns({
        "started": F.timestamp_seconds("a"), "stopped": F.timestamp_seconds("b"), "difficulty": F.lit("simple"),
        "environment": F.lit("e"), "model": F.lit("m"), "instruction": F.lit(5), "dataset_length": F.lit(360),
        "messages": F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))),
    })
    outcomes = replies.with_outcome(rows, "text")
    found = {r.question_id: tuple(r)[2:] for r in replies.metric_rows(outcomes).collect()}
    assert found == {
        1: ("0:01:02.500000", 5, 6, "simple"), 2: ("0", 7, 8, "simple"), 3: ("0", 0, 0, "simple")}
    records = [json.loads(line) for line in replies.log_records(outcomes).toJSON().collect()]
    assert {(r["severity"], r.get("sql_response"), r.get("response_time_stop"), r["message"]) for r in records} == {
        ("info", "select 1", "1970-01-01 00:01:02", "SQL Response successful"),
        ("warn", None, None, "No SQL Output detected"), ("error", None, None, "down")}
    assert records[0]["request"] == [{"role": "user", "content": "hi"}]


@pytest.mark.parametrize("retry, wanted", [(False, {3}), (True, {2, 3})])
def test_pending(spark, retry, wanted):
    asked = spark.createDataFrame([("r", i) for i in (1, 2, 3)], "run_id string, question_id bigint")
    done = spark.createDataFrame([("r", 1, None), ("r", 2, "e"), ("s", 3, None)], "run_id string, question_id bigint, error string")
    assert {r.question_id for r in replies.pending(asked, done, retry).collect()} == wanted


class Where:
    """Answers with the number of its task."""

    def complete(self, request, max_tokens):
        from pyspark import TaskContext

        return {"text": str(TaskContext.get().partitionId())}


def test_prompts_are_spread_without_being_told(spark):
    rows = prompts(spark, [str(i) for i in range(200)]).coalesce(1)
    assert len({r.text for r in inference.infer(rows, Where).collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_batch_looks_at_its_own_folder_only(spark, tmp_path):
    notes, source, table = (tmp_path / name for name in ("notes", "source", "table"))
    notes.mkdir()
    folder = str(notes)

    def run():
        stream = spark.readStream.schema("run_id string, question_id bigint, prompt string").parquet(str(source))
        answer_stream(stream, lambda: Echo(folder), str(table), str(tmp_path / "state"), by_batch=True).awaitTermination()

    prompts(spark, ["a", "bad"]).write.parquet(str(source))
    run()
    for part in (table / "batch=0").glob("*.parquet"):
        part.write_bytes(b"no parquet")  # reading the first batch again would fail
    prompts(spark, ["c"], start=2).write.mode("append").parquet(str(source))
    run()
    assert calls(notes) == {"a": 1, "bad": 1, "c": 1}
    later = str(table / "batch=[1-9]*")  # a batch without prompts may come between, to move the watermark
    assert [r.text for r in inference.read_replies(spark, later).collect()] == ["SELECT c"]


def test_metric_rows_carry_the_run(spark):
    from evalspark.operators import prompts as grids

    runs = grids.grid([("amazon-bedrock", "org/a.b-v1:0")], [5], ["4-cot"], [60])
    rows = grids.with_runs(spark.range(1).selectExpr("id AS question_id", "'simple' AS difficulty"), runs).withColumns({
        "severity": F.lit("info"), "started": F.timestamp_seconds(F.lit(0)), "stopped": F.timestamp_seconds(F.lit(2)),
        "prompt_tokens": F.lit(3), "response_tokens": F.lit(4),
    })
    assert tuple(replies.metric_rows(rows, with_run=True).first())[2:] == (
        "0:00:02", 3, 4, "simple", "amazon-bedrock", "a.b-v1_0", 5, "4_shot_cot", 60)


def test_each_length_has_its_own_questions(spark):
    from evalspark.operators import prompts as grids

    runs = grids.grid([("e", "m")], [0], ["0"], [60, 360])
    sets = {60: spark.range(2).toDF("question_id"), 360: spark.range(5).toDF("question_id")}
    counts = grids.with_sized_runs(sets, runs).groupBy("dataset_length").count().collect()
    assert {tuple(r) for r in counts} == {(60, 2), (360, 5)}
    with pytest.raises(ValueError):
        grids.with_sized_runs({60: sets[60]}, runs)


# --- progress inside a task ---------------------------------------------------------------


class Breaking:
    """Answers a number of prompts and then ends its task."""

    def __init__(self, folder, answers):
        self.folder, self.left = folder, answers

    def complete(self, request, max_tokens):
        if not self.left:
            raise SystemExit("lost")
        self.left -= 1
        return Echo(self.folder).complete(request, max_tokens)


def test_a_second_attempt_asks_no_more_than_a_chunk_again(tmp_path):
    import pandas as pd

    notes = tmp_path / "notes"
    notes.mkdir()
    batch = pd.DataFrame({"run_id": "r", "question_id": range(100), "prompt": ["bad" if i == 3 else f"q{i}" for i in range(100)]})
    attempt = lambda client: pd.concat(inference._answers(iter([batch[:60], batch[60:]]), client, "prompt", 5, inference.Progress(str(tmp_path / "part")), 8))
    with pytest.raises(SystemExit):
        attempt(Breaking(str(notes), 77))
    first = calls(notes)
    found = attempt(Echo(str(notes)))
    assert found["question_id"].tolist() == list(range(100)) and found["error"].notna().tolist() == [i == 3 for i in range(100)]
    again = calls(notes) - Counter(dict.fromkeys(set(batch["prompt"]), 1))
    assert sum(first.values()) == 77 and sum(again.values()) <= 8


def test_a_broken_call_goes_on_from_what_its_tasks_kept(spark, tmp_path):
    notes, path = tmp_path / "notes", str(tmp_path / "replies")
    notes.mkdir()
    folder = str(notes)
    asked = prompts(spark, [f"q{i}" for i in range(60)])
    with pytest.raises(Exception):
        inference.infer_into(asked, lambda: Breaking(folder, 25), path, partitions=2, chunk=4)
    assert (tmp_path / "_replies-progress").exists()
    first = sum(calls(notes).values())
    assert first >= 25
    found = inference.infer_into(asked, lambda: Echo(folder), path, partitions=3, chunk=4)
    assert sorted(r.text for r in found.collect()) == sorted(f"SELECT q{i}" for i in range(60))
    assert sum(calls(notes).values()) <= 60 + 2 * 4  # one chunk a task
    assert [p.name for p in tmp_path.iterdir() if "progress" in p.name] == []


# --- once over batches ----------------------------------------------------------------------


def test_a_prompt_in_two_batches_is_asked_once(spark, tmp_path):
    notes, source, path, state = (tmp_path / name for name in ("notes", "in", "out", "state"))
    notes.mkdir()
    folder = str(notes)
    schema = "run_id string, question_id bigint, prompt string"

    def arrive(texts):
        prompts(spark, texts).coalesce(1).write.mode("append").parquet(str(source))

    def answer(**more):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = answer_stream(stream, lambda: Echo(folder), str(path), str(state), by_batch=True, **more)
        query.awaitTermination()
        return query

    arrive(["a", "b"])
    arrive(["a", "b", "c"])
    answer()
    assert calls(notes) == Counter("abc")
    arrive(["a", "b", "c", "d"])  # also in a later run of the stream
    answer()
    assert calls(notes) == Counter("abcd")
    rows = inference.read_replies(spark, str(path))
    assert rows.count() == 4 and spark.read.parquet(str(path)).count() == 4


def test_the_state_of_a_stream_expires(spark, tmp_path):
    import time

    notes, source = tmp_path / "notes", tmp_path / "in"
    notes.mkdir()
    folder, held = str(notes), []
    for number in range(4):
        prompts(spark, [f"p{number}-{i}" for i in range(10)], start=100 * number).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("run_id string, question_id bigint, prompt string").parquet(str(source))
        query = answer_stream(stream, lambda: Echo(folder), str(tmp_path / "out"), str(tmp_path / "state"), by_batch=True, remember="1 second")
        query.awaitTermination()
        held.append(max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]))
        time.sleep(2)
    assert sum(calls(notes).values()) == 40 and held[-1] < 40
