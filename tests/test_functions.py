"""Column functions on literal edge cases."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.functions import durations, lines, prompts, replies
from evalspark.operators.prompts import family_of


def values(spark, texts, column, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [row.v for row in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("text, seconds", [
    ("0", 0.0), ("0:00:01", 1.0), ("0:01:02.5", 62.5), ("1 day, 1:00:00.000005", 90000.000005),
    ("2 days, 0:00:01", 172801.0), ("1.25", 1.25), ("10:00:00.000001", 36000.000001),
    (None, None), ("soon", None), ("1:2", None), ("0:0x:01", None), ("", None),
])
def test_duration(spark, text, seconds):
    assert values(spark, [text], durations.duration_seconds) == [seconds]


def test_duration_text_round_trip(spark):
    moments = [0, 1, 999_999, 1_000_000, 62_500_000, 86_399_999_999, 86_400_000_000, 90_000_000_005, 200_000_000_000]
    texts = values(spark, moments, durations.duration_text, "bigint")
    assert texts[1:] == [str(dt.timedelta(microseconds=m)) for m in moments[1:]] and texts[0] == "0"
    assert values(spark, texts, durations.duration_micros) == moments


def test_elapsed_label(spark):
    assert values(spark, [3725.9, 0.0, 59.999], durations.elapsed_label, "double") == [
        "1hrs 2min 5sec", "0hrs 0min 0sec", "0hrs 0min 59sec"]


def expected_extract(text):
    """The wanted result by its definition, with the standard library."""
    for noise in fixed.REPLY_NOISE:
        text = text.replace(noise, " ")
    found = re.search(fixed.STATEMENT_PATTERN, text, re.IGNORECASE)
    text = found.group(0) if found else text
    cut = re.search(r"\s*(?:" + "|".join(fixed.STOP_PHRASES) + ")", text, re.IGNORECASE)
    return text[: cut.start()] if cut else text


CASES = [
    "", "SELECT;", "selection", "SELECT 1; SELECT 2;", "```sql\nselect a\nfrom t;\n```",
    "WITH q AS (SELECT 1) SELECT 2;", "SELECT a   Explanation: b", "SELECT aExplanation b", "SELECT x\\nFROM t...",
    "Please help", "no\rmore\ttabs", "SELECT a b please", "SELECT a This  query", "SELECTED é SELECTé; SELECT b",
    "SELECT a  Caution", "select 1   \x1c This SQL query",
]


def test_sql_extract(spark):
    assert values(spark, CASES, replies.sql_extract) == [expected_extract(c) for c in CASES]
    assert values(spark, ["WITH q AS (SELECT 1) SELECT 2;"], replies.sql_extract) == ["SELECT 1) SELECT 2"]
    assert values(spark, ["WITH q AS (SELECT 1) SELECT 2;", "SELECT 3; x"], lambda c: replies.sql_extract(c, True)) == [
        "WITH q AS (SELECT 1) SELECT 2", "SELECT 3"]
    assert values(spark, [None], replies.sql_extract) == [None]


pieces = st.sampled_from([
    "select", "SELECT ", "x", " ", "\n", "\\n", "\t", "```", "...", ";", "Explanation", "this query", "Please", "é", "_", ".", "WITH",
])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(pieces, max_size=14).map("".join), min_size=20, max_size=60))
def test_sql_extract_any_text(spark, texts):
    assert values(spark, texts, replies.sql_extract) == [expected_extract(t) for t in texts]


def test_long_blank_run_is_linear(spark):
    text = "SELECT a" + " " * 200_000 + "b" + " " * 200_000 + "Please"
    assert values(spark, [text], replies.sql_extract) == ["SELECT a" + " " * 200_000 + "b"]


def test_reply_outcome(spark):
    rows = spark.createDataFrame(
        [(1, "Select 1;", None), (2, "nothing", None), (3, None, None), (4, "select 1", "down")], "i int, r string, e string")
    out = rows.select("i", *[c.alias(n) for n, c in replies.reply_outcome(F.col("r"), F.col("e")).items()]).orderBy("i").collect()
    assert [(r.severity, r.is_sql, r.predicted_sql, r.message) for r in out] == [
        ("info", 1, "Select 1", fixed.LOG_OK), ("warn", 0, "I don't know", fixed.LOG_NO_SQL),
        ("warn", 0, "I don't know", fixed.LOG_NO_SQL), ("error", 0, "An error occurred: down", "down")]


def test_provider_reply(spark):
    bodies = [
        ("choices", '{"choices":[{"message":{"content":"a"}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}'),
        ("content", '{"content":[{"text":"b"}],"usage":{"input_tokens":5,"output_tokens":6}}'),
        ("content", '{"content":[{"text":"c"}],"headers":{"x-amzn-bedrock-input-token-count":"7","x-amzn-bedrock-output-token-count":"8"}}'),
        ("generated_text", '[{"generated_text":"d"}]'), ("choices", "{broken"), ("completion", None), ("other", "{}"),
    ]
    rows = spark.createDataFrame([(i, *b) for i, b in enumerate(bodies)], "i int, s string, b string")
    out = rows.select("i", *[c.alias(n) for n, c in replies.provider_reply(F.col("s"), F.col("b")).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("a", 3, 4), ("b", 5, 6), ("c", 7, 8), ("d", 0, 0), (None, None, None), (None, None, None), (None, None, None)]


def test_shot_label_and_path_safe(spark):
    assert values(spark, ["4", "4-cot", "0"], prompts.shot_label) == ["4_shot", "4_shot_cot", "0_shot"]
    assert values(spark, ["a:b:0"], prompts.path_safe) == ["a_b_0"]


def plain_system(size):
    blocks = "".join(text for least, text in fixed.INSTRUCTION_BLOCKS if size >= least)
    return fixed.SYSTEM_PROMPT_HEAD + blocks + fixed.SYSTEM_PROMPT_TAIL


def test_system_prompt(spark):
    sizes = [0, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert values(spark, sizes, prompts.system_prompt, "int") == [plain_system(s) for s in sizes]


def test_prompt_layouts_fill_in_order(spark):
    given_values = {
        "question": "q [hint] [examples]", "hint": "h [examples] [question]", "context": "c [question][hint]", "examples": "e [context]",
    }
    slots = {name: F.lit(text) for name, text in given_values.items()}
    slots["instructions"] = prompts.instructions(F.lit(9))
    whole, empty = plain_system(9), plain_system(9)
    for mark, name, lead in fixed.PLACEHOLDERS:
        whole, empty = whole.replace(mark, lead + given_values[name]), empty.replace(mark, "")
    one = spark.range(1)
    for layouts, system in ((fixed.FILLED_LAYOUTS, whole), (fixed.BLANKED_LAYOUTS, empty)):
        for family, layout in layouts.items():
            text = one.select(prompts.prompt_text(F.lit(family), slots)).first()[0]
            assert text == layout.format(system=system, **given_values), family
    schema_only = plain_system(9).replace("[context]", "<<>>")
    for mark in ("[question]", "[hint]", "[examples]"):
        schema_only = schema_only.replace(mark, "")
    text = one.select(prompts.prompt_text(F.lit("endpoint_turns"), slots)).first()[0]
    assert text == fixed.CONTEXT_LAYOUTS["endpoint_turns"].format(
        system=schema_only.replace("<<>>", given_values["context"]), **given_values)
    chat = one.select(prompts.chat_messages(F.lit("chat"), slots)).first()[0]
    assert [(m.role, m.content) for m in chat] == [
        ("system", empty), ("user", fixed.CHAT_USER_LAYOUT.format(**given_values))]
    assert [(m.role, m.content) for m in one.select(prompts.chat_messages(F.lit("user_chat"), slots)).first()[0]] == [("user", whole)]


def test_family_of(spark):
    rows = [*fixed.MODEL_FAMILIES, ("anyscale", "unheard-of", "plain"), ("self-hosted", "claude-3-opus-20240229", "plain")]
    frame = spark.createDataFrame(rows, "environment string, model string, wanted string")
    assert frame.filter(family_of() != F.col("wanted")).count() == 0


def test_prediction_texts(spark):
    texts = ["SELECT 1" + fixed.PREDICTION_DELIMITER + "shop", None, "no database"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    split = lines.split_prediction(F.col("t"))
    out = rows.select("i", *[c.alias(n) for n, c in split.items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [("SELECT 1", "shop"), (" ", "financial"), ("no database", "financial")]


def test_database_name(spark):
    assert values(spark, ["shop"], lambda c: lines.database_name(c, "dev_")) == ["dev_shop"]


def test_paths(spark):
    paths = [
        "file:/x/open-ai/0_shot/gpt-4/5_Instructions/360_Inferences/metrics.csv",
        "./self-hosted/4_shot_cot/meta/Llama/11_Instructions/120_Inferences/60_size/metrics.csv",
        "/nothing/here.csv",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(paths)], "i int, t string")
    out = rows.select("i", *[c.alias(n) for n, c in lines.path_dimensions(F.col("t")).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("open-ai", "0_shot", "gpt-4", 5, 360, 360), ("self-hosted", "4_shot_cot", "Llama", 11, 120, 60),
        ("", "", None, None, None, None)]
