"""Shapes of the physical plans that matter at scale."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from evalspark.operators import context, matching, metrics, prompts, ranking, sampling
from evalspark.plans import queries, run_queries, views
from evalspark.plans.queries import REGISTRY

SCORED = {"score_pairs", "score_many_pairs"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def test_metrics_read_each_row_once_and_reduce_before_moving(spark, sf_dir):
    lines = plan(metrics.metrics_by_hardness(views.metric_rows(spark, sf_dir))).splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    kinds = [re.sub(r"^[\s:+\-*()\d]*", "", line).split(" ")[0].split("(")[0] for line in lines]
    assert sum("FileScan" in line for line in lines) == 1
    # From the scan upwards: the rows are aggregated before the first exchange,
    # and copied for the totals only after it.
    first_exchange = max(i for i, kind in enumerate(kinds) if kind == "Exchange")
    assert kinds[first_exchange + 1] == "HashAggregate"
    assert all(i < first_exchange for i, kind in enumerate(kinds) if kind == "Expand")
    assert scan > first_exchange
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in lines[scan]


def test_group_limit_runs_before_each_shuffle(spark, sf_dir):
    questions = views.question_rows(spark, sf_dir)
    text = plan(ranking.first_per_group(questions, ["difficulty"], [F.col("question_id")], 20))
    assert text.count("WindowGroupLimit") == 4 and text.count("Partial") >= 2


def test_buckets_do_not_move_the_rows(spark, sf_dir):
    rows = views.metric_rows(spark, sf_dir)
    text = plan(sampling.bucket_rows(rows, sampling.question_buckets(rows, "hardness")))
    outer = text[: text.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in outer and " Exchange " not in outer


def test_cells_are_reduced_where_they_are_read(spark, sf_dir):
    text = plan(matching.match_results(views.result_cells(spark, sf_dir)))
    lines = [line for line in text.splitlines() if "Exchange" in line or "HashAggregate" in line or "Join" in line]
    assert not any("Join" in line for line in lines)
    assert lines[-1].lstrip(" +-:").startswith("HashAggregate") and "Exchange" in lines[-2]


def test_whole_rows_are_compared_where_they_are_read(spark, sf_dir):
    text = plan(matching.match_rows(views.result_rows(spark, sf_dir)))
    lines = [line for line in text.splitlines() if "Exchange" in line or "HashAggregate" in line or "Join" in line]
    assert not any("Join" in line for line in lines)
    assert lines[-1].lstrip(" +-:").startswith("HashAggregate") and "Exchange" in lines[-2]
    assert not any("cells#" in line or "_row#" in line for line in text.splitlines() if "Exchange" in line)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_runs_are_unfolded_behind_the_last_shuffle(spark, sf_dir, threshold):
    """Schema and example texts meet a question once, whatever the number of runs."""
    runs = prompts.grid(run_queries.ALL_MODELS, [0, 5, 11], ["2", "4-cot"])
    contexts = context.db_context(views.schema_catalog(spark, sf_dir))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        asked = prompts.with_late_texts(views.question_rows(spark, sf_dir), contexts, queries._examples(spark, sf_dir), runs, 8)
        lines = plan(prompts.with_prompts(asked)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unfolding = next(i for i, line in enumerate(lines) if "Generate explode" in line and "_run" in line)
    assert not any("Exchange" in line for line in lines[:unfolding])


def test_positions_move_rows_once(spark, sf_dir):
    questions = views.question_rows(spark, sf_dir).select("question_id", "difficulty")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(ranking.ranged_positions(questions, ["difficulty"], F.col("question_id"), [F.col("question_id")]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\]", text)
    assert windows and all("_group" in keys for keys in windows)  # and no window over all rows
    ranges = [keys for keys in windows if "_range" in keys]
    assert len(ranges) == 1, text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    kept = views.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)]" in plan(kept)
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan(views.question_rows(spark, sf_dir).select("sql_query"))


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SCORED))
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    text = plan(entry_points.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "SinglePartition" not in text


def test_sources_use_no_forbidden_calls():
    package = Path(__file__).resolve().parents[1] / "evalspark"
    text = "\n".join(path.read_text() for path in package.rglob("*.py") if "llm" not in path.parts)
    for call in ("localCheckpoint", "crossJoin", "toPandas(", ".rdd", "monotonically_increasing_id", "inferSchema"):
        assert call not in text, call
    # One: the labels that become a pivot's columns.
    assert len(re.findall(r"\.collect\(\)", text)) == 1 and ".distinct().collect()" in text


@pytest.mark.parametrize("files", [1, 8])
def test_prompts_move_each_question_once_at_most(spark, tmp_path, files):
    """From few files each question moves once, from as many as there are cores none does. Samples of more bytes than Spark broadcasts by estimate, of which the prompts need a few."""
    folder = str(tmp_path)
    spark.range(200).selectExpr("id AS doc_id", "repeat('words ', 50) AS text", "'en' AS lang", "concat('src', id % 20) AS source", "300L AS n_chars").repartition(files).write.parquet(f"{folder}/documents.parquet")
    spark.range(40).selectExpr("id AS item_id", "'text' AS text").write.parquet(f"{folder}/benchmark.parquet")
    turns = "sha2(string(id), 512)"
    spark.range(120_000).selectExpr("id div 2 AS conv_id", "id % 2 AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", f"concat({turns}, {turns}) AS text").write.parquet(f"{folder}/conversations.parquet")
    text = plan(queries.prompt_fill(spark, folder))
    assert text.count("Exchange hashpartitioning(") == (files < 8) and "SortMergeJoin" not in text, text
