"""Cases in which the size of the input once changed the result, and names that once found no price."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.functions import replies
from evalspark.operators import metrics, reports, sampling


def test_buckets_take_each_question_once(spark):
    rows = spark.range(20).selectExpr("id % 10 as question_id", "'simple' as hardness", "id div 10 as run")
    sized = sampling.bucket_rows(rows, sampling.question_buckets(rows, "hardness"))
    assert sized.count() == 40
    assert sized.groupBy("run", "question_id", "dataset_size").count().filter("count > 1").count() == 0


def test_pivot_shows_every_size(spark):
    report = spark.createDataFrame(
        [("m", "e", size, fixed.TOTAL, fixed.FULL_SIZE, fixed.THROUGHPUT, float(size)) for size in (0, 3, 5, 8)],
        "model string, environment string, instruction int, hardness string, dataset_size int, metric string, value double")
    row, = reports.pivot_metrics(report).collect()
    assert [row[f"{size}_{fixed.TOTAL}"] for size in (0, 3, 5, 8)] == [0.0, 3.0, 5.0, 8.0]
    with pytest.raises(ValueError):
        reports.pivot_metrics(report, instructions=[0, 5])


def test_grid_models_find_their_price(spark):
    priced = metrics.price_list(spark).select("environment", "model").collect()
    safe = {(p.environment, p.model) for p in priced}
    runs = [(e, m) for e, m, _ in fixed.MODEL_FAMILIES if (e, m.split("/")[-1].replace(":", "_")) in safe]
    assert any(":" in m or "/" in m for _, m in runs)
    rows = spark.createDataFrame([(e, m, 1000, 1000) for e, m in runs], "environment string, model string, input_tokens long, output_tokens long")
    assert metrics.cost_api(rows, metrics.price_list(spark)).filter("api_cost is null").count() == 0


def extract(spark, text, keep_with=True):
    return spark.createDataFrame([(text,)], "t string").select(replies.sql_extract(F.col("t"), keep_with).alias("s")).first().s


def test_with_is_kept_only_where_it_begins_a_statement(spark):
    assert extract(spark, "Here is a query with a column as follows: SELECT 1 AS v") == "SELECT 1 AS v"
    assert extract(spark, "Sure: WITH q AS (SELECT 1 AS v) SELECT v FROM q; done") == "WITH q AS (SELECT 1 AS v) SELECT v FROM q"
    assert extract(spark, "WITH RECURSIVE q (v) AS (SELECT 1) SELECT v FROM q") == "WITH RECURSIVE q (v) AS (SELECT 1) SELECT v FROM q"


def test_long_reply_takes_linear_time(spark):
    text = "with a column as b " * 5_000
    extract(spark, "x")
    started = time.perf_counter()
    extract(spark, text)
    assert time.perf_counter() - started < 5
