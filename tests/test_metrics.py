"""Metrics, cost, accuracy and reports on small literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark.operators import accuracy, metrics, reports

SCHEMA = (
    "environment string, model string, instruction int, response_time string, llm_prompt_tokens bigint,"
    " llm_response_tokens bigint, hardness string"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        ("open-ai", "gpt-4-turbo-preview", 5, "0:00:02", 100, 10, "simple"),
        ("open-ai", "gpt-4-turbo-preview", 5, "0:00:04.5", 200, 45, "simple"),
        ("open-ai", "gpt-4-turbo-preview", 5, "0", 300, 7, "simple"),
        ("open-ai", "gpt-4-turbo-preview", 5, "0", 50, 5, "moderate"),
        ("open-ai", "gpt-4-turbo-preview", 5, "0:00:01", 10, 3, "strange"),
        ("open-ai", "gpt-4-turbo-preview", 5, "0:00:01", 10, 3, None),
        ("self-hosted", "dbrx-instruct", 5, "1:00:00", 100, 150, "simple"),
        ("self-hosted", "dbrx-instruct", 5, "0", 100, 130, "moderate"),
        ("open-ai", "unpriced", 5, "0:00:01", 10, 3, "simple"),
    ], SCHEMA)


@pytest.fixture(scope="module")
def wide(spark, rows):
    priced = metrics.with_cost(metrics.metrics_by_hardness(rows), metrics.price_list(spark))
    return {(r.model, r.hardness): r for r in priced.collect()}


def test_groups(wide):
    assert {h for m, h in wide if m == "gpt-4-turbo-preview"} == {"simple", "moderate", "total"}
    every = {(r.hardness) for r in wide.values()}
    assert "strange" not in every and None not in every


def test_usable_rows_give_latency_and_throughput(wide):
    simple = wide["gpt-4-turbo-preview", "simple"]
    assert simple.latency == pytest.approx(3.25) and simple.throughput == pytest.approx((5 + 10) / 2)
    assert simple.psr == pytest.approx(200 / 3) and simple.input_tokens == 600 and simple.output_tokens == 62


def test_group_without_usable_row(wide):
    moderate = wide["gpt-4-turbo-preview", "moderate"]
    assert moderate.latency is None and moderate.throughput is None and moderate.psr == 0.0
    assert moderate.input_tokens == 50 and moderate.cost == pytest.approx((50 * 10 + 5 * 30) / 1e6)
    assert wide["dbrx-instruct", "moderate"].cost == 0.0


def test_total_covers_every_row(wide):
    total = wide["gpt-4-turbo-preview", "total"]
    assert total.rows == 6 and total.input_tokens == 670 and total.psr == pytest.approx(400 / 6)
    assert total.cost == pytest.approx((670 * 10 + 73 * 30) / 1e6)


def test_self_hosted(wide):
    simple = wide["dbrx-instruct", "simple"]
    assert simple.output_tokens == 50 and simple.cost == pytest.approx(10.0)


def test_no_price_gives_no_cost(wide):
    assert wide["unpriced", "total"].cost is None


def test_every_hardness_on_request(rows):
    found = metrics.metrics_by_hardness(rows, levels=None).filter("model = 'gpt-4-turbo-preview'")
    assert sorted(str(r.hardness) for r in found.collect()) == ["None", "moderate", "simple", "strange", "total"]


def test_response_includes_prompt_overrides(rows):
    marked = rows.withColumn("response_includes_prompt", F.lit(False))
    found = metrics.metrics_by_hardness(marked).filter("environment = 'self-hosted' AND hardness = 'total'").first()
    assert found.output_tokens == 280


def test_rounding_goes_half_to_even(spark):
    values = [0.0005, 0.0015, 2.6745]
    report = spark.createDataFrame([(v,) for v in values], "value double")
    assert [r.value for r in reports.rounded(report).collect()] == [0.0, 0.002, 2.674]


def test_pivot_averages_duplicates_and_keeps_unmapped(spark):
    report = spark.createDataFrame([
        ("open-ai", "gpt-4-turbo-preview", 5, 360, fixed.THROUGHPUT, "simple", 1.0),
        ("open-ai", "gpt-4-turbo-preview", 5, 360, fixed.THROUGHPUT, "simple", 2.0),
        ("open-ai", "gpt-4-turbo-preview", 5, 60, fixed.THROUGHPUT, "simple", 9.0),
        ("open-ai", "gpt-4-turbo-preview", 5, 360, fixed.PSR, "simple", 9.0),
        ("open-ai", "mystery", 0, 360, fixed.INPUT_TOKENS, "total", 4.0),
    ], "environment string, model string, instruction int, dataset_size int, metric string, hardness string, value double")
    named = reports.model_names(report, reports.short_names(spark))
    cells = {(r.model, r.metric): r.asDict() for r in reports.pivot_metrics(named).collect()}
    assert set(cells) == {("gpt-4", fixed.THROUGHPUT), ("mystery", fixed.INPUT_TOKENS)}
    assert cells["gpt-4", fixed.THROUGHPUT]["5_simple"] == 1.5 and cells["mystery", fixed.INPUT_TOKENS]["0_total"] == 4.0
    mapped = reports.model_names(report, reports.short_names(spark), drop_unmapped=True)
    assert {r.model for r in mapped.collect()} == {"gpt-4"}


def test_pivot_keeps_further_keys_apart(spark):
    report = spark.createDataFrame(
        [("e", "m", 5, s, fixed.INPUT_TOKENS, "total", v) for s, v in (("0_shot", 1.0), ("2_shot", 3.0))],
        "environment string, model string, instruction int, shot string, metric string, hardness string, value double")
    assert [r["5_total"] for r in reports.pivot_cost(report).collect()] == [2.0]
    assert {r.shot: r["5_total"] for r in reports.pivot_cost(report, by=["shot"]).collect()} == {"0_shot": 1.0, "2_shot": 3.0}
    assert {r.shot: r["5_total"] for r in reports.pivot_metrics(report, by=["shot"]).collect()} == {"0_shot": 1.0, "2_shot": 3.0}


def test_accuracy(spark):
    scores = spark.createDataFrame(
        [(1, 1, "simple", "a"), (2, 0, "simple", "a"), (3, 1, "odd", "a"), (4, 1, "moderate", "b"), (5, None, "moderate", "b")],
        "question_id bigint, res int, difficulty string, model string")
    found = {(r.model, r.hardness): (r.questions, r.accuracy) for r in accuracy.accuracy_by_difficulty(scores, ["model"]).collect()}
    assert found == {
        ("a", "simple"): (2, 50.0), ("a", "moderate"): (0, 0.0), ("a", "challenging"): (0, 0.0), ("a", "total"): (3, pytest.approx(200 / 3)),
        ("b", "simple"): (0, 0.0), ("b", "moderate"): (2, 50.0), ("b", "challenging"): (0, 0.0), ("b", "total"): (2, 50.0)}
    whole = {r.hardness: r.questions for r in accuracy.accuracy_by_difficulty(scores).collect()}
    assert whole == {"simple": 2, "moderate": 2, "challenging": 0, "total": 5}


def test_pivots_show_whatever_the_report_holds(spark):
    rows = [("m", "open-ai", i, h, 360, metric, v) for i, h, v in ((5, "simple", 1.0), (5, "weird", 2.0), (None, "simple", 3.0), (7, None, 4.0)) for metric in (fixed.THROUGHPUT, fixed.COST, fixed.OUTPUT_TOKENS)]
    report = spark.createDataFrame(rows, "model string, environment string, instruction int, hardness string, dataset_size int, metric string, value double")
    row = reports.pivot_metrics(report).filter(F.col("metric") == fixed.THROUGHPUT).first().asDict()
    assert {name: value for name, value in row.items() if isinstance(value, float)} == {"5_simple": 1.0, "5_weird": 2.0, "none_simple": 3.0, "7_none": 4.0}
    assert [name for name in row if name.startswith("5_")] == ["5_simple", "5_moderate", "5_challenging", "5_total", "5_weird", "5_none"]
    with pytest.raises(ValueError, match="also has"):
        reports.pivot_metrics(report, [5, 7])
    turned = reports.pivot_metrics_transposed(report.withColumn("environment", F.lit(None).cast("string")))
    assert {(r.instruction, r.hardness, r[f"m_{fixed.THROUGHPUT}_none"]) for r in turned.collect()} == {(5, "simple", 1.0), (5, "weird", 2.0), (None, "simple", 3.0), (7, None, 4.0)}
