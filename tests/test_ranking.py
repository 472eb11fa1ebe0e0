"""Positions, heads, samples and buckets against plain Python, with a hot group."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalspark.operators import ranking, replies, sampling

KINDS = ["simple", "moderate", "challenging", "odd", None]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    ids = rng.sample(range(5_000_000), 6_000)
    # One group holds two thirds of the rows.
    return [(i, rng.choices(KINDS, [1, 6, 1, 0.5, 0.5])[0]) for i in ids]


@pytest.fixture(scope="module")
def questions(spark, data):
    rows = [(i, d, f"db{i % 3}", f"q{i}", None, f"s{i}", f"select {i}") for i, d in data]
    schema = "question_id bigint, difficulty string, db_id string, question string, evidence string, schema string, sql_query string"
    return spark.createDataFrame(rows, schema).repartition(7)


def grouped(data):
    groups = defaultdict(list)
    for i, d in data:
        groups[d].append(i)
    return {d: sorted(ids) for d, ids in groups.items()}


def test_first_per_group(questions, data):
    found = ranking.first_per_group(questions, ["difficulty"], [F.col("question_id")], 50)
    assert {(r.difficulty, r.question_id, r.position) for r in found.collect()} == {
        (d, i, p + 1) for d, ids in grouped(data).items() for p, i in enumerate(ids[:50])}


@pytest.mark.parametrize("k", [5, 999, 1_000, 1_001, 1_500])
def test_heads_are_exact_with_repeated_ids(spark, k):
    rows = spark.range(2_000).selectExpr("id div 3 as question_id", "'simple' as difficulty", "id as text")
    found = sampling.head_per_difficulty(rows, k, ["simple"])
    assert sorted(r.question_id for r in found.collect()) == sorted(i // 3 for i in range(2_000))[:k]


@pytest.mark.parametrize("block", [1_000, 100_000, 10_000_000])
def test_positions(questions, data, block):
    found = ranking.positions(
        questions.select("question_id", "difficulty"), ["difficulty"], [F.col("question_id")],
        F.floor(F.col("question_id") / block))
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(question_id={i}, difficulty={d!r}, position={p})" for d, ids in grouped(data).items() for p, i in enumerate(ids))


@pytest.mark.parametrize("rows", [70, 1_000_000])
@pytest.mark.parametrize("size", [30, 1_200, 9_000, 30_000])
def test_head_per_difficulty(questions, data, size, rows):
    found = {r.question_id for r in sampling.head_per_difficulty(questions, size, rows=rows).collect()}
    groups = grouped(data)
    assert found == {i for d in KINDS[:3] for i in groups[d][: size // 3]}


@pytest.mark.parametrize("size", [30, 1_200, 9_000, 30_000])
def test_equal_split(questions, data, size):
    sample = sampling.equal_split(questions, size, seed=5, rows=300)
    assert sample.columns == sampling.QUESTION_SET_COLUMNS
    found = [r.index_in_original for r in sample.collect()]
    draw = lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i)
    wanted = [i for d in KINDS[:3] for i in sorted(grouped(data)[d], key=draw)[: size // 3]]
    assert sorted(found) == sorted(wanted)
    if size == 30:
        assert sorted(r.index_in_original for r in sampling.equal_split(questions, size, seed=6).collect()) != sorted(found)


def test_question_buckets_put_unknown_levels_last(questions, data):
    levels = defaultdict(list)
    for i, d in data:
        levels[d if d in KINDS[:2] else "challenging"].append(i)
    wanted = set()
    for ids in levels.values():
        ids.sort()
        wanted |= {(i, 60) for i in ids[:20]} | {(i, 120) for i in ids[20:60]} | {(i, 180) for i in ids[60:120]}
    found = sampling.question_buckets(questions)
    assert {tuple(r) for r in found.collect()} == wanted
    rows = sampling.bucket_rows(questions.select("question_id"), found)
    assert sorted(tuple(r) for r in rows.collect()) == sorted([(i, 360) for i, _ in data] + list(wanted))


def test_exclude_schemas(spark):
    rows = spark.createDataFrame(
        [(1, "a -- phpMyAdmin SQL Dump b"), (2, "fine"), (3, None), (4, "bad one")], "question_id bigint, schema string")
    assert {r.question_id for r in sampling.exclude_schemas(rows).collect()} == {2, 3, 4}
    assert {r.question_id for r in sampling.exclude_schemas(rows, ["SQL Dump", "^bad"]).collect()} == {2, 3}


def test_append_frames_aligns_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert [tuple(r) for r in sampling.append_frames(a, b).collect()] == [(1, "x", None), (None, "y", 2.0)]


def hashed_ids(spark, n):
    """Ids all over the 64-bit range, one run with most rows, and some rows without an id or a run."""
    rows = spark.range(n).selectExpr("xxhash64(id) AS question_id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN concat('r', id % 3) END AS run_id", "id")
    return rows.unionByName(rows.filter("id % 40 = 0").withColumn("question_id", F.lit(None).cast("bigint")))


def test_ranges_follow_the_rows_and_not_the_ids(spark):
    rows = hashed_ids(spark, 200_000)
    cuts = ranking.measured_cuts(rows, ["run_id"], F.col("question_id"), 20_000)
    assert {r._group.run_id: (len(r._cuts) + 1, r._parts) for r in cuts.collect()} == {"hot": (7, 1), "r0": (1, 1), "r1": (1, 1), "r2": (1, 1), None: (1, 1)}
    ranged = ranking._with_range(rows, ["run_id"], F.col("question_id"), ranking.measured_cuts(rows, ["run_id"], F.col("question_id"), 2_000))
    sizes = [r["count"] for r in ranged.groupBy("_group", "_range").count().collect()]
    assert sum(sizes) == rows.count() and max(sizes) < 3_000 and len(sizes) < 140


@pytest.mark.parametrize("per_range", [150, 1_000_000])
def test_ranged_positions_number_every_row(spark, per_range):
    rows = hashed_ids(spark, 6_000)
    found = ranking.ranged_positions(rows, ["run_id"], F.col("question_id"), [F.col("question_id")], rows=per_range).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.run_id].append((r.position, r.question_id))
    assert len(found) == 6_150 and len(groups) == 5
    for numbered in groups.values():
        numbered.sort()
        assert [p for p, _ in numbered] == list(range(len(numbered)))
        ids = [i for _, i in numbered]
        assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("per_range", [40, 1_000_000])
def test_rows_without_an_id_are_not_lost(spark, per_range):
    rows = spark.createDataFrame(
        [(i if i % 3 else None, "simple", "d", f"q{i}", None, "s", "x") for i in range(300)],
        "question_id bigint, difficulty string, db_id string, question string, evidence string, schema string, sql_query string")
    assert sampling.head_per_difficulty(rows, 300, ["simple"], rows=per_range).count() == 300
    some = sampling.head_per_difficulty(rows, 220, ["simple"], rows=per_range).collect()
    assert len(some) == 220 and sum(r.question_id is None for r in some) == 20
    assert sampling.equal_split(rows, 250, levels=["simple"], rows=per_range).count() == 250
    parsed = replies.parse_predictions(rows.selectExpr("'r' AS run_id", "question_id", "question AS prediction"), ranked_rows=per_range).collect()
    assert sorted(r.pair_index for r in parsed) == list(range(300))
    assert all(r.question_id is None for r in parsed if r.pair_index >= 200)


def test_ranges_of_nothing(spark):
    none = spark.createDataFrame([], "run_id string, question_id bigint")
    assert ranking.ranged_positions(none, ["run_id"], F.col("question_id"), [F.col("question_id")]).collect() == []
    assert ranking.first_by_range(none, ["run_id"], F.col("question_id"), [F.col("question_id")], 5).collect() == []
