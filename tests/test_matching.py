"""Result comparison against its definition."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evalspark.operators import matching, scoring


def same_columns(gold, predicted):
    """The definition: the columns are the same multisets, as a multiset of columns."""
    columns = lambda rows, width: Counter(
        tuple(sorted(Counter((row[c] is None, str(row[c])) for row in rows).items())) for c in range(width))
    return int(gold[1] == predicted[1] and columns(*gold) == columns(*predicted))


def same_rows(gold, predicted):
    return int(gold[1] == predicted[1] and Counter(map(tuple, gold[0])) == Counter(map(tuple, predicted[0])))


def make_pairs(seed=1, count=120):
    rng = random.Random(seed)
    pairs = []
    for _ in range(count):
        width, height = rng.randint(1, 3), rng.choice([0, 1, 2, 5, 9])
        cell = lambda: rng.choice([None, "", "a", "b", "n:1"])
        gold = [[cell() for _ in range(width)] for _ in range(height)]
        predicted = [row[:] for row in gold]
        change = rng.choice(["none", "rows", "columns", "each column", "value", "drop", "repeat", "extra column", "null"])
        if change == "rows":
            rng.shuffle(predicted)
        elif change == "columns":
            order = rng.sample(range(width), width)
            predicted = [[row[c] for c in order] for row in predicted]
        elif change == "each column":
            columns = [rng.sample([row[c] for row in predicted], height) for c in range(width)]
            predicted = [list(row) for row in zip(*columns)]
        elif height and change == "value":
            predicted[0][0] = "changed"
        elif height and change == "drop":
            predicted.pop()
        elif height and change == "repeat":
            predicted.append(predicted[0][:])
        elif change == "extra column":
            predicted, width_predicted = [row + ["a"] for row in predicted], width + 1
            pairs.append(((gold, width), (predicted, width_predicted)))
            continue
        elif height and change == "null":
            predicted[0][0] = None
        pairs.append(((gold, width), (predicted, width)))
    return pairs


@pytest.fixture(scope="module")
def pairs():
    return make_pairs()


@pytest.fixture(scope="module")
def tables(spark, pairs):
    cells, shapes = [], []
    for pair_id, sides in enumerate(pairs):
        for side, (rows, width) in zip((matching.GOLD, matching.PREDICTED), sides):
            shapes.append((pair_id, side, width, len(rows)))
            cells += [(pair_id, side, c, r, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    random.Random(0).shuffle(cells)
    return (
        spark.createDataFrame(cells, "pair_id bigint, side string, col_pos int, row_id bigint, value string").repartition(5),
        spark.createDataFrame(shapes, "pair_id bigint, side string, n_cols int, n_rows bigint"),
    )


@pytest.mark.parametrize("mode, exact", [("columns", False), ("columns", True), ("rows", False)])
def test_match_results(tables, pairs, mode, exact):
    cells, shapes = tables
    found = {r.pair_id: r.res for r in matching.match_results(cells, shapes, mode=mode, exact=exact).collect()}
    wanted = same_columns if mode == "columns" else same_rows
    assert found == {i: wanted(*pair) for i, pair in enumerate(pairs)}
    assert 0 < sum(found.values()) < len(found)


def test_a_missing_side_does_not_match(spark):
    cells = spark.createDataFrame([(1, "gold", 0, "a")], "pair_id bigint, side string, col_pos int, value string")
    shapes = spark.createDataFrame([(1, "gold", 1, 1)], "pair_id bigint, side string, n_cols int, n_rows bigint")
    assert [r.res for r in matching.match_results(cells).collect()] == [0]
    assert [r.res for r in matching.match_results(cells, shapes).collect()] == [0]


def test_collisions_are_found(spark):
    """Two different columns under one made-up signature are reported."""
    cells = spark.createDataFrame(
        [(1, "gold", 0, "a"), (1, "predicted", 0, "b"), (2, "gold", 0, "a"), (2, "predicted", 0, "a")],
        "pair_id bigint, side string, col_pos int, value string")
    fake = matching.column_signatures(cells)
    for name in matching.SIGNATURE:
        fake = fake.withColumn(name, F.lit(1).cast("bigint"))
    assert {r.pair_id for r in matching.signature_collisions(cells, fake).collect()} == {1}


def signature(spark, sql):
    return [tuple(column) for column in scoring.signatures(spark, [("one", sql, spark.sql(sql).schema)]).first().signature]


SAME = [
    ("SELECT 1", "SELECT 1.0D"), ("SELECT 1", "SELECT 1L"), ("SELECT 1", "SELECT true"), ("SELECT 0", "SELECT -0.0D"),
    ("SELECT 0.5", "SELECT 0.5D"), ("SELECT 1.500", "SELECT 1.5D"), ("SELECT CAST(1 AS DECIMAL(20,5))", "SELECT 1"),
    ("SELECT CAST('NaN' AS DOUBLE)", "SELECT CAST(NULL AS INT)"), ("SELECT 0.00001", "SELECT 0.00001D"),
    ("SELECT 1e20D", "SELECT CAST(100000000000000000000 AS DECIMAL(30,0))"), ("SELECT CAST(0.1 AS FLOAT)", "SELECT 0.1"),
    ("SELECT 1, 'a'", "SELECT 'a', 1"), ("SELECT 1 WHERE false", "SELECT 'x' WHERE false"), ("SELECT 2 a, 2 a", "SELECT 2, 2"),
    ("SELECT * FROM VALUES (1, 'a'), (2, 'b')", "SELECT * FROM VALUES (1, 'b'), (2, 'a')"), ("SELECT NULL", "SELECT CAST(NULL AS STRING)"),
]
DIFFERENT = [
    ("SELECT '1'", "SELECT 1"), ("SELECT NULL", "SELECT ''"), ("SELECT 1e-20D", "SELECT 2e-20D"),
    ("SELECT 9007199254740993", "SELECT 9007199254740992"), ("SELECT 1", "SELECT 1, 1"), ("SELECT 1 WHERE false", "SELECT 1, 2 WHERE false"),
    ("SELECT 1", "SELECT 1 UNION ALL SELECT 1"), ("SELECT 0.12345678901234567890", "SELECT 0.12345678901234567891"),
    ("SELECT * FROM VALUES (1),(1),(2)", "SELECT * FROM VALUES (1),(2),(2)"), ("SELECT 1 WHERE false", "SELECT NULL"),
]


@pytest.mark.parametrize("one, other", SAME)
def test_equal_by_value(spark, one, other):
    assert signature(spark, one) == signature(spark, other)


@pytest.mark.parametrize("one, other", DIFFERENT)
def test_different_by_value(spark, one, other):
    assert signature(spark, one) != signature(spark, other)


def test_wide_results(spark):
    wide = ", ".join(f"id + {n} AS c{n % 7}" for n in range(60))
    turned = ", ".join(f"double(id + {n}) AS d" for n in reversed(range(60)))
    one, other = (f"SELECT {columns} FROM range(50)" for columns in (wide, turned))
    assert signature(spark, one) == signature(spark, other) != signature(spark, one.replace("range(50)", "range(49)"))
    empty = signature(spark, one + " WHERE id < 0")
    assert len(empty) == 60 and set(empty) == {(0,) * len(matching.SIGNATURE)}


def test_cells_and_signatures_agree(spark):
    result = spark.createDataFrame([(1, 2.5, "a", Decimal("1.50")), (None, None, None, None)], "a int, b double, c string, d decimal(9,2)")
    cells = matching.result_cells(result, 1, matching.GOLD)
    assert {(r.col_pos, r.value) for r in cells.collect() if r.value is not None} == {(0, "n:1"), (1, "n:2.5"), (2, "s:a"), (3, "n:1.5")}
    by_cells = matching.column_signatures(cells).select(*matching.SIGNATURE)
    result.createOrReplaceTempView("a_result")
    statements = [(key, f"SELECT * FROM a_result {rest}", result.schema) for key, rest in (("a", ""), ("b", "WHERE a = 0"), ("c", "ORDER BY 1"))]
    both = {r.key: sorted(map(tuple, r.signature)) for r in scoring.signatures(spark, statements).collect()}
    assert both["a"] == both["c"] == sorted(map(tuple, by_cells.collect())) != both["b"]


def test_whole_rows_match_without_regard_to_order(spark):
    rng = random.Random(8)
    rows, wanted = [], {}
    for pair in range(60):
        gold = [[rng.choice(["a", "b", None, "1"]) for _ in range(3)] for _ in range(rng.randrange(6))]
        predicted = rng.sample(gold, len(gold))
        if pair % 3 == 1 and gold:
            predicted = [*predicted[1:], rng.choice([predicted[0] + ["x"], predicted[0][:2], [None, None, "z"], predicted[-1]])]
        wanted[pair] = int(Counter(map(tuple, gold)) == Counter(map(tuple, predicted)))
        rows += [(pair, matching.GOLD, r) for r in gold] + [(pair, matching.PREDICTED, r) for r in predicted]
    table = spark.createDataFrame(rows, "pair_id bigint, side string, cells array<string>").repartition(5)
    found = {r.pair_id: r.res for r in matching.match_rows(table).collect()}
    present = {pair for pair, _, _ in rows}
    assert found == {pair: res for pair, res in wanted.items() if pair in present} and 0 in found.values()
    left = matching.result_rows(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL) t(x, y)"), 1, matching.GOLD)
    right = matching.result_rows(spark.sql("SELECT * FROM VALUES (2.0D, NULL), (1.0D, 'a') t(x, y)"), 1, matching.PREDICTED)
    assert matching.match_rows(left.unionByName(right)).first().res == 1
    shapes = spark.createDataFrame([(7, "gold", 2, 0), (7, "predicted", 2, 0), (8, "gold", 2, 0)], "pair_id bigint, side string, n_cols int, n_rows bigint")
    assert {r.pair_id: r.res for r in matching.match_rows(table.limit(0), shapes).collect()} == {7: 1, 8: 0}
