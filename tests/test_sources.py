"""Readers and writers on small files in the expected formats."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed
from evalspark import schemas
from evalspark import session as sessions
from evalspark.operators import context, metrics, prompts
from evalspark.sources import json_parts, named_files, readers, writers


def test_question_array(spark, tmp_path):
    path = tmp_path / "dev.json"
    path.write_text(json.dumps([
        {"question_id": 0, "db_id": "a", "difficulty": "simple", "question": "how\nmany?", "evidence": "", "SQL": "SELECT 1", "more": 1},
        {"question_id": 1, "db_id": "b", "difficulty": "odd", "question": "é", "SQL": "SELECT 2"},
    ], indent=2))
    rows = sorted(map(tuple, readers.read_questions(spark, str(path)).collect()))
    assert rows == [(0, "a", "simple", "how\nmany?", "", "SELECT 1"), (1, "b", "odd", "é", None, "SELECT 2")]


def test_question_set_with_index_column(spark, tmp_path):
    path = tmp_path / "set.csv"
    path.write_text(
        ',index_in_original,difficulty,db_id,sql_query,question,schema,evidence\n'
        '0,7,simple,a,"SELECT ""x"", 1","two\nlines","CREATE TABLE t (a INT, b TEXT)",\n'
        '1,9,moderate,b,SELECT 2,plain,none,hint\n')
    rows = {r.row_index: r for r in readers.read_question_set(spark, str(path)).collect()}
    assert rows[0].sql_query == 'SELECT "x", 1' and rows[0].question == "two\nlines" and rows[0].evidence is None
    assert (rows[1].index_in_original, rows[1].evidence) == (9, "hint")


def test_shot_samples(spark, tmp_path):
    (tmp_path / "set_2_shot_samples.json").write_text(json.dumps({"a": [{"question": "q0", "sql_query": "s0"}, {"question": "q1", "sql_query": "s1"}], "b": []}))
    (tmp_path / "set_1_shot_cot_samples.json").write_text(json.dumps({"a": [{"question": "q", "sql_query": "s", "cot": "why"}]}))
    samples = readers.read_shot_samples(spark, str(tmp_path))
    assert sorted(map(tuple, samples.collect())) == [
        ("1_shot_cot", "a", 0, "q", "s", "why"), ("2_shot", "a", 0, "q0", "s0", None), ("2_shot", "a", 1, "q1", "s1", None)]
    blocks = {(r.shot, r.db_id): r.examples for r in prompts.few_shot_examples(samples).collect()}
    assert blocks == {
        ("2_shot", "a"): "Examples: \n\n    Q: q0\n    A: s0\n    Q: q1\n    A: s1",
        ("1_shot_cot", "a"): "Examples: \n\n    Q: q\n    A: s\n    Explanation: \nwhy\n"}
    asked = spark.createDataFrame([(1, "2_shot", "a"), (2, "2_shot", "z"), (3, "0_shot", "a")], "question_id bigint, shot string, db_id string")
    assert {r.question_id: r.examples == "" for r in prompts.with_examples(asked, prompts.few_shot_examples(samples)).collect()} == {
        1: False, 2: True, 3: True}


def test_gold_lines(spark, tmp_path):
    path = tmp_path / "dev_gold.sql"
    path.write_text("SELECT 1\ta\n\n  SELECT b\tc \n")
    assert sorted(map(tuple, readers.read_gold_lines(spark, str(path)).collect())) == [("SELECT 1", "a"), ("SELECT b", "c")]


@pytest.mark.parametrize("per_line", [False, True])
def test_prediction_map(spark, tmp_path, per_line):
    path = tmp_path / "predict_dev.json"
    entries = {"0": "SELECT 1" + fixed.PREDICTION_DELIMITER + "a", "1": 0, "2": "SELECT 'x'" + fixed.PREDICTION_DELIMITER + "b"}
    path.write_text(json.dumps(entries, indent=None if per_line else 4))
    rows = readers.read_prediction_map(spark, str(path), per_line).select("pair_index", "predicted_sql", "db_id")
    assert sorted(map(tuple, rows.collect())) == [(0, "SELECT 1", "a"), (1, " ", "financial"), (2, "SELECT 'x'", "b")]


def test_prediction_maps_have_one_form(spark, tmp_path):
    rows = spark.createDataFrame([("r", i, f"SELECT {i}", "a") for i in range(2_500)], "run_id string, pair_index bigint, predicted_sql string, db_id string")
    maps = writers.prediction_maps(rows).collect()
    assert sorted(int(key) for m in maps for key in json.loads(m.value)) == list(range(2_500)) and len(maps) == 2_500
    whole, = writers.prediction_maps(rows, single_map=True).collect()
    assert list(json.loads(whole.value)) == [str(i) for i in range(2_500)]


def test_results_tree(spark, tmp_path):
    header = "response_time,llm_prompt_tokens,llm_response_tokens,hardness\n"
    for place, line in [
        ("open-ai/0_shot/gpt-4-turbo-preview/5_Instructions/360_Inferences", "0:00:02,100,10,simple\n0,5,5,simple\n"),
        ("open-ai/0_shot/gpt-4-turbo-preview/5_Instructions/360_Inferences/60_size", "0:00:02,100,10,simple\n"),
        ("self-hosted/2_shot/meta/Llama/11_Instructions/360_Inferences", "0:01:00.500000,7,9,moderate\n"),
    ]:
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "metrics.csv").write_text(header + line)
        (tmp_path / place / "other.csv").write_text("not,this\n")
    rows = readers.read_metrics(spark, str(tmp_path))
    found = {(r.environment, r.shot, r.model, r.instruction, r.dataset_size): r.n for r in rows.groupBy(
        "environment", "shot", "model", "instruction", "dataset_size").count().withColumnRenamed("count", "n").collect()}
    assert found == {
        ("open-ai", "0_shot", "gpt-4-turbo-preview", 5, 360): 2, ("open-ai", "0_shot", "gpt-4-turbo-preview", 5, 60): 1,
        ("self-hosted", "2_shot", "Llama", 11, 360): 1}
    sized = metrics.metrics_by_hardness(rows, [*metrics.RUN_KEYS, "dataset_size"])
    assert {(r.dataset_size, r.psr) for r in sized.filter("model LIKE 'gpt%' AND hardness = 'total'").collect()} == {(360, 50.0), (60, 100.0)}


def test_line_bundle(spark, tmp_path):
    for run, predicted in (("one", "SELECT 1\n\nI don't know\n\n"), ("two", " SELECT 9 \n\n\n\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "predicted.txt").write_text(predicted)
        (tmp_path / run / "gold.txt").write_text("SELECT a\tx\n\nSELECT b\ty\n\n")
    rows = readers.read_line_bundle(spark, str(tmp_path)).collect()
    assert sorted((r.folder.rsplit("/", 1)[1], r.line, r.predicted_sql, r.gold_sql, r.db_id) for r in rows) == [
        ("one", 0, "SELECT 1", "SELECT a", "x"), ("one", 2, "I don't know", "SELECT b", "y"), ("two", 0, "SELECT 9", "SELECT a", "x")]


def test_catalog_and_accuracy_files(spark, tmp_path):
    (tmp_path / "catalog.json").write_text('{"db_id":"a","table_ord":2,"ddl":"x"}\n{"db_id":"a","table_ord":1,"ddl":"y"}\n')
    catalog = readers.read_schema_catalog(spark, str(tmp_path / "catalog.json"))
    assert [r.schema for r in context.db_context(catalog).collect()] == ["yx"]
    (tmp_path / "accuracy.csv").write_text(
        "environment,model,instruction,hardness,shot,dataset_size,metric,value\ne,m,5,simple,0_shot,360,accuracy,51.25\n")
    assert tuple(readers.read_long_accuracy(spark, str(tmp_path / "accuracy.csv")).first()) == (
        "e", "m", 5, "simple", "0_shot", 360, "accuracy", 51.25)


def test_log_round_trip(spark, tmp_path):
    path = tmp_path / "execution-log.jsonl"
    path.write_text(json.dumps({
        "environment": "e", "model": "m", "instruction_size": 5, "dataset_length": 360, "severity": "info", "is_sql": 1,
        "request": [{"role": "user", "content": "hi"}], "response": "r", "sql_response": "s", "message": "ok"}) + "\n")
    row = readers.read_log(spark, str(path)).first()
    assert (row.is_sql, row.request[0].content, row.response_time_start) == (1, "hi", None)


def test_gold_line_export_stays_on_one_line(spark, tmp_path):
    rows = spark.createDataFrame([("SELECT\n1\tx", "a")], "gold_sql string, db_id string")
    writers.write_gold_lines(rows, str(tmp_path / "gold"))
    assert [tuple(r) for r in readers.read_gold_lines(spark, str(tmp_path / "gold")).collect()] == [("SELECT 1 x", "a")]


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_difficulty_folders(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, "simple", " x "), (2, "moderate", "a,\"b\"\n")], "id int, difficulty string, t string")
    writers.write_by_difficulty(rows, str(tmp_path / "out"), form)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"difficulty=simple", "difficulty=moderate"}
    reader = spark.read.schema("id int, t string, difficulty string")
    if form == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    assert {tuple(r) for r in reader.format(form).load(str(tmp_path / "out")).collect()} == {(1, " x ", "simple"), (2, 'a,"b"\n', "moderate")}


def test_context_of_many_tables(spark):
    catalog = spark.createDataFrame([("a", i, f"[{i}]") for i in range(3_500)] + [("b", 1, "x"), ("b", 0, "y")], "db_id string, table_ord int, ddl string")
    found = context.db_context(catalog.repartition(5))
    assert {r.db_id: r.schema for r in found.collect()} == {"a": "".join(f"[{i}]" for i in range(3_500)), "b": "yx"}
    asked = spark.createDataFrame([(1, "b"), (2, "c")], "question_id bigint, db_id string")
    assert {r.question_id: r.schema for r in context.with_context(asked, found).collect()} == {1: "yx", 2: "No database found"}


def test_context_joins_without_broadcast(spark):
    context_rows = spark.createDataFrame([("hot", "H"), ("b", "B")], "db_id string, schema string")
    asked = spark.range(5_000).selectExpr("id AS question_id", "CASE WHEN id % 3 = 0 THEN 'b' WHEN id % 3 = 1 THEN 'none' ELSE 'hot' END AS db_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found = context.with_context(asked, context_rows).groupBy("schema").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert {r[0]: r[1] for r in found} == {"H": 1666, "B": 1667, "No database found": 1667}


def test_run_spec_and_grid(spark):
    specs = spark.createDataFrame([(1, "a=7,9/b=5")], "id int, spec string")
    assert sorted(map(tuple, prompts.run_spec(specs).collect())) == [(1, "a", 7), (1, "a", 9), (1, "b", 5)]
    runs = prompts.grid([("e", "m:1"), ("e", "it's")], [5, 7], ["0", "2-cot"], [60], {"it's": [0]})
    rows = prompts.with_runs(spark.range(2).toDF("question_id"), runs, partitions=3).collect()
    assert len(rows) == 12 and {r.run_id for r in rows if r.model == "m:1"} == {
        f"e/{shot}/m_1/{size}_Instructions/60_Inferences" for shot in ("0_shot", "2_shot_cot") for size in (5, 7)}
    assert {(r.model, r.instruction) for r in rows} == {("m:1", 5), ("m:1", 7), ("it's", 0)}


class Settings(dict):
    @property
    def conf(self):
        return self


def test_shared_folder_is_required_on_a_cluster():
    assert sessions.shared_folder(Settings({"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    with pytest.raises(ValueError):
        sessions.shared_folder(Settings({"spark.master": "yarn"}))


# --- named files, runs and batches ------------------------------------------------------


def metric_row_table(spark, n=40):
    return spark.range(n).selectExpr(
        "id AS question_id", "'open-ai' AS environment", "'0_shot' AS shot", "concat('m', id % 2) AS model", "5 AS instruction",
        "360 AS dataset_length", "if(id % 4 = 0, 60, 360) AS dataset_size", "'0:00:02' AS response_time",
        "id AS llm_prompt_tokens", "id + 1 AS llm_response_tokens", "if(id % 3 = 0, 'a \"quoted\", text', 'simple') AS hardness")


def test_a_written_results_tree_reads_back(spark, tmp_path):
    rows = metric_row_table(spark)
    for _ in range(2):  # a repeated job replaces its files
        writers.write_results_tree(rows, str(tmp_path))
    names = sorted(str(path.relative_to(tmp_path)) for path in tmp_path.rglob("*") if path.is_file() and not path.name.startswith("."))
    assert names == [f"open-ai/0_shot/m{m}/5_Instructions/360_Inferences/{size}metrics.csv" for m in (0, 1) for size in (["60_size/", ""] if m == 0 else [""])]
    assert (tmp_path / names[1]).read_text().splitlines()[:2] == ["response_time,llm_prompt_tokens,llm_response_tokens,hardness", "0:00:02,2,3,simple"]
    columns = [c for c in rows.columns if c != "question_id"]
    assert sorted(map(tuple, readers.read_metrics(spark, str(tmp_path)).select(*columns).collect())) == sorted(map(tuple, rows.select(*columns).collect()))


def test_a_written_line_bundle_reads_back(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("a/b", 10, "SELECT\n1", "SELECT\t1", "d"), ("a/b", 2, None, "SELECT 2", "d"), ("c", 0, "SELECT 3", "SELECT 4", "e")],
        "folder string, line bigint, predicted_sql string, gold_sql string, db_id string")
    writers.write_line_bundle(pairs, str(tmp_path))
    assert (tmp_path / "a/b/predicted.txt").read_text() == "\nSELECT 1\n" and (tmp_path / "a/b/gold.txt").read_text() == "SELECT 2\td\nSELECT 1\td\n"
    found = readers.read_line_bundle(spark, str(tmp_path)).collect()
    assert sorted((r.folder.split("/")[-1], r.line, r.predicted_sql, r.gold_sql, r.db_id) for r in found) == [
        ("b", 1, "SELECT 1", "SELECT 1", "d"), ("c", 0, "SELECT 3", "SELECT 4", "e")]


def test_a_failed_job_leaves_named_files_as_they_were(spark, tmp_path):
    good = metric_row_table(spark)
    writers.write_results_tree(good, str(tmp_path))
    before = {path: path.read_text() for path in tmp_path.rglob("metrics.csv")}
    broken = good.withColumn("hardness", F.expr("if(question_id = 33, raise_error('lost'), 'other')"))
    with pytest.raises(Exception):
        writers.write_results_tree(broken, str(tmp_path))
    assert {path: path.read_text() for path in tmp_path.rglob("metrics.csv")} == before


@pytest.mark.parametrize("path", ["../x.txt", "a//b", "/etc/x", "", None, "a/./b"])
def test_names_stay_below_the_root(spark, tmp_path, path):
    lines = spark.createDataFrame([(path, 0, "x")], "path string, ord bigint, line string")
    with pytest.raises(Exception, match="below the root"):
        named_files.write_named(lines, str(tmp_path / "root"))


def test_no_lines_write_no_files(spark, tmp_path):
    writers.write_results_tree(metric_row_table(spark, 0), str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_writing_a_run_again_replaces_it(spark, tmp_path):
    path, dims = str(tmp_path / "t"), ["environment", "model"]
    rows = metric_row_table(spark).withColumn("run_id", F.concat(F.lit("r"), (F.col("question_id") % 3).cast("string")))
    writers.append_rows(rows, path, dims, run="run_id")
    writers.append_rows(rows.filter("run_id = 'r1'"), path, dims, run="run_id")
    writers.append_rows(rows.filter("run_id = 'r2'").withColumn("hardness", F.lit("new")), path, dims, run="run_id")
    read = spark.read.parquet(path)
    assert read.count() == 40 and read.filter("hardness = 'new'").count() == rows.filter("run_id = 'r2'").count()
    broken = rows.withColumn("hardness", F.expr("if(question_id = 7, raise_error('lost'), 'broken')"))
    with pytest.raises(Exception):
        writers.append_rows(broken, path, dims, run="run_id")
    again = spark.read.parquet(path)
    assert again.count() == 40 and again.filter("hardness = 'broken'").count() == 0


def test_writing_a_log_batch_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "log")
    records = spark.range(6).selectExpr("'info' AS severity", "1 AS is_sql", "concat('m', id) AS message", "'r' AS response")
    for batch in ("one", "two", "one"):
        writers.append_log(records, path, batch=batch)
    assert readers.read_log(spark, path).count() == 12 and readers.read_log(spark, path).columns == schemas.LOG_RECORD.fieldNames()


# --- large JSON values ----------------------------------------------------------------------


def odd_values(n, seed):
    import random

    r = random.Random(seed)
    pieces = ['"', "\\", "[", "]", "{", "}", ",", ":", "\n", "é", "日本", "x", " ", '\\"', "\\\\"]
    text = lambda: "".join(r.choice(pieces) for _ in range(r.randrange(12)))
    value = lambda depth=0: r.choice([text, text, lambda: r.randrange(99), lambda: None, lambda: True,
                                      lambda: [value(depth + 1) for _ in range(r.randrange(3))] if depth < 2 else 1,
                                      lambda: {text(): value(depth + 1) for _ in range(r.randrange(3))} if depth < 2 else {}])()
    return [value() for _ in range(n)], {f"{i}{text()}": value() for i in range(n)}


@pytest.mark.parametrize("part_bytes", [3, 17, 1_000, 1 << 20])
def test_elements_are_cut_anywhere(spark, tmp_path, part_bytes):
    values, mapping = odd_values(60, part_bytes)
    (tmp_path / "a.json").write_text(json.dumps(values, ensure_ascii=False, indent=1))
    (tmp_path / "b.json").write_text("  " + json.dumps(mapping) + "\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[ \n]")
    found = json_parts.read_elements(spark, str(tmp_path), part_bytes).collect()
    of = lambda name: [r.value for r in sorted(found, key=lambda r: r.start) if r.path.endswith(name)]
    assert [json.loads(v) for v in of("a.json")] == values
    merged = {}
    for v in of("b.json"):
        merged.update(json.loads("{" + v + "}"))
    assert merged == mapping and len(found) == 120


def test_one_large_array_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"question_id": i, "db_id": f"d{i % 7}", "difficulty": "simple", "question": f'how many "{i}"?\n[{i}, {{', "evidence": None, "SQL": f"SELECT {i}, '\\'"} for i in range(100_000)]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    array = readers.read_questions(spark, str(tmp_path / "array.json"), part_bytes=1 << 20)
    assert array.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    lines = readers.read_questions(spark, str(tmp_path / "lines.json"), array=False)
    assert array.exceptAll(lines).count() == 0 and array.count() == lines.count() == 100_000


def test_written_arrays_and_maps_are_valid_json(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS question_id", "'a' AS db_id", "'simple' AS difficulty", "concat('q \"', id, '\"') AS question", "NULL AS evidence", "'SELECT 1' AS SQL")
    writers.write_question_arrays(rows, str(tmp_path / "q"), parts=3)
    whole = [json.loads(path.read_text()) for path in (tmp_path / "q").rglob("questions.json")]
    assert len(whole) == 3 and sorted(q["question_id"] for part in whole for q in part) == list(range(50))
    predictions = spark.range(20).selectExpr("concat('r', id % 2) AS run_id", "id AS pair_index", "concat('SELECT \"', id) AS predicted_sql", "'a' AS db_id")
    writers.write_prediction_map_files(predictions, str(tmp_path / "p"))
    maps = {path.parent.name: json.loads(path.read_text()) for path in (tmp_path / "p").rglob("predict.json")}
    assert {name: list(m) for name, m in maps.items()} == {f"run_id=r{k}": [str(i) for i in range(k, 20, 2)] for k in (0, 1)}
    back = readers.read_prediction_map(spark, str(tmp_path / "p" / "run_id=*"), part_bytes=50)
    assert sorted((r.pair_index, r.predicted_sql) for r in back.collect()) == [(i, f'SELECT "{i}') for i in range(20)]


def test_large_question_sets_are_several_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "ARRAY_BYTES", 20_000, raising=False)
    rows = spark.range(2_000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS question_id", "'a' AS db_id", "'simple' AS difficulty", "repeat(string(id), 10) AS question", "'' AS evidence", "'SELECT 1' AS SQL")
    writers.write_question_arrays(rows, str(tmp_path / "q"))
    whole = [path.stat().st_size for path in (tmp_path / "q").rglob("questions.json")]
    assert len(whole) > 2 and max(whole) < sum(whole) / 2, whole
    back = readers.read_questions(spark, str(tmp_path / "q" / "part=*"), part_bytes=10_000)
    assert back.exceptAll(rows.withColumnRenamed("SQL", "sql_query")).count() == 0 and back.count() == 2_000
