"""The registered queries in SQL, for a side-by-side check on another engine."""

from __future__ import annotations

import re

from evalspark import fixed_values as fixed

METRIC_ROWS = """
metric_rows AS (
  SELECT event_id AS question_id,
         CASE event_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS hardness,
         CASE user_id % 3 WHEN 0 THEN 'self-hosted' WHEN 1 THEN 'open-ai' ELSE 'anthropic' END AS environment,
         CASE WHEN user_id % 3 = 0 THEN 'CodeLlama-34b-Instruct-hf'
              WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 'gpt-4-turbo-preview'
              WHEN user_id % 3 = 1 THEN 'gpt-3.5-turbo-16k'
              ELSE 'claude-3-haiku-20240307' END AS model,
         CAST(CASE CAST(floor(user_id / 3) AS BIGINT) % 5
              WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 9 ELSE 11 END AS INTEGER) AS instruction,
         CAST(round(value * 100) AS BIGINT) AS cents,
         event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 AS llm_prompt_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 + event_id % 50 AS llm_response_tokens
  FROM events),
timed AS (
  SELECT *, CASE WHEN event_type = 'error' THEN '0' ELSE
           CAST(cents // 360000 AS VARCHAR) || ':' || lpad(CAST(cents // 6000 % 60 AS VARCHAR), 2, '0') || ':'
           || lpad(CAST(cents // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '0000'
         END AS response_time,
         CASE WHEN event_type = 'error' THEN 0 ELSE cents / 100.0::DOUBLE END AS seconds,
         CASE WHEN environment = 'self-hosted' THEN llm_response_tokens - llm_prompt_tokens
              ELSE llm_response_tokens END AS out_tokens
  FROM metric_rows)"""

QUESTION_ROWS = """
question_rows AS (
  SELECT doc_id AS question_id, source AS db_id,
         CASE doc_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty,
         text AS question,
         CASE WHEN doc_id % 4 <> 0 THEN 'hint ' || CAST(n_chars AS VARCHAR) END AS evidence,
         'SELECT ' || CAST(doc_id AS VARCHAR) || ' AS v FROM ' || source AS sql_query,
         CASE WHEN doc_id % 11 = 0 THEN '-- phpMyAdmin SQL Dump ' || lang
              ELSE 'CREATE TABLE ' || source || ' (v INT)' END AS schema,
         lang
  FROM documents)"""

REPLY_ROWS = """
reply_rows AS (
  SELECT doc_id AS question_id,
         CASE doc_id % 7
           WHEN 0 THEN 'I do not know'
           WHEN 1 THEN '```sql' || chr(10) || 'SELECT ' || CAST(doc_id AS VARCHAR) || ' AS v FROM ' || source || ';' || chr(10) || '```'
           WHEN 2 THEN 'Sure: select v from ' || source || ' Explanation: it reads v'
           WHEN 3 THEN 'WITH q AS (SELECT 1) SELECT v FROM ' || source || ' ;'
           WHEN 4 THEN 'selection of ' || source
           WHEN 5 THEN 'SELECT v' || chr(9) || 'FROM ' || source || '   This query returns v' END AS reply,
         CASE WHEN doc_id % 7 = 6 THEN 'timeout' END AS error
  FROM documents)"""

CONTEXTS = """
schema_catalog AS (
  SELECT 'src' || CAST(item_id % 18 AS VARCHAR) AS db_id, item_id AS table_ord,
         'CREATE TABLE t' || CAST(item_id AS VARCHAR) || ' (a INT)' AS ddl
  FROM benchmark),
contexts AS (
  SELECT db_id, string_agg(ddl, '' ORDER BY table_ord) AS context FROM schema_catalog GROUP BY db_id)"""

SHOT_ROWS = """
shot_rows AS (
  SELECT 'src' || CAST(u.conv_id % 20 AS VARCHAR) AS db_id, u.conv_id * 100 + u.turn AS ord,
         u.text AS question, a.text AS sql_query,
         CASE WHEN u.conv_id % 2 = 0 THEN a.text END AS cot
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
ranked_shots AS (
  SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY ord, question) AS rn FROM shot_rows)"""


def text(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


def _layout(layout: str, names: dict[str, str]) -> str:
    parts = re.split(r"\{(\w+)\}", layout)
    return " || ".join(
        f"coalesce({names[part]}, '')" if position % 2 else text(part)
        for position, part in enumerate(parts)
        if position % 2 or part
    )


def _system(size: str) -> str:
    blocks = " || ".join(
        f"CASE WHEN {size} >= {least} THEN {text(block)} ELSE '' END" for least, block in fixed.INSTRUCTION_BLOCKS
    )
    return f"{text(fixed.SYSTEM_PROMPT_HEAD)} || {blocks} || {text(fixed.SYSTEM_PROMPT_TAIL)}"


def _shots(label: str) -> str:
    layout = fixed.COT_SAMPLE_LAYOUT if "cot" in label else fixed.SAMPLE_LAYOUT
    line = _layout(layout, {"question": "question", "sql_query": "sql_query", "cot": "cot"})
    return (
        f"SELECT '{label}' AS shot, db_id, {text(fixed.EXAMPLES_HEAD)} || string_agg({line}, '' ORDER BY ord, question)"
        f" AS examples FROM ranked_shots WHERE rn <= {label.split('_')[0]} GROUP BY db_id"
    )


GROUPED = """
grouped AS (
  SELECT {keys}, CASE WHEN grouping(hardness) = 1 THEN 'total' ELSE hardness END AS hardness,
         count(*) AS rows,
         CAST(sum(llm_prompt_tokens) AS BIGINT) AS input_tokens,
         CAST(sum(out_tokens) AS BIGINT) AS output_tokens,
         CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE cents END) AS BIGINT) / 100.0::DOUBLE AS usable_seconds,
         CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE cents END) AS BIGINT) / 100.0::DOUBLE
           / nullif(count(*) FILTER (WHERE seconds <> 0), 0) AS latency,
         avg(CASE WHEN seconds <> 0 THEN out_tokens / seconds END) AS throughput,
         100.0::DOUBLE * count(*) FILTER (WHERE seconds <> 0) / count(*) AS psr
  FROM {rows}
  GROUP BY GROUPING SETS (({keys}, hardness), ({keys})))"""

RUN = "environment, model, instruction"


def _grouped(keys: str = RUN, rows: str = "timed") -> str:
    return GROUPED.format(keys=keys, rows=rows)


def _priced() -> str:
    prices = ", ".join(f"('{env}', '{model}', {inp}::DOUBLE, {out}::DOUBLE)" for env, model, inp, out in fixed.PRICES)
    return f"""
prices(environment, model, input_cost, output_cost) AS (VALUES {prices}),
priced AS (
  SELECT g.*, (g.input_tokens * p.input_cost + g.output_tokens * p.output_cost) / {fixed.PRICE_PER_TOKENS} AS api_cost,
         CASE WHEN g.environment = 'self-hosted' THEN g.usable_seconds / 3600 * 10 END AS hosting_cost
  FROM grouped g LEFT JOIN prices p ON p.environment = g.environment AND p.model = g.model)"""


def _long() -> str:
    columns = [
        ("CASE WHEN environment = 'self-hosted' THEN hosting_cost ELSE api_cost END", fixed.COST),
        ("output_tokens", fixed.OUTPUT_TOKENS), ("input_tokens", fixed.INPUT_TOKENS),
        ("throughput", fixed.THROUGHPUT), ("psr", fixed.PSR), ("latency", fixed.LATENCY),
    ]
    selects = " UNION ALL ".join(
        f"SELECT {RUN}, CAST(360 AS INTEGER) AS dataset_size, hardness, {text(name)} AS metric,"
        f" CAST({value} AS DOUBLE) AS value FROM priced"
        for value, name in columns
    )
    return f"""
long_report AS ({selects})"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


REPORT = _with(METRIC_ROWS, _grouped(), _priced(), _long())

BUCKETS = """
ranked_questions AS (
  SELECT question_id, row_number() OVER (
           PARTITION BY CASE WHEN {level} IN ('simple', 'moderate') THEN {level} ELSE 'challenging' END
           ORDER BY question_id) AS rn
  FROM {source}),
sized AS (
  SELECT r.*, 360 AS dataset_size FROM {rows} r
  UNION ALL
  SELECT r.*, CASE WHEN rn <= 20 THEN 60 WHEN rn <= 60 THEN 120 ELSE 180 END AS dataset_size
  FROM {rows} r JOIN ranked_questions q ON q.question_id = r.question_id AND rn <= 120)"""

CLEAN = r"regexp_replace(reply, '\n|\\n|\r|\t|```|\.\.\.', ' ', 'g')"
PHRASES = "|".join(fixed.STOP_PHRASES)


def _statement(pattern: str) -> str:
    found = f"regexp_extract({CLEAN}, '{pattern}', 0)"
    first = f"CASE WHEN {found} = '' THEN {CLEAN} ELSE {found} END"
    return rf"regexp_replace({first}, '(?is)\s*(?:{PHRASES}).*$', '')"


EXTRACT = _statement(r"(?i)SELECT\b[^;]+")
EXTRACT_WITH = _statement(r"(?i)(?:\bWITH\b[^;]*?\bAS\b[^;]*?)?SELECT\b[^;]+")

OUTCOMES = f"""
outcomes AS (
  SELECT question_id,
         CASE WHEN error IS NOT NULL THEN 'error' WHEN lower(reply) LIKE '%select%' THEN 'info' ELSE 'warn' END AS severity,
         CAST(CASE WHEN error IS NULL AND lower(reply) LIKE '%select%' THEN 1 ELSE 0 END AS INTEGER) AS is_sql,
         CASE WHEN error IS NOT NULL THEN 'An error occurred: ' || error
              WHEN lower(reply) LIKE '%select%' THEN {EXTRACT} ELSE 'I don''t know' END AS predicted_sql,
         CASE WHEN error IS NOT NULL THEN error
              WHEN lower(reply) LIKE '%select%' THEN 'SQL Response successful' ELSE 'No SQL Output detected' END AS message
  FROM reply_rows)"""

PAIR_CELLS = """
cells AS (
  SELECT o_custkey % 50 AS pair_id, o_orderkey AS k, o_orderstatus AS gold_status,
         CASE WHEN o_custkey % 50 % 4 = 1 AND o_orderkey % 97 = 0 THEN 'X'
              WHEN o_custkey % 50 % 4 = 2 AND o_orderkey % 89 = 0 THEN NULL
              ELSE o_orderstatus END AS predicted_status,
         o_custkey % 50 % 4 = 3 AND o_orderkey % 101 = 0 AS dropped
  FROM orders)"""

SCORES = """
scores AS (
  SELECT l.doc_id AS question_id, l.quality AS res, 'model-' || d.lang AS model, q.difficulty
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN question_rows q ON q.question_id = l.doc_id)"""


def _accuracy(key: str, rows: str) -> str:
    return f"""
levels(hardness) AS (VALUES ('simple'), ('moderate'), ('challenging'), ('total')),
accuracy AS (
  SELECT k.{key}, hardness,
         count(s.question_id) AS questions,
         coalesce(100.0::DOUBLE * sum(s.res) / nullif(count(s.question_id), 0), 0) AS accuracy
  FROM (SELECT DISTINCT {key} FROM {rows}) k CROSS JOIN levels
  LEFT JOIN {rows} s ON s.{key} = k.{key} AND (s.difficulty = hardness OR hardness = 'total')
  GROUP BY k.{key}, hardness)"""


def _pivot(values: list[tuple[str, str]], index: str, source: str) -> str:
    columns = ", ".join(f'avg(v) FILTER (WHERE {test}) AS "{name}"' for name, test in values)
    return f"SELECT {index}, {columns} FROM (SELECT *, round_even(value, 3) AS v FROM long_report WHERE {source}) GROUP BY {index}"


VOLUME = "metric IN ('throughput(tok/sec)', 'total_output_tokens', 'total_input_tokens')"
COSTS = "metric IN ('total_cost($)', 'total_output_tokens', 'total_input_tokens') AND hardness = 'total'"


def _transposed_columns() -> list[tuple[str, str]]:
    models = [
        ("CodeLlama-34b-Instruct-hf", "self-hosted"), ("gpt-4-turbo-preview", "open-ai"),
        ("gpt-3.5-turbo-16k", "open-ai"), ("claude-3-haiku-20240307", "anthropic"),
    ]
    return [
        (f"{model}_{metric}_{env}", f"model = '{model}' AND environment = '{env}' AND metric = '{metric}'")
        for model, env in models
        for metric in (fixed.OUTPUT_TOKENS, fixed.INPUT_TOKENS, fixed.THROUGHPUT)
    ]


PROMPTED = """
prompted AS (
  SELECT *,
         replace(replace(replace(replace(template, '[context]', ''), '[question]', ''), '[hint]', ''), '[examples]', '') AS blanked,
         replace(replace(replace(replace(template, '[question]', ''), '[hint]', ''), '[examples]', ''), '[context]', context) AS schema_only,
         replace(replace(replace(replace(template,
           '[context]', 'Here is the schema of the tables which are needed for the SQL generation: ' || chr(10) || context),
           '[question]', 'Question: ' || question), '[hint]', 'Hint: ' || hint), '[examples]', examples) AS whole
  FROM filled)"""


def _prompt_rows() -> str:
    first = {(env, family): model for env, model, family in reversed(fixed.MODEL_FAMILIES)}
    models = ", ".join(f"('{env}', '{model}', '{family}')" for (env, family), model in first.items())
    return _with(
        QUESTION_ROWS, CONTEXTS, SHOT_ROWS,
        f" examples AS ({_shots('2_shot')})",
        f" models(environment, model, family) AS (VALUES {models})",
        f""" filled AS (
  SELECT m.environment, m.model, m.family, q.question_id, q.question, coalesce(q.evidence, '') AS hint,
         coalesce(c.context, 'No database found') AS context, coalesce(e.examples, '') AS examples,
         {_system("(CASE q.question_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 9 ELSE 11 END)")} AS template
  FROM question_rows q CROSS JOIN models m
  LEFT JOIN contexts c ON c.db_id = q.db_id LEFT JOIN examples e ON e.db_id = q.db_id)""",
        PROMPTED,
    )


def _prompt_text() -> str:
    slots = {name: name for name in ("question", "hint", "context", "examples")}
    cases = [
        f"WHEN '{family}' THEN {_layout(layout, {**slots, 'system': 'blanked'})}" for family, layout in fixed.BLANKED_LAYOUTS.items()
    ] + [
        f"WHEN '{family}' THEN {_layout(layout, {**slots, 'system': 'schema_only'})}" for family, layout in fixed.CONTEXT_LAYOUTS.items()
    ] + [
        f"WHEN '{family}' THEN {_layout(layout, {**slots, 'system': 'whole'})}"
        for family, layout in fixed.FILLED_LAYOUTS.items() if family != "plain"
    ]
    return f"CASE family {' '.join(cases)} ELSE whole END"


def _chat() -> str:
    slots = {name: name for name in ("question", "hint", "context", "examples")}
    return (
        "CASE WHEN family = 'user_chat' THEN 'user: ' || whole ELSE 'system: ' || blanked || chr(10) || '--' || chr(10)"
        f" || 'user: ' || {_layout(fixed.CHAT_USER_LAYOUT, slots)} END"
    )


ANSWERED = "SELECT question_id, db_id AS run_id, 'Question: ' || question || ' Hint: ' || coalesce(evidence, '') AS prompt FROM question_rows"
REPLIES = f"""{_with(QUESTION_ROWS)}
SELECT run_id, question_id,
       CASE WHEN length(prompt) % 7 <> 0 THEN 'SELECT ' || CAST(length(prompt) AS VARCHAR) || ';' END AS text,
       CASE WHEN length(prompt) % 7 <> 0 THEN CAST(length(prompt) AS BIGINT) END AS prompt_tokens,
       CASE WHEN length(prompt) % 7 <> 0 THEN CAST(length(prompt) % 300 AS BIGINT) END AS response_tokens,
       CASE WHEN length(prompt) % 7 = 0 THEN 'no answer' END AS error
FROM ({ANSWERED})"""


def oracle_sql() -> dict[str, str]:
    """SQL of every registered query that can be said in SQL."""
    six = ", ".join(f"round_even({name}, 6) AS {name}" for name in ("usable_seconds", "latency", "throughput", "psr"))
    sizes = ", ".join(f"({size})" for size in fixed.INSTRUCTION_SIZES)
    names = ", ".join(f"('{model}', '{short}')" for model, short in fixed.SHORT_NAMES)
    levels = [*fixed.LEVELS, fixed.TOTAL]
    matched = """
SELECT pair_id, CAST(CASE WHEN gold_keys = predicted_keys AND gold_values IS NOT DISTINCT FROM predicted_values
                     THEN 1 ELSE 0 END AS INTEGER) AS res
FROM (SELECT pair_id, list(k ORDER BY k) AS gold_keys, list(k ORDER BY k) AS predicted_keys,
             list(coalesce('v' || gold_status, 'n') ORDER BY coalesce('v' || gold_status, 'n')) AS gold_values,
             list(coalesce('v' || predicted_status, 'n') ORDER BY coalesce('v' || predicted_status, 'n'))
               FILTER (WHERE NOT dropped) AS predicted_values
      FROM cells GROUP BY pair_id)"""
    report = _pivot(
        [(f"{size}_{level}", f"instruction = {size} AND hardness = '{level}'") for size in fixed.INSTRUCTION_SIZES for level in levels],
        "model, metric, environment", VOLUME)
    wide = f"SELECT {RUN}, hardness, rows, input_tokens, output_tokens, {six} FROM grouped"
    split = f"""{_with(QUESTION_ROWS)}
SELECT question_id AS index_in_original, difficulty, db_id, sql_query, question, schema, evidence
FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY md5('7:' || CAST(question_id AS VARCHAR)), question_id) AS rn
      FROM question_rows WHERE schema NOT LIKE '%-- phpMyAdmin SQL Dump%') WHERE rn <= 120"""
    shapes = """CASE question_id % 6 WHEN 0 THEN 'choices' WHEN 1 THEN 'content' WHEN 2 THEN 'completion'
         WHEN 3 THEN 'outputs' WHEN 4 THEN 'generation' ELSE 'generated_text' END"""
    return {
        "duration_seconds": f"{_with(METRIC_ROWS)} SELECT question_id, response_time, CAST(seconds AS DOUBLE) AS seconds FROM timed",
        "elapsed_label": f"""{_with(METRIC_ROWS)}
SELECT question_id, CAST(s // 3600 AS VARCHAR) || 'hrs ' || CAST(s // 60 % 60 AS VARCHAR) || 'min ' || CAST(s % 60 AS VARCHAR) || 'sec' AS elapsed
FROM (SELECT question_id, CASE WHEN event_type = 'error' THEN 0 ELSE cents * 61 // 100 END AS s FROM timed)""",
        "response_seconds": """
SELECT event_id, round(value * 1000000) / 1000000 AS seconds,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS response_time_start,
       strftime(ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS response_time_stop
FROM events""",
        "metrics_by_hardness": f"{_with(METRIC_ROWS, _grouped())} {wide}",
        "metric_store": f"{_with(METRIC_ROWS, _grouped())} {wide}",
        "cost_api": f"{_with(METRIC_ROWS, _grouped(), _priced())} SELECT {RUN}, hardness, round_even(api_cost, 6) AS api_cost FROM priced",
        "cost_self_hosted": f"{_with(METRIC_ROWS, _grouped(), _priced())} SELECT {RUN}, hardness, round_even(hosting_cost, 6) AS hosting_cost FROM priced",
        "metrics_long": f"{REPORT} SELECT {RUN}, dataset_size, hardness, metric, round_even(value, 6) AS value FROM long_report",
        "model_names": f"""{REPORT}, names(model, short_name) AS (VALUES {names})
SELECT environment, coalesce(n.short_name, r.model) AS model, instruction, dataset_size, hardness, metric, round_even(value, 6) AS value
FROM long_report r LEFT JOIN names n ON n.model = r.model""",
        "cost_total": f"""{REPORT}
SELECT environment, model, '0-11' AS instruction, CAST(360 AS INTEGER) AS dataset_size, metric, 'total' AS hardness,
       round_even(sum(round_even(value, 3)), 6) AS value
FROM long_report WHERE {COSTS} GROUP BY environment, model, metric""",
        "pivot_metrics": f"{REPORT} {report}",
        "report_file": f"{REPORT} {report}",
        "pivot_metrics_t": REPORT + " " + _pivot(_transposed_columns(), "instruction, hardness", VOLUME),
        "pivot_cost": REPORT + " " + _pivot(
            [(f"{size}_total", f"instruction = {size}") for size in fixed.INSTRUCTION_SIZES], "model, metric, environment", COSTS),
        "distinct_dims": f"""{_with(METRIC_ROWS)}
SELECT DISTINCT 'environment' AS dim, environment AS value FROM timed
UNION SELECT 'model', environment || '/' || model FROM timed
UNION SELECT 'instruction', CAST(instruction AS VARCHAR) FROM timed
UNION SELECT 'hardness', hardness FROM timed""",
        "bucket_rows": f"""{_with(METRIC_ROWS, BUCKETS.format(level='hardness', source='timed', rows='timed'))}
SELECT question_id, hardness, response_time, CAST(dataset_size AS INTEGER) AS dataset_size FROM sized""",
        "bucket_metrics": f"""{_with(METRIC_ROWS, BUCKETS.format(level='hardness', source='timed', rows='timed'), _grouped(RUN + ', dataset_size', 'sized'))}
SELECT {RUN}, CAST(dataset_size AS INTEGER) AS dataset_size, hardness, rows, input_tokens, output_tokens, {six} FROM grouped""",
        "path_dimensions": f"""{_with(METRIC_ROWS)}
SELECT question_id, environment,
       CAST(question_id % 5 AS VARCHAR) || CASE WHEN question_id % 2 = 0 THEN '_shot' ELSE '_shot_cot' END AS shot,
       model, instruction, CAST(360 AS INTEGER) AS dataset_length,
       CAST(CASE WHEN question_id % 4 = 0 THEN 60 ELSE 360 END AS INTEGER) AS dataset_size
FROM timed""",
        "sql_extract": f"{_with(REPLY_ROWS)} SELECT question_id, {EXTRACT} AS sql_text, {EXTRACT_WITH} AS sql_with FROM reply_rows",
        "reply_status": f"{_with(REPLY_ROWS, OUTCOMES)} SELECT * FROM outcomes",
        "reply_json_text": f"""{_with(REPLY_ROWS)}
SELECT question_id, {shapes} AS shape, reply AS text,
       CASE WHEN question_id % 6 = 5 THEN 0 ELSE question_id + 10 END AS prompt_tokens,
       CASE WHEN question_id % 6 = 5 THEN 0 ELSE question_id + 20 END AS response_tokens
FROM reply_rows""",
        "log_status_counts": f"{_with(REPLY_ROWS, OUTCOMES)} SELECT severity, is_sql, count(*) AS records FROM outcomes GROUP BY severity, is_sql",
        "gold_line_render": f"{_with(QUESTION_ROWS)} SELECT question_id, sql_query || chr(9) || db_id AS line FROM question_rows",
        "gold_line_parse": f"{_with(QUESTION_ROWS)} SELECT question_id, sql_query AS gold_sql, db_id FROM question_rows",
        "prediction_parse": f"""{_with(QUESTION_ROWS)}
SELECT CAST(question_id % 3 AS VARCHAR) AS run_id, question_id,
       CASE WHEN question_id % 7 = 6 THEN ' ' ELSE sql_query END AS predicted_sql,
       CASE WHEN question_id % 7 = 6 THEN 'financial' ELSE db_id END AS db_id,
       row_number() OVER (PARTITION BY question_id % 3 ORDER BY question_id) - 1 AS pair_index
FROM question_rows WHERE question_id % 7 <> 0""",
        "pair_join": f"""{_with(QUESTION_ROWS, REPLY_ROWS, OUTCOMES)}
SELECT o.question_id, o.predicted_sql, q.db_id, q.sql_query AS gold_sql
FROM outcomes o JOIN question_rows q ON q.question_id = o.question_id""",
        "difficulty_split": f"{_with(QUESTION_ROWS)} SELECT question_id, difficulty, db_id, sql_query FROM question_rows",
        "head_per_difficulty": f"""{_with(QUESTION_ROWS)}
SELECT question_id, db_id, difficulty, question, evidence, sql_query, schema
FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY question_id) AS rn FROM question_rows) WHERE rn <= 120""",
        "equal_split": split,
        "question_set_file": split,
        "exclude_schema": f"{_with(QUESTION_ROWS)} SELECT question_id, schema FROM question_rows WHERE schema NOT LIKE '%-- phpMyAdmin SQL Dump%'",
        "db_context": f"""{_with(QUESTION_ROWS, CONTEXTS)}
SELECT question_id, q.db_id, coalesce(context, 'No database found') AS schema
FROM question_rows q LEFT JOIN contexts c ON c.db_id = q.db_id""",
        "run_spec": """
SELECT event_id, 'm' || CAST(user_id AS VARCHAR) AS model_key, CAST(event_id % 12 AS INTEGER) AS instruction FROM events
UNION ALL SELECT event_id, 'm' || CAST(user_id AS VARCHAR), CAST(event_id % 5 AS INTEGER) FROM events
UNION ALL SELECT event_id, event_type, CAST(event_id % 7 AS INTEGER) FROM events""",
        "run_grid": f"""{_with(QUESTION_ROWS, ''' runs(environment, model, safe, instruction) AS (VALUES
  ('open-ai', 'gpt-4-turbo-preview', 'gpt-4-turbo-preview', 5),
  ('amazon-bedrock', 'mistral.mixtral-8x7b-instruct-v0:1', 'mistral.mixtral-8x7b-instruct-v0_1', 0),
  ('amazon-bedrock', 'mistral.mixtral-8x7b-instruct-v0:1', 'mistral.mixtral-8x7b-instruct-v0_1', 11))''',
        " shots(shot) AS (VALUES ('0_shot'), ('4_shot_cot'))")}
SELECT question_id, db_id, environment, model, CAST(instruction AS INTEGER) AS instruction, CAST(360 AS INTEGER) AS dataset_length, shot,
       environment || '/' || shot || '/' || safe || '/' || CAST(instruction AS VARCHAR) || '_Instructions/360_Inferences' AS run_id
FROM question_rows CROSS JOIN runs CROSS JOIN shots""",
        "resume_pending": f"""{_with(QUESTION_ROWS, REPLY_ROWS)}
SELECT 'open-ai/0_shot/' || model || '/5_Instructions/360_Inferences' AS run_id, q.question_id
FROM question_rows q CROSS JOIN (VALUES ('gpt-4-turbo-preview'), ('gpt-3.5-turbo-16k')) m(model)
WHERE NOT EXISTS (SELECT 1 FROM reply_rows r JOIN labels l ON l.doc_id = r.question_id
                  WHERE r.question_id = q.question_id AND r.error IS NULL
                    AND (m.model = 'gpt-4-turbo-preview' OR l.quality = 1))""",
        "instruction_prompt": f"""{_with(QUESTION_ROWS, f' sizes(instruction) AS (VALUES {sizes})')}
SELECT question_id, CAST(instruction AS INTEGER) AS instruction, {_system('instruction')} AS system_prompt
FROM question_rows CROSS JOIN sizes""",
        "few_shot_prompt": f"""{_with(QUESTION_ROWS, SHOT_ROWS, f" examples AS ({_shots('2_shot')} UNION ALL {_shots('4_shot_cot')})",
        ''' asked AS (SELECT question_id, db_id,
  CASE question_id % 3 WHEN 0 THEN '0_shot' WHEN 1 THEN '2_shot' ELSE '4_shot_cot' END AS shot FROM question_rows)''')}
SELECT a.shot, a.db_id, question_id, coalesce(examples, '') AS examples
FROM asked a LEFT JOIN examples e ON e.shot = a.shot AND e.db_id = a.db_id""",
        "prompt_fill": f"{_prompt_rows()} SELECT environment, model, family, question_id, {_prompt_text()} AS prompt FROM prompted",
        "chat_messages": f"""{_prompt_rows()}
SELECT environment, model, question_id, {_chat()} AS chat FROM prompted WHERE family IN ('chat', 'user_chat')""",
        "request_bodies": f"""{_prompt_rows()}
SELECT model, question_id, CAST(length({_prompt_text()}) AS INTEGER) AS prompt_length,
       CAST(CASE family WHEN 'plain' THEN NULL WHEN 'endpoint_turns' THEN 200 ELSE 300 END AS INTEGER) AS token_limit
FROM prompted WHERE environment IN ('amazon-bedrock', 'hugging-face')""",
        "result_match": f"{_with(PAIR_CELLS)} {matched}",
        "result_match_exact": f"{_with(PAIR_CELLS)} {matched}",
        **dict.fromkeys(("result_match_rows", "result_match_row_cells"), f"""{_with(PAIR_CELLS)}
SELECT pair_id, CAST(CASE WHEN count(*) FILTER (WHERE dropped OR gold_status IS DISTINCT FROM predicted_status) = 0
                     THEN 1 ELSE 0 END AS INTEGER) AS res
FROM cells GROUP BY pair_id"""),
        "accuracy_by_difficulty": f"""{_with(QUESTION_ROWS, SCORES, _accuracy('model', 'scores'))}
SELECT model, hardness, questions, round_even(accuracy, 6) AS accuracy FROM accuracy""",
        "accuracy_buckets": f"""{_with(QUESTION_ROWS, SCORES, BUCKETS.format(level='difficulty', source='question_rows', rows='scores'), _accuracy('dataset_size', 'sized'))}
SELECT CAST(dataset_size AS INTEGER) AS dataset_size, hardness, questions, round_even(accuracy, 6) AS accuracy FROM accuracy""",
        "consolidated_report": f"""{REPORT},{QUESTION_ROWS},{SCORES},{_accuracy('model', 'scores')}
SELECT environment, model, instruction, hardness, metric, round_even(value, 6) AS value FROM long_report
UNION ALL SELECT NULL, model, NULL, hardness, 'accuracy', round_even(accuracy, 6) FROM accuracy""",
        "question_file": f"{_with(QUESTION_ROWS)} SELECT question_id, db_id, difficulty, question, evidence, sql_query FROM question_rows",
        "difficulty_folders": f"{_with(QUESTION_ROWS)} SELECT question_id, difficulty, db_id, sql_query FROM question_rows",
        "gold_file": f"{_with(QUESTION_ROWS)} SELECT sql_query AS gold_sql, db_id FROM question_rows",
        "prediction_file": f"""{_with(QUESTION_ROWS)}
SELECT CAST(question_id % 3 AS VARCHAR) AS run_id,
       CASE WHEN question_id % 7 = 6 THEN ' ' ELSE sql_query END AS predicted_sql,
       CASE WHEN question_id % 7 = 6 THEN 'financial' ELSE db_id END AS db_id,
       row_number() OVER (PARTITION BY question_id % 3 ORDER BY question_id) - 1 AS pair_index
FROM question_rows WHERE question_id % 7 <> 0""",
        "log_file": f"{_with(REPLY_ROWS, OUTCOMES)} SELECT severity, is_sql, message, reply AS response FROM outcomes JOIN reply_rows USING (question_id)",
        "bucket_folders": f"""{_with(METRIC_ROWS, BUCKETS.format(level='hardness', source='timed', rows='timed'))}
SELECT question_id, hardness, CAST(dataset_size AS INTEGER) AS dataset_size FROM sized""",
        "infer_replies": REPLIES,
        "stream_replies": REPLIES,
        "score_pairs": """
SELECT CAST(n_nationkey AS BIGINT) AS pair_id, CAST(status = 'match' AS INTEGER) AS res, status
FROM (SELECT n_nationkey,
             CASE n_nationkey % 5
               WHEN 0 THEN 'match'
               WHEN 1 THEN CASE WHEN count(*) FILTER (WHERE NOT c_acctbal > 0) = 0 THEN 'match' ELSE 'mismatch' END
               WHEN 2 THEN 'error'
               WHEN 3 THEN 'error'
               ELSE CASE WHEN count(*) FILTER (WHERE NOT c_mktsegment <> 'BUILDING') = 0 THEN 'match' ELSE 'mismatch' END END AS status
      FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)""",
        "score_many_pairs": """
SELECT CAST(s_suppkey AS BIGINT) AS pair_id, CAST(status = 'match' AS INTEGER) AS res, status
FROM (SELECT s_suppkey,
             CASE s_suppkey % 4
               WHEN 1 THEN CASE WHEN count(*) FILTER (WHERE NOT o_totalprice > 50000) = 0 THEN 'match' ELSE 'mismatch' END
               WHEN 2 THEN 'error'
               ELSE 'match' END AS status
      FROM supplier LEFT JOIN orders ON o_custkey % 977 = s_suppkey % 977 GROUP BY s_suppkey)""",
    }
