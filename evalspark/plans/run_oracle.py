"""SQL of the queries in ``run_queries``."""

from __future__ import annotations

from evalspark import fixed_values as fixed
from evalspark.plans import oracle
from evalspark.plans.oracle import (
    BUCKETS, CONTEXTS, EXTRACT, METRIC_ROWS, OUTCOMES, PROMPTED, QUESTION_ROWS, REPLY_ROWS, SHOT_ROWS, text,
)

RUN = "environment, model, instruction, shot, dataset_length"


def _asked() -> str:
    """Every benchmark question in every run, with the text of its prompt."""
    models = ", ".join(f"({text(env)}, {text(model)}, {text(family)})" for env, model, family in fixed.MODEL_FAMILIES)
    sizes = ", ".join(f"({size})" for size in fixed.INSTRUCTION_SIZES)
    return oracle._with(
        CONTEXTS, SHOT_ROWS,
        f" examples AS ({oracle._shots('2_shot')} UNION ALL {oracle._shots('4_shot_cot')})",
        f" models(environment, model, family) AS (VALUES {models})",
        f" sizes(instruction) AS (VALUES {sizes})",
        " shots(shot) AS (VALUES ('2_shot'), ('4_shot_cot'))",
        """ asked AS (
  SELECT item_id AS question_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS db_id, text AS question,
         CASE item_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS hardness,
         CASE WHEN item_id % 4 <> 0 THEN 'hint ' || CAST(item_id AS VARCHAR) ELSE '' END AS hint
  FROM benchmark)""",
        f""" filled AS (
  SELECT m.*, s.instruction, h.shot, a.*, coalesce(c.context, 'No database found') AS context,
         coalesce(e.examples, '') AS examples, {oracle._system('s.instruction')} AS template
  FROM asked a CROSS JOIN models m CROSS JOIN sizes s CROSS JOIN shots h
  LEFT JOIN contexts c ON c.db_id = a.db_id LEFT JOIN examples e ON e.db_id = a.db_id AND e.shot = h.shot)""",
        PROMPTED,
        f""" measured AS (
  SELECT environment, replace(regexp_replace(model, '^.*/', ''), ':', '_') AS model,
         CAST(instruction AS INTEGER) AS instruction, shot, CAST(360 AS INTEGER) AS dataset_length, hardness,
         length({oracle._prompt_text()}) AS n
  FROM prompted)""",
        """ answers AS (
  SELECT *, CASE WHEN n % 7 = 0 THEN 'error' ELSE 'answer' END AS event_type, n % 97 * 25 AS cents,
         CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS llm_prompt_tokens,
         CASE WHEN n % 7 = 0 THEN 0 ELSE n % 300 - CASE WHEN environment = 'self-hosted' THEN n ELSE 0 END END AS out_tokens,
         CASE WHEN n % 7 = 0 THEN 0 ELSE n % 97 * 0.25::DOUBLE END AS seconds
  FROM measured)""",
    )


def oracle_sql() -> dict[str, str]:
    with_, levels = oracle._with, [*fixed.LEVELS, fixed.TOTAL]
    names = ", ".join(f"('{model}', '{short}')" for model, short in fixed.SHORT_NAMES)
    six = ", ".join(f"round_even({name}, 6) AS {name}" for name in ("usable_seconds", "latency", "throughput", "psr"))
    pivots = {
        count: oracle._pivot(
            [(f"{size}_{level}", f"instruction = {size} AND hardness = '{level}'") for size in sizes for level in levels],
            "model, metric, environment", oracle.VOLUME)
        for count, sizes in (("all", range(12)), ("listed", fixed.INSTRUCTION_SIZES))
    }
    totals = ", ".join(
        f"round_even(sum(round_even(value, 3)) FILTER (WHERE metric = {text(metric)}), 6) AS \"0-11_{metric}\""
        for metric in (fixed.COST, fixed.OUTPUT_TOKENS, fixed.INPUT_TOKENS)
    )
    ranked_heads = f"""{with_(QUESTION_ROWS)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY question_id) AS rn FROM question_rows)"""
    statement = "'SELECT ' || CAST(doc_id AS VARCHAR) || ' AS v FROM ' || source"
    accuracy_keys = "environment, model, instruction, shot, dataset_size"
    grid = "environment, model, CAST(instruction AS INTEGER) AS instruction, shot, question_id"
    return {
        "prompt_grid": f"{_asked()} SELECT {grid}, family, md5({oracle._prompt_text()}) AS prompt_md5 FROM prompted",
        "chat_grid": f"{_asked()} SELECT {grid}, md5({oracle._chat()}) AS chat_md5 FROM prompted WHERE family IN ('chat', 'user_chat')",
        "request_fields": f"""{_asked()}
SELECT {grid}, md5({oracle._prompt_text()}) AS prompt_md5,
       CAST(CASE family WHEN 'plain' THEN NULL WHEN 'endpoint_turns' THEN 200 ELSE 300 END AS INTEGER) AS token_limit,
       CASE family WHEN 'endpoint_turns' THEN {text('|'.join(fixed.ENDPOINT_STOPS))} END AS stops,
       CASE family WHEN 'user_chat' THEN {text(fixed.BEDROCK_BODY_VERSION)} END AS version,
       CASE family WHEN 'user_chat' THEN 'user' END AS role, CASE family WHEN 'user_chat' THEN 'text' END AS content_type
FROM prompted WHERE environment IN ('amazon-bedrock', 'hugging-face')""",
        "pipeline_report": f"""{_asked()}, {oracle._grouped(RUN, 'answers')}, {oracle._priced()},
names(model, short_name) AS (VALUES {names})
SELECT p.environment, coalesce(n.short_name, p.model) AS model, instruction, shot, dataset_length, hardness, rows,
       input_tokens, output_tokens, {six},
       round_even(CASE WHEN environment = 'self-hosted' THEN hosting_cost ELSE api_cost END, 6) AS cost
FROM priced p LEFT JOIN names n ON n.model = p.model""",
        "run_grid_lengths": f"""{ranked_heads}
SELECT question_id, 'open-ai' AS environment, 'gpt-4-turbo-preview' AS model, CAST(i AS INTEGER) AS instruction,
       CAST(l AS INTEGER) AS dataset_length, '0_shot' AS shot,
       'open-ai/0_shot/gpt-4-turbo-preview/' || CAST(i AS VARCHAR) || '_Instructions/' || CAST(l AS VARCHAR) || '_Inferences' AS run_id
FROM ranked CROSS JOIN (VALUES (0), (11)) sizes(i) CROSS JOIN (VALUES (60), (360)) lengths(l) WHERE rn <= l / 3""",
        "head_large": f"{ranked_heads} SELECT question_id, difficulty, question FROM ranked WHERE rn <= 1500",
        "pivot_all_sizes": f"""{with_(
            METRIC_ROWS, " sized AS (SELECT * REPLACE (CAST(question_id % 12 AS INTEGER) AS instruction) FROM timed)",
            oracle._grouped(rows='sized'), oracle._priced(), oracle._long())} {pivots['all']}""",
        "reply_texts": f"""WITH reply_rows AS (
  SELECT doc_id AS question_id, CASE doc_id % 4
    WHEN 0 THEN coalesce(text, '')
    WHEN 1 THEN coalesce(text, '') || chr(10) || '```sql' || chr(10) || {statement} || ';' || chr(10) || '```' || chr(10) || coalesce(text, '')
    WHEN 2 THEN 'WITH q AS (SELECT 1) SELECT v' || chr(9) || 'FROM ' || source || '  Explanation: ' || coalesce(text, '')
    ELSE {statement} || ' WHERE t = ''it''''s "so"''' || chr(13) || chr(10) || 'AND u IS NULL; ' || coalesce(text, '') END AS reply
  FROM documents)
SELECT question_id, {EXTRACT} AS sql_text, lower(reply) LIKE '%select%' AS answered FROM reply_rows""",
        "database_name": f"{with_(QUESTION_ROWS)} SELECT question_id, 'eval_' || db_id AS database FROM question_rows",
        "question_array": f"{with_(QUESTION_ROWS)} SELECT question_id, db_id, difficulty, question, evidence, sql_query FROM question_rows",
        "shot_file": f"""{with_(SHOT_ROWS)}
SELECT shot, db_id, CAST(rn - 1 AS INTEGER) AS ord, question, sql_query, cot
FROM ranked_shots JOIN (VALUES ('2_shot', 2), ('4_shot_cot', 4)) labels(shot, n) ON rn <= n""",
        "log_record_file": f"""{with_(QUESTION_ROWS, REPLY_ROWS, OUTCOMES)}
SELECT 'open-ai' AS environment, 'gpt-4-turbo-preview' AS model, CAST(5 AS INTEGER) AS instruction_size,
       CAST(360 AS INTEGER) AS dataset_length, severity, is_sql, 'user: ' || question AS request, reply AS response,
       CASE WHEN severity = 'info' THEN strftime(make_timestamp(question_id * 60000000), '%Y-%m-%d %H:%M:%S') END AS response_time_start,
       CASE WHEN severity = 'info' THEN strftime(make_timestamp(question_id * 60000000 + 5000000), '%Y-%m-%d %H:%M:%S') END AS response_time_stop,
       CASE WHEN severity = 'info' THEN predicted_sql END AS sql_response, message
FROM outcomes JOIN reply_rows USING (question_id) JOIN question_rows USING (question_id)""",
        "accuracy_file": f"""{with_(QUESTION_ROWS, f''' run_scores AS (
  SELECT l.doc_id AS question_id, q.difficulty, r.environment, r.model, r.instruction, r.shot,
         CASE r.instruction WHEN 5 THEN l.quality ELSE l.toxic END AS res
  FROM labels l JOIN question_rows q ON q.question_id = l.doc_id
  CROSS JOIN (VALUES ('open-ai', 'gpt-4-turbo-preview', 5, '0_shot'), ('anthropic', 'claude-3-haiku-20240307', 11, '4_shot_cot'))
    r(environment, model, instruction, shot))''', BUCKETS.format(level='difficulty', source='question_rows', rows='run_scores'),
        " levels(hardness) AS (VALUES ('simple'), ('moderate'), ('challenging'), ('total'))")}
SELECT k.environment, k.model, CAST(k.instruction AS INTEGER) AS instruction, hardness, k.shot,
       CAST(k.dataset_size AS INTEGER) AS dataset_size, 'accuracy' AS metric,
       round_even(coalesce(100.0::DOUBLE * sum(s.res) / nullif(count(s.question_id), 0), 0), 6) AS value
FROM (SELECT DISTINCT {accuracy_keys} FROM sized) k CROSS JOIN levels
LEFT JOIN sized s ON s.environment = k.environment AND s.dataset_size = k.dataset_size AND (s.difficulty = hardness OR hardness = 'total')
GROUP BY k.environment, k.model, k.instruction, hardness, k.shot, k.dataset_size""",
        "prediction_map_file": oracle.oracle_sql()["prediction_file"],
        "run_store": f"""{with_(METRIC_ROWS)}
SELECT 'r' || CAST(question_id % 2 AS VARCHAR) AS run_id, question_id, environment, model, instruction, response_time, hardness FROM timed""",
        "log_batches": f"""{with_(REPLY_ROWS, OUTCOMES)}
SELECT severity, is_sql, count(*) AS records FROM outcomes GROUP BY severity, is_sql""",
        "results_tree": f"""{with_(METRIC_ROWS)}
SELECT response_time, llm_prompt_tokens, llm_response_tokens, hardness, environment, CASE question_id % 2 WHEN 0 THEN '0_shot' ELSE '4_shot_cot' END AS shot,
       model, instruction, CAST(360 AS INTEGER) AS dataset_length, CAST(CASE question_id % 4 WHEN 1 THEN 60 ELSE 360 END AS INTEGER) AS dataset_size
FROM timed""",
        "line_bundle": f"""{with_(QUESTION_ROWS)}
SELECT * FROM (
  SELECT CAST(question_id % 3 AS VARCHAR) AS folder, CAST(row_number() OVER (PARTITION BY question_id % 3 ORDER BY question_id) - 1 AS INTEGER) AS line,
         CASE WHEN question_id % 7 <> 0 THEN sql_query || '  LIMIT ' || CAST(question_id % 5 AS VARCHAR) END AS predicted_sql, sql_query AS gold_sql, db_id
  FROM question_rows)
WHERE predicted_sql IS NOT NULL""",
        "pivot_file": f"{oracle.REPORT} {pivots['listed']}",
        "pivot_cost_total": f"""{oracle.REPORT}
SELECT model, environment, {totals} FROM long_report WHERE {oracle.COSTS} GROUP BY model, environment""",
    }
