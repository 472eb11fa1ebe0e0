"""Texts, names, prices and formats that results depend on.

Everything here must stay exactly as it is for prompts, reports and file
formats to come out right. There is no logic in this module.
"""

# --- fixed values: strata, buckets and grid -------------------------------
LEVELS = ["simple", "moderate", "challenging"]
TOTAL = "total"
# Every difficulty outside the first two counts as this one when bucketing.
OTHER_LEVEL = "challenging"
# (size label, first position, end position) inside each difficulty.
BUCKETS = [(60, 0, 20), (120, 20, 60), (180, 60, 120)]
FULL_SIZE = 360
INSTRUCTION_SIZES = [0, 5, 7, 9, 11]
ALL_INSTRUCTIONS = "0-11"
MAX_TOKENS = 300
HOSTED_ENDPOINT_MAX_TOKENS = 200
SQL_TIMEOUT_SECONDS = 30.0
SELF_HOSTED_DOLLARS_PER_HOUR = 10.0

# --- fixed values: environments -------------------------------------------
OPEN_AI = "open-ai"
ANYSCALE = "anyscale"
BEDROCK = "amazon-bedrock"
SELF_HOSTED = "self-hosted"
HOSTED_ENDPOINT = "hugging-face"
ANTHROPIC = "anthropic"
GEMINI = "gemini"

# --- fixed values: question set -------------------------------------------
BAD_SCHEMA_PATTERNS = ["-- phpMyAdmin SQL Dump"]
NO_DATABASE = "No database found"

# --- fixed values: prediction line format ---------------------------------
PREDICTION_DELIMITER = "\t----- bird -----\t"
MISSING_PREDICTION = " "
DEFAULT_DB = "financial"

# --- fixed values: metric names -------------------------------------------
COST = "total_cost($)"
OUTPUT_TOKENS = "total_output_tokens"
INPUT_TOKENS = "total_input_tokens"
THROUGHPUT = "throughput(tok/sec)"
PSR = "PSR"
LATENCY = "latency"
METRICS = [COST, OUTPUT_TOKENS, INPUT_TOKENS, THROUGHPUT, PSR, LATENCY]
ACCURACY = "accuracy"

# --- fixed values: stored texts for rows without SQL -----------------------
UNKNOWN_REPLY = "I don't know"
ERROR_PREFIX = "An error occurred: "
LOG_OK = "SQL Response successful"
LOG_NO_SQL = "No SQL Output detected"

# --- fixed values: reply clean-up ------------------------------------------
# Each of these becomes one space.
REPLY_NOISE = ["\n", "\\n", "\r", "\t", "```", "..."]
STATEMENT_PATTERN = r"SELECT\b[^;]+"
# The statement ends where one of these phrases starts.
STOP_PHRASES = [
    "Explanation",
    "Caution",
    "This query",
    "The code",
    "Please",
    "The above query",
    "This SQL query",
]

# --- fixed values: prices in dollars per million tokens --------------------
# (environment, model, input price, output price)
PRICE_PER_TOKENS = 1_000_000
PRICES = [
    ("anyscale", "Llama-2-70b-chat-hf", 1.0, 1.0),
    ("anyscale", "Mistral-7B-Instruct-v0.1", 0.15, 0.15),
    ("anyscale", "Mixtral-8x7B-Instruct-v0.1", 0.5, 0.5),
    ("anyscale", "CodeLlama-70b-Instruct-hf", 1.0, 1.0),
    ("amazon-bedrock", "meta.llama2-70b-chat-v1", 1.95, 2.56),
    ("amazon-bedrock", "anthropic.claude-3-sonnet-20240229-v1_0", 3.0, 15.0),
    ("amazon-bedrock", "anthropic.claude-3-haiku-20240307-v1_0", 0.25, 1.25),
    ("amazon-bedrock", "mistral.mixtral-8x7b-instruct-v0_1", 0.45, 0.7),
    ("amazon-bedrock", "mistral.mistral-7b-instruct-v0_2", 0.15, 0.2),
    ("open-ai", "gpt-4-turbo-preview", 10.0, 30.0),
    ("open-ai", "gpt-3.5-turbo-16k", 0.5, 1.5),
    ("open-ai", "gpt-4o-2024-05-13", 5.0, 15.0),
    ("gemini", "gemini-1.0-pro-latest", 0.0, 0.0),
    ("anthropic", "claude-3-haiku-20240307", 0.25, 1.25),
    ("anthropic", "claude-3-sonnet-20240229", 3.0, 15.0),
    ("anthropic", "claude-3-opus-20240229", 15.0, 75.0),
]

# --- fixed values: short model names for reports ---------------------------
SHORT_NAMES = [
    ("anthropic.claude-3-haiku-20240307-v1_0", "claude-3-haiku"),
    ("anthropic.claude-3-sonnet-20240229-v1_0", "claude-3-sonnet"),
    ("meta.llama2-70b-chat-v1", "llama2-70b"),
    ("mistral.mistral-7b-instruct-v0_2", "mistral-7b"),
    ("mistral.mixtral-8x7b-instruct-v0_1", "mixtral-8x7b"),
    ("claude-3-haiku-20240307", "claude-3-haiku"),
    ("claude-3-opus-20240229", "claude-3-opus"),
    ("claude-3-sonnet-20240229", "claude-3-sonnet"),
    ("CodeLlama-70b-Instruct-hf", "CodeLlama-70b"),
    ("Llama-2-70b-chat-hf", "llama2-70b"),
    ("gemini-1.0-pro-latest", "gemini"),
    ("gpt-3.5-turbo-16k", "gpt-3.5"),
    ("gpt-4-turbo-preview", "gpt-4"),
    ("gpt-4o-2024-05-13", "gpt-4-o"),
    ("Mixtral-8x7B-Instruct-v0.1", "mixtral-8x7b"),
    ("Mistral-7B-Instruct-v0.2", "mistral-7b-v2"),
    ("Mistral-7B-Instruct-v0.1", "mistral-7b-v1"),
    ("CodeLlama-34b-Instruct-hf", "CodeLlama-34b"),
    ("dbrx-instruct", "dbrx"),
    ("sqlcoder-7b-2", "sqlcoder-7b-2"),
    ("sqlcoder-70b-alpha", "sqlcoder-70b-alpha"),
    ("WizardCoder-33B-V1.1", "WizardCoder"),
]

# --- fixed values: system prompt -------------------------------------------
SYSTEM_PROMPT_HEAD = (
    "\n    You are an SQL query generator. Given a question, you must generate a SQL query."
    " If unsure do not assume the answer and give the default answer as \"I don't know\".\n    "
)
SYSTEM_PROMPT_TAIL = "\n\n    [question]\n\n    [hint]\n\n    [context]\n\n    [examples]\n\n    "
# (smallest instruction size that includes the block, block)
INSTRUCTION_BLOCKS = [
    (
        5,
        "\n    Adhere to the following Instuction:"
        "\n    1. The answer generated must only be an SQL query ending with delimiter “;”"
        "\n    2. Dedicate time to understand the database schema fully, identifying the relevant tables and columns that align with the query’s objectives."
        "\n    3. Utilize only the data from the specified tables in the provided database schema."
        "\n    4. Pay attention to case sensitivity in data and ensure the extraction of required information aligns precisely with the specified columns and tables."
        "\n    5. Analyze the query’s requirements to determine the appropriate use of GROUP BY, HAVING, and UNION clauses, ensuring they contribute to the accurate aggregation and segmentation of data.",
    ),
    (
        7,
        "\n    6. Pay careful attention to the primary keys, foreign keys present in the database schema to determine appropriate columns for JOIN operations."
        "\n    7. Apply WHERE clause conditions accurately to filter the dataset based on specified criteria.",
    ),
    (
        9,
        "\n    8. Apply WHERE clause conditions accurately to filter the dataset and use ASC or DESC in sorting results where specified."
        "\n    9. Assign meaningful aliases to tables and columns where necessary, especially in cases of grouping or joining, to enhance the clarity and maintainability of the SQL query.",
    ),
    (
        11,
        "\n    10. When multiple tables are involved, prioritize selecting appropriate columns based on context and handle null values properly in columns."
        "\n    11. Avoid any write operations (like modify, update, delete, or drop). Should the task demand such actions, respond with a polite refusal, stating, “I’m sorry, but I can’t assist with that.”",
    ),
]

# --- fixed values: placeholders and the text put in front of their values --
# In the order in which they are filled.
PLACEHOLDERS = [
    ("[context]", "context", "Here is the schema of the tables which are needed for the SQL generation: \n"),
    ("[question]", "question", "Question: "),
    ("[hint]", "hint", "Hint: "),
    ("[examples]", "examples", ""),
]

# --- fixed values: few-shot samples ----------------------------------------
EXAMPLES_HEAD = "Examples: \n"
SAMPLE_LAYOUT = "\n    Q: {question}\n    A: {sql_query}"
COT_SAMPLE_LAYOUT = "\n    Q: {question}\n    A: {sql_query}\n    Explanation: \n{cot}\n"
NO_SHOT = "0_shot"

# --- fixed values: prompt layouts per model family -------------------------
# "filled" layouts put the values into the system prompt's placeholders;
# "blanked" layouts empty the placeholders and lay the values out themselves.
CHAT_USER_LAYOUT = (
    "Question: {question} \n Hint: {hint} \n Here is the schema of the tables which are"
    " needed for the SQL generation: \n {context}\n {examples}"
)
FILLED_LAYOUTS = {
    "instruction_response": (
        "Below is an instruction that describes a task. Write a response that appropriately"
        " completes the request.\n\n### Instruction:\n{system} \n\n### Response:"
    ),
    "inst": "<s> [INST] {system} [/INST]",
    "turn_markers": "<bos><start_of_turn>user\n{system} <end_of_turn>\n<start_of_turn>model",
    "human_assistant": "\n\nHuman: {system}\n\nAssistant:",
    "inst_lines": "<s>[INST] {system}\n\n[/INST]",
    "plain": "{system}",
}
BLANKED_LAYOUTS = {
    "step_turns": (
        "<s>Source: system\n\n {system} <step> Source: user\n\n " + CHAT_USER_LAYOUT
        + "  <step> Source: assistant\nDestination: user\n\n "
    ),
    "sys_inst": (
        "<<SYS>>\n {system}\n<<SYS>>\n\n[INST] Question: {question}\nHint: {hint}\n"
        "Here is the schema of the tables which are needed for the SQL generation: \n {context}\n {examples}[/INST]"
    ),
    "header_turns": (
        "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{system}\n<|eot_id|>"
        "<|start_header_id|>user<|end_header_id|>\n Question: {question}\nHint: {hint}\n"
        "Here is the schema of the tables which are needed for the SQL generation: \n {context}\n {examples}<|eot_id|>"
    ),
    "task_sections": (
        "### Task \nGenerate a SQL query to answer [QUESTION]{question} \nHint: {hint}[/QUESTION]"
        "### Instructions \n{system}### Database Schema \nThe query will run on a database with the"
        " following schema: {context} ### Answer \nGiven the database schema, here is the SQL query that"
        " [QUESTION]{question} \nHint: {hint}[/QUESTION] {examples} \n[SQL]"
    ),
}
# This one has the bare schema text in the placeholder and the others empty.
CONTEXT_LAYOUTS = {
    "endpoint_turns": (
        "<s>Source: system\n\n {system}\n  <step> Source: user\n\n {question}"
        "  <step> Source: user: assistant\nDestination: user"
    ),
}
ENDPOINT_STOPS = ["</s>", "<step>"]
# The family of each model; a model that is not listed has the plain layout.
# (environment, model, family)
MODEL_FAMILIES = [
    ("self-hosted", "codellama/CodeLlama-70b-Instruct-hf", "step_turns"),
    ("self-hosted", "codellama/CodeLlama-34b-Instruct-hf", "sys_inst"),
    ("self-hosted", "meta-llama/Meta-Llama-3-70B-Instruct", "header_turns"),
    ("self-hosted", "WizardLM/WizardCoder-33B-V1.1", "instruction_response"),
    ("self-hosted", "mistralai/Mistral-7B-Instruct-v0.1", "inst"),
    ("self-hosted", "mistralai/Mixtral-8x7B-Instruct-v0.1", "inst"),
    ("self-hosted", "mistralai/Mistral-7B-Instruct-v0.2", "inst"),
    ("self-hosted", "defog/sqlcoder-70b-alpha", "task_sections"),
    ("self-hosted", "defog/sqlcoder-7b-2", "task_sections"),
    ("self-hosted", "google/codegemma-7b-it", "turn_markers"),
    ("self-hosted", "databricks/dbrx-instruct", "chat"),
    ("self-hosted", "mistral-community/Mixtral-8x22B-v0.1", "plain"),
    ("hugging-face", "codellama/CodeLlama-70b-Instruct-hf", "endpoint_turns"),
    ("hugging-face", "codellama/CodeLlama-34b-Instruct-hf", "endpoint_turns"),
    ("open-ai", "gpt-3.5-turbo-16k", "chat"),
    ("open-ai", "gpt-4-turbo-preview", "chat"),
    ("open-ai", "gpt-4o-2024-05-13", "chat"),
    ("anyscale", "meta-llama/Llama-2-70b-chat-hf", "chat"),
    ("anyscale", "codellama/CodeLlama-70b-Instruct-hf", "chat"),
    ("anyscale", "codellama/CodeLlama-34b-Instruct-hf", "chat"),
    ("anyscale", "mistralai/Mistral-7B-Instruct-v0.1", "chat"),
    ("anyscale", "mistralai/Mixtral-8x7B-Instruct-v0.1", "chat"),
    ("anthropic", "claude-3-opus-20240229", "user_chat"),
    ("anthropic", "claude-3-sonnet-20240229", "user_chat"),
    ("anthropic", "claude-3-haiku-20240307", "user_chat"),
    ("gemini", "models/gemini-1.0-pro-latest", "plain"),
    ("amazon-bedrock", "meta.llama2-70b-chat-v1", "plain"),
    ("amazon-bedrock", "anthropic.claude-v2", "human_assistant"),
    ("amazon-bedrock", "anthropic.claude-3-sonnet-20240229-v1:0", "user_chat"),
    ("amazon-bedrock", "anthropic.claude-3-haiku-20240307-v1:0", "user_chat"),
    ("amazon-bedrock", "mistral.mixtral-8x7b-instruct-v0:1", "inst_lines"),
    ("amazon-bedrock", "mistral.mistral-7b-instruct-v0:2", "inst_lines"),
]
BEDROCK_BODY_VERSION = "bedrock-2023-05-31"

# --- fixed values: where a provider's reply keeps its text and counts ------
# shape -> (text path, prompt tokens path, response tokens path)
REPLY_PATHS = {
    "choices": ("$.choices[0].message.content", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "content": ("$.content[0].text", "$.usage.input_tokens", "$.usage.output_tokens"),
    "completion": (
        "$.completion",
        "$.headers['x-amzn-bedrock-input-token-count']",
        "$.headers['x-amzn-bedrock-output-token-count']",
    ),
    "outputs": (
        "$.outputs[0].text",
        "$.headers['x-amzn-bedrock-input-token-count']",
        "$.headers['x-amzn-bedrock-output-token-count']",
    ),
    "generation": (
        "$.generation",
        "$.headers['x-amzn-bedrock-input-token-count']",
        "$.headers['x-amzn-bedrock-output-token-count']",
    ),
    "generated_text": ("$[0].generated_text", None, None),
}
