"""Prompt texts, chat messages and provider request bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed


def shot_label(shots: Column) -> Column:
    """``4`` -> ``4_shot``; ``4-cot`` -> ``4_shot_cot``."""
    return F.when(
        shots.contains("cot"), F.concat(F.substring_index(shots, "-", 1), F.lit("_shot_cot"))
    ).otherwise(F.concat(shots, F.lit("_shot")))


def path_safe(model: Column) -> Column:
    """A model name that can be a path segment."""
    return F.translate(model, ":", "_")


def report_model(model: Column) -> Column:
    """The name that reports and price lists use: the last part of the path, safe as a path segment."""
    return path_safe(F.substring_index(model, "/", -1))


def instructions(instruction_size: Column) -> Column:
    """The system prompt up to its placeholders, with every instruction block the size includes."""
    text = fixed.SYSTEM_PROMPT_HEAD + "".join(block for _, block in fixed.INSTRUCTION_BLOCKS)
    cases = None
    for least, block in reversed(fixed.INSTRUCTION_BLOCKS):
        case = (instruction_size >= least, F.lit(text))
        cases = F.when(*case) if cases is None else cases.when(*case)
        text = text.removesuffix(block)
    return cases.otherwise(F.lit(text))


def system_prompt(instruction_size: Column) -> Column:
    """The whole system prompt with its placeholders."""
    return F.concat(instructions(instruction_size), F.lit(fixed.SYSTEM_PROMPT_TAIL))


def filled(template: str, values: dict[str, Column]) -> list[Column]:
    """The parts of a template with the values in its placeholders.

    Placeholders are filled one after the other, so a mark inside a value that
    was filled in earlier is filled as well. Each value is completed on its
    own, and the long template text is never searched.
    """
    complete: dict[str, Column] = {}
    for mark, name, lead in reversed(fixed.PLACEHOLDERS):
        value = F.coalesce(values[name], F.lit(""))
        text = F.concat(F.lit(lead), value) if lead else value
        for later_mark, later_name, _ in fixed.PLACEHOLDERS[len(fixed.PLACEHOLDERS) - len(complete) :]:
            text = F.replace(text, F.lit(later_mark), complete[later_name])
        complete[name] = text
    by_mark = {mark: complete[name] for mark, name, _ in fixed.PLACEHOLDERS}
    pieces = re.split("(" + "|".join(re.escape(mark) for mark in by_mark) + ")", template)
    return [by_mark.get(piece, F.lit(piece)) for piece in pieces if piece]


def blanked(template: str) -> str:
    """A template without its placeholders."""
    for mark, _, _ in fixed.PLACEHOLDERS:
        template = template.replace(mark, "")
    return template


def system_forms(values: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The system prompt with all values, with none, and with the bare schema text only.

    ``values`` holds ``instructions, question, hint, context, examples``.
    """
    tail = fixed.SYSTEM_PROMPT_TAIL
    mark = fixed.PLACEHOLDERS[0][0]
    before, after = (F.lit(blanked(part)) for part in tail.split(mark))
    whole = F.concat(values["instructions"], *filled(tail, values))
    empty = F.concat(values["instructions"], F.lit(blanked(tail)))
    return whole, empty, F.concat(values["instructions"], before, F.coalesce(values["context"], F.lit("")), after)


def lay_out(layout: str, values: dict[str, Column]) -> Column:
    """A layout text with ``{name}`` slots as one concat; slots in values stay untouched."""
    parts = re.split(r"\{(\w+)\}", layout)
    columns = [
        F.coalesce(values[part], F.lit("")) if position % 2 else F.lit(part)
        for position, part in enumerate(parts)
        if position % 2 or part
    ]
    return F.concat(*columns)


def prompt_text(family: Column, values: dict[str, Column]) -> Column:
    """The single-string prompt of a model family.

    A family without a layout of its own gets the plain filled prompt.
    """
    whole, empty, with_schema = system_forms(values)
    cases = None
    forms = ((fixed.BLANKED_LAYOUTS, empty), (fixed.CONTEXT_LAYOUTS, with_schema), (fixed.FILLED_LAYOUTS, whole))
    for layouts, system in forms:
        for name, layout in layouts.items():
            if name == "plain":
                continue
            text = lay_out(layout, {**values, "system": system})
            cases = F.when(family == name, text) if cases is None else cases.when(family == name, text)
    return cases.otherwise(whole)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(family: Column, values: dict[str, Column]) -> Column:
    """``array<struct<role,content>>``: system and user turn, or one user turn for ``user_chat``."""
    whole, system, _ = system_forms(values)
    user = lay_out(fixed.CHAT_USER_LAYOUT, values)
    return F.when(family == "user_chat", F.array(_message("user", whole))).otherwise(
        F.array(_message("system", system), _message("user", user))
    )


def request_body(family: Column, prompt: Column, max_tokens: int | None = None) -> Column:
    """JSON body for endpoints that take one: message list, or prompt with a token limit."""
    limit = F.lit(max_tokens or fixed.MAX_TOKENS)
    endpoint = F.struct(
        prompt.alias("inputs"),
        F.struct(
            F.lit(max_tokens or fixed.HOSTED_ENDPOINT_MAX_TOKENS).alias("max_new_tokens"),
            F.array(*[F.lit(stop) for stop in fixed.ENDPOINT_STOPS]).alias("stop"),
        ).alias("parameters"),
    )
    content = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text")))
    chat = F.struct(
        F.lit(fixed.BEDROCK_BODY_VERSION).alias("anthropic_version"),
        limit.alias("max_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
    )
    return (
        F.when(family == "user_chat", F.to_json(chat))
        .when(family == "human_assistant", F.to_json(F.struct(prompt.alias("prompt"), limit.alias("max_tokens_to_sample"))))
        .when(family == "inst_lines", F.to_json(F.struct(prompt.alias("prompt"), limit.alias("max_tokens"))))
        .when(family == "endpoint_turns", F.to_json(endpoint))
        .otherwise(F.to_json(F.struct(prompt.alias("prompt"))))
    )
