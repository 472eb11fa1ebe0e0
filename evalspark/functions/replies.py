"""Cleaning model replies: statement extraction, outcome, provider JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import fixed_values as fixed

# Unicode whitespace plus the four separators that (?U)\s leaves out.
_SPACE = r"[\s\x1c-\x1f]"


def mentions_select(reply: Column) -> Column:
    """Whether the reply holds the word part ``select`` in any case."""
    return F.coalesce(reply.rlike("(?i)select"), F.lit(False))


def one_line(reply: Column) -> Column:
    """Line breaks, tabs, code fences and dots-of-omission become one space each."""
    return reduce(lambda text, noise: F.replace(text, F.lit(noise), F.lit(" ")), fixed.REPLY_NOISE, reply)


def first_statement(line: Column, keep_with: bool = False) -> Column:
    """Text from the first SELECT up to a semicolon; the whole text if there is none.

    ``keep_with`` starts at a leading WITH instead, so that common table
    expressions survive; off by default.
    """
    pattern = fixed.STATEMENT_PATTERN
    if keep_with:
        name = r"""(?:\w+|"[^"]*"|`[^`]*`|\[[^\]]*\])"""
        head = rf"WITH\s+(?:RECURSIVE\s+)?{name}\s*(?:\([^()]*\)\s*)?AS\s*\("
        pattern = rf"(?:\b{head}[^;]+|{pattern})"
    # One replacement for both cases, so that the search runs once per reply.
    return F.regexp_replace(line, rf"(?isU)\A(?:.*?({pattern}).*|(.*))\z", "$1$2")


def before_stop_phrase(text: Column) -> Column:
    """Text before the first stop phrase and the whitespace in front of it."""
    phrases = "|".join(fixed.STOP_PHRASES)
    # The look-behind starts a try only at the first blank of a run, so long
    # runs of blanks cost linear time.
    return F.regexp_replace(text, rf"(?isU)(?<!{_SPACE}){_SPACE}*+(?:{phrases}).*\z", "")


def sql_extract(reply: Column, keep_with: bool = False) -> Column:
    """The statement inside a reply, on one line."""
    return before_stop_phrase(first_statement(one_line(reply), keep_with))


def reply_outcome(reply: Column, error: Column, keep_with: bool = False) -> dict[str, Column]:
    """Columns ``severity, is_sql, predicted_sql, message`` of one reply."""
    failed = error.isNotNull()
    answered = mentions_select(reply)
    return {
        "severity": F.when(failed, "error").when(answered, "info").otherwise("warn"),
        "is_sql": F.when(~failed & answered, 1).otherwise(0),
        "predicted_sql": F.when(failed, F.concat(F.lit(fixed.ERROR_PREFIX), error))
        .when(answered, sql_extract(reply, keep_with))
        .otherwise(F.lit(fixed.UNKNOWN_REPLY)),
        "message": F.when(failed, error).when(answered, F.lit(fixed.LOG_OK)).otherwise(F.lit(fixed.LOG_NO_SQL)),
    }


def provider_reply(shape: Column, body: Column) -> dict[str, Column]:
    """Columns ``text, prompt_tokens, response_tokens`` out of a provider's JSON.

    ``shape`` names where the provider keeps them (see ``REPLY_PATHS``). The
    body is parsed once; broken JSON gives NULLs, not a failed job.
    """
    parsed = F.try_parse_json(body)
    header_paths = fixed.REPLY_PATHS["completion"]

    def pick(position: int, kind: str) -> Column:
        picked = None
        for name, paths in fixed.REPLY_PATHS.items():
            if paths[position] is None:
                value = F.when(body.isNotNull(), F.lit(0).cast(kind))
            else:
                value = F.try_variant_get(parsed, paths[position], kind)
                if position > 0 and paths[position] != header_paths[position]:
                    value = F.coalesce(value, F.try_variant_get(parsed, header_paths[position], kind))
            picked = F.when(shape == name, value) if picked is None else picked.when(shape == name, value)
        return picked

    return {
        "text": pick(0, "string"),
        "prompt_tokens": pick(1, "bigint"),
        "response_tokens": pick(2, "bigint"),
    }
