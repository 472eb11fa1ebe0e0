"""Durations, response times and time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def duration_micros(text: Column) -> Column:
    """``[N day(s), ]H:MM:SS[.ffffff]``, ``0`` or plain seconds -> whole microseconds.

    Integers, so that sums do not depend on the order of the rows. Text in no
    known form gives NULL, which every metric treats as "no usable answer".
    """
    clock = F.substring_index(text, ", ", -1)
    days = F.when(
        text.contains(" day"), F.substring_index(text, " day", 1).try_cast("bigint")
    ).otherwise(F.lit(0))
    hours = F.substring_index(clock, ":", 1)
    minutes = F.substring_index(F.substring_index(clock, ":", 2), ":", -1)
    seconds = F.substring_index(clock, ":", -1)
    # Exactly two colons: the three parts and the colons make up the whole.
    parts = F.octet_length(hours) + F.octet_length(minutes) + F.octet_length(seconds)
    whole_minutes = (days * 24 + hours.try_cast("bigint")) * 60 + minutes.try_cast("bigint")
    micros = F.round(seconds.try_cast("double") * MICROS).cast("bigint")
    return F.when(parts + 2 == F.octet_length(clock), whole_minutes * (60 * MICROS) + micros).when(
        ~text.contains(":"), F.round(text.try_cast("double") * MICROS).cast("bigint")
    )


def duration_seconds(text: Column) -> Column:
    """Same text as :func:`duration_micros`, as double seconds."""
    return duration_micros(text) / F.lit(float(MICROS))


def elapsed_label(seconds: Column) -> Column:
    """3725.9 -> ``1hrs 2min 5sec``."""
    whole = F.floor(seconds).cast("bigint")
    return F.concat(
        F.floor(whole / 3600).cast("string"), F.lit("hrs "),
        F.floor((whole % 3600) / 60).cast("string"), F.lit("min "),
        (whole % 60).cast("string"), F.lit("sec"),
    )


def response_seconds(started: Column, stopped: Column) -> Column:
    """Seconds between two timestamps, to the microsecond."""
    return (F.unix_micros(stopped) - F.unix_micros(started)) / F.lit(float(MICROS))


def duration_text(micros: Column) -> Column:
    """Microseconds -> ``[N day(s), ]H:MM:SS[.ffffff]``; 0 -> ``0``."""
    days = F.floor(micros / (86_400 * MICROS)).cast("bigint")
    rest = micros % (86_400 * MICROS)
    fraction = rest % MICROS
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / (3600 * MICROS)).cast("bigint"),
        F.floor(rest / (60 * MICROS)).cast("bigint") % 60,
        F.floor(rest / MICROS).cast("bigint") % 60,
    )
    day_text = F.when(days == 1, F.lit("1 day, ")).when(
        days > 1, F.concat(days.cast("string"), F.lit(" days, "))
    ).otherwise(F.lit(""))
    fraction_text = F.when(fraction > 0, F.format_string(".%06d", fraction)).otherwise(F.lit(""))
    return F.when(micros == 0, F.lit("0")).otherwise(F.concat(day_text, clock, fraction_text))


def log_time(moment: Column) -> Column:
    """Timestamp -> ``yyyy-MM-dd HH:mm:ss`` in the session time zone (UTC)."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
