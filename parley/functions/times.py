"""Times: RFC 3339 strings, milliseconds and offsets. Unreadable times give null or 0, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 string, 0 if earlier; null if unreadable."""
    shaped = F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"))
    ms = F.unix_millis(F.when(shaped, F.try_to_timestamp(text)))
    return F.when(ms.isNotNull(), F.greatest(ms, F.lit(0).cast("long")))


def delta_ms(base: Column, later: Column) -> Column:
    """Milliseconds from base to later, 0 if negative or unreadable."""
    return F.coalesce(F.greatest(F.unix_millis(F.try_to_timestamp(later)) - F.unix_millis(F.try_to_timestamp(base)), F.lit(0).cast("long")), F.lit(0).cast("long"))


def since(now_ms: Column, start_ms: Column) -> Column:
    return F.greatest(now_ms - start_ms, F.lit(0).cast("long"))


def offset_text(ms: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour."""
    seconds = F.floor(ms / 1000)
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))


def rfc3339(ms: Column) -> Column:
    """UTC string with milliseconds (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def backoff_seconds(attempt: Column, first: int = 2, most: int = 60) -> Column:
    """first, 2 first, 4 first ... up to most; attempts from 0."""
    return F.least(F.lit(first) * F.pow(F.lit(2), F.least(attempt, F.lit(30))), F.lit(most)).cast("long")


# Patterns of dates and times, and marks of numbers, by language.
SHOWN = {"en": ("M/d/yyyy", "h:mm a", ",", "."), "pl": ("d.MM.yyyy", "HH:mm", "\u00a0", ",")}
NEAR = {"en": {("day", -1): "yesterday", ("day", 0): "today", ("day", 1): "tomorrow"}, "pl": {("day", -1): "wczoraj", ("day", 0): "dzisiaj", ("day", 1): "jutro"}}


def shown_date(at: Column, language: str = "en") -> Column:
    return F.date_format(at, SHOWN[language][0])


def shown_time(at: Column, language: str = "en") -> Column:
    return F.date_format(at, SHOWN[language][1])


def shown_number(value: Column, language: str = "en") -> Column:
    """Thousands apart, three decimals at most, none that are zero at the end."""
    plain = F.regexp_replace(F.format_number(value.cast("double"), 3), r"\.?0+$", "")
    _, _, thousands, decimal = SHOWN[language]
    return F.translate(plain, ",.", thousands + decimal)


def shown_ago(number: Column, unit: str, language: str = "en") -> Column:
    """How far away a number of units is; the nearest days have names."""
    named = {k: name for (u, k), name in NEAR[language].items() if u == unit}
    several = F.when(F.abs(number) == 1, unit).otherwise(f"{unit}s")
    other = F.when(number < 0, F.concat_ws(" ", -number, several, F.lit("ago"))).otherwise(F.concat_ws(" ", F.lit("in"), number, several))
    for k, name in named.items():
        other = F.when(number == k, name).otherwise(other)
    return other
