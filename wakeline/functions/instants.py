"""ISO-8601 text as instants, and whether a fact is in effect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of a date and of a time with an optional offset.
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?$"


def instant(text: Column) -> Column:
    """
    The instant a text names, NULL when it names none. A bare date is its
    first moment in UTC and a missing offset is UTC.
    """
    spelled = F.trim(text)
    timed = F.regexp_replace(F.regexp_replace(spelled, "Z$", "+00:00"), ",", ".")
    timed = F.regexp_replace(timed, r"([+-]\d{2})(\d{2})$", "$1:$2")
    timed = F.regexp_replace(timed, r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1:00")
    zoned = F.when(timed.rlike(r"[+-]\d{2}:\d{2}(:\d{2})?$"), timed).otherwise(F.concat(timed, F.lit("+00:00")))
    return (
        F.when(spelled.rlike(DATE_ONLY), F.try_to_timestamp(F.concat(spelled, F.lit("T00:00:00+00:00"))))
        .when(spelled.rlike(DATE_TIME), F.try_to_timestamp(zoned))
    )


def date_only(text: Column) -> Column:
    return F.trim(text).rlike(DATE_ONLY)


def in_effect(effective: Column, as_of_text: Column) -> Column:
    """
    Whether an instant counts when asking as of a text. A date asks about the
    whole day, so everything before the next midnight is in effect.
    """
    cutoff = instant(as_of_text)
    return F.when(date_only(as_of_text), effective < cutoff + F.expr("INTERVAL 1 DAY")).otherwise(effective <= cutoff)
