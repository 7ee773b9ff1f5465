"""RFC 3339 instants, rendered in UTC with milliseconds."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..issues import INVALID_DATE, fail

#: Fixed value: a date-time with a mandatory zone.
RFC3339 = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})\z"
#: The tokens of a format, longest first, and what date_format calls them (None: written as it is).
TOKENS = (("YYYY", "yyyy"), ("SSS", "SSS"), ("MM", "MM"), ("DD", "dd"), ("hh", "HH"), ("mm", "mm"), ("ss", "ss"), ("Z", None))


def instant(text: Column) -> Column:
    """The timestamp of a date-time, to the millisecond (cut, not rounded); null if it isn't one.

    The offset moves the local time, so nothing depends on which zones Spark's own parser knows. The grammar fixes the first
    19 characters' places; the cast checks the calendar and the clock.
    """
    local = F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8)).try_cast("timestamp_ntz")
    zone = F.when(text.endswith("Z"), "+00:00").otherwise(F.right(text, F.lit(6)))
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    shift = F.when((hours <= 23) & (minutes <= 59), (hours * 60 + minutes) * F.when(F.left(zone, F.lit(1)) == "+", -1).otherwise(1))
    millis = F.rpad(F.regexp_extract(text, r"\.([0-9]{1,3})", 1), 3, "0").try_cast("int")
    moved = local + F.make_dt_interval(mins=shift, secs=(millis / 1000).cast("decimal(18,6)"))
    return F.when(text.rlike(RFC3339) & F.year(moved).between(1, 9999), moved)


def canonical(text: Column) -> Column:
    return F.date_format(instant(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def render(text: Column, pattern: str) -> Column:
    """The pattern's tokens replaced; letters other than T that are in no token are an error of the pattern."""
    java, i = "", 0
    while i < len(pattern):
        for token, letters in TOKENS:
            if pattern.startswith(token, i):
                java += letters or "'Z'"
                i += len(token)
                break
        else:
            if pattern[i] != "T" and pattern[i].isascii() and pattern[i].isalpha():
                raise fail(INVALID_DATE, f"unsupported date format token at index {i}")
            java += "''" if pattern[i] == "'" else f"'{pattern[i]}'"
            i += 1
    moment = instant(text)
    return F.date_format(moment, java.replace("''", "") if "'" not in pattern else java) if java else F.when(moment.isNotNull(), "")
