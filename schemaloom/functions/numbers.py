"""Binary64 arithmetic with safe integers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SAFE = 9007199254740991
#: The grammars of numeric strings.
DECIMAL = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
INTEGER = r"\A[+-]?[0-9]+\z"


def unsafe_long(c: Column) -> Column:
    return (c > MAX_SAFE) | (c < -MAX_SAFE)


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def unsafe_double(c: Column) -> Column:
    """Not finite, or beyond the safe integers: no result may be."""
    return F.isnan(c) | (F.abs(c) > float(MAX_SAFE))


def round_half_away(c: Column, digits: int) -> Column:
    """floor(|c| 10^digits + 0.5) / 10^digits with the sign of c, in binary64; ``floor`` is passed by where it has nothing to do
    and would saturate."""
    factor = float(10**digits)
    scaled = F.abs(c) * F.lit(factor) + F.lit(0.5)
    whole = F.when(scaled < float(2**52), F.floor(scaled).cast("double")).otherwise(scaled)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * whole / F.lit(factor))


def double_text(c: Column) -> Column:
    """The text of a double: integral ones without a point; others as Spark writes them, with e-notation in two digits."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0E", "E"), r"E(-?)([0-9])\z", r"e$10$2")
    plain = F.regexp_replace(F.regexp_replace(plain, "E", "e"), r"e([0-9])", r"e+$1")
    return F.when((F.abs(c) < 1e18) & (c == F.floor(c).cast("double")), F.floor(c).cast("string")).otherwise(plain)
