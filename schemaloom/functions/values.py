"""Types of JSON values on Spark types: common types, casts by name, equality, counts of nodes and characters."""
from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numbers

NULL, BOOL, LONG, DOUBLE, STRING = T.NullType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def normal_type(t: T.DataType) -> T.DataType:
    """The JSON reading of a source column's type: every integer a long, every other number a double, dates as text."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return LONG
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(t, T.ArrayType):
        return T.ArrayType(normal_type(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, normal_type(f.dataType)) for f in t.fields])
    return t if isinstance(t, (T.NullType, T.BooleanType, T.StringType)) else STRING


def normal_value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.NullType, T.BooleanType, T.StringType, T.LongType, T.DoubleType)):
        return c
    if isinstance(t, T.FloatType):
        return c.cast("string").cast("double")
    if isinstance(t, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(t, T.ArrayType):
        return c if normal_type(t) == t else F.transform(c, lambda x: normal_value(x, t.elementType))
    if isinstance(t, T.StructType):
        if normal_type(t) == t:
            return c
        return F.when(c.isNotNull(), F.struct(*[normal_value(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c.cast(normal_type(t))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds both, or None: null fits all, integers fit numbers, structs need the same names."""
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or type(a) is type(b) and not isinstance(a, (T.ArrayType, T.StructType)):
        return a
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return DOUBLE
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = common_type(a.elementType, b.elementType)
        return inner and T.ArrayType(inner)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and set(a.names) == set(b.names):
        fields = [(f.name, common_type(f.dataType, b[f.name].dataType)) for f in a.fields]
        return T.StructType([T.StructField(n, t) for n, t in fields]) if all(t is not None for _, t in fields) else None
    return None


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as ``want``, structs matched by name."""
    if have == want:
        return c
    if isinstance(have, T.NullType):
        return F.lit(None).cast(want)
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(want, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[as_type(c[f.name], have[f.name].dataType, f.dataType).alias(f.name) for f in want.fields]))
    return c.cast(want)


def equal(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """JSON equality: 1 equals 1.0, names matter and their order doesn't, null equals null only."""
    t = common_type(ta, tb)
    if t is None or isinstance(t, T.NullType):
        return a.isNull() & b.isNull()
    return as_type(a, ta, t).eqNullSafe(as_type(b, tb, t))


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """Like ``common_type``, but a struct gets the fields of both: a field that one side's type lacks is missing there."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *[n for n in b.names if n not in a.names]]
        fields = [(n, merged_type(a[n].dataType if n in a.names else NULL, b[n].dataType if n in b.names else NULL)) for n in names]
        return T.StructType([T.StructField(n, t) for n, t in fields]) if all(t is not None for _, t in fields) else None
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        inner = merged_type(a.elementType, b.elementType)
        return inner and T.ArrayType(inner)
    return common_type(a, b)


def padded(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as a merged type, missing fields null."""
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        parts = [(padded(c[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: padded(x, have.elementType, want.elementType))
    return as_type(c, have, want)


def any_leaf(c: Column, t: T.DataType, test: Any) -> Column | None:
    """Whether some scalar below ``c`` passes ``test(column, type)`` (a Column or None); None if none can."""
    if isinstance(t, T.ArrayType):
        if any_leaf(F.lit(None), t.elementType, test) is None:
            return None
        return F.coalesce(F.exists(c, lambda x: F.coalesce(any_leaf(x, t.elementType, test), F.lit(False))), F.lit(False))
    if isinstance(t, T.StructType):
        found = [x for x in (any_leaf(c[f.name], f.dataType, test) for f in t.fields) if x is not None]
        return reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in found]) if found else None
    return test(c, t)


def unsafe(c: Column, t: T.DataType) -> Column | None:
    """Whether a number below ``c`` isn't safe to compare."""

    def test(x: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.LongType):
            return numbers.unsafe_long(x)
        return numbers.not_finite(x) if isinstance(kind, T.DoubleType) else None

    return any_leaf(c, t, test)


def tally(c: Column, t: T.DataType, leaf: Any, container: int) -> Column:
    """The sum of ``leaf(column, type)`` over all scalars below ``c``, and ``container`` for each array or object."""
    zero = F.lit(0).cast("long")
    if isinstance(t, T.ArrayType):
        inner = F.aggregate(c, zero, lambda acc, x: acc + tally(x, t.elementType, leaf, container))
        return F.when(c.isNull(), leaf(c, NULL)).otherwise(inner + F.lit(container).cast("long"))
    if isinstance(t, T.StructType):
        inner = reduce(lambda x, y: x + y, [tally(c[f.name], f.dataType, leaf, container) for f in t.fields], F.lit(container).cast("long"))
        return F.when(c.isNull(), leaf(c, NULL)).otherwise(inner)
    return leaf(c, t)


def nodes(c: Column, t: T.DataType) -> Column:
    return tally(c, t, lambda x, kind: F.lit(1).cast("long"), 1)


def characters(c: Column, t: T.DataType) -> Column:
    return tally(c, t, lambda x, kind: F.coalesce(F.length(x), F.lit(0)).cast("long") if isinstance(kind, T.StringType) else F.lit(0).cast("long"), 0)


def literal(value: Any) -> tuple[Column, T.DataType]:
    """A JSON constant as a column; arrays need one type of item."""
    if value is None:
        return F.lit(None), NULL
    if isinstance(value, bool):
        return F.lit(value), BOOL
    if isinstance(value, int):
        return (F.lit(value).cast("long"), LONG) if abs(value) < 2**63 else (F.lit(float("inf") if value > 0 else float("-inf")), DOUBLE)
    if isinstance(value, float):
        return (F.lit(int(value)).cast("long"), LONG) if value.is_integer() and abs(value) <= numbers.MAX_SAFE else (F.lit(value), DOUBLE)
    if isinstance(value, str):
        return F.lit(value), STRING
    if isinstance(value, dict):
        parts = {k: literal(v) for k, v in value.items()}
        t = T.StructType([T.StructField(k, x) for k, (_, x) in parts.items()])
        return (F.struct(*[c.alias(k) for k, (c, _) in parts.items()]) if parts else F.struct()), t
    parts = [literal(v) for v in value]
    t = reduce(lambda a, b: None if a is None else common_type(a, b), [x for _, x in parts], NULL)
    if t is None:
        raise TypeError("items of several types")
    return F.array(*[as_type(c, x, t) for c, x in parts]) if parts else F.expr("array()"), T.ArrayType(t)
