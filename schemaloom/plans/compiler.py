"""Expressions compiled to pairs of columns: a value and the code of the first error, null where there is none.

Values are total: where the error column has a code, the value is unspecified and is masked once, at the top. Errors follow
the order of evaluation: operands left to right, then an operator's own check; the branch not taken, operands after
the one that ``coalesce`` returns, and the unused default of ``lookup`` don't count; ``and`` and ``or`` evaluate all.
"""
from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import issues
from ..functions import dates, numbers, values
from ..functions.values import BOOL, DOUBLE, LONG, NULL, STRING
from ..sources.pointers import tokens
from . import expressions as X
from .expressions import Expr


@dataclass(frozen=True)
class Typed:
    """A value with its error (None: it never has one) and its type; computed: a number made by arithmetic; columns: the
    fields of a document that is spread over the columns of a frame."""

    value: Column
    err: Column | None
    type: T.DataType
    computed: bool = False
    columns: dict | None = None

    @property
    def code(self) -> Column:
        return F.lit(None).cast("string") if self.err is None else self.err

    def masked(self) -> "Typed":
        return self if self.err is None else replace(self, value=F.when(self.err.isNull(), self.value))


@dataclass(frozen=True)
class Scope:
    """What ``get`` reads. ``present``: says of a pointer into input whether a null found there was written (True) or the field
    is missing; without it, a null in a typed column is a written null.
    """

    input: Typed
    output: Typed | None = None
    current: tuple[Typed, ...] = ()
    present: object = None
    binder: "Binder | None" = None


#: Lookups of more entries are joined, not written into the plan (but inside maps); joined ones of more aren't broadcast by hand.
LITERAL_MOST, TABLE_MOST = 1_000, 1_000_000


class Binder:
    """Names for intermediate results: columns of their own, a projection for each level of nesting. Without them an operand that
    is checked, used and masked would be written out many times, and the whole would grow with a power of the depth.
    """

    def __init__(self, prefix: str):
        self.prefix, self.levels, self.open, self.joins = prefix, {}, [], {}

    def bind(self, c: Column, level: int) -> Column:
        name = f"{self.prefix}{sum(map(len, self.levels.values()))}"
        self.levels.setdefault(level, {})[name] = c
        return F.col(name)

    def note(self, level: int) -> None:
        if self.open:
            self.open[-1] = max(self.open[-1], level)

    def look_up(self, key: Column, entries: dict, kind: T.DataType) -> tuple[Column, Column]:
        """(hit, value) of a key in a table too large for a literal: joined, once its key is there. The table is part of the mapping
        document and is sent to all tasks only up to ``TABLE_MOST`` entries; the optimiser chooses beyond that."""
        level, name = self.open[-1] + 1 if self.open else 1, f"{self.prefix}t{sum(map(len, self.joins.values()))}"
        self.joins.setdefault(level, []).append((name, key, entries, kind))
        self.note(level)
        return F.col(name + "k").isNotNull(), F.col(name + "v")

    def apply(self, df: DataFrame) -> DataFrame:
        for level in sorted({*self.levels, *self.joins}):
            for name, key, entries, kind in self.joins.get(level, ()):
                rows = df.sparkSession.createDataFrame([(k, json.dumps({"v": v})) for k, v in entries.items()], "k string, j string")
                parsed = F.from_json("j", T.StructType([T.StructField("v", kind)]))["v"] if not isinstance(kind, T.NullType) else F.lit(None)
                table = rows.select(F.col("k").alias(name + "k"), parsed.alias(name + "v"))
                df = df.join(F.broadcast(table) if len(entries) <= TABLE_MOST else table, key == F.col(name + "k"), "left")
            df = df.withColumns(self.levels.get(level, {}))
        return df

    def names(self) -> list[str]:
        tables = [name + c for own in self.joins.values() for name, *_ in own for c in "kv"]
        return tables + [n for own in self.levels.values() for n in own]


def first(*errs: Column | None) -> Column | None:
    found = [e for e in errs if e is not None]
    return (found[0] if len(found) == 1 else F.coalesce(*found)) if found else None


def check(bad: Column | bool, code: str) -> Column | None:
    """The code where ``bad`` holds; a null condition does."""
    if isinstance(bad, bool):
        return F.lit(code) if bad else None
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(code))


def broken(code: str, *errs: Column | None) -> Typed:
    return Typed(F.lit(None), first(*errs, F.lit(code)), NULL)


def resolve(base: Typed, pointer: str, present=None) -> Typed:
    """What a pointer finds. A missing field, a null on the way and an index out of range are errors."""
    value, err, kind = base.value, base.err, base.type
    parts = tokens(pointer)
    for n, part in enumerate(parts):
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return broken(issues.SOURCE_PATH_NOT_FOUND, err)
            err = first(err, check(value.isNull(), issues.SOURCE_PATH_NOT_FOUND)) if n else err
            value, kind = base.columns[part] if n == 0 and base.columns else value[part], kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.isascii() and part.isdigit():
            at = int(part)
            err = first(err, check(value.isNull() | (F.size(value) <= at), issues.SOURCE_PATH_NOT_FOUND))
            value, kind = F.get(value, F.lit(at)), kind.elementType
        else:
            return broken(issues.SOURCE_PATH_NOT_FOUND, err)
    if present is not None and parts:
        err = first(err, check(value.isNull() & ~present(parts), issues.SOURCE_PATH_NOT_FOUND))
    return Typed(values.normal_value(value, kind), err, values.normal_type(kind))


def source(name: str, kind: T.DataType) -> Typed:
    """A struct column as the input document; a null document has no fields."""
    return Typed(F.col(name), None, kind)


def compile_expression(e: Expr, scope: Scope) -> Typed:
    binder = scope.binder
    if binder is None:
        return _OPERATORS[e.op](e, scope)
    binder.open.append(0)
    made = _OPERATORS[e.op](e, scope)
    level = binder.open.pop() + (e.op not in ("get", "literal"))
    if e.op not in ("get", "literal"):
        made = replace(made, value=binder.bind(made.value, level), err=made.err if made.err is None else binder.bind(made.err, level))
    binder.note(level)
    return made


def _get(e: Expr, s: Scope) -> Typed:
    if e["document"] == "input":
        return resolve(s.input, e["path"], s.present)
    if e["document"] == "output":
        return resolve(s.output, e["path"]) if s.output is not None else broken(issues.SOURCE_PATH_NOT_FOUND)
    return resolve(s.current[-1], e["path"]) if s.current else broken(issues.INVALID_EXPRESSION)


def _literal(e: Expr, s: Scope) -> Typed:
    try:
        value, kind = values.literal(e["value"])
    except TypeError as why:
        raise issues.fail(issues.INVALID_EXPRESSION, str(why)) from None
    return Typed(value, None, kind)


def _object(e: Expr, s: Scope) -> Typed:
    parts = {k: compile_expression(x, s) for k, x in e["fields"].items()}
    kind = T.StructType([T.StructField(k, p.type) for k, p in parts.items()])
    return Typed(F.struct(*[p.value.alias(k) for k, p in parts.items()]), first(*[p.err for p in parts.values()]), kind)


def _joint(parts: list[Typed]) -> T.DataType:
    kind = reduce(lambda a, b: None if a is None else values.common_type(a, b), [p.type for p in parts], NULL)
    if kind is None:
        raise issues.fail(issues.INVALID_EXPRESSION, f"branches of several types: {', '.join(p.type.simpleString() for p in parts)}")
    return kind


def _array(e: Expr, s: Scope) -> Typed:
    if len(e["items"]) > X.MAX_ITEMS:
        return broken(issues.EVALUATION_LIMIT_EXCEEDED)
    parts = [compile_expression(x, s) for x in e["items"]]
    kind = _joint(parts)
    made = F.array(*[values.as_type(p.value, p.type, kind) for p in parts]) if parts else F.expr("array()")
    return Typed(made, first(*[p.err for p in parts]), T.ArrayType(kind))


def _map(e: Expr, s: Scope) -> Typed:
    rows = compile_expression(e["collection"], s)
    if not isinstance(rows.type, T.ArrayType):
        return broken(issues.TYPE_MISMATCH, rows.err)
    inner: list[Typed] = []

    def body(item: Column) -> Typed:
        return compile_expression(e["expression"], replace(s, binder=None, current=(*s.current, Typed(item, None, rows.type.elementType))))

    def value(item: Column) -> Column:
        inner.append(body(item))
        return inner[-1].value

    made = F.transform(rows.value, value)
    own = first(rows.err, check(rows.value.isNull(), issues.TYPE_MISMATCH), check(F.coalesce(F.size(rows.value) > X.MAX_ITEMS, F.lit(False)), issues.EVALUATION_LIMIT_EXCEEDED))
    err = own
    if inner[-1].err is not None:  # the first item's error that there is
        codes = F.transform(rows.value, lambda item: body(item).err)
        err = first(own, F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0)))
    return Typed(made, err, T.ArrayType(inner[-1].type))


def _coalesce(e: Expr, s: Scope) -> Typed:
    parts = [compile_expression(x, s) for x in e["operands"]]
    kind = _joint(parts)
    value, err = F.lit(None).cast(kind), None
    for p in reversed(parts):
        own = values.as_type(p.value, p.type, kind)
        if p.err is None:
            value, err = F.coalesce(own, value), err and F.when(own.isNull(), err)
            continue
        missing = p.err == issues.SOURCE_PATH_NOT_FOUND
        later = F.lit(None).cast("string") if err is None else err
        next_one = F.coalesce(missing, F.lit(False)) | (p.err.isNull() & own.isNull())
        err = F.when(next_one, later).otherwise(p.err)
        value = F.when(next_one, value).otherwise(own)
    return Typed(value, err, kind, any(p.computed for p in parts))


def _concat(e: Expr, s: Scope) -> Typed:
    parts = [compile_expression(x, s) for x in e["operands"]]
    errs: list[Column | None] = []
    for p in parts:
        errs += [p.err, check(p.value.isNull() if isinstance(p.type, T.StringType) else True, issues.TYPE_MISMATCH)]
        if not isinstance(p.type, T.StringType):
            return Typed(F.lit(None).cast("string"), first(*errs), STRING)
    mixed = [x for i, p in enumerate(parts) for x in ([F.lit(e["separator"])] if i and e["separator"] else []) + [p.value]]
    return Typed(F.concat(*mixed) if mixed else F.lit(""), first(*errs), STRING)


def _cast(e: Expr, s: Scope) -> Typed:
    p, want = compile_expression(e["value"], s), e["target_type"]
    c, t = p.value, p.type
    wrong = lambda kind: Typed(F.lit(None).cast(kind), first(p.err, F.lit(issues.TYPE_MISMATCH)), kind)
    if want == "string":
        if isinstance(t, (T.ArrayType, T.StructType)):
            return wrong(STRING)
        text = numbers.double_text(c) if isinstance(t, T.DoubleType) else c.cast("string")
        return Typed(F.coalesce(text, F.lit("null")), p.err, STRING)
    if want == "boolean":
        if isinstance(t, T.BooleanType):
            return Typed(c, first(p.err, check(c.isNull(), issues.TYPE_MISMATCH)), BOOL)
        if not isinstance(t, T.StringType):
            return wrong(BOOL)
        low = F.lower(c)
        return Typed(F.when(low == "true", True).when(low == "false", False), first(p.err, check(~low.isin("true", "false"), issues.TYPE_MISMATCH)), BOOL)
    if want == "integer":
        if isinstance(t, T.LongType):
            return Typed(c, first(p.err, check(c.isNull(), issues.TYPE_MISMATCH), check(numbers.unsafe_long(c), issues.NUMERIC_PRECISION_RISK)), LONG)
        if isinstance(t, T.DoubleType) and p.computed:  # arithmetic has made integral results integers
            return Typed(c.try_cast("long"), first(p.err, check(c != F.floor(c).cast("double"), issues.TYPE_MISMATCH)), LONG)
        if not isinstance(t, T.StringType):
            return wrong(LONG)
        digits = c.rlike(numbers.INTEGER)
        number = F.when(digits, c).try_cast("decimal(38,0)")
        risky = digits & (number.isNull() | (F.abs(number) > numbers.MAX_SAFE))
        return Typed(number.try_cast("long"), first(p.err, check(~digits, issues.TYPE_MISMATCH), check(risky, issues.NUMERIC_PRECISION_RISK)), LONG)
    if isinstance(t, T.StringType):
        decimal = c.rlike(numbers.DECIMAL)
        number = F.when(decimal, c).try_cast("double")
        finite = F.abs(number) != float("inf")
        errs = [check(~(decimal & finite), issues.TYPE_MISMATCH), check(numbers.unsafe_double(number), issues.NUMERIC_PRECISION_RISK)]
        return Typed(number, first(p.err, *errs), DOUBLE, True)
    if isinstance(t, (T.LongType, T.DoubleType)):
        number = c.cast("double")
        return Typed(number, first(p.err, check(c.isNull(), issues.TYPE_MISMATCH), check(numbers.unsafe_double(number), issues.NUMERIC_PRECISION_RISK)), DOUBLE, True)
    return wrong(DOUBLE)


def _boolean(p: Typed) -> Column | None:
    return check(p.value.isNull() if isinstance(p.type, T.BooleanType) else True, issues.TYPE_MISMATCH)


def _truth(p: Typed) -> Column:
    return p.value if isinstance(p.type, T.BooleanType) else F.lit(None).cast("boolean")


def _if(e: Expr, s: Scope) -> Typed:
    c, a, b = (compile_expression(e[n], s) for n in ("condition", "then", "otherwise"))
    kind, holds = _joint([a, b]), _truth(c)
    value = F.when(holds, values.as_type(a.value, a.type, kind)).otherwise(values.as_type(b.value, b.type, kind))
    branch = None if a.err is None and b.err is None else F.when(holds, a.code).otherwise(b.code)
    return Typed(value, first(c.err, _boolean(c), branch), kind, a.computed or b.computed)


def _equals(e: Expr, s: Scope) -> Typed:
    a, b = (compile_expression(e[n], s) for n in ("left", "right"))
    risks = [x for x in (values.unsafe(p.value, p.type) for p in (a, b)) if x is not None]
    risk = check(reduce(lambda x, y: x | y, [F.coalesce(r, F.lit(False)) for r in risks]), issues.NUMERIC_PRECISION_RISK) if risks else None
    return Typed(values.equal(a.value, a.type, b.value, b.type), first(a.err, b.err, risk), BOOL)


def _not(e: Expr, s: Scope) -> Typed:
    p = compile_expression(e["value"], s)
    return Typed(~_truth(p), first(p.err, _boolean(p)), BOOL)


def _all_of(e: Expr, s: Scope) -> Typed:
    parts = [compile_expression(x, s) for x in e["operands"]]
    join = (lambda x, y: x & y) if e.op == "and" else (lambda x, y: x | y)
    return Typed(reduce(join, [_truth(p) for p in parts]), first(*[p.err for p in parts], *[_boolean(p) for p in parts]), BOOL)


def _lookup(e: Expr, s: Scope) -> Typed:
    key = compile_expression(e["key"], s)
    default = compile_expression(e["default"], s) if e["default"] is not None else Typed(F.lit(None), None, NULL)
    entries = {k: _literal(Expr("literal", {"value": v}), s) for k, v in e["values"].items()}
    kind = _joint([*entries.values(), default])
    otherwise = values.as_type(default.value, default.type, kind)
    if not entries or not isinstance(key.type, T.StringType):
        return Typed(otherwise, first(key.err, default.err), kind, default.computed)
    if len(entries) > LITERAL_MOST and s.binder is not None and not s.current:
        hit, found = s.binder.look_up(key.value, e["values"], kind)
        err = default.err if default.err is None else F.when(~hit, default.err)
        return Typed(F.when(hit, found).otherwise(otherwise), first(key.err, err), kind, True)
    hit = key.value.isin(list(entries))
    pairs = [x for k, p in entries.items() for x in (F.lit(k), values.as_type(p.value, p.type, kind))]
    found = F.try_element_at(F.create_map(*pairs), key.value)
    err = default.err if default.err is None else F.when(~F.coalesce(hit, F.lit(False)), default.err)
    return Typed(F.when(F.coalesce(hit, F.lit(False)), found).otherwise(otherwise), first(key.err, err), kind, True)


def _number(p: Typed) -> list[Column | None]:
    """The checks of an arithmetic operand."""
    if isinstance(p.type, T.LongType):
        return [check(p.value.isNull(), issues.TYPE_MISMATCH), check(numbers.unsafe_long(p.value), issues.NUMERIC_PRECISION_RISK)]
    if isinstance(p.type, T.DoubleType):
        return [check(p.value.isNull(), issues.TYPE_MISMATCH), check(numbers.not_finite(p.value), issues.NUMERIC_PRECISION_RISK)]
    return [check(True, issues.TYPE_MISMATCH)]


def _double(p: Typed) -> Column:
    return p.value.cast("double") if isinstance(p.type, (T.LongType, T.DoubleType)) else F.lit(None).cast("double")


def _arithmetic(e: Expr, s: Scope) -> Typed:
    a, b = (compile_expression(e[n], s) for n in ("left", "right"))
    x, y = _double(a), _double(b)
    errs = [a.err, b.err, *_number(a), *_number(b)]
    if e.op == "divide":
        made = F.try_divide(x, y)
        errs.append(check(y == 0, issues.DIVIDE_BY_ZERO))
    else:
        made = {"add": x + y, "subtract": x - y, "multiply": x * y}[e.op]
    errs.append(check(numbers.unsafe_double(made), issues.NUMERIC_PRECISION_RISK))
    if e.op != "divide" and isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType):
        return Typed(made.try_cast("long"), first(*errs), LONG, True)
    return Typed(made, first(*errs), DOUBLE, True)


def _round(e: Expr, s: Scope) -> Typed:
    p = compile_expression(e["value"], s)
    made = numbers.round_half_away(_double(p), e["digits"])
    return Typed(made, first(p.err, *_number(p), check(numbers.unsafe_double(made), issues.NUMERIC_PRECISION_RISK)), DOUBLE, True)


def _parse_date(e: Expr, s: Scope) -> Typed:
    p = compile_expression(e["value"], s)
    if not isinstance(p.type, T.StringType):
        return Typed(F.lit(None).cast("string"), first(p.err, F.lit(issues.INVALID_DATE)), STRING)
    made = dates.canonical(p.value)
    return Typed(made, first(p.err, check(made.isNull(), issues.INVALID_DATE)), STRING)


def _format_date(e: Expr, s: Scope) -> Typed:
    p = compile_expression(e["value"], s)
    try:
        made = dates.render(p.value if isinstance(p.type, T.StringType) else F.lit(None).cast("string"), e["pattern"])
    except issues.MappingError as why:
        return Typed(F.lit(None).cast("string"), first(p.err, F.lit(why.codes[0])), STRING)
    return Typed(made, first(p.err, check(made.isNull(), issues.INVALID_DATE)), STRING)


_OPERATORS = {
    "get": _get, "literal": _literal, "object": _object, "array": _array, "map": _map, "coalesce": _coalesce, "concat": _concat, "cast": _cast,
    "if": _if, "equals": _equals, "not": _not, "and": _all_of, "or": _all_of, "lookup": _lookup, "add": _arithmetic, "subtract": _arithmetic,
    "multiply": _arithmetic, "divide": _arithmetic, "round": _round, "parse_date": _parse_date, "format_date": _format_date,
}


def limited(p: Typed) -> Typed:
    """``p`` with the limits on nodes and characters of a rule's value; skipped where the type bounds them."""
    if not isinstance(p.type, (T.ArrayType, T.StructType, T.StringType)):
        return p
    errs = [check(values.characters(p.value, p.type) > X.MAX_CHARACTERS, issues.EVALUATION_LIMIT_EXCEEDED)]
    if "array" in p.type.simpleString():
        errs.insert(0, check(values.nodes(p.value, p.type) > X.MAX_NODES, issues.EVALUATION_LIMIT_EXCEEDED))
    return replace(p, err=first(p.err, *errs))
