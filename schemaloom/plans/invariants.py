"""Assertions about a mapped document: ten operators, each a boolean column that is never null."""
from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import issues
from ..functions import values
from . import expressions as X
from .compiler import Scope, Typed, compile_expression

#: The assertions and what each needs besides expressions.
ASSERTIONS = {
    "equals": ("left", "right"), "not_null": ("value",), "in": ("value",), "matches": ("value",), "greater_than": ("left", "right"),
    "greater_than_or_equal": ("left", "right"), "less_than": ("left", "right"), "less_than_or_equal": ("left", "right"), "unique": ("value",), "length_equals": ("value",),
}
PLAIN = {"in": "allowed", "matches": "pattern", "length_equals": "expected"}


@dataclass(frozen=True)
class Invariant:
    id: str
    op: str
    operands: dict[str, X.Expr]
    plain: Any = None
    when: X.Expr | None = None

    @staticmethod
    def parse(raw: dict) -> "Invariant":
        body = raw.get("assertion", {})
        op = body.get("op")
        if op not in ASSERTIONS or set(raw) - {"id", "when", "assertion"} or set(body) - {"op", *ASSERTIONS[op], PLAIN.get(op, "op")}:
            raise issues.fail(issues.INVALID_EXPRESSION, f"not an invariant: {raw.get('id')!r}")
        if op == "length_equals" and not (isinstance(body.get("expected"), int) and body["expected"] >= 0):
            raise issues.fail(issues.INVALID_EXPRESSION, "an expected length is 0 or more")
        if op == "matches":
            _java(body["pattern"])
        when = raw.get("when")
        return Invariant(raw["id"], op, {n: X.parse(body[n]) for n in ASSERTIONS[op]}, body.get(PLAIN.get(op, "")), None if when is None else X.parse(when))


    def document(self) -> dict:
        plain = {PLAIN[self.op]: self.plain} if self.op in PLAIN else {}
        body = {"op": self.op} | {n: e.document() for n, e in self.operands.items()} | plain
        return {"id": self.id, "assertion": body} | ({} if self.when is None else {"when": self.when.document()})


def _java(pattern: str) -> str:
    """A full match in Java's dialect; what Java lacks or reads otherwise is refused."""
    try:
        re.compile(pattern)
    except re.error as why:
        raise issues.fail(issues.INVALID_EXPRESSION, f"pattern: {why}") from None
    if re.search(r"\(\?P[<=>]|\(\?\(|\\Z", pattern):
        raise issues.fail(issues.INVALID_EXPRESSION, "pattern uses a construct that regular expressions of the JVM lack")
    return rf"\A(?:{pattern})\z"


def holds(i: Invariant, scope: Scope) -> tuple[Column, Column]:
    """(failed, unevaluable): a guard that isn't true skips the assertion; a guard with an error fails it."""
    parts = [compile_expression(e, scope) for e in i.operands.values()]
    ok, bad = _test(i, parts)
    for p in parts:
        if p.err is not None:
            bad = p.err.isNotNull() | bad
    bad = F.coalesce(bad, F.lit(True))
    failed = ~bad & ~F.coalesce(ok, F.lit(False))
    if i.when is not None:
        guard = compile_expression(i.when, scope)
        wrong = F.lit(False) if guard.err is None else guard.err.isNotNull()
        on = F.coalesce(guard.value, F.lit(False)) if isinstance(guard.type, T.BooleanType) else F.lit(False)
        failed, bad = ~wrong & on & failed, wrong | (on & bad)
    return failed, bad


def applies(i: Invariant, scope: Scope) -> Column:
    """Whether the assertion counts for a row: without a guard, where the guard is true, and where it can't be worked out."""
    if i.when is None:
        return F.lit(True)
    guard = compile_expression(i.when, scope)
    on = F.coalesce(guard.value, F.lit(False)) if isinstance(guard.type, T.BooleanType) else F.lit(False)
    return on if guard.err is None else guard.err.isNotNull() | on


def _test(i: Invariant, parts: list[Typed]) -> tuple[Column, Column]:
    """(true where it holds, true where it can't be said)."""
    p, no = parts[0], F.lit(False)
    risk = lambda q: F.coalesce(values.unsafe(q.value, q.type), no) if values.unsafe(q.value, q.type) is not None else no
    if i.op == "equals":
        return values.equal(p.value, p.type, parts[1].value, parts[1].type), risk(p) | risk(parts[1])
    if i.op == "not_null":
        return p.value.isNotNull(), no
    if i.op == "in":
        found = no
        for item in i.plain:
            c, t = values.literal(item)
            found = found | values.equal(p.value, p.type, c, t)
        return found, risk(p)
    if i.op == "matches":
        return (p.value.rlike(_java(i.plain)), p.value.isNull()) if isinstance(p.type, T.StringType) else (no, F.lit(True))
    if i.op == "unique":
        if not isinstance(p.type, T.ArrayType):
            return no, F.lit(True)
        return F.size(F.array_distinct(p.value)) == F.size(p.value), p.value.isNull() | risk(p)
    if i.op == "length_equals":
        if isinstance(p.type, T.StringType):
            return F.length(p.value) == i.plain, p.value.isNull()
        if isinstance(p.type, T.ArrayType):
            return F.size(p.value) == i.plain, p.value.isNull()
        if isinstance(p.type, T.StructType):
            return F.lit(len(p.type.names) == i.plain), p.value.isNull()
        return no, F.lit(True)
    numeric = all(isinstance(q.type, (T.LongType, T.DoubleType)) for q in parts)
    if not numeric:
        return no, F.lit(True)
    a, b = (q.value.cast("double") for q in parts)
    unknown = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    return {"greater_than": a > b, "greater_than_or_equal": a >= b, "less_than": a < b, "less_than_or_equal": a <= b}[i.op], unknown
