"""The expression language, case by case: a value or an error code."""
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from schemaloom.functions import values
from schemaloom.plans import expressions
from schemaloom.plans.compiler import Scope, Typed, compile_expression, limited
from schemaloom.plans.invariants import Invariant, holds
from schemaloom.plans.mapping import Mapping
from pyspark.sql import functions as F

G = lambda path, doc="input": {"op": "get", "path": path, "document": doc}
L = lambda v: {"op": "literal", "value": v}
CAST = lambda path, to: {"op": "cast", "value": G(path), "target_type": to}
BIN = lambda op, a, b: {"op": op, "left": a, "right": b}
DATE = lambda v: {"op": "parse_date", "value": L(v)}
HUGE = 10**400

CASES = [
    (G("/text"), {"text": "alpha"}, "alpha"),
    ({"op": "object", "fields": {"z": L(1), "a": {"op": "array", "items": [L(True), L(False)]}}}, {}, {"a": [True, False], "z": 1}),
    ({"op": "map", "collection": G("/items"), "expression": {"op": "object", "fields": {"v": G("/v", "current"), "in": {"op": "map", "collection": G("/in", "current"), "expression": BIN("multiply", G("", "current"), L(2))}}}},
     {"items": [{"v": 1, "in": [2, 3]}, {"v": 4, "in": [5]}]}, [{"v": 1, "in": [4, 6]}, {"v": 4, "in": [10]}]),
    ({"op": "coalesce", "operands": [G("/missing"), L("fallback")]}, {}, "fallback"),
    ({"op": "coalesce", "operands": [G("/n"), L("fallback")]}, {"n": None}, "fallback"),
    ({"op": "coalesce", "operands": [{"op": "concat", "operands": [G("/missing")]}, L("x")]}, {}, "x"),
    ({"op": "coalesce", "operands": [BIN("divide", L(1), L(0)), L(2)]}, {}, "!DIVIDE_BY_ZERO"),
    ({"op": "coalesce", "operands": [L("a"), CAST("/t", "string")]}, {"t": "b"}, "a"),
    ({"op": "concat", "operands": [L("a"), L("b"), L("c")], "separator": "-"}, {}, "a-b-c"),
    ({"op": "concat", "operands": [L("a"), G("/n")]}, {"n": None}, "!TYPE_MISMATCH"),
    (CAST("/t", "integer"), {"t": "-12"}, -12),
    (CAST("/t", "number"), {"t": "1.25e2"}, 125),
    (CAST("/t", "boolean"), {"t": "TRUE"}, True),
    (CAST("/t", "boolean"), {"t": "yes"}, "!TYPE_MISMATCH"),
    (CAST("/b", "string"), {"b": False}, "false"),
    (CAST("/x", "string"), {"x": 12.0}, "12"),
    (CAST("/x", "string"), {"x": 0.25}, "0.25"),
    (CAST("/x", "integer"), {"x": 12.5}, "!TYPE_MISMATCH"),
    (CAST("/x", "integer"), {"x": True}, "!TYPE_MISMATCH"),
    ({"op": "if", "condition": G("/b"), "then": L("yes"), "otherwise": L("no")}, {"b": False}, "no"),
    ({"op": "if", "condition": G("/b"), "then": L("yes"), "otherwise": L("no")}, {"b": None}, "!TYPE_MISMATCH"),
    ({"op": "if", "condition": L(True), "then": L(1), "otherwise": BIN("divide", L(1), L(0))}, {}, 1),
    (BIN("equals", L(1), L(1.0)), {}, True),
    (BIN("equals", L({"a": 1, "b": [2, 3]}), L({"b": [2.0, 3.0], "a": 1.0})), {}, True),
    (BIN("equals", L("1"), L(1)), {}, False),
    (BIN("equals", L(None), L(None)), {}, True),
    ({"op": "not", "value": L(False)}, {}, True),
    ({"op": "and", "operands": [L(True), L(True)]}, {}, True),
    ({"op": "or", "operands": [L(False), L(True)]}, {}, True),
    ({"op": "or", "operands": [L(True), BIN("divide", L(1), L(0))]}, {}, "!DIVIDE_BY_ZERO"),
    ({"op": "lookup", "key": G("/t"), "values": {"A": "alpha"}, "default": L("unknown")}, {"t": "B"}, "unknown"),
    ({"op": "lookup", "key": G("/t"), "values": {"A": "alpha"}}, {"t": "B"}, None),
    ({"op": "lookup", "key": G("/t"), "values": {"A": "alpha"}, "default": G("/gone")}, {"t": "A"}, "alpha"),
    (BIN("add", L(0.1), L(0.2)), {}, 0.30000000000000004),
    (BIN("subtract", L(5), L(2)), {}, 3),
    (BIN("multiply", L(2.5), L(4)), {}, 10),
    (BIN("divide", L(7), L(2)), {}, 3.5),
    (BIN("divide", G("/a"), G("/b")), {"a": 1, "b": 0}, "!DIVIDE_BY_ZERO"),
    (BIN("add", G("/a"), L(1)), {"a": "1"}, "!TYPE_MISMATCH"),
    (BIN("multiply", G("/a"), L(2)), {"a": 9007199254740991}, "!NUMERIC_PRECISION_RISK"),
    ({"op": "round", "value": L(2.5)}, {}, 3),
    ({"op": "round", "value": L(-2.5)}, {}, -3),
    ({"op": "round", "value": L(1.005), "digits": 2}, {}, 1.0),
    (DATE("2026-08-12T12:00:00.1239Z"), {}, "2026-08-12T12:00:00.123Z"),
    (DATE("2026-08-12T12:00:00-04:00"), {}, "2026-08-12T16:00:00.000Z"),
    (DATE("2026-08-12T12:00:00+01:00"), {}, "2026-08-12T11:00:00.000Z"),
    (DATE("2026-08-12T12:00:00+19:30"), {}, "2026-08-11T16:30:00.000Z"),
    ({"op": "format_date", "value": L("2026-08-12T12:34:56.789Z"), "pattern": "YYYY/YYYY-MM-MM-DD-DDThh:hh:mm:mm:ss:ss.SSS/SSSZ"}, {}, "2026/2026-08-08-12-12T12:12:34:34:56:56.789/789Z"),
    (G("/missing"), {}, "!SOURCE_PATH_NOT_FOUND"),
    (G("/a/1"), {"a": [5, 6]}, 6),
    (G("/a/2"), {"a": [5, 6]}, "!SOURCE_PATH_NOT_FOUND"),
    (G("/o/x"), {"o": None}, "!SOURCE_PATH_NOT_FOUND"),
    (G("", "current"), {}, "!INVALID_EXPRESSION"),
    ({"op": "map", "collection": G("/n"), "expression": L(1)}, {"n": None}, "!TYPE_MISMATCH"),
    ({"op": "map", "collection": G("/a"), "expression": BIN("divide", L(1), G("", "current"))}, {"a": [1, 0]}, "!DIVIDE_BY_ZERO"),
    *[(CAST("/t", "number"), {"t": t}, "!TYPE_MISMATCH") for t in ("", " 1", "0x10", "Infinity", "1_000", "1d", "1e999")],
    (CAST("/t", "integer"), {"t": "9007199254740992"}, "!NUMERIC_PRECISION_RISK"),
    (BIN("add", G("/n"), L(1)), {"n": HUGE}, "!NUMERIC_PRECISION_RISK"),
    (BIN("equals", G("/n"), G("/n")), {"n": HUGE}, "!NUMERIC_PRECISION_RISK"),
    (CAST("/n", "number"), {"n": HUGE}, "!NUMERIC_PRECISION_RISK"),
    *[(DATE(d), {}, "!INVALID_DATE") for d in ("2026-08-12 12:00:00+00:00", "2026-13-01T00:00:00Z", "2026-02-30T12:00:00Z", "2026-08-12T12:00:60Z", "2026-08-12T12:00:00", "2026-08-12T24:00:00Z", "2026-08-12T12:00:00+24:00")],
    ({"op": "format_date", "value": L("2026-08-12T12:00:00.000Z"), "pattern": "YY-MM-DD"}, {}, "!INVALID_DATE"),
]


def plain(x):
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def scope_of(document):
    c, t = values.literal({k: (math.inf if isinstance(v, int) and abs(v) > 2**63 else v) for k, v in document.items()})
    return Scope(Typed(c, None, t))


def test_cases(spark):
    cols = []
    for i, (raw, document, _) in enumerate(CASES):
        made = limited(compile_expression(expressions.parse(raw), scope_of(document))).masked()
        cols += [F.struct(made.value.alias("v")).alias(f"v{i}"), made.code.alias(f"e{i}")]
    row = spark.range(1).select(*cols).first()
    for i, (raw, _, expected) in enumerate(CASES):
        if isinstance(expected, str) and expected.startswith("!"):
            assert row[f"e{i}"] == expected[1:], raw
        else:
            assert row[f"e{i}"] is None and plain(row[f"v{i}"]["v"]) == expected, (raw, row[f"e{i}"], row[f"v{i}"])


@pytest.mark.parametrize("raw", [{"op": "nope"}, {"op": "get"}, {"op": "get", "path": "/a", "x": 1}, {"op": "and", "operands": [L(True)]}, {"op": "round", "value": L(1), "digits": 13}])
def test_refused(raw):
    with pytest.raises(ValueError):
        expressions.parse(raw)


def test_depth_limit():
    raw = L(True)
    for _ in range(65):
        raw = {"op": "not", "value": raw}
    with pytest.raises(ValueError, match="EVALUATION_LIMIT"):
        expressions.parse(raw)


def test_array_limit(spark):
    made = compile_expression(expressions.parse({"op": "map", "collection": G("/a"), "expression": G("", "current")}), Scope(Typed(F.struct(F.sequence(F.lit(1), F.lit(10001)).alias("a")), None, T.StructType([T.StructField("a", T.ArrayType(T.LongType()))]))))
    assert spark.range(1).select(made.code).first()[0] == "EVALUATION_LIMIT_EXCEEDED"


INVARIANTS = [
    ({"op": "equals", "left": L(1), "right": L(1.0)}, "ok"), ({"op": "equals", "left": L(1), "right": L(2)}, "failed"),
    ({"op": "not_null", "value": L(None)}, "failed"), ({"op": "in", "value": L("a"), "allowed": ["a", None]}, "ok"),
    ({"op": "matches", "value": L("ab\n"), "pattern": "ab"}, "failed"), ({"op": "matches", "value": L(1), "pattern": "1"}, "unknown"),
    ({"op": "greater_than", "left": L(2), "right": L(1)}, "ok"), ({"op": "less_than", "left": L(True), "right": L(1)}, "unknown"),
    ({"op": "greater_than_or_equal", "left": L(2), "right": L(2)}, "ok"), ({"op": "less_than_or_equal", "left": L(3), "right": L(2)}, "failed"),
    ({"op": "unique", "value": L([1, 2, 1])}, "failed"), ({"op": "unique", "value": L("x")}, "unknown"),
    ({"op": "length_equals", "value": L("😀x"), "expected": 2}, "ok"), ({"op": "length_equals", "value": L({"a": 1}), "expected": 2}, "failed"),
    ({"op": "not_null", "value": G("/gone")}, "unknown"),
]


def test_invariants(spark):
    cols = []
    for i, (body, _) in enumerate(INVARIANTS):
        failed, unknown = holds(Invariant.parse({"id": "i", "assertion": body}), scope_of({}))
        cols.append(F.when(unknown, "unknown").when(failed, "failed").otherwise("ok").alias(f"i{i}"))
    row = spark.range(1).select(*cols).first()
    assert [row[i] for i in range(len(cols))] == [e for _, e in INVARIANTS]
    guarded = Invariant.parse({"id": "g", "when": L("no boolean"), "assertion": {"op": "not_null", "value": L(None)}})
    failed, unknown = holds(guarded, scope_of({}))
    assert spark.range(1).select(failed | unknown).first()[0] is False


def test_modes(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    m = Mapping.parse({"mapping_version": "0.1", "id": "m", "rules": [{"target": "/a/b", "expression": CAST("/t", "integer")}]})
    assert [(r["output"] and r["output"]["a"]["b"], r["err"]) for r in m.transform(df).collect()] == [(1, None), (None, "TYPE_MISMATCH")]
    assert m.transform(df, "ok").count() == 1 and m.transform(df, "quarantine").count() == 1
    with pytest.raises(Exception, match="TYPE_MISMATCH"):
        m.transform(df, "strict").collect()
    with pytest.raises(Exception, match="TYPE_MISMATCH"):
        m.transform(df, "strict").count()  # though no column is read
    assert m.transform(df.where("t = '1'"), "strict").count() == 1
    assert json.loads(json.dumps(m.document()))["rules"][0]["target"] == "/a/b" and len(m.sha256()) == 64
