"""JSON Schema constraints as one column of violations: array<struct<pointer, category>>, in pointer order.

A null where null is no allowed type is a missing field: a violation if the field is required, of ``required-property`` at its
parent. ``format`` isn't enforced. Keywords that can't be compiled are refused.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import issues
from ..functions import values

#: Keywords that are compiled or say nothing about values.
KNOWN = set(
    "type enum const pattern minLength maxLength minItems maxItems uniqueItems minimum maximum exclusiveMinimum exclusiveMaximum multipleOf "
    "required properties items additionalProperties format title description $schema $id $comment examples default x-schema-version deprecated readOnly writeOnly choice".split()
)
ISSUE = "array<struct<pointer:string,category:string>>"


def _fits(t: T.DataType, kinds: set) -> Column | bool:
    return {
        T.LongType: bool({"integer", "number"} & kinds), T.DoubleType: "number" in kinds, T.StringType: "string" in kinds,
        T.BooleanType: "boolean" in kinds, T.ArrayType: "array" in kinds, T.StructType: "object" in kinds, T.NullType: "null" in kinds,
    }.get(type(t), True)


def _not_multiple(c: Column, step: float) -> Column:
    """By whole numbers the remainder counts; by fractions, whether the quotient is whole, since 1.0 / 0.1 is 10 and 1.0 % 0.1 isn't 0."""
    if isinstance(step, int) or float(step).is_integer():
        return c % F.lit(int(step)) != 0
    quotient = c.cast("double") / F.lit(float(step))
    return F.floor(quotient).cast("double") != quotient


def _one(test: Column, path: Column, category: str) -> Column:
    row = F.array(F.struct(path.alias("pointer"), F.lit(category).alias("category")))
    return F.when(F.coalesce(test, F.lit(False)), row).otherwise(F.expr(f"cast(array() as {ISSUE})"))


def _none_of(found: list[Column]) -> Column:
    return F.size(F.concat(*found)) == 0 if found else F.lit(True)


def violations(c: Column, t: T.DataType, node: dict) -> Column:
    """All violations of a document column."""
    found = _violations(values.normal_value(c, t), values.normal_type(t), node, F.lit(""), False)
    whole = F.concat(*found) if found else F.expr(f"cast(array() as {ISSUE})")
    return F.array_sort(whole)


def _violations(c: Column, t: T.DataType, node: dict, path: Column, missing_is_said: bool) -> list[Column]:
    if unknown := set(node) - KNOWN:
        raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, f"the keyword {sorted(unknown)[0]} isn't compiled")
    kinds, out = set(node["type"]), []
    present = c.isNotNull()
    add = lambda test, category: out.append(_one(test, path, category))
    fits = _fits(t, kinds)
    if fits is False and isinstance(t, T.DoubleType) and "integer" in kinds:
        add(present & (c != F.floor(c).cast("double")), "type")
    elif fits is False:
        add(present, "type")
        return out
    if "null" not in kinds and not missing_is_said:
        add(c.isNull(), "type")
    if "choice" in node:  # whatever a branch has against a value, the choice as a whole is what fails
        which, parts = node["choice"]
        fitting = reduce(lambda a, b: a + b, [_none_of(_violations(c, t, p, path, True)).cast("int") for p in parts])
        add(present & ((fitting != 1) if which == "oneOf" else (fitting == 0)), "schema")
        return out
    allowed = node["enum"] if "enum" in node else [node["const"]] if "const" in node else None
    if allowed is not None:
        same = [values.equal(c, t, *values.literal(v)) for v in allowed]
        inside = reduce(lambda a, b: a | b, same, F.lit(False))
        add(present & ~inside, "enum" if "enum" in node else "schema")
    if isinstance(t, T.StringType):
        if "pattern" in node:
            add(~c.rlike(node["pattern"]), "pattern")
        if "minLength" in node:
            add(F.length(c) < node["minLength"], "string-length")
        if "maxLength" in node:
            add(F.length(c) > node["maxLength"], "string-length")
    if isinstance(t, (T.LongType, T.DoubleType)):
        for key, test in (("minimum", lambda m: c < m), ("maximum", lambda m: c > m), ("exclusiveMinimum", lambda m: c <= m), ("exclusiveMaximum", lambda m: c >= m), ("multipleOf", lambda m: _not_multiple(c, node["multipleOf"]))):
            if key in node:
                add(test(F.lit(node[key])), "numeric-range")
    if isinstance(t, T.ArrayType):
        if "minItems" in node:
            add(present & (F.size(c) < node["minItems"]), "array-size")
        if "maxItems" in node:
            add(present & (F.size(c) > node["maxItems"]), "array-size")
        if node.get("uniqueItems"):
            add(present & (F.size(F.array_distinct(c)) < F.size(c)), "array-size")
        if "items" in node:
            def each(x: Column, i: Column) -> Column:
                below = _violations(x, t.elementType, node["items"], F.concat(path, F.lit("/"), i.cast("string")), False)
                return F.concat(*below) if below else F.expr(f"cast(array() as {ISSUE})")

            out.append(F.coalesce(F.flatten(F.transform(c, each)), F.expr(f"cast(array() as {ISSUE})")))
    if isinstance(t, T.StructType):
        needed = set(node.get("required", ()))
        for name in sorted(needed):
            nullable = "null" in node.get("properties", {}).get(name, {"type": ["null"]})["type"]
            if name not in t.names:
                add(present, "required-property")
            elif not nullable:
                add(present & c[name].isNull(), "required-property")
        for name, child in node.get("properties", {}).items():
            if name in t.names:
                escaped = name.replace("~", "~0").replace("/", "~1")
                out += _violations(c[name], t[name].dataType, child, F.concat(path, F.lit("/" + escaped)), True)
        if node.get("additionalProperties") is False:
            for name in sorted(set(t.names) - set(node.get("properties", {}))):
                add(present & c[name].isNotNull(), "additional-property")
    return out


