"""Registered queries of what works on schemas, catalogues and documents, next to those over whole tables in ``queries``.

Where rows come from a table, SQL works the same thing out; where a query only looks at documents given here, its rows are held
against rows written out by hand (``golden``).
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .issues import MappingError
from .operators import assist, matching, metrics, profile, reports, review, static
from .plans.mapping import Mapping, Rule, verify_samples
from .plans.expressions import parse
from .queries import LINE, SOURCE, TARGET, _scored, add, cast, each, get, lit, mapping, orders_with_lines, read, two, when
from .sources.documents import canonical, parse_text, sha256, yaml_text
from .sources.json_schema import Schema, read_openapi, read_schema, units
from .sources.samples import parse_samples
from .sources.shared import shared_dir
from .streaming.stream import error_rates, mapped_stream, split_sink


def golden(name: str, schema: str, make: Callable[[SparkSession], list[tuple]], rows: list[tuple]) -> None:
    """A query over given documents, and the rows that it has to give."""

    def text(v: Any) -> str:
        if v is None:
            return "null"
        return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    columns = [c.split() for c in schema.split(", ")]
    types = {"string": "varchar", "long": "bigint", "int": "int", "double": "double", "boolean": "boolean"}
    cells = ", ".join(f"cast({n} as {types[t]}) as {n}" for n, t in columns)
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    add(name, lambda spark, _: spark.createDataFrame(make(spark), schema), f"select {cells} from (values {values}) as given({', '.join(n for n, _ in columns)})")


# --- the language and its envelope


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than a million characters and arrays of more than ten thousand items, of a supplier's own number."""
    df = read(spark, sf_dir, "supplier").select("s_suppkey", F.expr("repeat('x', cast(s_suppkey % 13 * 100000 as int))").alias("t"), F.expr("sequence(1, cast(s_suppkey % 7 * 2000 + 1 as int))").alias("many"))
    long = mapping({"/v": {"op": "concat", "operands": [get("t"), lit("y")]}}).transform(df).select("s_suppkey", F.lit("characters").alias("what"), "err")
    wide = mapping({"/v": {"op": "map", "collection": get("many"), "expression": get("", "current")}}).transform(df).select("s_suppkey", F.lit("items").alias("what"), "err")
    deep = mapping({"/v": {"op": "array", "items": [{"op": "map", "collection": get("many"), "expression": lit(1)}] * 12}}).transform(df.where("s_suppkey % 7 < 5")).select("s_suppkey", F.lit("nodes").alias("what"), "err")
    return long.unionByName(wide).unionByName(deep)


_OVER = "case when {} then 'EVALUATION_LIMIT_EXCEEDED' end as err from supplier"
add("op_limits", limits, f"""select s_suppkey, 'characters' as what, {_OVER.format('s_suppkey % 13 * 100000 + 1 > 1000000')}
union all select s_suppkey, 'items', {_OVER.format('s_suppkey % 7 * 2000 + 1 > 10000')}
union all select s_suppkey, 'nodes', {_OVER.format('12 * (s_suppkey % 7 * 2000 + 1) + 13 > 100000')} where s_suppkey % 7 < 5""")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read from JSON: a field that isn't there is an error, a null that is written there is a null."""
    seg = "case c_custkey % 3 when 0 then '' when 1 then ',\"seg\":null' else concat(',\"seg\":\"', c_mktsegment, '\"') end"
    df = read(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('{{\"name\":\"', c_name, '\"', {seg}, '}}')").alias("j"))
    df = df.select("c_custkey", F.from_json("j", "name string, seg string").alias("doc"), F.parse_json("j").alias("raw"))
    rules = {"/v": get("seg"), "/w": {"op": "coalesce", "operands": [get("seg"), lit("none")]}}
    return mapping(rules).transform(df, input_column="doc", raw="raw").select("c_custkey", F.col("output.v").alias("v"), F.col("output.w").alias("w"), "err")


add("op_get_presence", presence, """select c_custkey, case when c_custkey % 3 = 2 then c_mktsegment end as v, case c_custkey % 3 when 1 then 'none' when 2 then c_mktsegment end as w,
  case when c_custkey % 3 = 0 then 'SOURCE_PATH_NOT_FOUND' end as err from customer""")  # fmt: skip

TABLE = {str(k): f"n{k % 7}" for k in range(3000)}


def lookup_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of 3,000 entries: joined, with its default where no entry is."""
    df = read(spark, sf_dir, "lineitem").select(*LINE, "l_quantity")
    raw = {"op": "lookup", "key": cast(get("l_partkey"), "string"), "values": TABLE, "default": when(two("equals", get("l_quantity"), lit(1)), lit("one"), {"op": "concat", "operands": [lit(5)]})}
    return mapping({"/v": raw}).transform(df).select(*LINE, F.col("output.v").alias("v"), "err")


add("op_lookup_broadcast", lookup_broadcast, f"""select {', '.join(LINE)}, case when l_partkey < 3000 then 'n' || l_partkey % 7 when l_quantity = 1 then 'one' end as v,
  case when l_partkey >= 3000 and l_quantity <> 1 then 'TYPE_MISMATCH' end as err from lineitem""")  # fmt: skip


def map_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map in a map: flags of the lines of orders."""
    df = orders_with_lines(spark, sf_dir).withColumn("items", F.expr("transform(items, i -> struct(i.lineNumber, array(i.warehouse, coalesce(i.unit, '?')) as tags))"))
    inner = {"op": "map", "collection": get("tags", "current"), "expression": {"op": "concat", "operands": [get("", "current"), lit("!")]}}
    out = mapping({"/v": each("items", {"n": get("lineNumber", "current"), "tags": inner})}).transform(df)
    return out.select("orderKey", F.explode("output.v").alias("l")).select("orderKey", F.col("l.n").alias("n"), F.posexplode("l.tags").alias("i", "tag"))


add("op_map_nested", map_nested, """select l_orderkey as "orderKey", cast(l_linenumber as bigint) as n, i, tag || '!' as tag from (
  select l_orderkey, l_linenumber, unnest([0, 1])::int as i, unnest([l_linestatus, case l_returnflag when 'N' then 'DZ' when 'A' then 'EA' else '?' end]) as tag
  from lineitem where l_orderkey in (select o_orderkey from orders))""")  # fmt: skip


# --- modes, guards, samples


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mode keeps of quotients by a discount that may be zero; strict sees only rows that can't fail."""
    df = read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount")
    m = mapping({"/v": two("divide", get("l_extendedprice"), get("l_discount"))})
    one = lambda mode, rows: m.transform(rows, mode).groupBy("err").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "err", "n")
    return one("ok", df).unionByName(one("quarantine", df)).unionByName(one("report", df)).unionByName(one("strict", df.where("l_discount > 0")))


add("mode_counts", modes, """with e as (select case when l_discount = 0 then 'DIVIDE_BY_ZERO' end as err from lineitem)
select 'ok' as mode, err, count(*) as n from e where err is null group by err union all select 'quarantine', err, count(*) from e where err is not null group by err
union all select 'report', err, count(*) from e group by err union all select 'strict', err, count(*) from e where err is null group by err""")  # fmt: skip


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invariant under a guard: only returned lines need a quantity above 25; a guard that can't be worked out fails."""
    df = read(spark, sf_dir, "lineitem").select(*LINE, "l_returnflag", "l_quantity", F.expr("if(l_linenumber = 7, null, l_returnflag = 'R')").alias("back"))
    guard = {"op": "and", "operands": [get("back"), lit(True)]}
    check = {"id": "enough", "when": guard, "assertion": two("greater_than", get("l_quantity"), lit(25))}
    return mapping({"/k": get("l_orderkey")}, [check]).transform(df).select(*LINE, F.col("err").isNull().alias("ok"))


add("inv_when", guarded, f"select {', '.join(LINE)}, l_linenumber <> 7 and (l_returnflag <> 'R' or l_quantity > 25) as ok from lineitem")


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of samples made of customers: without an id, with a repeated one, with both or neither of the expectations, not JSON."""
    line = """case when c_custkey % 11 = 0 then 'no json' else concat('{', case c_custkey % 5 when 0 then '' when 1 then '"id":"twice",' else concat('"id":"', c_custkey, '",') end, '"input":{"a":"', c_name, '"}',
      case c_custkey % 7 when 0 then '' when 1 then ',"expected":null' when 2 then ',"expected":{"b":"x"},"expected_error":"E"' when 3 then ',"expected_error":"E"' else ',"expected":{"b":"x"}' end, '}') end"""
    lines = read(spark, sf_dir, "customer").select(F.expr(line).alias("value"))
    text = lambda n: read_schema({"type": "object", "properties": {n: {"type": "string"}}}, n)
    return parse_samples(lines, text("a"), text("b")).groupBy("problem", "has_expected", "expected_error").agg(F.count("*").alias("n"), F.count("expected.b").alias("given"), F.count("input.a").alias("inputs"))


add("samples_lines", sample_lines, """with c as (select c_custkey % 5 as i, c_custkey % 7 as e, c_custkey % 11 = 0 as broken from customer), p as (
  select broken, e, case when broken then 'not JSON' when i = 0 then 'no id' when i = 1 and (select count(*) from c where i = 1 and not broken) > 1 then 'repeated id' when e in (0, 2) then 'one expectation is needed' end as problem from c)
select problem, not broken and e not in (0, 3) as has_expected, case when not broken and e in (2, 3) then 'E' end as expected_error, count(*) as n,
  count(*) filter (not broken and e in (2, 4, 5, 6)) as given, count(*) filter (not broken) as inputs from p group by 1, 2, 3""")  # fmt: skip


def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs held against expected documents, some of which are wrong, some of which aren't there."""
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("due")).alias("input"))
    expected = read(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").cast("string").alias("id"), F.struct(F.expr("if(c_custkey % 7 = 0, 'other', c_name)").alias("name"), F.expr("c_acctbal * 2").alias("twice")).alias("expected"))
    source = read_schema({"type": "object", "required": ["name", "due"], "properties": {"name": {"type": "string"}, "due": {"type": "number", "minimum": 0}}}, "s")
    target = read_schema({"type": "object", "required": ["name", "twice"], "properties": {"name": {"type": "string"}, "twice": {"type": "number", "maximum": 15000}}}, "t")
    m = mapping({"/name": get("name"), "/twice": two("multiply", get("due"), lit(2))})
    return verify_samples(m, df, source, target, expected).select("id", "err", F.size("issues").cast("long").alias("n"))


add("samples_golden", golden_compare, """select c_custkey::varchar as id, case when c_acctbal < 0 then 'SOURCE_SCHEMA_VALIDATION' when c_acctbal * 2 > 15000 then 'TARGET_SCHEMA_VALIDATION' when c_custkey % 4 > 0 and c_custkey % 7 = 0 then 'GOLDEN_OUTPUT_MISMATCH' end as err,
  case when c_acctbal < 0 then 1 else (c_acctbal * 2 > 15000)::bigint + (c_custkey % 4 > 0 and c_custkey % 7 = 0)::bigint end as n from customer""")  # fmt: skip


# --- schemas and documents

_T = {"type": "string"}
SCHEMAS: dict[str, Callable[[], Schema]] = {
    "ref": lambda: read_schema({"$defs": {"p": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}, "type": "object", "properties": {"a": {"$ref": "#/$defs/p"}}}),
    "allOf": lambda: read_schema({"type": "object", "properties": {"n": {"allOf": [{"type": "number"}, {"minimum": 2}]}, "o": {"allOf": [{"properties": {"p": _T}, "required": ["p"]}, {"properties": {"q": _T}}]}}}),
    "anyOf": lambda: read_schema({"type": "object", "properties": {"d": {"anyOf": [_T, {"type": "null"}]}, "e": {"oneOf": [{"type": "integer"}, {"type": "boolean"}]}}}),
    "array": lambda: read_schema({"type": "object", "required": ["l"], "properties": {"l": {"type": "array", "items": {"type": "object", "required": ["s"], "properties": {"s": _T}}}}}),
    "guess": lambda: read_schema({"properties": {"c": {"const": 3}, "e": {"enum": ["a", None]}, "l": {"items": _T}, "any": {}}}),
    "yaml": lambda: read_schema(parse_text("type: object\nrequired: [day]\nproperties:\n  day: {type: string, format: date}\n  n: {type: [integer, 'null']}\n", True)),
    "openapi": lambda: read_openapi({"openapi": "3.1.0", "info": {"version": "7"}, "components": {"schemas": {"X": {"type": "object", "properties": {"a": _T}}}}, "paths": {"/p": {"post": {"operationId": "op", "responses": {"201": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/X"}}}}}}}}}, "response:op:201"),
}
golden("schema_catalogue", "document string, pointer string, types string, required boolean", lambda spark: [(n, f.pointer, ",".join(sorted(f.types)), f.required) for n, make in SCHEMAS.items() for f in make().fields if f.pointer], [
    ("ref", "/a", "object", False), ("ref", "/a/x", "integer", True), ("allOf", "/n", "number", False), ("allOf", "/o", "object", False), ("allOf", "/o/p", "string", True), ("allOf", "/o/q", "string", False),
    ("anyOf", "/d", "null,string", False), ("anyOf", "/e", "boolean,integer", False), ("array", "/l", "array", True), ("array", "/l/items", "object", False), ("array", "/l/items/s", "string", True),
    ("guess", "/any", "array,boolean,integer,null,number,object,string", False), ("guess", "/c", "integer", False), ("guess", "/e", "null,string", False), ("guess", "/l", "array", False), ("guess", "/l/items", "string", False),
    ("yaml", "/day", "string", True), ("yaml", "/n", "integer,null", False), ("openapi", "/a", "string", False),
])


def refused(make: Callable[[], Any]) -> str | None:
    try:
        make()
    except MappingError as why:
        return why.codes[0]
    return None


REFUSED: dict[str, Callable[[], Any]] = {
    "remote": lambda: read_schema({"$ref": "http://x/y"}), "cycle": lambda: read_schema({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}), "nullable": lambda: read_schema(_T | {"nullable": True}),
    "union of objects": lambda: read_schema({"oneOf": [{"type": "object", "properties": {"a": _T}}, {"type": "null"}]}), "conflict": lambda: read_schema({"allOf": [_T, {"type": "integer"}]}),
    "dialect": lambda: read_schema({"$schema": "http://json-schema.org/draft-07/schema#"}), "old api": lambda: read_openapi({"openapi": "3.0.0"}, "component:X"),
    "repeated key": lambda: parse_text('{"a":1,"a":2}'), "yaml tag": lambda: parse_text("a: !!python/object:x {}", True), "not a number": lambda: canonical({"a": float("nan")}),
    "version": lambda: Mapping.parse({"mapping_version": "9"}), "operator": lambda: parse({"op": "eval"}), "depth": lambda: parse(_deep(66)), "fine": lambda: read_schema(_T),
    "hints of a version": lambda: matching.check_hints({"hints_version": "2"}), "hints of a kind": lambda: matching.check_hints({"guesses": []}), "hint without source": lambda: matching.check_hints({"direct": [{"target": "/a"}]}),
    "hints": lambda: matching.check_hints({"hints_version": "0.1", "id": "h"} | HINTS), "report": lambda: matching.Report.parse([{"target_path": "/a"}]), "review with a source": lambda: review.check_document({"suggestion_report_sha256": "x", "decisions": [{"target_path": "/a", "action": "defer", "source_path": "/b"}]}),
    "review unbound": lambda: review.check_document({"decisions": []}), "samples twice": lambda: _pack_of([{"id": "a", "expected": 1}] * 2), "sample with both": lambda: _pack_of([{"id": "a", "expected": 1, "expected_error": "E"}]), "truth of no unit": lambda: _pack_of([{"id": "a", "expected": 1}], ["/gone"]), "pack": lambda: pack().reconcile(),
}


def _pack_of(samples: list[dict], no_match: list[str] | None = None) -> None:
    own = pack()
    metrics.Pack(own.id, own.source, own.target, own.truth, own.hints, own.review, tuple(samples), own.manifest | ({"expected_no_match_targets": no_match} if no_match else {})).reconcile()


def _deep(n: int) -> dict:
    return lit(True) if not n else {"op": "not", "value": _deep(n - 1)}


golden("documents_refused", "document string, code string", lambda spark: [(n, refused(make)) for n, make in REFUSED.items()], [
    ("remote", "REMOTE_REF_DISABLED"), ("cycle", "CYCLIC_REF"), ("nullable", "UNSUPPORTED_SCHEMA_FEATURE"), ("union of objects", "UNSUPPORTED_SCHEMA_FEATURE"), ("conflict", "UNSUPPORTED_SCHEMA_FEATURE"),
    ("dialect", "UNSUPPORTED_SCHEMA_FEATURE"), ("old api", "UNSUPPORTED_SCHEMA_FEATURE"), ("repeated key", "INVALID_INPUT"), ("yaml tag", "INVALID_INPUT"), ("not a number", "INVALID_INPUT"),
    ("version", "UNSUPPORTED_MAPPING_VERSION"), ("operator", "INVALID_EXPRESSION"), ("depth", "EVALUATION_LIMIT_EXCEEDED"), ("fine", None),
    ("hints of a version", "INVALID_INPUT"), ("hints of a kind", "INVALID_INPUT"), ("hint without source", "INVALID_INPUT"), ("hints", None), ("report", "INVALID_INPUT"), ("review with a source", "INVALID_INPUT"),
    ("review unbound", "INVALID_INPUT"), ("samples twice", "INVALID_INPUT"), ("sample with both", "INVALID_INPUT"), ("truth of no unit", "INVALID_INPUT"), ("pack", None),
])


def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical texts and hashes of a document for each nation (a few dozen rows)."""
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    made = [{"name": r["n_name"], "key": float(r["n_nationkey"]), "half": r["n_nationkey"] / 2, "list": [None, True]} for r in rows]
    return spark.createDataFrame([(r["n_nationkey"], canonical(d), sha256(d)) for r, d in zip(rows, made)], "n_nationkey int, text string, hash string")


_CANON = """'{"half":' || case when n_nationkey % 2 = 0 then (n_nationkey // 2)::varchar else (n_nationkey / 2)::varchar end || ',"key":' || n_nationkey || ',"list":[null,true],"name":"' || n_name || '"}'"""
add("documents_canonical", canonical_rows, f"select n_nationkey, text, sha256(text) as hash from (select n_nationkey, {_CANON} as text from nation)")


def _round_trip() -> list[tuple]:
    raw = {"mapping_version": "0.1", "id": "m", "source_schema": "s", "rules": [{"target": "/a", "expression": get("x"), "confidence": 0.5}], "invariants": [{"id": "i", "when": get("b"), "assertion": {"op": "in", "value": get("a", "output"), "allowed": [1, None]}}]}
    m = Mapping.parse(raw)
    other = Mapping.parse(raw | {"invariants": []})
    back = Mapping.parse(parse_text(yaml_text(m.document()), True))
    return [("json", Mapping.parse(parse_text(canonical(m.document()))) == m), ("yaml", back == m), ("hash", back.sha256() == m.sha256()), ("invariants in the hash", other.sha256() != m.sha256())]


golden("documents_mapping", "what string, same boolean", lambda spark: _round_trip(), [("json", True), ("yaml", True), ("hash", True), ("invariants in the hash", True)])


# --- validation and profiles

MORE = read_schema({"type": "object", "properties": {
    "orderKey": {"type": "integer", "multipleOf": 2, "const": 4}, "due": {"type": "number", "multipleOf": 0.1}, "day": {"type": "string", "format": "date", "minLength": 4}, "status": {"anyOf": [{"type": "string", "maxLength": 9}, {"type": "null"}]}, "size": {"oneOf": [{"type": "integer", "minimum": 3}, {"type": "integer", "maximum": 5}]},
    "flags": {"type": "array", "minItems": 2, "maxItems": 4, "uniqueItems": True, "items": {"type": "string", "enum": ["O", "F"]}},
}}, "more")


def validate_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linestatus")).alias("flags"))
    df = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.select(F.col("o_orderkey").alias("orderKey"), F.expr("cast(o_custkey as double) / 10").alias("due"), F.lit("no date").alias("day"), F.expr("if(o_orderstatus = 'P', null, o_orderpriority)").alias("status"), F.size("flags").alias("size"), "flags")
    out = mapping({"/k": get("orderKey")}).transform(df, source=MORE).select(F.explode("issues").alias("i"))
    return out.groupBy(F.regexp_replace("i.pointer", "[0-9]+", "N").alias("pointer"), F.col("i.detail").alias("category")).agg(F.count("*").alias("n"))


add("validate_more", validate_more, """with o as (select o_orderkey as k, o_custkey::double / 10 as due, case when o_orderstatus <> 'P' then o_orderpriority end as status, list(l_linestatus) as flags
  from orders join lineitem on l_orderkey = o_orderkey group by all), v as (
  select '/orderKey' as pointer, 'numeric-range' as category from o where k % 2 <> 0 union all select '/orderKey', 'schema' from o where k <> 4
  union all select '/due', 'numeric-range' from o where floor(due / 0.1::double) <> due / 0.1::double
  union all select '/status', 'schema' from o where length(status) > 9 union all select '/size', 'schema' from o where len(flags) between 3 and 5
  union all select '/flags', 'array-size' from o where len(flags) < 2 union all select '/flags', 'array-size' from o where len(flags) > 4 union all select '/flags', 'array-size' from o where len(list_distinct(flags)) < len(flags)
  union all select '/flags/N', 'enum' from (select unnest(flags) as f from o) where f not in ('O', 'F')
) select pointer, category, count(*) as n from v group by 1, 2""")  # fmt: skip


def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON documents that are missing, null, of several types, of several classes."""
    made = """concat('{"k":', case c_custkey % 3 when 0 then string(c_custkey) when 1 then '"a"' else 'null' end, case when c_custkey % 4 = 0 then '' else concat(',"d":"', case when c_custkey % 2 = 0 then '2024-01-01' else concat(c_custkey, '.5') end, '"') end, '}')"""
    df = read(spark, sf_dir, "customer").select(F.expr(made).alias("j")).select(F.from_json("j", "k string, d string").alias("doc"), F.parse_json("j").alias("raw"))
    out = profile.profile(df.select("doc.*", "raw"), raw="raw")
    return out.select("pointer", "sample_count", "missing_count", "null_count", F.array_join("observed_types", ",").alias("types"), "distinct_count", F.array_join("pattern_classes", ",").alias("classes"))


add("profile_missing", profile_missing, """select '/d' as pointer, count(*) as sample_count, count(*) filter (c_custkey % 4 = 0) as missing_count, 0::bigint as null_count, 'string' as types,
  count(distinct c_custkey) filter (c_custkey % 2 = 1) + 1 as distinct_count, 'decimal-string,iso-date' as classes from customer
union all select '/k', count(*), 0, count(*) filter (c_custkey % 3 = 2), 'null,string', count(distinct c_custkey) filter (c_custkey % 3 = 0) + 1, 'integer-string,lowercase-word' from customer""")  # fmt: skip


# --- matching

_SHAPES = ["null", "boolean", "integer", "number", "string", "array", "object", "integer,null", "object,string", "null,string"]


def type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility of all pairs of type lists, with and without enums and requirement."""
    lists = spark.createDataFrame([(x,) for x in _SHAPES], "x string")
    one = lambda p: lists.select(F.col("x").alias(p), F.split("x", ",").alias(p + "_types"), F.array().cast("array<string>").alias(p + "_enum"))
    pairs = one("s").crossJoin(F.broadcast(one("t"))).withColumn("t_required", F.explode(F.array(F.lit(True), F.lit(False))))
    return pairs.select("s", "t", "t_required", matching.compatibility().alias("score"))


add("match_types", type_pairs, f"""with l as (select unnest({_SHAPES!r}) as x), p as (select a.x as s, b.x as t, r as t_required, string_split(a.x, ',') as st, string_split(b.x, ',') as tt from l a, l b, (select unnest([true, false]) as r))
select s, t, t_required, case when list_contains(st, 'object') and len(list_filter(st, lambda y: y not in ('object', 'null'))) > 0 or list_contains(st, 'array') <> list_contains(tt, 'array') or s = 'null' and t_required and not list_contains(tt, 'null') then null
  when len(list_intersect(st, tt)) = len(st) then 1.0::double when len(list_intersect(st, tt)) > 0 then 0.8::double when list_contains(st, 'integer') and list_contains(tt, 'number') then 0.9::double
  when list_contains(st, 'string') and list_contains(tt, 'number') then 0.4::double end as score from p""")  # fmt: skip

#: The features of ``SOURCE`` and ``TARGET``: path, words of the name, description, type; every field is required, none has parents or an enum.
_FEATURES = {
    "s": [("/custId", "cust identifier", "customer identifier", "string"), ("/custName", "cust name", "name of the customer", "string"), ("/balance", "balance", "account balance", "number"), ("/segment", "segment", "market segment", "string"), ("/nation", "nation", "nation key", "integer")],
    "t": [("/customerIdentifier", "customer identifier", "customer identifier", "string"), ("/name", "name", "customer name", "string"), ("/accountBalance", "account balance", "balance of the account", "number"), ("/marketSegment", "market segment", "segment", "string"), ("/country", "country", "country name", "string")],
}
_SCORES = "with recursive " + ", ".join(f"{k} as (select * from (values {', '.join(str(r) for r in rows)}) as x(path, name, said, kind))" for k, rows in _FEATURES.items()) + """,
texts as (select distinct a, b from (select s.name as a, t.name as b from s, t union all select s.said, t.said from s, t)),
lcs as (select a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda j: 0) as r from texts union all
  select a, b, i + 1, list_transform(range(0, len(b) + 1), lambda j: case when j = 0 then 0 else list_max(list_transform(range(1, j + 1), lambda k: case when a[i + 1] = b[k] then r[k] + 1 else r[k + 1] end)) end) from lcs where i < len(a)),
likeness as (select a, b, 2.0::double * r[-1] / (len(a) + len(b)) as v from lcs where i = len(a)),
pairs as (select s.path as source_path, t.path as target_path, list_sort(string_split(s.name, ' ')) = list_sort(string_split(t.name, ' ')) as same, n.v as by_name, d.v as by_text,
  list_contains(string_split(t.name || ' ' || t.said, ' '), 'identifier') as wants, list_contains(string_split(s.name || ' ' || s.said, ' '), 'identifier') as has,
  case when s.kind = t.kind then 1.0::double when s.kind = 'integer' and t.kind = 'number' then 0.9::double when s.kind = 'string' and t.kind = 'number' then 0.4::double end as kinds
  from s, t, likeness n, likeness d where n.a = s.name and n.b = t.name and d.a = s.said and d.b = t.said),
scored as (select source_path, target_path, case when same then 1.0::double else 0.0::double end as exact_name, case when same then 1.0::double else by_name end as name_similarity, case when wants and not has then 0.0::double else by_text end as description_similarity,
  kinds as type_compatibility, 0.0::double as enum_overlap, case when wants and not has then 0.0::double else 1.0::double end as structural_context, 0.0::double as sample_profile from pairs where kinds is not null or true)
"""
_RAW = "round_even(0.4::double * exact_name + 0.2::double * name_similarity + 0.15::double * description_similarity + 0.15::double * type_compatibility + 0.05::double * structural_context, 12)"
add("match_candidates", lambda s, d: _scored(s), f"{_SCORES} select *, {_RAW} as raw_score from scored where type_compatibility is not null")
add("match_topk", lambda s, d: matching.top_candidates(_scored(s), 2).select("target_path", "source_path", "raw_score", "rank"),
    f"{_SCORES}, raw as (select target_path, source_path, {_RAW} as raw_score from scored where type_compatibility is not null) select target_path, source_path, raw_score, k::int as rank from (select *, row_number() over (partition by target_path order by raw_score desc, source_path) as k from raw) where k <= 2")

HINTS = {
    "direct": [{"source": "/custName", "target": "/name"}], "lookups": [{"source": "/segment", "target": "/marketSegment", "values": {"A": "a"}, "default": "z"}],
    "unit_conversions": [{"value_source": "/balance", "unit_source": "/segment", "target": "/accountBalance", "factors": {"K": 1000.0, "H": 0.5}}], "dates": [{"source": "/custId", "target": "/country", "pattern": "YYYY"}],
    "constants": [{"target": "/country", "value": "US"}], "expressions": [{"target": "/gone", "expression": lit(1)}],
}
_GET = '{"document":"input","op":"get","path":"%s"}'
golden("match_hints", "target string, expression string", lambda spark: [(r.target, canonical(r.expression.document())) for r in matching.hint_rules(HINTS)], [
    ("/name", _GET % "/custName"), ("/marketSegment", '{"default":{"op":"literal","value":"z"},"key":' + _GET % "/segment" + ',"op":"lookup","values":{"A":"a"}}'),
    ("/accountBalance", '{"op":"cast","target_type":"integer","value":{"left":' + _GET % "/balance" + ',"op":"multiply","right":{"key":' + _GET % "/segment" + ',"op":"lookup","values":{"H":0.5,"K":1000}}}}'),
    ("/country", '{"op":"format_date","pattern":"YYYY","value":{"op":"parse_date","value":' + _GET % "/custId" + "}}"), ("/country", '{"op":"literal","value":"US"}'), ("/gone", '{"op":"literal","value":1}'),
])


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome for every unit of the target, without and with hints."""
    rows = [(x.target_path, x.disposition, x.band, x.source_path, h) for h, hints in ((False, None), (True, HINTS)) for x in matching.suggest(spark, SOURCE, TARGET, hints).suggestions]
    return spark.createDataFrame(rows, "target string, disposition string, band string, source string, hinted boolean")


_DECIDED = f"""{_SCORES}, raw as (select *, {_RAW} as raw_score from scored where type_compatibility >= 0.9),
r as (select *, row_number() over w as k, lead(raw_score) over w as nxt from raw window w as (partition by target_path order by raw_score desc, source_path)), m as (select *, coalesce(raw_score - nxt, 1.0) as margin from r where k = 1),
d as (select target_path, source_path, case when raw_score >= 0.9 then 'high' when raw_score >= 0.7 then 'medium' when raw_score >= 0.4 then 'low' else 'none' end as band,
  case when raw_score < 0.4 then 'no_match' when nxt is not null and margin <= 0.08 then 'ambiguous' when raw_score >= 0.9 and margin >= 0.12 then 'suggested' when raw_score < 0.9 or margin > 0.08 then 'review_required' else 'no_match' end as disposition from m),
o as (select t.path as target, h as hinted, h and t.path in ('/name', '/marketSegment', '/country', '/accountBalance') as manual, d.* from t left join d on d.target_path = t.path, (select unnest([false, true]) as h)),
outcomes as (select target, case when manual then 'manual' else coalesce(disposition, 'no_match') end as disposition, case when manual then 'none' else coalesce(band, 'none') end as band,
  case when not manual and disposition in ('suggested', 'review_required') then source_path end as source, hinted from o)"""
add("match_suggest", suggested, f"{_DECIDED} select * from outcomes")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = matching.suggest(spark, SOURCE, TARGET, HINTS).counts()
    return spark.createDataFrame([(kind, name, n) for kind, own in counts.items() for name, n in own.items() if n], "kind string, name string, n long")


add("match_summary", summary, f"{_DECIDED} select 'confidence' as kind, band as name, count(*) as n from outcomes where hinted group by 2 union all select 'disposition', disposition, count(*) from outcomes where hinted group by 2")


def coverage(spark: SparkSession) -> list[tuple]:
    report = matching.suggest(spark, SOURCE, TARGET)
    a, b, *rest = report.suggestions
    cases = {"whole": report, "one twice": matching.Report((a, a, b, *rest)), "one gone": matching.Report((b, *rest)), "one more": matching.Report((matching.Suggestion("/more", "no_match"), a, b, *rest))}
    return [(name, *x) for name, r in cases.items() for x in matching.check_coverage(r, TARGET)] + [(name, "none", "") for name, r in cases.items() if not matching.check_coverage(r, TARGET)]


golden("match_coverage", "report string, code string, target string", coverage, [
    ("whole", "none", ""), ("one twice", "SUGGESTION_TARGET_DUPLICATE", "/accountBalance"), ("one gone", "SUGGESTION_TARGET_MISSING", "/accountBalance"), ("one more", "SUGGESTION_TARGET_MISSING", "/more"),
])


# --- static verification

_O = lambda required, **p: {"type": "object", "required": required, "properties": p}
_N, _E = {"type": "number"}, {"type": "string", "enum": ["A", "B"]}
VS = read_schema(_O(["t", "n", "e", "rows", "sure", "plain"], t=_T, n=_N, i={"type": "integer"}, e=_E, maybe=_E, o=_O(["x"], x=_T), sure=_O(["x", "y"], x=_T, y=_T, z=_T), rows={"type": "array", "items": _O(["s", "q"], s=_T, q=_N, m=_T)}, plain={"type": "array", "items": _T}), "s")
VT = read_schema(_O(["t", "l"], t=_T, n=_N, i={"type": "integer"}, e=_E, opt={"type": ["string", "null"]}, p=_O(["x"], x=_T, y=_T), l={"type": "array", "items": _O(["s"], s=_T, q=_N)}), "t")
_ROWS = lambda **f: {"op": "map", "collection": get("rows"), "expression": {"op": "object", "fields": f}}
_OBJ = lambda **f: {"op": "object", "fields": f}
_S = get("s", "current")
RULES: dict[str, tuple[str, dict]] = {
    "fits": ("/t", get("t")), "unknown source": ("/t", get("gone")), "unknown target": ("/gone", get("t")), "type": ("/t", get("n")), "integer is a number": ("/n", lit(3)), "number is no integer": ("/i", get("n")),
    "index": ("/l/0", get("t")), "reads the output": ("/t", get("n", "output")), "current outside": ("/t", get("s", "current")), "optional field": ("/t", get("maybe")), "optional parent": ("/t", get("o/x")),
    "optional into null": ("/opt", get("o/x")), "coalesced": ("/t", {"op": "coalesce", "operands": [get("o/x"), lit("-")]}), "coalesced nulls": ("/t", {"op": "coalesce", "operands": [get("o/x")]}),
    "enum kept": ("/e", get("e")), "enum open": ("/e", get("t")), "enum of branches": ("/e", when(two("equals", get("n"), lit(1)), lit("A"), get("e"))), "enum missed": ("/e", when(two("equals", get("n"), lit(1)), lit("C"), get("e"))),
    "lookup complete": ("/t", {"op": "lookup", "key": get("e"), "values": {"A": "a", "B": "b"}}), "lookup open": ("/t", {"op": "lookup", "key": get("e"), "values": {"A": "a"}}), "lookup default": ("/t", {"op": "lookup", "key": get("t"), "values": {"A": "a"}, "default": lit("z")}),
    "lookup optional key": ("/t", {"op": "lookup", "key": get("maybe"), "values": {"A": "a", "B": "b"}}), "cast loses": ("/n", cast(get("t"), "number")), "cast keeps": ("/i", cast(get("i"), "integer")),
    "object": ("/p", _OBJ(x=get("t"))), "object lacks": ("/p", _OBJ(y=get("t"))), "object has more": ("/p", _OBJ(x=get("t"), z=get("t"))), "object of wrong": ("/p", _OBJ(x=get("n"))), "literal object": ("/p", lit({"x": 1})),
    "read object": ("/p", get("sure")), "read optional object": ("/p", get("o")), "branches of objects": ("/p", when(two("equals", get("n"), lit(1)), _OBJ(x=get("t")), _OBJ(x=get("t"), y=get("t")))), "one branch lacks": ("/p", when(two("equals", get("n"), lit(1)), _OBJ(x=get("t")), _OBJ(y=get("t")))),
    "lookup of objects": ("/p", {"op": "lookup", "key": get("e"), "values": {"A": {"x": "a"}, "B": {"y": "b"}}}), "map": ("/l", _ROWS(s=_S, q=get("q", "current"))), "map lacks": ("/l", _ROWS(q=get("q", "current"))), "map of wrong": ("/l", _ROWS(s=get("q", "current"))),
    "map optional field": ("/l", _ROWS(s=get("m", "current"))), "map over no array": ("/l", {"op": "map", "collection": get("t"), "expression": lit(1)}), "array of literals": ("/l", {"op": "array", "items": [lit({"s": "a"}), lit({"q": 1})]}), "read array": ("/l", get("rows")), "read array of text": ("/l", get("plain")),
}


def rule_findings(spark: SparkSession) -> list[tuple]:
    out = []
    for name, (target, raw) in RULES.items():
        found = sorted({(severity, code, at) for severity, code, at, _ in static.verify_rule(Rule(target, parse(raw)), VS, VT)})
        out += [(name, *x) for x in found] or [(name, "none", "", "")]
    return out


_ERR = {
    "unknown source": ("SOURCE_PATH_NOT_FOUND", "/t"), "unknown target": ("TARGET_PATH_NOT_FOUND", "/gone"), "type": ("TYPE_MISMATCH", "/t"), "number is no integer": ("TYPE_MISMATCH", "/i"), "index": ("INVALID_INPUT", "/l/0"),
    "reads the output": ("INVALID_EXPRESSION", "/t"), "current outside": ("INVALID_EXPRESSION", "/t"), "optional field": ("TYPE_MISMATCH", "/t"), "optional parent": ("TYPE_MISMATCH", "/t"), "coalesced nulls": ("TYPE_MISMATCH", "/t"),
    "enum open": ("TYPE_MISMATCH", "/e"), "enum missed": ("TYPE_MISMATCH", "/e"), "lookup open": ("TYPE_MISMATCH", "/t"), "lookup optional key": ("TYPE_MISMATCH", "/t"), "object lacks": ("REQUIRED_TARGET_UNMAPPED", "/p/x"),
    "object has more": ("TARGET_PATH_NOT_FOUND", "/p/z"), "object of wrong": ("TYPE_MISMATCH", "/p/x"), "literal object": ("TYPE_MISMATCH", "/p/x"), "read optional object": ("TYPE_MISMATCH", "/p"), "one branch lacks": ("REQUIRED_TARGET_UNMAPPED", "/p/x"),
    "map lacks": ("REQUIRED_TARGET_UNMAPPED", "/l/items/s"), "map of wrong": ("TYPE_MISMATCH", "/l/items/s"), "map optional field": ("TYPE_MISMATCH", "/l/items/s"), "array of literals": ("REQUIRED_TARGET_UNMAPPED", "/l/items/s"),
    "read array of text": ("TYPE_MISMATCH", "/l/items"), "map over no array": ("TYPE_MISMATCH", "/l"),
}
_TWO = {"lookup of objects": [("error", "REQUIRED_TARGET_UNMAPPED", "/p/x")], "cast loses": [("warning", "LOSSY_CAST", "/n")]}
golden("static_rules", "rule string, severity string, code string, target string", rule_findings, [
    (n, *x) for n in RULES for x in ([("error", *_ERR[n])] if n in _ERR else _TWO.get(n, [("none", "", "")]))
])


def whole_findings(spark: SparkSession) -> list[tuple]:
    good = {"/t": get("t"), "/l": _ROWS(s=_S)}
    branch = when(two("equals", get("n"), lit(1)), _OBJ(x=get("t"), y=get("t")), _OBJ(x=get("t")))
    check = {"id": "c", "assertion": two("equals", get("gone"), get("t", "output"))}
    base = lambda rules, invariants=None, **more: Mapping.parse({"mapping_version": "0.1", "id": "m", "source_schema": "s", "target_schema": "t", "rules": [{"target": t, "expression": e} for t, e in rules], "invariants": invariants or []} | more)
    cases = {
        "whole": base(good.items()), "no list": base([("/t", get("t"))]), "twice": base([*good.items(), ("/t", get("t"))]), "overlap": base([*good.items(), ("/p", _OBJ(x=get("t"))), ("/p/x", get("t"))]),
        "other schema": base(good.items(), source_schema="other"), "other version": base(good.items(), target_schema_version="9"), "invariant": base(good.items(), [check]),
        "both branches": base([*good.items(), ("/p", branch)]), "read whole": base([*good.items(), ("/p", get("sure"))]),
    }
    # the required leaf /p/x is asked for whether /p is or not
    return [(name, *x) for name, m in cases.items() for x in sorted({(code, at) for severity, code, at, _ in static.verify_static(m, VS, VT) if severity == "error"})]


_LEAF = ("REQUIRED_TARGET_UNMAPPED", "/p/x")
golden("static_whole", "mapping string, code string, target string", whole_findings, [
    ("whole", *_LEAF), ("no list", "REQUIRED_TARGET_UNMAPPED", "/l"), ("no list", *_LEAF), ("twice", "DUPLICATE_TARGET_ASSIGNMENT", "/t"), ("twice", *_LEAF), ("overlap", "OVERLAPPING_TARGET_ASSIGNMENT", "/p/x"),
    ("other schema", "INVALID_INPUT", ""), ("other schema", *_LEAF), ("other version", "INVALID_INPUT", ""), ("other version", *_LEAF), ("invariant", "SOURCE_PATH_NOT_FOUND", ""), ("invariant", *_LEAF), ("read whole", *_LEAF),
])


# --- review

RS = read_schema(_O(["orderNo", "qty", "state"], orderNo=_T, qty={"type": "integer"}, state=_E, note=_T), "src")
RT = read_schema(_O(["orderNumber", "status"], orderNumber=_T, status={"type": "string", "enum": ["Open", "Done"]}, quantity=_N, remark={"type": ["string", "null"]}), "tgt")
RH = {"lookups": [{"target": "/status", "source": "/state", "values": {"A": "Open", "B": "Done"}}]}


def reviewed(spark: SparkSession) -> list[tuple]:
    """What assembling comes to: by case, the issues, or the rules' number."""
    report = matching.suggest(spark, RS, RT, RH)
    d = lambda target, action, source=None: {"target_path": target, "action": action} | ({"source_path": source} if source else {})
    doc = lambda *decisions, **more: {"review_version": "0.1", "suggestion_report_sha256": report.sha256(), "mapping_id": "m", "decisions": list(decisions)} | more
    full = [d("/orderNumber", "select_candidate", "/orderNo"), d("/quantity", "reject"), d("/remark", "defer")]
    cases: dict[str, tuple] = {
        "no review": (None, {}), "no review, manual only": (None, {"policy": "manual-only"}), "other report": (doc(suggestion_report_sha256="0"), {}), "no hash": ({"decisions": []}, {}),
        "twice": (doc(*full, full[1]), {}), "unknown": (doc(*full, d("/x", "defer")), {}), "manual": (doc(*full, d("/status", "defer")), {}), "incomplete": (doc(full[0]), {"complete": True}),
        "complete": (doc(*full), {"complete": True}), "no candidate": (doc(d("/orderNumber", "select_candidate", "/gone")), {}), "unfit candidate": (doc(d("/orderNumber", "select_candidate", "/qty")), {}),
        "nothing to accept": (doc(*full[:1], d("/remark", "accept_selected")) if not report.find("/remark").rule else doc(), {}), "odd action": (doc(*full[:1], d("/quantity", "maybe")), {}),
    }
    out = []
    for name, (review_, more) in cases.items():
        made = review.assemble(spark, report, review_, RS, RT, **more)
        out += [(name, code, at, None) for code, at in sorted(set(made.issues))] or [(name, "made", "", len(made.mapping.rules))]
    return out


golden("review_assemble", "review string, code string, target string, rules long", reviewed, [
    ("no review", "INVALID_REVIEW_DECISION", "", None), ("no review, manual only", "REQUIRED_TARGET_UNMAPPED", "/orderNumber", None), ("other report", "STALE_SUGGESTION_REPORT", "", None), ("no hash", "STALE_SUGGESTION_REPORT", "", None),
    ("twice", "INVALID_REVIEW_DECISION", "/quantity", None), ("unknown", "REVIEW_TARGET_NOT_FOUND", "/x", None), ("manual", "INVALID_REVIEW_DECISION", "/status", None),
    ("incomplete", "INVALID_REVIEW_DECISION", "/quantity", None), ("incomplete", "INVALID_REVIEW_DECISION", "/remark", None), ("complete", "made", "", 2), ("no candidate", "REVIEW_CANDIDATE_NOT_FOUND", "/orderNumber", None),
    ("unfit candidate", "REVIEW_CANDIDATE_NOT_FOUND", "/orderNumber", None), ("nothing to accept", "INVALID_REVIEW_DECISION", "/remark", None), ("odd action", "INVALID_REVIEW_DECISION", "/quantity", None),
])


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action under every policy, over suppliers as targets."""
    s = read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as target_path", "element_at(array('manual', 'suggested', 'review_required', 'ambiguous', 'no_match'), cast(s_suppkey % 5 + 1 as int)) as disposition", "if(s_suppkey % 2 = 0, 'high', 'low') as band", "s_suppkey % 7 <> 0 as has_rule")
    d = read(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").selectExpr("cast(s_suppkey as string) as target_path", "element_at(array('accept_selected', 'select_candidate', 'reject', 'defer'), cast(s_suppkey % 4 + 1 as int)) as action", "if(s_suppkey % 8 = 1, '/x', null) as source_path")
    one = lambda policy: review.apply_decisions(s, d, policy).select(F.lit(policy).alias("policy"), "target_path", "accepted")
    return one("high-and-manual").unionByName(one("manual-only")).unionByName(one("review-document-only"))


add("review_policies", decided, """with s as (select s_suppkey::varchar as target_path, s_suppkey as k, s_suppkey % 5 as what, s_suppkey % 7 <> 0 as has_rule, case when s_suppkey % 3 > 0 then s_suppkey % 4 end as act from supplier)
select policy, target_path, case when what = 0 then has_rule when act is null then policy = 'high-and-manual' and has_rule and what = 1 and k % 2 = 0 when act = 0 then has_rule and what in (1, 2) when act = 1 then k % 8 = 1 else false end as accepted
from s, (select unnest(['high-and-manual', 'manual-only', 'review-document-only']) as policy)""")  # fmt: skip


def decision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that can't stand: repeated, unknown, on manual targets, missing."""
    s = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("cast(c_custkey as string) as target_path", "if(c_custkey % 10 = 0, 'manual', 'suggested') as disposition")
    d = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("cast(c_custkey as string) as target_path", "'defer' as action", "cast(null as string) as source_path", "explode(sequence(1, if(c_custkey % 9 = 0, 2, 1)))").drop("col")
    return review.check_decisions(s, d, True)


add("review_checks", decision_checks, """select 'INVALID_REVIEW_DECISION' as code, c_custkey::varchar as target_path from customer where c_custkey % 9 = 0 or c_custkey % 30 = 0 or c_custkey % 2 = 0 and c_custkey % 10 <> 0 and c_custkey % 3 <> 0
union all select 'REVIEW_TARGET_NOT_FOUND', c_custkey::varchar from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0""")  # fmt: skip


# --- metrics


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of matching over parts as units: what was suggested and what is true by their numbers."""
    df = read(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as target", "p_partkey % 2 = 0 as required", "element_at(array('suggested', 'review_required', 'ambiguous', 'no_match', 'manual'), cast(p_partkey % 5 + 1 as int)) as disposition",
        "element_at(array('high', 'medium', 'low', 'none'), cast(p_partkey % 4 + 1 as int)) as band", "p_partkey % 3 > 0 as has_rule", "if(p_partkey % 3 > 0, concat('/', p_size), null) as path",
        "if(p_partkey % 7 > 0, concat('e', p_partkey % 6), null) as assisted", "p_partkey % 11 > 0 as known", "if(p_partkey % 11 > 2, concat('/', p_size + if(p_partkey % 4 = 0, 1, 0)), null) as true_path",
        "if(p_partkey % 11 > 0, concat('e', p_partkey % 4), null) as true_text", "p_partkey % 13 = 0 as ambiguous", "p_partkey % 11 = 0 as no_match",
    )
    mapped = read(spark, sf_dir, "part").where("p_partkey % 8 > 0").selectExpr("cast(p_partkey as string) as target", "concat('e', p_partkey % 5) as text")
    return metrics.rates(metrics.match_evidence(df, mapped))


_COUNTS = {
    "target_outcome_coverage": ("true", "true"), "direct_match_precision": ("direct and hit", "direct"), "direct_match_recall": ("direct and hit", "k % 11 > 2 and not amb"),
    "transformation_exact_match_rate": ("changed and k % 7 > 0 and k % 6 = k % 4", "changed"), "high_confidence_false_positive_rate": ("high and not (direct and hit)", "high"),
    "ambiguity_precision": ("what = 2 and amb", "what = 2"), "expected_ambiguity_detection": ("what = 2 and amb", "amb"), "no_match_precision": ("what = 3 and none", "what = 3"), "no_match_recall": ("what = 3 and none", "none"),
    "expected_no_match_detection": ("what = 3 and none", "none"), "required_target_coverage": ("k % 2 = 0 and k % 8 > 0 and k % 11 > 0 and k % 5 = k % 4", "k % 2 = 0"),
    **{f"{b}_confidence_precision": (f"band = {i} and direct and hit", f"band = {i} and direct") for i, b in enumerate(("high", "medium", "low"))},
}
add("metrics_match", outcomes, "with p as (select p_partkey as k, p_partkey % 3 > 0 as direct, p_partkey % 11 > 2 and p_partkey % 4 <> 0 as hit, p_partkey % 13 = 0 as amb, p_partkey % 11 = 0 as none, p_partkey % 11 in (1, 2) as changed, p_partkey % 5 as what, p_partkey % 4 as band, p_partkey % 20 = 0 as high from part), e as (" + " union all ".join(f"select '{m}' as metric, count(*) filter ({a}) as numerator, count(*) filter ({b}) as denominator from p" for m, (a, b) in _COUNTS.items()) + ") select *, round(numerator / denominator, 12) as value from e")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine rates of a model's run, over suppliers as targets."""
    p = read(spark, sf_dir, "supplier").where("s_suppkey % 9 > 0").selectExpr("cast(s_suppkey as string) as target", "s_suppkey % 5 > 0 as proposed", "if(s_suppkey % 5 > 0 and s_suppkey % 2 = 0, concat('/', s_nationkey), null) as path", "if(s_suppkey % 5 > 0, concat('e', s_suppkey % 6), null) as text", "s_suppkey % 5 > 0 and s_suppkey % 7 > 0 as valid")
    t = read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as target", "if(s_suppkey % 4 < 2, concat('/', s_nationkey), null) as path", "if(s_suppkey % 10 > 0, concat('e', s_suppkey % 4), null) as text", "s_suppkey % 15 = 1 as ambiguous", "s_suppkey % 10 = 0 as no_match")
    b = read(spark, sf_dir, "nation").selectExpr("n_nationkey % 3 > 0 as valid", "4 as targets")
    return metrics.model_rates(p, t, b)


add("metrics_model", model, """with s as (select s_suppkey as k, s_suppkey % 9 > 0 as said, s_suppkey % 9 > 0 and s_suppkey % 5 > 0 as put, s_suppkey % 9 > 0 and s_suppkey % 5 = 0 as kept, s_suppkey % 2 = 0 as direct, s_suppkey % 4 < 2 as plain, s_suppkey % 10 = 0 as none, s_suppkey % 15 = 1 as amb from supplier),
e as (select 'model_response_validity_rate' as metric, (select count(*) filter (n_nationkey % 3 > 0) from nation) as numerator, (select count(*) from nation) as denominator
union all select 'model_target_proposal_coverage', count(*) filter (said), (select 4 * count(*) from nation) from s union all select 'model_proposal_static_validity_rate', count(*) filter (put and k % 7 > 0), count(*) filter (put) from s
union all select 'model_direct_match_precision', count(*) filter (put and direct and plain and not amb), count(*) filter (put and direct) from s union all select 'model_direct_match_recall', count(*) filter (put and direct and plain and not amb), count(*) filter (plain and not amb) from s
union all select 'model_transformation_exact_match_rate', count(*) filter (put and not plain and not none and k % 6 = k % 4), count(*) filter (not plain and not none) from s
union all select 'model_expected_ambiguity_abstention', count(*) filter (amb and kept), count(*) filter (amb) from s union all select 'model_expected_no_match_abstention', count(*) filter (none and kept), count(*) filter (none) from s
union all select 'model_full_mapping_completion_rate', 0, 1) select *, coalesce(round(numerator / nullif(denominator, 0), 12), 1.0) as value from e""")  # fmt: skip
add("metrics_usage", lambda s, d: metrics.model_usage(read(s, d, "orders").selectExpr("o_custkey as input_tokens", "if(o_orderkey = 1, null, 5) as output_tokens", "o_orderkey % 10 as latency_ms")),
    "select sum(o_custkey)::bigint as model_input_tokens, null::bigint as model_output_tokens, sum(o_orderkey % 10)::bigint as model_latency_ms from orders")


def pack() -> metrics.Pack:
    """A pack of its own: units of every kind, two invariants, one of them under a guard, samples that have to fail."""
    rules = [("/orderNumber", get("orderNo")), ("/status", {"op": "lookup", "key": get("state"), "values": {"A": "Open", "B": "Done"}}), ("/quantity", get("qty"))]
    checks = [{"id": "same", "assertion": two("equals", get("orderNo"), get("orderNumber", "output"))}, {"id": "few", "when": two("equals", get("state"), lit("A")), "assertion": two("less_than", get("qty"), lit(5))}]
    truth = Mapping.parse({"mapping_version": "0.1", "id": "truth", "rules": [{"target": t, "expression": e} for t, e in rules], "invariants": checks})
    sample = lambda i, state, qty, **more: {"id": i, "input": {"orderNo": i, "qty": qty, "state": state}} | more
    out = lambda i, status, qty: {"expected": {"orderNumber": i, "status": status, "quantity": qty}}
    samples = (sample("a", "A", 3, **out("a", "Open", 3)), sample("b", "B", 9, **out("b", "Done", 9)), sample("c", "C", 1, expected_error="SOURCE_SCHEMA_VALIDATION"), sample("d", "A", 7, expected_error="INVARIANT_FAILED"))
    decisions = [{"target_path": "/orderNumber", "action": "select_candidate", "source_path": "/orderNo"}, {"target_path": "/quantity", "action": "select_candidate", "source_path": "/qty"}, {"target_path": "/remark", "action": "reject"}]
    return metrics.Pack("own", RS, RT, truth, RH, {"decisions": decisions}, samples, {"expected_no_match_targets": ["/remark"], "expected_ambiguous_targets": [], "release_gates": {"cross_runtime_equivalence": {"minimum": 1.0}, "no_match_precision": {"minimum": 1.0}}})


def benchmarked(spark: SparkSession) -> list[tuple]:
    own = pack()
    own.reconcile()
    got = metrics.benchmark(spark, own)
    return [(m, n, d, v, got["gates"].get(m)) for m, (n, d, v) in got["metrics"].items()]


golden("metrics_benchmark", "metric string, numerator long, denominator long, value double, passed boolean", benchmarked, [
    ("target_outcome_coverage", 4, 4, 1.0, None), ("direct_match_precision", 2, 2, 1.0, None), ("direct_match_recall", 2, 2, 1.0, None), ("transformation_exact_match_rate", 1, 1, 1.0, None), ("high_confidence_false_positive_rate", 0, 0, 0.0, None),
    ("ambiguity_precision", 0, 0, 1.0, None), ("expected_ambiguity_detection", 0, 0, 1.0, None), ("no_match_precision", 1, 2, 0.5, False), ("no_match_recall", 1, 1, 1.0, None), ("expected_no_match_detection", 1, 1, 1.0, None),
    ("required_target_coverage", 2, 2, 1.0, None), ("high_confidence_precision", 0, 0, 0.0, None), ("medium_confidence_precision", 2, 2, 1.0, None), ("low_confidence_precision", 0, 0, 0.0, None),
    ("review_application_correctness", 3, 3, 1.0, None), ("compile_success_rate", 1, 1, 1.0, None), ("invalid_source_path_rejection", 1, 1, 1.0, None), ("duplicate_target_rejection", 1, 1, 1.0, None),
    ("target_schema_pass_rate", 2, 2, 1.0, None), ("cross_runtime_equivalence", 4, 4, 1.0, True), ("invariant_pass_rate", 5, 5, 1.0, None),
])


# --- assistance, reports


def assisted(spark: SparkSession) -> list[tuple]:
    """Packages within a budget: batches, targets and fields; redaction of documents; responses; drafts with one repair; reconciliation."""
    out = []
    for name, budget, more in (("wide", 5000, {}), ("narrow", 420, {}), ("full", 5000, {"mode": "full"}), ("halved", 330, {"mode": "targeted"})):
        packages = assist.context_packages(RS, RT, {"/orderNumber": ["/orderNo"], "/quantity": ["/qty", "/note"]}, budget, batch=3, **more)
        out += [(name, str(p["batch"]), p["mode"], f"{len(p['targets'])} targets, {len(p['source_fields'])} fields", all(assist.tokens_of(x) <= budget for x in packages)) for p in packages]
    out.append(("too small", "", "", str(refused(lambda: assist.context_packages(RS, RT, {}, 10))), True))
    raw = assist.context_packages(RS, RT, {}, 500_000, samples=["x " * 15_000] * 12)[0]["raw_samples"]
    out.append(("raw samples", "", "", f"{len(raw)} kept", True))
    value, n = assist.redact_value({"a": ["token=abc", 5, None], "me@x.org": 1, "you@x.org": 2, "1234567890123": {"k": "Bearer zzz"}})
    out.append(("redaction", str(n), "", canonical(value), True))
    p = assist.context_packages(RS, RT, {"/orderNumber": ["/orderNo"]}, 5000, batch=9)[0]
    answer = lambda *rows, **more: {"protocol_version": "0.1", "batch": 1, "context_sha256": sha256(p), "proposals": [{"target_path": t} | x for t, x in rows]} | more
    off, read_it = {"abstain": True}, {"expression": get("orderNo")}
    whole = [("/orderNumber", read_it), ("/quantity", off), ("/remark", off), ("/status", off)]
    responses = {"good": answer(*whole), "stale": answer(*whole, context_sha256="0"), "gap": answer(*whole[:3]), "twice": answer(*whole, whole[1]), "order": answer(*whole[::-1]), "secret": answer(("/orderNumber", {"expression": get("secret")}), *whole[1:]), "constant": answer(("/orderNumber", {"expression": lit(1)}), *whole[1:])}
    out += [("response " + k, "", "", ";".join(f"{c} {t}".strip() for c, t in assist.check_response(r, p)), True) for k, r in responses.items()]
    broken = answer(*whole) | {"extra": 1}
    for name, answers in {"at once": [answer(*whole)], "repaired": [broken, answer(*whole)], "never": [broken, broken, answer(*whole)], "beyond": [answer(("/x", {}), *whole)], "fails": []}.items():
        rest = iter(answers)
        d = assist.draft(p, lambda package, problem, previous, rest=rest: next(rest))
        out.append(("draft " + name, str(d.attempts), str(d.repairs), ";".join(c for c, _ in d.issues), d.response is not None))
    report = matching.suggest(spark, RS, RT, RH)
    drafts = [assist.Proposal("/remark", {"op": "coalesce", "operands": [get("note")]}), assist.Proposal("/quantity", get("orderNo")), assist.Proposal("/status", lit("Open")), assist.Proposal("/orderNumber")]
    after = assist.reconcile(report, drafts, RS, RT)
    out += [("reconciled", s.target_path, report.find(s.target_path).disposition, s.disposition, s.rule is not None) for s in after.suggestions]
    return out


_BAD = "PROVIDER_RESPONSE_INVALID"
golden("assist_all", "what string, a string, b string, c string, ok boolean", assisted, [
    ("wide", "1", "full", "3 targets, 4 fields", True), ("wide", "2", "full", "1 targets, 4 fields", True), ("narrow", "1", "full", "3 targets, 4 fields", True), ("narrow", "2", "full", "1 targets, 4 fields", True),
    ("full", "1", "full", "3 targets, 4 fields", True), ("full", "2", "full", "1 targets, 4 fields", True), ("halved", "1", "targeted", "3 targets, 3 fields", True), ("halved", "2", "targeted", "1 targets, 0 fields", True),
    ("too small", "", "", "MODEL_CONTEXT_TOO_LARGE", True), ("raw samples", "", "", "8 kept", True),
    ("redaction", "5", "", '{"[REDACTED]":{"k":"Bearer [REDACTED]"},"[REDACTED]@x.org":1,"[REDACTED]@x.org#2":2,"a":["token: [REDACTED]",5,null]}', True),
    ("response good", "", "", "", True), ("response stale", "", "", _BAD, True), ("response gap", "", "", _BAD + " /status", True), ("response twice", "", "", _BAD + " /quantity", True), ("response order", "", "", _BAD, True),
    ("response secret", "", "", _BAD + " /orderNumber", True), ("response constant", "", "", _BAD + " /orderNumber", True),
    ("draft at once", "1", "0", "", True), ("draft repaired", "2", "1", "", True), ("draft never", "2", "1", _BAD, False), ("draft beyond", "1", "0", _BAD, False), ("draft fails", "1", "0", _BAD, False),
    ("reconciled", "/orderNumber", "review_required", "review_required", True), ("reconciled", "/quantity", "review_required", "review_required", True), ("reconciled", "/remark", "no_match", "review_required", True), ("reconciled", "/status", "manual", "manual", True),
])


def report_texts(spark: SparkSession) -> list[tuple]:
    """Reports in each of their forms."""
    found = static.verify_rule(Rule("/t", parse(get("n"))), VS, VT)
    outcome = review.Outcome(None, (("/a", "reject", False, None),), (("INVALID_REVIEW_DECISION", "/b|c"),))
    suggestion = matching.Report((matching.Suggestion("/a", "suggested", "high", 0.95, "/b", Rule("/a", parse(get("b")))),))
    makers = {"verification": lambda f: reports.findings(found, f), "review": lambda f: reports.decisions(outcome, f), "suggestions": lambda f: reports.suggestions(suggestion, f)}
    return [(n, f, make(f)) for n, make in makers.items() for f in ("json", "text", "markdown")]


_HEAD = {"v": "| severity | code | target | message |\n| --- | --- | --- | --- |\n", "a": "| target_path | action | accepted | source_path |\n| --- | --- | --- | --- |\n", "i": "| code | target_path |\n| --- | --- |\n", "s": "| target_path | disposition | band | confidence | source_path |\n| --- | --- | --- | --- | --- |\n"}
_SUM = '{"confidence":{"high":1,"low":0,"medium":0,"none":0},"disposition":{"ambiguous":0,"manual":0,"no_match":0,"review_required":0,"suggested":1}}'
golden("reports_all", "report string, form string, text string", report_texts, [
    ("verification", "json", '{"issues":[{"code":"TYPE_MISMATCH","message":"[\'number\'] into [\'string\']","severity":"error","target":"/t"}],"valid":false}'),
    ("verification", "text", "invalid: 1 findings\n\nseverity  code           target  message\nerror     TYPE_MISMATCH  /t      ['number'] into ['string']\n"),
    ("verification", "markdown", "invalid: 1 findings\n\n" + _HEAD["v"] + "| error | TYPE_MISMATCH | /t | ['number'] into ['string'] |\n"),
    ("review", "json", '{"applied":[{"accepted":false,"action":"reject","source_path":null,"target_path":"/a"}],"issues":[{"code":"INVALID_REVIEW_DECISION","target_path":"/b|c"}],"mapping_sha256":null}'),
    ("review", "text", "target_path  action  accepted  source_path\n/a           reject  False\n\ncode                     target_path\nINVALID_REVIEW_DECISION  /b\\|c\n\nmapping: none\n"),
    ("review", "markdown", _HEAD["a"] + "| /a | reject | False |  |\n\n" + _HEAD["i"] + "| INVALID_REVIEW_DECISION | /b\\|c |\n\nmapping: none\n"),
    ("suggestions", "json", '[{"band":"high","confidence":0.95,"disposition":"suggested","source_path":"/b","target_path":"/a"}]'),
    ("suggestions", "text", "target_path  disposition  band  confidence  source_path\n/a           suggested    high  0.95        /b\n\n" + _SUM + "\n"),
    ("suggestions", "markdown", _HEAD["s"] + "| /a | suggested | high | 0.95 | /b |\n\n" + _SUM + "\n"),
])


# --- streams


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Mapping]:
    """A stream of the events, read file by file, and a mapping that fails where a value is too small to divide by."""
    rows = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = rows.select("event_id", "ts", "event_type", F.expr("floor(value / 10)").alias("tens"))
    return stream, mapping({"/kind": get("event_type"), "/share": two("divide", lit(1), get("tens"))})


def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad rows of a stream in folders of their own, read back."""
    stream, m = _events(spark, sf_dir)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    split_sink(mapped_stream(stream, m), f"{folder}/good", f"{folder}/bad", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    back = lambda name: spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("sink"), "event_id", F.col("output.share").alias("share"), "err")
    return back("good").unionByName(back("bad"))


_TENS = "select event_id, ts, floor(value / 10) as tens from events"
add("stream_split", stream_split, f"select case when tens = 0 then 'bad' else 'good' end as sink, event_id, 1 / nullif(tens, 0) as share, case when tens = 0 then 'DIVIDE_BY_ZERO' end as err from ({_TENS})")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each hour, from a stream under a watermark; the last batch has them all."""
    stream, m = _events(spark, sf_dir)
    folder = f"{shared_dir(spark)}/rates-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")
    counted = error_rates(mapped_stream(stream, m), "ts", "1 hour", "1 hour")
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


add("stream_rates", stream_rates, f"select time_bucket(interval 1 hour, ts) as start, case when tens = 0 then 'DIVIDE_BY_ZERO' end as err, count(*) as n from ({_TENS}) group by 1, 2")
