"""The registered queries of the mapping engine over the star schema, and the SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assist, matching, metrics, profile, review
from .plans.mapping import Mapping
from .sources.json_schema import read_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

get = lambda path, document="input": {"op": "get", "path": "/" + path if path else "", "document": document}
lit = lambda v: {"op": "literal", "value": v}
two = lambda op, a, b: {"op": op, "left": a, "right": b}
cast = lambda v, to: {"op": "cast", "value": v, "target_type": to}
when = lambda c, a, b: {"op": "if", "condition": c, "then": a, "otherwise": b}
SAFE = 9007199254740991
#: The errors of arithmetic on a result, in SQL.
RISK = "case when abs({0}) > 9007199254740991 then 'NUMERIC_PRECISION_RISK' end"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mapping(rules: dict[str, Any], invariants: list | None = None) -> Mapping:
    return Mapping.parse({"mapping_version": "0.1", "id": "query", "rules": [{"target": t, "expression": e} for t, e in rules.items()], "invariants": invariants or []})


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def expression(name: str, table: str, keys: list[str], raw: dict, sql: str, columns: list[str] | None = None, prepared: dict[str, str] | None = None) -> None:
    """Registers one expression as ``v`` and its error as ``err``; ``sql``: "v; err" in terms of the table (and ``prepared``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = df.select(*keys, *(columns or []), *[F.expr(x).alias(n) for n, x in (prepared or {}).items()])
        return mapping({"/v": raw}).transform(df).select(*keys, F.col("output.v").alias("v"), "err")

    value, err = sql.split(";")
    more = "".join(f", {x} as {n}" for n, x in (prepared or {}).items())
    inner = f"select {', '.join(keys + (columns or []))}{more} from {table}"
    add(name, run, f"select {', '.join(keys)}, case when err is null then v end as v, err from (select *, {value} as v, cast({err} as varchar) as err from ({inner}))")


LINE, ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["o_orderkey"]
expression("op_get", "customer", ["c_custkey"], get("c_name"), "c_name; null", ["c_name"])
expression("op_literal", "nation", ["n_nationkey"], lit("fixed"), "'fixed'; null")
expression("op_coalesce", "customer", ["c_custkey"], {"op": "coalesce", "operands": [get("gone"), get("seg"), lit("none")]}, "coalesce(seg, 'none'); null", prepared={"seg": "nullif(c_mktsegment, 'BUILDING')"})
expression("op_concat", "customer", ["c_custkey"], {"op": "concat", "operands": [get("c_name"), get("seg")], "separator": "-"}, "c_name || '-' || seg; case when seg is null then 'TYPE_MISMATCH' end", ["c_name"], {"seg": "nullif(c_mktsegment, 'BUILDING')"})
expression("op_cast_string", "lineitem", LINE, cast(get("l_linenumber"), "string"), "cast(l_linenumber as varchar); null")
expression("op_cast_boolean", "lineitem", LINE, cast(get("flag"), "boolean"), "lower(flag) = 'true'; case when lower(flag) not in ('true', 'false') then 'TYPE_MISMATCH' end", prepared={"flag": "case when l_returnflag = 'A' then 'TRUE' when l_returnflag = 'N' then 'false' else 'yes' end"})
expression("op_cast_integer", "part", ["p_partkey"], cast(get("t"), "integer"), "try_cast(t as bigint); case when not regexp_full_match(t, '[+-]?[0-9]+') then 'TYPE_MISMATCH' end", prepared={"t": "case when p_size % 2 = 0 then concat('+', p_size) else concat(' ', p_size) end"})
expression("op_cast_number", "part", ["p_partkey"], cast(get("t"), "number"), "try_cast(t as double); case when not regexp_full_match(t, '[0-9]+[.]?[0-9]*') then 'TYPE_MISMATCH' end", prepared={"t": "case when p_size % 3 = 0 then concat(p_size, '.5') when p_size % 3 = 1 then concat(p_size, 'd') else cast(p_size as varchar(20)) end"})
expression("op_if", "orders", ORDER, when(two("equals", get("o_orderstatus"), lit("F")), lit("done"), lit("open")), "case when o_orderstatus = 'F' then 'done' else 'open' end; null", ["o_orderstatus"])
expression("op_equals", "lineitem", LINE, two("equals", get("l_quantity"), get("l_linenumber")), "l_quantity = l_linenumber; null", ["l_quantity"])
expression("op_not", "orders", ORDER, {"op": "not", "value": get("f")}, "not f; case when f is null then 'TYPE_MISMATCH' end", prepared={"f": "case when o_orderstatus = 'P' then null else o_orderstatus = 'F' end"})
expression("op_and", "orders", ORDER, {"op": "and", "operands": [get("a"), get("b")]}, "a and b; case when b is null then 'TYPE_MISMATCH' end", prepared={"a": "o_totalprice > 100000", "b": "case when o_orderstatus = 'P' then null else o_orderstatus = 'F' end"})
expression("op_or", "orders", ORDER, {"op": "or", "operands": [get("a"), get("b")]}, "a or b; case when b is null then 'TYPE_MISMATCH' end", prepared={"a": "o_totalprice > 100000", "b": "case when o_orderstatus = 'P' then null else o_orderstatus = 'F' end"})
expression("op_lookup", "lineitem", LINE, {"op": "lookup", "key": get("l_returnflag"), "values": {"A": "accepted", "R": "returned"}}, "case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' end; null", ["l_returnflag"])
expression("op_lookup_default", "lineitem", LINE, {"op": "lookup", "key": get("l_returnflag"), "values": {"A": 1, "R": 2}, "default": two("divide", lit(1), get("z"))}, "case l_returnflag when 'A' then 1.0 when 'R' then 2.0 end; case when l_returnflag = 'N' then 'DIVIDE_BY_ZERO' end", ["l_returnflag"], {"z": "0"})
for _op, _sign in (("add", "+"), ("subtract", "-"), ("multiply", "*")):
    expression(f"op_{_op}", "lineitem", LINE, two(_op, get("l_extendedprice"), get("l_discount")), f"l_extendedprice {_sign} l_discount; null", ["l_extendedprice", "l_discount"])
expression("op_divide", "lineitem", LINE, two("divide", get("l_extendedprice"), get("l_discount")), "l_extendedprice / nullif(l_discount, 0); case when l_discount = 0 then 'DIVIDE_BY_ZERO' end", ["l_extendedprice", "l_discount"])
expression("op_round", "lineitem", LINE, {"op": "round", "digits": 2, "value": two("multiply", get("l_extendedprice"), get("l_discount"))}, "floor(abs(l_extendedprice * l_discount) * 100.0::double + 0.5::double) / 100.0::double; null", ["l_extendedprice", "l_discount"])
_MOMENT = "case when event_id % 3 = 0 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") || '9-04:30' when event_id % 3 = 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z' else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end"
_MOMENT_SQL = "case when event_id % 3 = 0 then date_trunc('millisecond', ts) + interval 270 minute when event_id % 3 = 1 then date_trunc('second', ts) end"


def _dates(name: str, raw: dict, form: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "events").select("event_id", F.expr(_MOMENT).alias("t"))
        return mapping({"/v": raw}).transform(df).select("event_id", F.col("output.v").alias("v"), "err")

    add(name, run, f"select event_id, {form} as v, case when event_id % 3 = 2 then 'INVALID_DATE' end as err from (select event_id, {_MOMENT_SQL} as m from events)")


_dates("op_parse_date", {"op": "parse_date", "value": get("t")}, "strftime(m, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'")
_dates("op_format_date", {"op": "format_date", "value": get("t"), "pattern": "DD/MM/YYYY hh:mm"}, "strftime(m, '%d/%m/%Y %H:%M')")


def op_object_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    raw = {"op": "object", "fields": {"names": {"op": "array", "items": [get("p_name"), get("p_brand")]}, "n": lit(2)}}
    out = mapping({"/v": raw}).transform(df)
    return out.select("p_partkey", F.col("output.v.n").alias("n"), F.posexplode("output.v.names").alias("i", "name"))


add("op_object", op_object_array, "select p_partkey, 2::bigint as n, i, name from (select p_partkey, unnest([0, 1])::int as i, unnest([p_name, p_brand]) as name from part)")
add("op_array", lambda s, d: op_object_array(s, d).groupBy("i").agg(F.count("*").alias("rows"), F.countDistinct("name").alias("names")),
    "select 0::int as i, count(*) as rows, count(distinct p_name) as names from part union all select 1, count(*), count(distinct p_brand) from part")


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array: the nested input of the order scenario; one shuffle by order, lines pre-sorted by none."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_linenumber").alias("lineNumber"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").alias("orderedQuantity"),
        F.when(F.col("l_returnflag") == "N", "DZ").when(F.col("l_returnflag") == "A", "EA").alias("unit"), F.col("l_linestatus").alias("warehouse"),
    )).alias("items"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderKey"), F.concat(F.lit("SO-"), F.col("o_orderkey").cast("string")).alias("orderNumber"), F.struct(F.col("o_custkey").cast("string").alias("id")).alias("customer"))
    return orders.join(lines, orders["orderKey"] == lines["l_orderkey"]).drop("l_orderkey")


def each(rows: str, fields: dict) -> dict:
    return {"op": "map", "collection": get(rows), "expression": {"op": "object", "fields": fields}}


ORDER_LINES = each("items", {
    "lineNumber": get("lineNumber", "current"), "partNumber": get("sku", "current"), "facility": get("warehouse", "current"),
    "quantityEach": two("multiply", get("orderedQuantity", "current"), {"op": "lookup", "key": get("unit", "current"), "values": {"EA": 1, "DZ": 12}}),
})


def flow_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested orders mapped line by line: an order with a line of unknown unit fails as a whole."""
    out = mapping({"/requestId": get("orderNumber"), "/customerId": get("customer/id"), "/lines": ORDER_LINES}).transform(orders_with_lines(spark, sf_dir))
    good = out.where("err is null").select("output.requestId", "output.customerId", F.explode("output.lines").alias("l"))
    return good.select("requestId", "customerId", "l.lineNumber", "l.partNumber", "l.quantityEach", "l.facility")


_FLOW = """with bad as (select l_orderkey from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') > 0)
select 'SO-' || o_orderkey as "requestId", cast(o_custkey as varchar) as "customerId", cast(l_linenumber as bigint) as "lineNumber", cast(l_partkey as varchar) as "partNumber",
  l_quantity * case l_returnflag when 'N' then 12 else 1 end as "quantityEach", l_linestatus as facility
from orders join lineitem on o_orderkey = l_orderkey where l_orderkey not in (select l_orderkey from bad)"""
add("flow_order_fulfillment", flow_orders, _FLOW)
add("op_map", lambda s, d: mapping({"/v": each("items", {"n": get("lineNumber", "current")})}).transform(orders_with_lines(s, d)).select("orderKey", F.explode("output.v.n").alias("n")),
    'select l_orderkey as "orderKey", cast(l_linenumber as bigint) as n from lineitem where l_orderkey in (select o_orderkey from orders)')
add("op_errors", lambda s, d: mapping({"/lines": ORDER_LINES}).transform(orders_with_lines(s, d)).groupBy("err").agg(F.count("*").alias("n")),
    "select case when r > 0 then 'TYPE_MISMATCH' end as err, count(*) as n from (select count(*) filter (l_returnflag = 'R') as r from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey) group by 1")


def flow_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_partkey as string) as materialNumber", "p_name as materialDescription", "struct(p_retailprice as value, if(p_size % 2 = 0, 'KG', 'LB') as unit) as grossWeight")
    weight = two("multiply", get("grossWeight/value"), {"op": "lookup", "key": get("grossWeight/unit"), "values": {"KG": 2.2046226218, "LB": 1}})
    rules = {"/partNumber": get("materialNumber"), "/description": get("materialDescription"), "/weightLb": {"op": "round", "digits": 6, "value": weight}}
    return mapping(rules).transform(df, "ok").select("output.partNumber", "output.description", "output.weightLb")


add("flow_material_part", flow_material, """select cast(p_partkey as varchar) as "partNumber", p_name as description,
  floor(abs(p_retailprice * case when p_size % 2 = 0 then 2.2046226218::double else 1.0::double end) * 1000000.0::double + 0.5::double) / 1000000.0::double as "weightLb" from part""")  # fmt: skip


def flow_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, nation and region as a business partner; the dimensions are a few dozen rows, left to the optimiser's own size check."""
    df = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = df.select(F.col("c_custkey").cast("string").alias("customerId"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("country"), F.col("r_name").alias("region")).alias("address"))
    rules = {"/businessPartnerId": get("customerId"), "/displayName": get("name"), "/primaryAddress/country": get("address/country"), "/primaryAddress/region": get("address/region")}
    same = [{"id": "same-name", "assertion": two("equals", get("name"), get("displayName", "output"))}]
    return mapping(rules, same).transform(df, "ok").select("output.businessPartnerId", "output.displayName", F.col("output.primaryAddress.country").alias("country"), F.col("output.primaryAddress.region").alias("region"))


add("flow_crm_erp", flow_crm, """select cast(c_custkey as varchar) as "businessPartnerId", c_name as "displayName", n_name as country, r_name as region
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")  # fmt: skip


def flow_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").selectExpr(*LINE, "lpad(cast(l_orderkey as string), 6, '0') as s1", "lpad(cast(l_partkey as string), 6, '0') as s2", "lpad(cast(l_suppkey as string), 6, '0') as s3")
    rules = {"/company": get("s1"), "/costCenter": {"op": "concat", "operands": [get("s2"), get("s3")], "separator": "-"}, "/account": {"op": "concat", "operands": [get("s1"), get("s2"), get("s3")]}}
    check = [{"id": "long", "assertion": {"op": "length_equals", "value": get("account", "output"), "expected": 18}}]
    return mapping(rules, check).transform(df, "ok").select(*LINE, "output.company", "output.costCenter", "output.account")


add("flow_account_segments", flow_accounts, f"""select {', '.join(LINE)}, s1 as company, s2 || '-' || s3 as "costCenter", s1 || s2 || s3 as account
from (select *, lpad(l_orderkey::varchar, 6, '0') as s1, lpad(l_partkey::varchar, 6, '0') as s2, lpad(l_suppkey::varchar, 6, '0') as s3 from lineitem)""")  # fmt: skip


def flow_mes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('MO-', o_orderkey) as manufacturingOrder", "struct(cast(o_custkey % 50 as double) as value, if(o_orderkey % 2 = 0, 'DZ', 'EA') as unit) as plannedQuantity",
        "o_orderstatus as systemStatus", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") || '-04:00' as scheduledStart")
    quantity = cast(two("multiply", get("plannedQuantity/value"), {"op": "lookup", "key": get("plannedQuantity/unit"), "values": {"EA": 1, "DZ": 12}}), "integer")
    status = {"op": "lookup", "key": get("systemStatus"), "values": {"F": "Released", "O": "Pending"}, "default": lit("Unknown")}
    start = {"op": "format_date", "value": {"op": "parse_date", "value": get("scheduledStart")}, "pattern": "YYYY-MM-DDThh:mm:ss.SSSZ"}
    out = mapping({"/jobNumber": get("manufacturingOrder"), "/quantity": quantity, "/status": status, "/scheduledStartUtc": start}).transform(df)
    return out.select("output.jobNumber", "output.quantity", "output.status", "output.scheduledStartUtc", "err")


add("flow_erp_mes", flow_mes, """select 'MO-' || o_orderkey as "jobNumber", (o_custkey % 50) * case when o_orderkey % 2 = 0 then 12 else 1 end as quantity,
  case o_orderstatus when 'F' then 'Released' when 'O' then 'Pending' else 'Unknown' end as status, strftime(o_orderdate + interval 4 hour, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as "scheduledStartUtc", null::varchar as err from orders""")  # fmt: skip


def invariant(name: str, table: str, keys: list[str], assertion: dict, sql: str, columns: list[str], sql_from: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table).select(*dict.fromkeys([*keys, *columns]))
        return mapping({"/k": get(keys[0])}, [{"id": name, "assertion": assertion}]).transform(df).select(*keys, F.col("err").isNull().alias("ok"))

    add(f"inv_{name}", run, f"select {', '.join(keys)}, {sql} as ok from {table}")


invariant("equals", "lineitem", LINE, two("equals", get("l_linenumber"), get("l_quantity")), "l_linenumber = l_quantity", ["l_quantity"])
invariant("in", "customer", ["c_custkey"], {"op": "in", "value": get("c_mktsegment"), "allowed": ["BUILDING", "MACHINERY"]}, "c_mktsegment in ('BUILDING', 'MACHINERY')", ["c_mktsegment"])
invariant("matches", "part", ["p_partkey"], {"op": "matches", "value": get("p_brand"), "pattern": "Brand#[1-3]"}, "regexp_full_match(p_brand, 'Brand#[1-3]')", ["p_brand"])
for _op, _sign in (("greater_than", ">"), ("greater_than_or_equal", ">="), ("less_than", "<"), ("less_than_or_equal", "<=")):
    invariant(_op, "lineitem", LINE, two(_op, get("l_quantity"), lit(25)), f"l_quantity {_sign} 25", ["l_quantity"])
invariant("length_equals", "customer", ["c_custkey"], {"op": "length_equals", "value": get("c_mktsegment"), "expected": 9}, "length(c_mktsegment) = 9", ["c_mktsegment"])


def _order_check(name: str, assertion: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = mapping({"/lines": each("items", {"n": get("lineNumber", "current")})}, [{"id": name, "assertion": assertion}]).transform(orders_with_lines(spark, sf_dir))
        return out.select("orderKey", F.col("err").isNull().alias("ok"))

    add(f"inv_{name}", run, f'select l_orderkey as "orderKey", {sql} as ok from lineitem where l_orderkey in (select o_orderkey from orders) group by l_orderkey')


_order_check("unique", {"op": "unique", "value": {"op": "map", "collection": get("lines", "output"), "expression": get("n", "current")}}, "count(distinct l_linenumber) = count(*)")
_order_check("not_null", {"op": "not_null", "value": get("lines/2", "output")}, "count(*) > 2")

PART_SCHEMA = {
    "type": "object", "required": ["p_name", "p_kind"], "additionalProperties": False,
    "properties": {
        "p_partkey": {"type": "integer"}, "p_name": {"type": "string", "minLength": 9, "maxLength": 11}, "p_kind": {"type": "string", "enum": ["ECONOMY", "SMALL"]},
        "p_brand": {"type": "string", "pattern": "[13]$"}, "p_size": {"type": "integer", "minimum": 5, "exclusiveMaximum": 40, "multipleOf": 2}, "p_retailprice": {"type": "integer"},
    },
}


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a schema by field and category."""
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("nullif(p_type, 'PROMO')").alias("p_kind"), "p_brand", "p_size", "p_retailprice", F.lit(1).alias("extra"))
    out = mapping({"/k": get("p_partkey")}).transform(df, source=read_schema(PART_SCHEMA))
    return out.select(F.explode("issues").alias("i")).groupBy(F.col("i.pointer").alias("pointer"), F.col("i.detail").alias("category")).agg(F.count("*").alias("n"))


_PARTS = [("/p_name", "string-length", "length(p_name) < 9"), ("/p_name", "string-length", "length(p_name) > 11"), ("", "required-property", "p_type = 'PROMO'"), ("/p_kind", "enum", "p_type not in ('ECONOMY', 'SMALL', 'PROMO')"),
    ("/p_brand", "pattern", "not regexp_matches(p_brand, '[13]$')"), ("/p_size", "numeric-range", "p_size < 5"), ("/p_size", "numeric-range", "p_size >= 40"), ("/p_size", "numeric-range", "p_size % 2 <> 0"),
    ("/p_retailprice", "type", "p_retailprice <> floor(p_retailprice)"), ("", "additional-property", "true")]
add("validate_schema", validate, "select pointer, category, count(*) as n from (" + " union all ".join(f"select '{p}' as pointer, '{c}' as category from part where {w}" for p, c, w in _PARTS) + ") group by 1, 2")


def profile_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"))
    out = profile.profile(df)
    return out.select("pointer", "sample_count", "missing_count", "null_count", F.array_join("observed_types", ",").alias("types"), "distinct_count", "min_length", "max_length", F.array_join("pattern_classes", ",").alias("classes"))


add("profile_fields", profile_customers, """select '/c_custkey' as pointer, count(*) as sample_count, 0::bigint as missing_count, 0::bigint as null_count, 'integer' as types, count(distinct c_custkey) as distinct_count,
  null::int as min_length, null::int as max_length, '' as classes from customer
union all select '/c_name', count(*), 0, 0, 'string', count(distinct c_name), min(length(c_name))::int, max(length(c_name))::int, 'mixed-text' from customer
union all select '/seg', count(*), 0, count(*) filter (s is null), case when count(*) filter (s is null) > 0 then 'null,string' else 'string' end, count(distinct s), min(length(s))::int, max(length(s))::int, 'uppercase-code'
  from (select nullif(c_mktsegment, 'BUILDING') as s from customer)""")  # fmt: skip
add("profile_patterns", lambda s, d: read(s, d, "events").select(F.explode(F.array(F.col("event_id").cast("string"), "event_type", "props", F.date_format("ts", "yyyy-MM-dd"))).alias("t")).groupBy(profile.pattern_class(F.col("t")).alias("class")).agg(F.count("*").alias("n")),
    """select case when regexp_full_match(t, '[+-]?[0-9]+') then 'integer-string' when regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'iso-date' when regexp_full_match(t, '[A-Z0-9][A-Z0-9_-]*') then 'uppercase-code'
  when regexp_full_match(t, '[a-z0-9][a-z0-9_-]*') then 'lowercase-word' else 'mixed-text' end as class, count(*) as n from (select unnest([event_id::varchar, event_type, props, strftime(ts, '%Y-%m-%d')]) as t from events) group by 1""")  # fmt: skip

FIELDS = lambda names: {"type": "object", "required": [n for n, _, _ in names], "properties": {n: {"type": t, "description": d} for n, t, d in names}}
SOURCE = read_schema(FIELDS([("custId", "string", "customer identifier"), ("custName", "string", "name of the customer"), ("balance", "number", "account balance"), ("segment", "string", "market segment"), ("nation", "integer", "nation key")]), "crm")
TARGET = read_schema(FIELDS([("customerIdentifier", "string", "customer identifier"), ("name", "string", "customer name"), ("accountBalance", "number", "balance of the account"), ("marketSegment", "string", "segment"), ("country", "string", "country name")]), "erp")


def _scored(spark: SparkSession) -> DataFrame:
    return matching.score_pairs(matching.field_frame(spark, [f for f in SOURCE.fields if f.pointer], "s_"), matching.field_frame(spark, matching.units(TARGET), "t_"))


def ranked(df: DataFrame) -> DataFrame:
    """Suppliers of parts as candidates with made-up scores, so that SQL can hold the ranking and the decision to account."""
    return df.selectExpr("cast(l_partkey as string) as target_path", "cast(l_suppkey as string) as source_path", "(l_partkey * 7 + l_suppkey * 13) % 101 / 100.0D as raw_score").distinct()


_RANKED = "select distinct l_partkey::varchar as target_path, l_suppkey::varchar as source_path, ((l_partkey * 7 + l_suppkey * 13) % 101)::double / 100.0::double as raw_score from lineitem"
add("match_rank", lambda s, d: matching.top_candidates(ranked(read(s, d, "lineitem")), 3).select("target_path", "source_path", "raw_score", "rank"),
    f"select target_path, source_path, raw_score, rank::int as rank from (select *, row_number() over (partition by target_path order by raw_score desc, source_path) as rank from ({_RANKED})) where rank <= 3")
add("match_disposition", lambda s, d: matching.decide(ranked(read(s, d, "lineitem"))).select("target_path", "source_path", "band", "disposition"), f"""
with r as (select *, row_number() over w as k, lead(raw_score) over w as nxt from ({_RANKED}) window w as (partition by target_path order by raw_score desc, source_path)), m as (select *, coalesce(raw_score - nxt, 1.0) as margin from r where k = 1)
select target_path, source_path, case when raw_score >= 0.9 then 'high' when raw_score >= 0.7 then 'medium' when raw_score >= 0.4 then 'low' else 'none' end as band,
  case when raw_score < 0.4 then 'no_match' when nxt is not null and margin <= 0.08 then 'ambiguous' when raw_score >= 0.9 and margin >= 0.12 then 'suggested' when raw_score < 0.9 or margin > 0.08 then 'review_required' else 'no_match' end as disposition from m""")  # fmt: skip


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, sf_dir, "customer").where("c_custkey % 7 > 0").selectExpr("cast(c_custkey as string) as target_path", "if(c_custkey % 3 = 0, 'suggested', 'review_required') as disposition", "if(c_custkey % 2 = 0, 'high', 'low') as band", "c_custkey % 5 <> 0 as has_rule")
    d = read(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").selectExpr("cast(o_custkey as string) as target_path", "'accept_selected' as action", "cast(null as string) as source_path").distinct()
    return s, d


_DECIDED = "(select distinct o_custkey from orders where o_orderkey % 20 = 0)"
add("review_apply", lambda s, d: review.apply_decisions(*_reviewed(s, d), "high-and-manual").select("target_path", "accepted"),
    f"select c_custkey::varchar as target_path, case when o_custkey is null then c_custkey % 5 <> 0 and c_custkey % 3 = 0 and c_custkey % 2 = 0 else c_custkey % 5 <> 0 end as accepted from customer left join {_DECIDED} on o_custkey = c_custkey where c_custkey % 7 > 0")
add("review_unresolved", lambda s, d: review.unresolved(*_reviewed(s, d)).select("target_path"), f"select c_custkey::varchar as target_path from customer where c_custkey % 7 > 0 and c_custkey not in {_DECIDED}")
add("review_unknown", lambda s, d: review.check_decisions(*_reviewed(s, d)), f"select 'REVIEW_TARGET_NOT_FOUND' as code, o_custkey::varchar as target_path from {_DECIDED} where o_custkey % 7 = 0")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.count_if(F.col("l_discount") > 0.05).alias("numerator"), F.count_if(F.col("l_quantity") > 10).alias("denominator")).withColumns({"expects_zero": F.lit(False), "absence": F.lit(False)})


_EVIDENCE = "select l_returnflag as metric, count(*) filter (l_discount > 0.05) as numerator, count(*) filter (l_quantity > 10) as denominator from lineitem group by 1"
add("metrics_rates", lambda s, d: metrics.rates(_evidence(s, d)), f"select *, round(numerator / denominator, 12) as value from ({_EVIDENCE})")


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("A", 0.5, None), ("N", None, 0.1), ("none", 0.1, None)], "metric string, minimum double, maximum double")
    return metrics.check_gates(metrics.rates(_evidence(spark, sf_dir)), wanted).select("metric", "passed")


add("metrics_gates", gates, f"with e as ({_EVIDENCE}) select 'A' as metric, (select numerator / denominator >= 0.5 from e where metric = 'A') as passed union all select 'N', (select numerator / denominator <= 0.1 from e where metric = 'N') union all select 'none', false")


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = assist.redact(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), n.cast("long").alias("redactions"))


def _redact_sql() -> str:
    # no lookahead there: nothing marked stands in these texts, so the patterns mean the same without it
    steps, count = "text", []
    for pattern, kept in assist.PATTERNS:
        plain = pattern.replace(r"(?!\[REDACTED\])", "").replace("'", "''")
        count.append(f"len(regexp_extract_all({steps}, '{plain}'))")
        steps = f"regexp_replace({steps}, '{plain}', '{kept}', 'g')"
    return f"select conv_id, turn, {steps} as text, ({' + '.join(count)})::bigint as redactions from conversations"


add("redact_text", redact, _redact_sql())
add("token_estimate", lambda s, d: read(s, d, "conversations").groupBy("role").agg(F.sum(assist.token_estimate(F.col("text"))).cast("long").alias("tokens")), "select role, sum(ceil(strlen(text) / 3))::bigint as tokens from conversations group by role")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_orders(spark, sf_dir)
