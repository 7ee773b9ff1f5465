"""Samples of documents: JSON lines read with a declared type, and generated samples of the five reference scenarios."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import canonical, load_document
from .json_schema import Schema

#: Sizes of the generated samples.
SIZES = {"erp-mes": 100, "material-part": 60, "crm-erp": 50, "account-segments": 80, "order-fulfillment": 70}


def read_samples(spark: SparkSession, path: str, source: Schema, target: Schema) -> DataFrame:
    """id, input, raw (the input as it was written), expected, has_expected, expected_error of a JSON lines file; an expected null is not the same as none.

    Lines without an id or with a repeated one, or with both or neither of the expectations, are kept with ``problem`` set.
    """
    return parse_samples(spark.read.text(path), source, target)


def read_document(spark: SparkSession, path: str, source: Schema) -> DataFrame:
    """One row, input and raw (the document as it was written), of a JSON or YAML file."""
    text = spark.createDataFrame([(canonical(load_document(path)),)], "value string")
    return text.select(F.from_json("value", source.spark_type()).alias("input"), F.parse_json("value").alias("raw"))


def parse_samples(lines: DataFrame, source: Schema, target: Schema) -> DataFrame:
    """The same from a column ``value`` of lines; a line that isn't JSON is kept too, with ``problem`` set."""
    lines = lines.where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"))
    raw = lambda name: F.expr(f"try_variant_get(v, '$.{name}', 'variant')")
    out = lines.select(
        F.expr("try_variant_get(v, '$.id', 'string')").alias("id"),
        F.from_json(F.to_json(raw("input")), source.spark_type()).alias("input"),
        raw("input").alias("raw"),
        F.from_json(F.to_json(raw("expected")), target.spark_type()).alias("expected"),
        raw("expected").isNotNull().alias("has_expected"),
        F.expr("try_variant_get(v, '$.expected_error', 'string')").alias("expected_error"),
        F.col("v").isNull().alias("broken"),
    )
    twice = out.groupBy("id").agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_n") > 1, "repeated id").when(F.col("has_expected") == F.col("expected_error").isNotNull(), "one expectation is needed")
    problem = F.when(F.col("broken"), "not JSON").when(F.col("id").isNull(), "no id").otherwise(problem)
    twice = twice.withColumnRenamed("id", "_id")
    return out.join(twice, F.col("id").eqNullSafe(F.col("_id")), "left").withColumn("problem", problem).drop("_n", "_id", "broken")


#: The generated inputs of the five reference scenarios, by field, as SQL of the row's number i.
_PLACE = "named_struct('street', concat(i + 1, ' {0} Street'), 'city', concat('City', i % 5), 'region', concat('Region', i % 3), 'postalCode', string(10000 + i), 'country', 'US')"
_START = "date_format(timestamp'2026-08-11 08:30:00' + make_interval(0, 0, 0, int(i), int(i % 5)), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")"
INPUTS = {
    "erp-mes": {
        "manufacturingOrder": "concat('MO-', lpad(i + 1, 5, '0'))", "material": "concat('MAT-', 1000 + i % 9)", "plant": "concat('P', i % 4 + 1)", "workCenter": "concat('WC-', i % 5 + 1)",
        "productionLine": "concat('LINE-', i % 3 + 1)", "plannedQuantity": "named_struct('value', double(1 + i % 50), 'unit', if(i < 20, 'DZ', 'EA'))",
        "batch": "if(i % 10 = 9, null, concat('B-', i % 7 + 1))", "systemStatus": "if(i % 2 = 0, 'REL', 'CRTD')", "scheduledStart": f"concat({_START}, element_at(array('Z', '-04:00', '+01:00'), int(i % 3) + 1))",
    },
    "material-part": {
        "materialNumber": "concat('MP-', lpad(i + 1, 5, '0'))", "materialDescription": "concat('Material ', i + 1)", "partDescription": "concat('Legacy part narrative ', i + 1)",
        "baseUnit": "if(i = 1 or i % 60 >= 30, 'LB', 'KG')", "grossWeight": "named_struct('value', case i when 0 then 10d when 1 then 22.046226d else 10d + i * 0.5d end, 'unit', if(i = 1 or i % 60 >= 30, 'LB', 'KG'))",
        "plantData": "transform(sequence(1, if(i % 3 = 0, 3, 2)), k -> named_struct('plant', concat('P', (i + 2 * k - 2) % 4 + 1), 'status', if((k + i) % 3 <> 0, 'ACT', 'INA')))",
    },
    "crm-erp": {
        "customerId": "concat('CUS-', lpad(i + 1, 5, '0'))", "name": "concat('Customer ', i + 1)", "soldToAddress": _PLACE.format("SoldTo"), "shipToAddress": _PLACE.format("ShipTo"),
        "billToAddress": _PLACE.format("BillTo"), "payerId": "concat('PAY-', lpad(i + 1, 5, '0'))", "email": "concat('customer', i + 1, '@example.com')",
    },
    "account-segments": {
        "segments": "named_struct(" + ", ".join(f"'segment{n:02d}', lpad(if(i = 0, {n}, pmod(hash(i, {n}), 1000000)), 6, '0')" for n in range(1, 11)) + ")",
        "effectiveDate": "'2026-08-11'", "currency": "'USD'",
    },
    "order-fulfillment": {
        "orderNumber": "concat('SO-', lpad(i + 1, 5, '0'))", "customer": "named_struct('id', concat('CUST-', lpad(i % 20 + 1, 4, '0')))", "requestedShipDate": f"concat({_START}, 'Z')",
        "items": "transform(sequence(1L, i % 20 + 1), n -> named_struct('lineNumber', n, 'sku', concat('SKU-', 1000 + pmod(hash(i, n), 9000)), 'orderedQuantity', 1 + (n + i) % 24, 'unit', if((n + i) % 3 = 1, 'DZ', 'EA'), 'warehouse', concat('WH-', n % 4 + 1)))",
    },
}
#: Samples that have to fail: their id, what differs from the sample of number 0, and the error.
FAILING = {
    "material-part": {"unsupported-unit": ({"baseUnit": lambda c: F.lit("OZ"), "grossWeight": lambda c: c.withField("value", F.lit(1.0)).withField("unit", F.lit("OZ"))}, "SOURCE_SCHEMA_VALIDATION")},
    "account-segments": {
        "missing-segment": ({"segments": lambda c: c.dropFields("segment10")}, "SOURCE_SCHEMA_VALIDATION"),
        "malformed-length": ({"segments": lambda c: c.withField("segment01", F.lit("12345"))}, "SOURCE_SCHEMA_VALIDATION"),
    },
    "order-fulfillment": {
        "array-limit": ({"items": lambda c: F.transform(F.sequence(F.lit(1), F.lit(10_001)), lambda n: c[0].withField("lineNumber", n.cast("long")))}, "EVALUATION_LIMIT_EXCEEDED"),
        "duplicate-line": ({"items": lambda c: F.array(c[0], c[0])}, "INVARIANT_FAILED"),
    },
}


def generate(spark: SparkSession, scenario: str) -> DataFrame:
    """id, input (JSON text) and expected_error of a scenario's samples, the same in every run; those without an error have what the
    scenario's true mapping gives for them as their expected output (``with_expected``)."""
    rows = spark.range(SIZES[scenario]).withColumnRenamed("id", "i").selectExpr("i", *[f"{x} as {c}" for c, x in INPUTS[scenario].items()])
    fields = list(INPUTS[scenario])
    out = rows.select(F.format_string(f"{scenario}-%03d", F.col("i") + 1).alias("id"), F.to_json(F.struct(*fields)).alias("input"), F.lit(None).cast("string").alias("expected_error"))
    for name, (changed, error) in FAILING.get(scenario, {}).items():
        one = rows.where("i = 0").withColumns({c: change(F.col(c)) for c, change in changed.items()})
        out = out.unionByName(one.select(F.lit(name).alias("id"), F.to_json(F.struct(*fields)).alias("input"), F.lit(error).alias("expected_error")))
    return out


def with_expected(samples: DataFrame, mapping, source: Schema) -> DataFrame:
    """``samples`` with what ``mapping`` makes of each input that isn't to fail, as JSON text."""
    typed = samples.withColumn("_d", F.from_json("input", source.spark_type()))
    made = mapping.transform(typed, "report", "_d")
    kept = F.when(F.col("expected_error").isNull(), F.to_json("output", {"ignoreNullFields": "false"}))
    return made.select(*samples.columns, kept.alias("expected"))
