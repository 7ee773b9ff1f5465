"""Profiles of samples: one row a field, in one pass and one aggregation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Typed, resolve
from ..plans.mapping import written_null
from ..sources.json_schema import Schema
from ..sources.pointers import pointer, tokens

#: The classes of strings, in the order of their tests, and the tests.
CLASSES = (
    ("empty", r"\A\z"),
    ("uuid", r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"),
    ("integer-string", r"\A[+-]?[0-9]+\z"),
    ("decimal-string", r"\A[+-]?[0-9]+\.[0-9]+\z"),
    ("iso-date", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
    ("rfc3339-date-time", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"),
    ("email-like", r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"),
    ("uri-like", r"\A(?i:[a-z][a-z0-9+.-]*)://"),
    ("uppercase-code", r"\A[A-Z0-9][A-Z0-9_-]*\z"),
    ("lowercase-word", r"\A[a-z0-9][a-z0-9_-]*\z"),
)


def pattern_class(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, test in CLASSES:
        out = out.when(c.rlike(test), name)
    return out.otherwise("mixed-text")


def _observed(c: Column, t: T.DataType) -> Column:
    """The JSON type of a value; integral doubles are integers, as their texts say."""
    if isinstance(t, T.DoubleType):
        return F.when(c == F.floor(c).cast("double"), "integer").otherwise("number")
    names = {T.LongType: "integer", T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object"}
    return F.lit(names.get(type(t), "null"))


def profile(df: DataFrame, fields: list[str] | Schema | None = None, approximate: bool = False, raw: str | None = None) -> DataFrame:
    """pointer, sample_count, missing_count, null_count, observed_types, distinct_count, min_length, max_length, pattern_classes.

    ``df``'s columns are the document. Fields inside arrays never resolve, so they count as missing; so does a field that the
    type lacks. ``raw``: a VARIANT column (no field itself) with the documents as they were written, by which a null that wasn't
    written is missing. Distinct counts are exact, but for values that agree in 128 bits of hashes, unless ``approximate``.
    """
    names = [c for c in df.columns if c != raw]
    root = Typed(F.struct(*[F.col(f"`{c}`") for c in names]), None, df.select(*[f"`{c}`" for c in names]).schema)
    present = None if raw is None else written_null(raw)
    paths = [f.pointer for f in fields.fields if f.pointer] if isinstance(fields, Schema) else fields or [pointer([c]) for c in names]
    rows = []
    for path in sorted(paths, key=tokens):
        at = resolve(root, path, present)
        c, t = at.value, at.type
        missing = F.lit(False) if at.err is None else at.err.isNotNull()
        scalar = not isinstance(t, (T.ArrayType, T.StructType, T.NullType))
        text = c.cast("string") if scalar else F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(path).alias("pointer"), missing.alias("missing"), (~missing & c.isNull()).alias("empty"),
            F.when(~missing, F.when(c.isNull(), "null").otherwise(_observed(c, t))).alias("kind"),
            F.when(~missing & c.isNotNull(), text).alias("text"), F.lit(isinstance(t, T.StringType)).alias("is_text"),
        ))
    flat = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    string = F.when(F.col("is_text"), F.col("text"))
    distinct = F.approx_count_distinct("text") if approximate else F.countDistinct(F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), F.xxhash64(F.concat(F.lit("+"), "text")))))
    out = flat.groupBy("pointer").agg(
        F.count("*").alias("sample_count"), F.count_if("missing").alias("missing_count"), F.count_if("empty").alias("null_count"),
        F.array_sort(F.collect_set("kind")).alias("observed_types"), distinct.alias("distinct_count"),
        F.min(F.length(string)).alias("min_length"), F.max(F.length(string)).alias("max_length"), F.collect_set(pattern_class(string)).alias("seen"),
    )
    order = F.array(*[F.lit(n) for n, _ in CLASSES], F.lit("mixed-text"))
    return out.withColumn("pattern_classes", F.filter(order, lambda x: F.array_contains("seen", x))).drop("seen")



