"""Mapping documents: loaded, checked and applied to DataFrames.

``transform`` adds nothing but columns to the plan: no shuffle, no Python. Modes: ``strict`` raises at the first bad row, ``report``
keeps output, err and issues of all rows, ``ok`` and ``quarantine`` keep the good or the bad rows.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import issues
from ..sources.documents import canonical, load_document, sha256, write_all, yaml_text
from ..sources.json_schema import Schema
from ..sources.pointers import assemble, tokens
from . import compiler, expressions, invariants
from .compiler import Scope, Typed
from .validation import violations

ISSUE = "struct<code:string,pointer:string,detail:string>"


@dataclass(frozen=True)
class Rule:
    target: str
    expression: expressions.Expr
    confidence: float = 1.0


@dataclass(frozen=True)
class Mapping:
    id: str
    rules: tuple[Rule, ...]
    checks: tuple[invariants.Invariant, ...] = ()
    source_schema: str = ""
    target_schema: str = ""
    source_version: str = "unversioned"
    target_version: str = "unversioned"

    @staticmethod
    def parse(raw: Any) -> "Mapping":
        if not isinstance(raw, dict) or raw.get("mapping_version") != "0.1":
            raise issues.fail(issues.UNSUPPORTED_MAPPING_VERSION, "mapping_version is 0.1")
        rules = tuple(Rule(r["target"], expressions.parse(r["expression"]), float(r.get("confidence", 1.0))) for r in raw.get("rules", ()))
        checks = tuple(invariants.Invariant.parse(i) for i in raw.get("invariants") or ())
        return Mapping(
            raw.get("id", "mapping"), rules, checks, raw.get("source_schema", ""), raw.get("target_schema", ""),
            str(raw.get("source_schema_version", "unversioned")), str(raw.get("target_schema_version", "unversioned")),
        )

    @staticmethod
    def load(path: str) -> "Mapping":
        return Mapping.parse(load_document(path))

    def document(self) -> dict:
        return {
            "mapping_version": "0.1", "id": self.id, "source_schema": self.source_schema, "source_schema_version": self.source_version,
            "target_schema": self.target_schema, "target_schema_version": self.target_version,
            "rules": [{"target": r.target, "expression": r.expression.document(), "confidence": r.confidence} for r in self.rules],
            "invariants": [c.document() for c in self.checks],
        }

    def write(self, path: str, force: bool = False) -> None:
        """The whole document, as YAML or as canonical JSON by the path's ending; ``load`` reads it back as it was."""
        text = yaml_text(self.document()) if path.endswith((".yaml", ".yml")) else canonical(self.document()) + "\n"
        write_all({path: text}, force)

    def sha256(self) -> str:
        return sha256(self.document())

    def compiled(self, scope: Scope) -> Typed:
        """The output document: rules in the order of their target's tokens, the first failing one gives the error."""
        done: dict[str, Typed] = {}
        for rule in sorted(self.rules, key=lambda r: tokens(r.target)):
            if rule.target in done:
                raise issues.fail(issues.DUPLICATE_TARGET_ASSIGNMENT, "two rules have this target", rule.target)
            done[rule.target] = compiler.limited(compiler.compile_expression(rule.expression, scope))
        value, kind = _tree(assemble(done))
        return Typed(value, compiler.first(*[p.err for p in done.values()]), kind)

    def columns(self, df: DataFrame, input_column: str | None = None) -> tuple[Column, Column, T.DataType]:
        """(output, err, the output's type) over ``df``: its columns are the document, or those of a struct column."""
        made = self.compiled(Scope(_input(df, input_column))).masked()
        return made.value, made.code, made.type

    def transform(
        self, df: DataFrame, mode: str = "report", input_column: str | None = None, source: Schema | None = None, target: Schema | None = None,
        raw: str | None = None,
    ) -> DataFrame:
        """``df`` with output, err (a stable code or null) and issues (array of code, pointer, detail).

        Stages run in order, a failing one ends the row: source validation, the rules, target validation with
        invariants. Without schemas, their validations are left out. ``raw``: a VARIANT column with the documents as they were
        written, which tells a missing field from a written null; without it, a null of a typed column is a written null.
        """
        document = _input(df, input_column)
        before, after = compiler.Binder("_b"), compiler.Binder("_a")
        made = self.compiled(Scope(document, binder=before, present=None if raw is None else written_null(raw)))
        none = F.expr(f"cast(array() as array<{ISSUE}>)")
        seen = _named(violations(document.value, document.type, source.resolved), issues.SOURCE_SCHEMA_VALIDATION) if source else none
        out = before.apply(df).withColumns({"_source": seen, "_ran": made.code})
        out = out.withColumn("err", F.when(F.size("_source") > 0, F.lit(issues.SOURCE_SCHEMA_VALIDATION)).otherwise(F.col("_ran")))
        out = out.withColumn("output", F.when(F.col("err").isNull(), made.value)).drop(*before.names(), "_ran")
        scope = Scope(document, Typed(F.col("output"), None, made.type), binder=after)
        checked: dict[str, Column] = {}
        for n, check in enumerate(self.checks):
            failed, unknown = invariants.holds(check, scope)
            said = F.when(failed, "failed").when(unknown, "could not be evaluated")
            row = F.struct(F.lit(issues.INVARIANT_FAILED).alias("code"), F.lit(check.id).alias("pointer"), said.alias("detail"))
            checked[f"_c{n}"] = F.when(F.col("output").isNotNull() & said.isNotNull(), F.array(row)).otherwise(none)
        if target:
            broken = _named(violations(F.col("output"), made.type, target.resolved), issues.TARGET_SCHEMA_VALIDATION)
            checked = {"_t": F.when(F.col("output").isNotNull(), broken).otherwise(none)} | checked
        out = after.apply(out).withColumns(checked) if checked else out
        rule = F.struct(F.col("err").alias("code"), F.lit("").alias("pointer"), F.lit("evaluation").alias("detail"))
        ran = F.when((F.size("_source") == 0) & F.col("err").isNotNull(), F.array(rule)).otherwise(none)
        out = out.withColumn("issues", F.concat(F.col("_source"), ran, *map(F.col, checked)))
        code = F.coalesce("err", F.get(F.col("issues"), F.lit(0))["code"])
        # Always true, but not for the optimiser: a filter on err would else be pushed down by writing out, level by level, all that
        # err was made from, which grows without bound and could reach no scan anyway.
        out = out.withColumn("err", F.when(F.spark_partition_id() >= 0, code)).drop("_source", *checked, *after.names())
        if mode == "report":
            return out
        if mode in ("ok", "quarantine"):
            return out.where(F.col("err").isNull() if mode == "ok" else F.col("err").isNotNull())
        if mode != "strict":
            raise issues.fail(issues.INVALID_INPUT, f"no mode {mode!r}")
        # a filter that no action can do without; a column that raises is pruned where it isn't read
        return out.where(F.when(F.col("err").isNull(), True).otherwise(F.raise_error(F.col("err")).cast("boolean")))

    def sql(self, df: DataFrame, input_column: str | None = None) -> str:
        """The plan's expressions as Spark prints them, the portable form of the compiled mapping."""
        value, err, _ = self.columns(df, input_column)
        return df.select(value.alias("output"), err.alias("err"))._jdf.queryExecution().analyzed().toString()


def _input(df: DataFrame, column: str | None) -> Typed:
    if column is not None:
        return Typed(F.col(column), None, df.schema[column].dataType)
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    return Typed(F.struct(*columns.values()), None, df.schema, columns=columns)


def written_null(raw: str):
    """Says of a pointer's tokens whether the VARIANT column ``raw`` has a null written there."""

    def said(parts: tuple[str, ...]) -> Column:
        steps = "".join(f"[{p}]" if p.isascii() and p.isdigit() else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in parts)
        found = F.try_variant_get(F.col(raw), "$" + steps, "variant")
        return F.coalesce(F.is_variant_null(found), F.lit(False))

    return said


def _tree(node: Any) -> tuple[Column, T.DataType]:
    if isinstance(node, Typed):
        return node.value, node.type
    parts = {k: _tree(v) for k, v in node.items()}
    return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), T.StructType([T.StructField(k, t) for k, (_, t) in parts.items()])


def _named(found: Column, code: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(code).alias("code"), x["pointer"].alias("pointer"), x["category"].alias("detail")))


def verify_samples(
    mapping: Mapping, samples: DataFrame, source: Schema, target: Schema, expected: DataFrame | None = None, id_column: str = "id", input_column: str = "input",
    raw: str | None = None,
) -> DataFrame:
    """id, err and issues of each sample (id, input); where ``expected`` (id, expected) has a document, the output must equal it."""
    from ..functions import values

    done = mapping.transform(samples, "report", input_column, source, target, raw)
    if expected is not None:
        t_out, t_expected = done.schema["output"].dataType, expected.schema["expected"].dataType
        t_out, t_want = values.normal_type(t_out), values.normal_type(t_expected)
        both = values.merged_type(t_out, t_want)  # expected documents are read with the whole target type
        wanted = values.normal_value(F.col("expected"), t_expected)
        same = F.lit(False) if both is None else values.padded(F.col("output"), t_out, both).eqNullSafe(values.padded(wanted, t_want, both))
        done = done.join(expected.select(id_column, "expected", F.lit(True).alias("_golden")), id_column, "left")
        golden = F.struct(F.lit(issues.GOLDEN_OUTPUT_MISMATCH).alias("code"), F.lit("").alias("pointer"), F.lit("output").alias("detail"))
        off = F.col("_golden") & F.col("output").isNotNull() & ~same
        done = done.withColumn("issues", F.when(off, F.array_append("issues", golden)).otherwise(F.col("issues")))
    return done.select(id_column, F.get(F.col("issues"), F.lit(0))["code"].alias("err"), "issues", "output")


__all__ = ["Mapping", "Rule", "verify_samples"]
