"""Benchmark metrics, gates and the closed loop over a pack: schemas, samples, truth, hints, review."""
from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import issues
from ..plans import invariants
from ..plans.compiler import Scope, Typed
from ..plans.mapping import Mapping, verify_samples
from ..sources.documents import canonical, load_document
from ..sources.json_schema import Schema, load_schema, units
from . import matching, review, static


def ratio(numerator: Column, denominator: Column, expects_zero: Column | bool = False, absence: Column | bool = False) -> Column:
    """A rate; an empty denominator is 1 where none was expected, 0 where it counts failures, else 0."""
    expects_zero, absence = (x if isinstance(x, Column) else F.lit(x) for x in (expects_zero, absence))
    empty = F.when(absence, 0.0).when(expects_zero, 1.0).otherwise(0.0)
    return F.when(denominator > 0, numerator / F.when(denominator > 0, denominator)).otherwise(empty)


def rates(evidence: DataFrame) -> DataFrame:
    """metric, numerator, denominator and value of (metric, numerator, denominator, expects_zero, absence)."""
    value = F.round(ratio(F.col("numerator"), F.col("denominator"), F.col("expects_zero"), F.col("absence")), 12)
    return evidence.select("metric", "numerator", "denominator", value.alias("value"))


def check_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """metric, value, minimum, maximum and passed of every gate (metric, minimum, maximum); a metric that isn't there fails."""
    low = F.col("minimum").isNull() | (F.col("value") >= F.col("minimum"))
    high = F.col("maximum").isNull() | (F.col("value") <= F.col("maximum"))
    joined = gates.join(metrics.select("metric", "value"), "metric", "left")
    return joined.select("metric", "value", "minimum", "maximum", F.coalesce(low & high & F.col("value").isNotNull(), F.lit(False)).alias("passed"))


@dataclass(frozen=True)
class Pack:
    id: str
    source: Schema
    target: Schema
    truth: Mapping
    hints: dict
    review: dict
    samples: tuple[dict, ...]
    manifest: dict

    @staticmethod
    def load(folder: str, samples: list[dict] | None = None) -> "Pack":
        """A pack's folder; ``samples`` where its file isn't there."""
        manifest = load_document(f"{folder}/manifest.yaml")
        at = lambda name: f"{folder}/{manifest[name]}"
        if samples is None:
            with open(at("samples"), encoding="utf-8") as f:
                samples = [json.loads(line) for line in f if line.strip()]
        pack = Pack(manifest["id"], load_schema(at("source_schema")), load_schema(at("target_schema")), Mapping.load(at("expected_mapping")), load_document(at("hints")), load_document(at("review")), tuple(samples), manifest)
        pack.reconcile()
        return pack

    def reconcile(self) -> None:
        """Samples have ids of their own and either an expected output or an expected error; truth and no-match cover the units."""
        ids = [s.get("id") for s in self.samples]
        if not ids or len(set(ids)) < len(ids) or any(("expected" in s) == ("expected_error" in s) for s in self.samples):
            raise issues.fail(issues.INVALID_INPUT, "samples need ids of their own and one expectation each")
        wanted, told = {f.pointer for f in units(self.target)}, {r.target for r in self.truth.rules}
        none = set(self.manifest.get("expected_no_match_targets") or ())
        if told & none or (told | none) - wanted or wanted - told - none:
            raise issues.fail(issues.INVALID_INPUT, "truth and no-match targets are the target's units, once each")


def _direct(expression: Any) -> str | None:
    """The source path of a plain read."""
    if expression is None:
        return None
    if expression.op == "coalesce" and len(expression["operands"]) == 1:
        expression = expression["operands"][0]
    return expression["path"] if expression.op == "get" and expression["document"] == "input" else None


def _text(expression: Any) -> str | None:
    return None if expression is None else canonical(expression.document())


def outcome_frame(spark: SparkSession, pack: Pack, baseline: matching.Report, assisted: matching.Report) -> DataFrame:
    """A row for each unit: what was suggested, what is true."""
    truth = {r.target: r.expression for r in pack.truth.rules}
    rows = []
    for f in units(pack.target):
        b, a = baseline.find(f.pointer), assisted.find(f.pointer)
        e = truth.get(f.pointer)
        rows.append((
            f.pointer, f.required, b.disposition if b else None, b.band if b else None, b is not None and b.rule is not None, _direct(b.rule.expression) if b and b.rule else None,
            _text(a.rule.expression) if a and a.rule else None, e is not None, _direct(e), _text(e),
            f.pointer in (pack.manifest.get("expected_ambiguous_targets") or ()), f.pointer in (pack.manifest.get("expected_no_match_targets") or ()),
        ))
    schema = (
        "target string, required boolean, disposition string, band string, has_rule boolean, path string, assisted string, known boolean, true_path string, true_text string, "
        "ambiguous boolean, no_match boolean"
    )
    return spark.createDataFrame(rows, schema)


def match_evidence(outcomes: DataFrame, mapped: DataFrame) -> DataFrame:
    """The metrics of matching as (metric, numerator, denominator, expects_zero, absence), in one aggregation.

    ``mapped``: (target, text) of the rules of the reviewed mapping.
    """
    rows = outcomes.join(mapped.select("target", F.col("text").alias("mapped")), "target", "left")
    c, n = F.col, lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    direct, right = c("path").isNotNull(), c("path") == c("true_path")
    resolvable = c("true_path").isNotNull() & ~c("ambiguous")
    changed = c("known") & c("true_path").isNull()
    high = (c("band") == "high") & (c("disposition") == "suggested")
    is_what = lambda what: c("disposition") == what
    table = {
        "target_outcome_coverage": (n(c("disposition").isNotNull()), F.count("*"), False, False),
        "direct_match_precision": (n(direct & right), n(direct), False, False),
        "direct_match_recall": (n(direct & right), n(resolvable), True, False),
        "transformation_exact_match_rate": (n(changed & (c("assisted") == c("true_text"))), n(changed), True, False),
        "high_confidence_false_positive_rate": (n(high & ~F.coalesce(right, F.lit(False))), n(high), False, True),
        "ambiguity_precision": (n(is_what("ambiguous") & c("ambiguous")), n(is_what("ambiguous")), ~F.bool_or("ambiguous"), False),
        "expected_ambiguity_detection": (n(is_what("ambiguous") & c("ambiguous")), n(c("ambiguous")), True, False),
        "no_match_precision": (n(is_what("no_match") & c("no_match")), n(is_what("no_match")), ~F.bool_or("no_match"), False),
        "no_match_recall": (n(is_what("no_match") & c("no_match")), n(c("no_match")), True, False),
        "expected_no_match_detection": (n(is_what("no_match") & c("no_match")), n(c("no_match")), True, False),
        "required_target_coverage": (n(c("required") & (c("mapped") == c("true_text"))), n(c("required")), True, False),
    }
    for b in ("high", "medium", "low"):
        own = (c("band") == b) & c("has_rule")
        table[f"{b}_confidence_precision"] = (n(own & right), n(own), False, False)
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    packed = [F.struct(F.lit(k).alias("metric"), a.alias("numerator"), b.alias("denominator"), flag(z).alias("expects_zero"), flag(x).alias("absence")) for k, (a, b, z, x) in table.items()]
    return rows.agg(F.array(*packed).alias("all")).select(F.explode("all").alias("e")).select("e.*")


def sample_frames(spark: SparkSession, pack: Pack) -> tuple[DataFrame, DataFrame]:
    """(id, input) and (id, expected) of a pack's samples, typed by its schemas."""
    source, target = pack.source.spark_type(), pack.target.spark_type()
    text = spark.createDataFrame([(s["id"], json.dumps(s["input"]), json.dumps(s["expected"]) if "expected" in s else None) for s in pack.samples], "id string, i string, e string")
    samples = text.select("id", F.from_json("i", source).alias("input"))
    return samples, text.where("e is not null").select("id", F.from_json("e", target).alias("expected"))


def compiles(mapping: Mapping | None, samples: DataFrame, pack: Pack) -> bool:
    """Whether the mapping's plan over the samples can be built, its physical plan included."""
    if mapping is None:
        return False
    try:
        mapping.transform(samples, "report", "input", pack.source, pack.target)._jdf.queryExecution().executedPlan()
    except Exception:  # whatever the plan fails by, it is the measure's answer
        return False
    return True


def _said_by(name: str):
    return lambda x: (x["code"] == issues.INVARIANT_FAILED) & (x["pointer"] == name)


def held_invariants(mapping: Mapping, samples: DataFrame, wanted: DataFrame, observed: DataFrame) -> tuple[int, int]:
    """(held, counted): each invariant of each sample that is to succeed, or to fail by an invariant, counts where its guard is true or
    can't be worked out; a sample that failed as it had to holds all of its own, one that failed otherwise none."""
    document = Typed(F.col("input"), None, samples.schema["input"].dataType)
    done = samples.join(wanted, "id").join(observed.select("id", "err", "issues", "output"), "id")
    scope = Scope(document, Typed(F.col("output"), None, observed.schema["output"].dataType))
    counts = done.where(F.col("expected_error").isNull() | (F.col("expected_error") == issues.INVARIANT_FAILED))
    held = counted = F.lit(0)
    for check in mapping.checks:
        own = invariants.applies(check, scope)
        failed = F.array_size(F.filter("issues", _said_by(check.id))) > 0
        ok = F.when(F.col("expected_error").isNull(), F.col("output").isNotNull() & ~failed).otherwise(F.col("err").eqNullSafe(F.lit(issues.INVARIANT_FAILED)))
        counted, held = counted + own.cast("int"), held + (own & ok).cast("int")
    row = counts.agg(F.coalesce(F.sum(held), F.lit(0)).alias("held"), F.coalesce(F.sum(counted), F.lit(0)).alias("counted")).first()
    return row["held"], row["counted"]


def benchmark(spark: SparkSession, pack: Pack) -> dict[str, Any]:
    """All metrics of a pack, its gates, and the counts of outcomes."""
    baseline = matching.suggest(spark, pack.source, pack.target)
    assisted = matching.suggest(spark, pack.source, pack.target, pack.hints)
    made = review.assemble(spark, assisted, pack.review, pack.source, pack.target, "review-document-only", True, bound=False)
    mapping = made.mapping and Mapping(made.mapping.id, made.mapping.rules, pack.truth.checks, made.mapping.source_schema, made.mapping.target_schema, made.mapping.source_version, made.mapping.target_version)
    mapped = spark.createDataFrame([(r.target, _text(r.expression)) for r in (mapping.rules if mapping else ())], "target string, text string")
    evidence = match_evidence(outcome_frame(spark, pack, baseline, assisted), mapped)
    extra = [("review_application_correctness", sum(_decided(a, pack) for a in made.applied), len(made.applied), True, False), ("compile_success_rate", int(compiles(mapping, sample_frames(spark, pack)[0], pack)), 1, False, False)]
    extra += [(name, int(ok), 1, False, False) for name, ok in zip(("invalid_source_path_rejection", "duplicate_target_rejection"), _probes(mapping, pack))]
    observed = spark.createDataFrame([], "id string, err string, issues array<struct<code:string,pointer:string,detail:string>>")
    wanted = spark.createDataFrame([(s["id"], s.get("expected_error")) for s in pack.samples], "id string, expected_error string")
    held = counted = 0
    if mapping:
        samples, expected = sample_frames(spark, pack)
        observed = verify_samples(mapping, samples, pack.source, pack.target, expected)
        held, counted = held_invariants(mapping, samples, wanted, observed)
        observed = observed.drop("output")
    rows = wanted.join(observed, "id", "left")
    ran = F.col("expected_error").isNull()
    has = lambda code: F.exists("issues", lambda x: x["code"] == code)
    sums = rows.agg(
        F.count_if(ran & ~has(issues.TARGET_SCHEMA_VALIDATION)).alias("valid"), F.count_if(ran).alias("ran"),
        F.count_if(F.col("err").eqNullSafe(F.col("expected_error"))).alias("equal"), F.count("*").alias("all"),
    ).first()
    extra += [
        ("target_schema_pass_rate", sums["valid"], sums["ran"], True, False), ("cross_runtime_equivalence", sums["equal"], sums["all"], False, False),
        ("invariant_pass_rate", held, counted, not pack.truth.checks, False),
    ]
    schema = "metric string, numerator long, denominator long, expects_zero boolean, absence boolean"
    metrics = rates(evidence.unionByName(spark.createDataFrame(extra, schema)))
    gates = spark.createDataFrame([(k, v.get("minimum") and float(v["minimum"]), None if v.get("maximum") is None else float(v["maximum"])) for k, v in pack.manifest.get("release_gates", {}).items()], "metric string, minimum double, maximum double")
    return {
        "metrics": {r["metric"]: (r["numerator"], r["denominator"], r["value"]) for r in metrics.collect()},
        "gates": {r["metric"]: r["passed"] for r in check_gates(metrics, gates).collect()},
        "baseline": baseline.counts(), "assisted": assisted.counts(),
    }


def model_rates(proposals: DataFrame, truth: DataFrame, batches: DataFrame) -> DataFrame:
    """metric, numerator, denominator and value of the nine rates of a model's run.

    ``proposals``: target, proposed (else abstained), path (of a plain read), text (the expression's canonical text), valid (passes static
    verification). ``truth``: target, path, text, ambiguous, no_match of every target asked for. ``batches``: valid, targets of each.
    """
    c, n = F.col, lambda x: F.count_if(F.coalesce(x, F.lit(False))).cast("long")
    told = truth.select("target", c("path").alias("true_path"), c("text").alias("true_text"), "ambiguous", "no_match")
    rows = proposals.join(told, "target", "left")
    right = c("proposed") & (c("path") == c("true_path")) & ~c("ambiguous")
    exact = c("proposed") & c("valid") & (c("text") == c("true_text"))
    by_target = rows.groupBy("target").agg(F.bool_or(F.coalesce(exact, F.lit(False))).alias("exact"), F.bool_or(~c("proposed")).alias("abstained"))
    asked = told.join(by_target, "target", "left")
    a = rows.agg(
        n(c("proposed") & c("valid")).alias("valid"), n(c("proposed")).alias("proposed"), n(right).alias("right"), n(c("proposed") & c("path").isNotNull()).alias("direct"),
        n(c("proposed") & c("true_path").isNull() & (c("text") == c("true_text"))).alias("exact"), F.countDistinct("target").alias("covered"),
    ).first()
    t = asked.agg(
        n(c("true_path").isNotNull() & ~c("ambiguous")).alias("direct"), n(c("true_text").isNotNull() & c("true_path").isNull()).alias("changed"),
        n(c("ambiguous")).alias("ambiguous"), n(c("ambiguous") & c("abstained")).alias("ambiguous_kept"), n(c("no_match")).alias("none"), n(c("no_match") & c("abstained")).alias("none_kept"),
        n(c("true_text").isNotNull() & ~F.coalesce("exact", F.lit(False)) | c("no_match") & ~F.coalesce("abstained", F.lit(False))).alias("open"),
    ).first()
    b = batches.agg(n(c("valid")).alias("valid"), F.count("*").alias("all"), F.coalesce(F.sum("targets"), F.lit(0)).cast("long").alias("targets")).first()
    table = [
        ("model_response_validity_rate", b["valid"], b["all"], False), ("model_target_proposal_coverage", a["covered"], b["targets"], False),
        ("model_proposal_static_validity_rate", a["valid"], a["proposed"], False), ("model_direct_match_precision", a["right"], a["direct"], False),
        ("model_direct_match_recall", a["right"], t["direct"], False), ("model_transformation_exact_match_rate", a["exact"], t["changed"], False),
        ("model_expected_ambiguity_abstention", t["ambiguous_kept"], t["ambiguous"], True), ("model_expected_no_match_abstention", t["none_kept"], t["none"], True),
        ("model_full_mapping_completion_rate", int(t["open"] == 0), 1, False),
    ]
    spark = proposals.sparkSession
    return rates(spark.createDataFrame([(*x, False) for x in table], "metric string, numerator long, denominator long, expects_zero boolean, absence boolean"))


def model_usage(batches: DataFrame) -> DataFrame:
    """model_input_tokens, model_output_tokens (null if any batch's aren't known) and model_latency_ms of (input_tokens, output_tokens, latency_ms)."""
    known = lambda x: F.when(F.count(x) == F.count("*"), F.coalesce(F.sum(x), F.lit(0)))
    return batches.agg(known("input_tokens").alias("model_input_tokens"), known("output_tokens").alias("model_output_tokens"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("model_latency_ms"))


def _decided(applied: tuple, pack: Pack) -> bool:
    """Whether an applied decision agrees with the truth: rejected targets have none, accepted ones the true source."""
    target, action, accepted, source = applied
    truth = {r.target: r.expression for r in pack.truth.rules}.get(target)
    return (truth is None) if action in ("reject", "defer") else accepted and truth is not None and _direct(truth) == source


def _probes(mapping: Mapping | None, pack: Pack) -> tuple[bool, bool]:
    """Whether verification refuses the mapping with a read of a field that isn't there, and with a rule twice."""
    if not mapping:
        return False, False
    raw = mapping.document()

    def spoil(node: Any) -> bool:
        if isinstance(node, dict) and node.get("op") == "get" and node["document"] == "input":
            node["path"] = "/no such field"
            return True
        return any(map(spoil, node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()))

    spoil(raw["rules"])
    codes = lambda m: {code for _, code, _, _ in static.verify_static(m, pack.source, pack.target)}
    twice = Mapping(mapping.id, (*mapping.rules, mapping.rules[0]))
    return issues.SOURCE_PATH_NOT_FOUND in codes(Mapping.parse(raw)), issues.DUPLICATE_TARGET_ASSIGNMENT in codes(twice)
