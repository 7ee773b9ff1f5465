"""Matching source fields to target fields: seven signals, a weighted score, top k, confidence, ambiguity, suggestions.

Both catalogues are a few thousand rows at most; features of fields are worked out when the catalogue is built, the pairs,
scores, ranks and margins are DataFrame operations.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import issues
from ..functions.similarity import lcs_ratio, name_tokens
from ..plans.expressions import parse
from ..plans.mapping import Rule
from ..sources.documents import canonical, sha256
from ..sources.json_schema import Field, Schema, units
from ..sources.pointers import tokens
from . import static

#: Weights of the signals and thresholds of the decision.
WEIGHTS = {"exact_name": 0.40, "name_similarity": 0.20, "description_similarity": 0.15, "type_compatibility": 0.15, "enum_overlap": 0.05, "structural_context": 0.05, "sample_profile": 0.0}
HIGH, MEDIUM, LOW, AMBIGUOUS, AUTO = 0.90, 0.70, 0.40, 0.08, 0.12
TOP_K = 10
#: The most fields of a target: their frame is sent to all tasks, so its size is looked at first.
FIELDS_MOST = 20_000
FIELD = (
    "path string, required boolean, types array<string>, enum array<string>, name array<string>, title array<string>, name_text string, title_text string, "
    "description string, parents array<string>, roles array<string>, classes array<string>"
)


def check_weights(weights: dict[str, float]) -> None:
    if set(weights) != set(WEIGHTS) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9 or weights["sample_profile"] > 0.15:
        raise issues.fail(issues.INVALID_INPUT, "weights are seven, none below zero, of sum one, the profile's at most 0.15")


def _features(f: Field, classes: list[str] | None) -> tuple:
    parents = sorted({t for p in tokens(f.pointer)[:-1] for t in name_tokens(p)})
    title, description = f.title or "", f.description or ""
    roles = set(parents) | set(name_tokens(f.name)) | set(name_tokens(title)) | set(name_tokens(description))
    if roles & {"billing", "bill"}:
        roles.add("bill")
    return (
        f.pointer, f.required, sorted(f.types), sorted(canonical(v) for v in f.enum), sorted(name_tokens(f.name)), sorted(name_tokens(title)),
        " ".join(name_tokens(f.name)), " ".join(name_tokens(title)), description, parents, sorted(roles), classes,
    )


def field_frame(spark: SparkSession, fields: list[Field], prefix: str, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    df = spark.createDataFrame([_features(f, (profiles or {}).get(f.pointer)) for f in fields], FIELD)
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def compatibility() -> Column:
    """Null prunes the pair."""
    s, t = F.col("s_types"), F.col("t_types")
    has = F.array_contains
    overlap = F.size(F.array_intersect(s, t))
    disjoint = (F.size("s_enum") > 0) & (F.size("t_enum") > 0) & ~F.arrays_overlap("s_enum", "t_enum")
    only_null = (F.size(s) == 1) & has(s, "null")
    pruned = (
        (has(s, "object") & (F.size(F.array_except(s, F.array(F.lit("object"), F.lit("null")))) > 0))
        | (has(s, "array") != has(t, "array"))
        | disjoint
        | (only_null & F.col("t_required") & ~has(t, "null"))
    )
    score = F.when(overlap == F.size(s), 1.0).when(overlap > 0, 0.8).when(has(s, "integer") & has(t, "number"), 0.9).when(has(s, "string") & has(t, "number"), 0.4)
    return F.when(~pruned, score)


def _jaccard(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))

def role_similarity() -> Column:
    """A score that overrides description and context where the target's words name a role, else null. The words are fixed values."""
    s = lambda *w: F.arrays_overlap("s_roles", F.array(*map(F.lit, w)))
    t = lambda w: F.array_contains("t_roles", w)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return (
        F.when(t("identifier") & ~s("identifier"), 0.0)
        .when(t("payer"), yes(s("payer")))
        .when(t("bill"), yes(s("bill")))
        .when(t("primary") & t("address"), yes(s("primary", "ship", "sold")))
        .when(t("business") & t("partner"), F.when(s("payer"), 0.0).when(s("customer", "sold", "primary"), 1.0))
    )


def score_pairs(sources: DataFrame, targets: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Every compatible pair of fields with its signals and raw_score (12 digits)."""
    weights = weights or WEIGHTS
    check_weights(weights)
    same = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.col(a) == F.col(b))
    if targets.count() > FIELDS_MOST:
        raise issues.fail(issues.INVALID_INPUT, f"a catalogue has {FIELDS_MOST} fields at most")
    pairs = sources.crossJoin(F.broadcast(targets)).withColumn("type_compatibility", compatibility()).where("type_compatibility is not null")
    name = same("s_name", "t_name") | same("s_name", "t_title") | same("s_title", "t_name")
    titled = lambda c, a, b: F.when(F.col(c) != "", lcs_ratio(a, b)).otherwise(0.0)
    likeness = F.when(name, 1.0).otherwise(F.greatest(lcs_ratio("s_name_text", "t_name_text"), titled("t_title_text", "s_name_text", "t_title_text"), titled("s_title_text", "s_title_text", "t_name_text")))
    said = F.when((F.col("s_description") != "") & (F.col("t_description") != ""), lcs_ratio("s_description", "t_description")).otherwise(0.0)
    context = (
        F.when((F.size("s_parents") == 0) & (F.size("t_parents") == 0), 1.0)
        .when((F.size("s_parents") == 0) | (F.size("t_parents") == 0), 0.0)
        .otherwise(_jaccard("s_parents", "t_parents"))
    )
    sampled = F.when(F.col("s_classes").isNotNull() & F.col("t_classes").isNotNull(), F.size(F.array_intersect("s_classes", "t_classes")) / F.greatest(F.size(F.array_union("s_classes", "t_classes")), F.lit(1)))
    scored = (
        pairs.withColumn("_role", role_similarity())
        .withColumn("exact_name", F.when(name, 1.0).otherwise(0.0))
        .withColumn("name_similarity", likeness)
        .withColumn("description_similarity", F.coalesce("_role", said))
        .withColumn("enum_overlap", F.when((F.size("s_enum") > 0) & (F.size("t_enum") > 0), _jaccard("s_enum", "t_enum")).otherwise(0.0))
        .withColumn("structural_context", F.coalesce("_role", context))
        .withColumn("sample_profile", F.coalesce(sampled, F.lit(0.0)))
    )
    total = F.lit(0.0)
    for signal in WEIGHTS:
        total = total + F.col(signal) * F.lit(weights[signal])
    return scored.select(F.col("s_path").alias("source_path"), F.col("t_path").alias("target_path"), *WEIGHTS, F.bround(total, 12).alias("raw_score"))


def top_candidates(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best sources of each target: score first, then path."""
    order = Window.partitionBy("target_path").orderBy(F.desc("raw_score"), "source_path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score >= LOW, "low").otherwise("none")


def decide(eligible: DataFrame) -> DataFrame:
    """target_path, source_path, confidence, band, margin and disposition of the best eligible candidate of each target."""
    order = Window.partitionBy("target_path").orderBy(F.desc("raw_score"), "source_path")
    best = (
        eligible.withColumn("_next", F.lead("raw_score").over(order)).withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
        .withColumn("margin", F.coalesce(F.col("raw_score") - F.col("_next"), F.lit(1.0)))
    )
    score, margin = F.col("raw_score"), F.col("margin")
    close = F.col("_next").isNotNull() & (margin <= AMBIGUOUS)
    what = (
        F.when(score < LOW, "no_match").when(close, "ambiguous").when((score >= HIGH) & (margin >= AUTO), "suggested")
        .when((score < HIGH) | (margin > AMBIGUOUS), "review_required").otherwise("no_match")
    )
    return best.select("target_path", "source_path", score.alias("confidence"), band(score).alias("band"), "margin", what.alias("disposition"))


def direct_rule(source: Schema, source_path: str, target_path: str) -> Rule:
    get = {"op": "get", "path": source_path}
    field = source.find(source_path)
    return Rule(target_path, parse(get if field is None or field.required else {"op": "coalesce", "operands": [get]}), 0.0)


#: The kinds of hints, and what each needs besides its target.
HINTS = {
    "direct": {"source"}, "lookups": {"source", "values"}, "unit_conversions": {"value_source", "unit_source", "factors"}, "dates": {"source", "pattern"}, "constants": {"value"}, "expressions": {"expression"},
}


def check_hints(hints: dict[str, Any]) -> None:
    """Refuses a hints document of another version, or with kinds or fields that are missing or unknown."""
    bad = lambda what, path="": issues.fail(issues.INVALID_INPUT, f"hints: {what}", path)
    if not isinstance(hints, dict) or set(hints) - {"hints_version", "id", *HINTS} or hints.get("hints_version", "0.1") != "0.1":
        raise bad("not a document of version 0.1")
    for kind, needed in HINTS.items():
        for h in hints.get(kind) or ():
            more = {"reason"} | ({"default"} if kind == "lookups" else set())
            if not isinstance(h, dict) or not needed | {"target"} <= set(h) or set(h) - needed - more - {"target"}:
                raise bad(f"{kind} have target, {', '.join(sorted(needed))}", str(h.get("target", "")) if isinstance(h, dict) else "")


def hint_rules(hints: dict[str, Any]) -> list[Rule]:
    """Hints as rules, in the order of their kinds: the first valid one of a target wins."""
    check_hints(hints)
    get = lambda p: {"op": "get", "path": p}
    whole = lambda x: int(x) if float(x).is_integer() else float(x)
    makers = {
        "direct": lambda h: get(h["source"]),
        "lookups": lambda h: {"op": "lookup", "key": get(h["source"]), "values": h["values"]} | ({"default": {"op": "literal", "value": h["default"]}} if h.get("default") is not None else {}),
        "unit_conversions": lambda h: {
            "op": "cast", "target_type": "integer",
            "value": {"op": "multiply", "left": get(h["value_source"]), "right": {"op": "lookup", "key": get(h["unit_source"]), "values": {k: whole(v) for k, v in h["factors"].items()}}},
        },
        "dates": lambda h: {"op": "format_date", "value": {"op": "parse_date", "value": get(h["source"])}, "pattern": h["pattern"]},
        "constants": lambda h: {"op": "literal", "value": h["value"]},
        "expressions": lambda h: h["expression"],
    }
    return [Rule(h["target"], parse(make(h)), 0.0) for kind, make in makers.items() for h in hints.get(kind) or ()]


@dataclass(frozen=True)
class Suggestion:
    target_path: str
    disposition: str
    band: str = "none"
    confidence: float | None = None
    source_path: str | None = None
    rule: Rule | None = None
    candidates: tuple[str, ...] = ()


@dataclass(frozen=True)
class Report:
    suggestions: tuple[Suggestion, ...]

    @staticmethod
    def parse(rows: Any) -> "Report":
        """A report from its document; what isn't one is refused."""
        fields = {"target_path", "disposition", "band", "confidence", "source_path", "expression", "candidates"}
        whats, bands = ("ambiguous", "manual", "no_match", "review_required", "suggested"), ("high", "low", "medium", "none")
        if not isinstance(rows, list) or any(not isinstance(r, dict) or set(r) != fields or r["disposition"] not in whats or r["band"] not in bands for r in rows):
            raise issues.fail(issues.INVALID_INPUT, "not a report of suggestions")
        rule = lambda r: r["expression"] and Rule(r["target_path"], parse(r["expression"]), 0.0)
        return Report(tuple(Suggestion(r["target_path"], r["disposition"], r["band"], r["confidence"], r["source_path"], rule(r), tuple(r["candidates"])) for r in rows))

    def find(self, target: str) -> Suggestion | None:
        return next((s for s in self.suggestions if s.target_path == target), None)

    def counts(self) -> dict[str, dict[str, int]]:
        bands, whats = dict.fromkeys(("high", "low", "medium", "none"), 0), dict.fromkeys(("ambiguous", "manual", "no_match", "review_required", "suggested"), 0)
        for s in self.suggestions:
            bands[s.band] += 1
            whats[s.disposition] += 1
        return {"confidence": bands, "disposition": whats}

    def document(self) -> list[dict]:
        return [
            {"target_path": s.target_path, "disposition": s.disposition, "band": s.band, "confidence": s.confidence, "source_path": s.source_path,
             "expression": s.rule and s.rule.expression.document(), "candidates": list(s.candidates)}
            for s in self.suggestions
        ]

    def sha256(self) -> str:
        return sha256(self.document())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.target_path, s.disposition, s.band, s.confidence, s.source_path, s.rule is not None) for s in self.suggestions]
        return spark.createDataFrame(rows, "target_path string, disposition string, band string, confidence double, source_path string, has_rule boolean")


def check_coverage(report: Report, target: Schema) -> list[tuple[str, str]]:
    """(code, target) of every outcome that isn't one of the target's units, or stands twice, and of every unit without one."""
    wanted, told = {f.pointer for f in units(target)}, [s.target_path for s in report.suggestions]
    out = {(issues.SUGGESTION_TARGET_MISSING, t) for t in wanted ^ set(told)}
    return sorted(out | {(issues.SUGGESTION_TARGET_DUPLICATE, t) for t in told if told.count(t) > 1})


def suggest(spark: SparkSession, source: Schema, target: Schema, hints: dict | None = None, profiles: dict[str, list[str]] | None = None, weights: dict | None = None) -> Report:
    """One outcome for every mapping unit of the target."""
    wanted = units(target)
    scored = score_pairs(field_frame(spark, [f for f in source.fields if f.pointer], "s_", profiles), field_frame(spark, wanted, "t_"), weights)
    top = top_candidates(scored).select("target_path", "source_path", "raw_score", "rank").collect()
    rules = {(r["target_path"], r["source_path"]): direct_rule(source, r["source_path"], r["target_path"]) for r in top}
    valid = {k for k, rule in rules.items() if not static.errors(static.verify_rule(rule, source, target))}
    eligible = spark.createDataFrame([(r["target_path"], r["source_path"], r["raw_score"]) for r in top if (r["target_path"], r["source_path"]) in valid], "target_path string, source_path string, raw_score double")
    best = {r["target_path"]: r for r in decide(eligible).collect()}
    manual: dict[str, Rule] = {}
    for rule in hint_rules(hints or {}):
        if rule.target not in manual and not static.errors(static.verify_rule(rule, source, target)):
            manual[rule.target] = rule
    out = []
    for unit in sorted(wanted, key=lambda f: tokens(f.pointer)):
        t = unit.pointer
        names = tuple(r["source_path"] for r in sorted(top, key=lambda r: r["rank"]) if r["target_path"] == t)
        if t in manual:
            out.append(Suggestion(t, "manual", rule=manual[t], candidates=names))
        elif t not in best:
            out.append(Suggestion(t, "no_match", candidates=names))
        else:
            b = best[t]
            chosen = b["disposition"] in ("suggested", "review_required")
            out.append(Suggestion(t, b["disposition"], b["band"], b["confidence"], b["source_path"] if chosen else None, rules[t, b["source_path"]] if chosen else None, names))
    return Report(tuple(out))
