"""Review: decisions joined onto suggestions, applied under a policy, assembled into a mapping that passes verification."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import issues
from ..plans.expressions import parse
from ..plans.mapping import Mapping, Rule
from ..sources.json_schema import Schema
from . import matching, static
from .matching import Report

#: What a decision may do, and what is taken without one.
ACTIONS = ("accept_selected", "select_candidate", "reject", "defer")
POLICIES = ("high-and-manual", "manual-only", "review-document-only")
DECISION = "target_path string, action string, source_path string"


@dataclass(frozen=True)
class Outcome:
    """mapping: None if any issue forbids it; applied: (target, action, accepted, source)."""

    mapping: Mapping | None
    applied: tuple[tuple[str, str, bool, str | None], ...]
    issues: tuple[tuple[str, str], ...]


def check_document(review: dict, bound: bool = True) -> None:
    """Refuses a review with fields that are missing, unknown or of another version, or a source where the action takes none."""
    fields = {"review_version", "suggestion_report_sha256", "mapping_id", "decisions"}
    if set(review) - fields or review.get("review_version", "0.1") != "0.1" or bound and not review.get("suggestion_report_sha256"):
        raise issues.fail(issues.INVALID_INPUT, "not a review document of version 0.1")
    for d in review.get("decisions", ()):
        if set(d) - {"target_path", "action", "source_path", "reason"} or "target_path" not in d or (d.get("action") == "select_candidate") != bool(d.get("source_path")):
            raise issues.fail(issues.INVALID_INPUT, "only select_candidate has a source, and needs one", str(d.get("target_path", "")))


def decision_frame(spark: SparkSession, review: dict) -> DataFrame:
    return spark.createDataFrame([(d["target_path"], d["action"], d.get("source_path")) for d in review.get("decisions", [])], DECISION)


def check_decisions(suggestions: DataFrame, decisions: DataFrame, complete: bool = False) -> DataFrame:
    """code and target_path of every decision or target that can't stand: repeated, unknown, on a manual target, missing."""
    twice = decisions.groupBy("target_path").count().where("count > 1").select(F.lit(issues.INVALID_REVIEW_DECISION).alias("code"), "target_path")
    unknown = decisions.join(suggestions, "target_path", "left_anti").select(F.lit(issues.REVIEW_TARGET_NOT_FOUND).alias("code"), "target_path")
    manual = decisions.join(suggestions.where("disposition = 'manual'"), "target_path", "left_semi").select(F.lit(issues.INVALID_REVIEW_DECISION).alias("code"), "target_path")
    out = twice.unionByName(unknown).unionByName(manual)
    if complete:
        out = out.unionByName(unresolved(suggestions, decisions).select(F.lit(issues.INVALID_REVIEW_DECISION).alias("code"), "target_path"))
    return out.distinct()


def unresolved(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Targets that are neither manual nor decided."""
    return suggestions.where("disposition <> 'manual'").join(decisions, "target_path", "left_anti")


def apply_decisions(suggestions: DataFrame, decisions: DataFrame, policy: str) -> DataFrame:
    """``suggestions`` with action and accepted: whether a rule for the target goes into the mapping."""
    has, auto = F.col("has_rule"), F.lit(policy == "high-and-manual")
    taken = (
        F.when(F.col("disposition") == "manual", has)
        .when(F.col("action").isNull(), auto & has & (F.col("disposition") == "suggested") & (F.col("band") == "high"))
        .when(F.col("action") == "accept_selected", has & F.col("disposition").isin("suggested", "review_required"))
        .when(F.col("action") == "select_candidate", F.col("decided_source").isNotNull())
        .otherwise(False)
    )
    joined = suggestions.join(decisions.select("target_path", "action", F.col("source_path").alias("decided_source")), "target_path", "left")
    return joined.withColumn("accepted", F.coalesce(taken, F.lit(False)))


def assemble(spark: SparkSession, report: Report, review: dict | None, source: Schema, target: Schema, policy: str = "review-document-only", complete: bool = False, mapping_id: str = "mapping", bound: bool = True) -> Outcome:
    """The mapping of a report under a policy and a review; ``bound``: the review must carry the report's hash."""
    if policy not in POLICIES:
        raise issues.fail(issues.INVALID_INPUT, f"no policy {policy!r}")
    if uncovered := matching.check_coverage(report, target):
        return Outcome(None, (), tuple(uncovered))
    if review is None and policy == "review-document-only":
        return Outcome(None, (), ((issues.INVALID_REVIEW_DECISION, ""),))
    if review is not None and bound and review.get("suggestion_report_sha256") != report.sha256():
        return Outcome(None, (), ((issues.STALE_SUGGESTION_REPORT, ""),))
    if review is not None:
        check_document(review, bound)
    review = review or {"decisions": []}
    frame, decisions = report.frame(spark), decision_frame(spark, review)
    found = [(r["code"], r["target_path"]) for r in check_decisions(frame, decisions, complete).collect()]
    if found:
        return Outcome(None, (), tuple(sorted(found)))
    rules, applied = [], []
    for r in apply_decisions(frame, decisions, policy).orderBy("target_path").collect():
        s = report.find(r["target_path"])
        rule, accepted = s.rule, r["accepted"]
        if r["action"] is not None and r["action"] not in ACTIONS:
            found.append((issues.INVALID_REVIEW_DECISION, s.target_path))
        elif r["action"] == "accept_selected" and not accepted:
            found.append((issues.INVALID_REVIEW_DECISION, s.target_path))
        elif r["action"] == "select_candidate":
            if r["decided_source"] not in s.candidates:
                found.append((issues.REVIEW_CANDIDATE_NOT_FOUND, s.target_path))
                accepted = False
            else:
                rule = Rule(s.target_path, parse({"op": "get", "path": r["decided_source"]}), 0.0)
                bad = static.errors(static.verify_rule(rule, source, target))
                found += [(code, s.target_path) for _, code, _, _ in bad]
                accepted = not bad
        if accepted:
            rules.append(Rule(rule.target, rule.expression, s.confidence or 0.0))
        if r["action"] is not None:
            applied.append((s.target_path, r["action"], accepted, r["decided_source"] or (s.source_path if accepted else None)))
    if found or not rules:
        return Outcome(None, tuple(applied), tuple(sorted(found)) or ((issues.INVALID_REVIEW_DECISION, ""),))
    mapping = Mapping(review.get("mapping_id", mapping_id), tuple(rules), (), source.id, target.id, source.version, target.version)
    bad = static.errors(static.verify_static(mapping, source, target))
    return Outcome(None if bad else mapping, tuple(applied), tuple((code, path) for _, code, path, _ in bad))
