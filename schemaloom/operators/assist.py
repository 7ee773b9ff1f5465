"""What drafting with a model needs without a model: redaction, context packages under a budget, checks of a response, reconciliation."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import issues
from ..plans.expressions import parse
from ..plans.mapping import Rule
from ..sources.documents import canonical, sha256
from ..sources.json_schema import Field, Schema, units
from . import static
from .matching import Report, Suggestion

MARK = "[REDACTED]"
#: What is redacted, in this order, and what stays of it.
PATTERNS = (
    (r"(?i)\b(authorization)\s*[:=]\s*(?:bearer\s+)?(?!\[REDACTED\])\S+", r"\1: [REDACTED]"),
    (r"(?i)\b(bearer)\s+(?!\[REDACTED\])\S+", r"\1 [REDACTED]"),
    (r"(?i)\b(api[_-]?key|token)\s*[:=]\s*(?!\[REDACTED\])\S+", r"\1: [REDACTED]"),
    (r"[A-Za-z0-9._%+-]+@", "[REDACTED]@"),
    (r"[0-9]{12,}", "[REDACTED]"),
    (r"[A-Za-z0-9_-]{32,}", "[REDACTED]"),
)
#: Raw samples in a context, their number and bytes.
RAW_SAMPLES, RAW_BYTES = 10, 256 * 1024


def redact(c: Column) -> tuple[Column, Column]:
    """(text, redactions): each pattern runs over what the one before has left."""
    count = F.lit(0)
    for pattern, kept in PATTERNS:
        count = count + F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))
        c = F.regexp_replace(c, pattern, kept.replace(r"\1", "$1"))
    return c, count


def redact_value(value: Any) -> tuple[Any, int]:
    """A JSON value with all its texts and keys redacted; keys that then agree are numbered from 2."""
    if isinstance(value, str):
        n = 0
        for pattern, kept in PATTERNS:
            value, k = re.subn(pattern, kept, value)
            n += k
        return value, n
    if isinstance(value, list):
        parts = [redact_value(v) for v in value]
        return [v for v, _ in parts], sum(n for _, n in parts)
    if isinstance(value, dict):
        out, n = {}, 0
        for key in sorted(value):
            name, a = redact_value(key)
            item, b = redact_value(value[key])
            unique, k = name, 2
            while unique in out:
                unique, k = f"{name}#{k}", k + 1
            out[unique], n = item, n + a + b
        return out, n
    return value, 0


def tokens_of(value: Any) -> int:
    """A third of the canonical text's bytes, rounded up."""
    return -(-len(canonical(value).encode()) // 3)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 3)


def _field(f: Field) -> dict:
    return {"path": f.pointer, "types": sorted(f.types), "required": f.required, "description": f.description, "enum": list(f.enum)}


def _package(mode: str, group: list[Field], source: Schema, candidates: dict[str, list[str]], limit: int, instructions: list[str], raw: list[Any], ordinal: int) -> dict:
    named = {p for f in group for p in candidates.get(f.pointer, [])[:limit]}
    fields = [_field(f) for f in source.fields if f.pointer and (mode == "full" or f.pointer in named)]
    return {
        "protocol_version": "0.1", "batch": ordinal, "mode": mode, "source_fields": fields, "instructions": instructions, "raw_samples": raw,
        "targets": [_field(f) | {"candidates": candidates.get(f.pointer, [])[:limit]} for f in group],
    }


def context_packages(
    source: Schema, target: Schema, candidates: dict[str, list[str]], budget: int, batch: int = 20, mode: str = "auto", limit: int = 10,
    instructions: list[str] | None = None, samples: list[Any] | None = None,
) -> list[dict]:
    """Batches of targets, each within the budget of tokens; a batch that is too large is halved until it fits.

    full: every source field; targeted: the candidates' only; auto: full if all batches fit, else targeted.
    """
    raw = [redact_value(s)[0] for s in (samples or [])[:RAW_SAMPLES]]
    while raw and len(canonical(raw).encode()) > RAW_BYTES:
        raw.pop()
    wanted = units(target)
    groups = [wanted[i : i + batch] for i in range(0, len(wanted), batch)]
    make = lambda how, group, n: _package(how, group, source, candidates, limit, [redact_value(t)[0] for t in instructions or []], raw, n)
    if mode == "auto":
        whole = [make("full", g, n) for n, g in enumerate(groups, 1)]
        if all(tokens_of(p) <= budget for p in whole):
            return whole
        mode = "targeted"
    done, todo = [], groups[::-1]
    while todo:
        group = todo.pop()
        if tokens_of(make(mode, group, 1)) <= budget:
            done.append(group)
        elif len(group) == 1:
            raise issues.fail(issues.MODEL_CONTEXT_TOO_LARGE, "one target alone is over the budget", group[0].pointer)
        else:
            half = len(group) // 2
            todo += [group[half:], group[:half]]
    return [make(mode, g, n) for n, g in enumerate(done, 1)]


def check_response(response: dict, package: dict) -> list[tuple[str, str]]:
    """(code, target) of everything a response says beyond its package: versions, hash, coverage in order, paths, operators."""
    bad = lambda target="": (issues.PROVIDER_RESPONSE_INVALID, target)
    out = [bad() for key, want in (("protocol_version", package["protocol_version"]), ("batch", package["batch"]), ("context_sha256", sha256(package))) if response.get(key) != want]
    wanted, told = [t["path"] for t in package["targets"]], [p["target_path"] for p in response.get("proposals", [])]
    counts = Counter(told)
    out += [bad(t) for t in told if t not in wanted] + [bad(t) for t, n in sorted(counts.items()) if n > 1] + [bad(t) for t in wanted if not counts[t]]
    if sorted(told) == sorted(wanted) and told != wanted:
        out.append(bad())
    allowed = {f["path"] for f in package["source_fields"]}
    for p in response.get("proposals", []):
        if p.get("abstain"):
            continue
        try:
            reads = {e["path"] for e, _ in parse(p["expression"]).walk() if e.op == "get" and e["document"] == "input"}
        except (issues.MappingError, KeyError):
            out.append(bad(p["target_path"]))
            continue
        if not reads <= allowed or not reads or set(p.get("source_paths", reads)) != reads:
            out.append(bad(p["target_path"]))
    return out


@dataclass(frozen=True)
class Draft:
    """What a batch came to: a response that passed every check, or why there is none."""

    response: dict | None
    attempts: int
    repairs: int
    issues: tuple[tuple[str, str], ...] = ()


def _well_formed(payload: Any) -> str | None:
    """What keeps a payload from being a response at all; None if nothing does."""
    if not isinstance(payload, dict):
        return "a response is an object"
    if unknown := sorted(set(payload) - {"protocol_version", "batch", "context_sha256", "proposals"}):
        return f"unknown field {unknown[0]}"
    rows = payload.get("proposals")
    if not isinstance(rows, list) or not all(isinstance(p, dict) and isinstance(p.get("target_path"), str) for p in rows):
        return "proposals are objects with a target_path"
    return next((f"{p['target_path']}: an expression or an abstention" for p in rows if bool(p.get("abstain")) == ("expression" in p)), None)


def draft(package: dict, call: Callable[[dict, str | None, Any], Any]) -> Draft:
    """A batch's response. ``call(package, problem, previous)`` asks the model; where the first answer isn't well formed, it is asked once
    more with the problem and that answer, and never again. An answer that names a target outside the package isn't repaired.
    """
    bad = ((issues.PROVIDER_RESPONSE_INVALID, ""),)
    attempts, repairs, problem, answer = 0, 0, None, None
    while attempts < 2:
        attempts += 1
        try:
            answer = call(package, problem, answer)
        except Exception:  # a transport may fail in any way; the batch is then without a response
            return Draft(None, attempts, repairs, bad)
        problem = _well_formed(answer)
        if problem is None:
            found = check_response(answer, package)
            return Draft(None if found else answer, attempts, repairs, tuple(found))
        named = {p.get("target_path") for p in answer.get("proposals") or () if isinstance(p, dict)} if isinstance(answer, dict) and isinstance(answer.get("proposals"), list) else set()
        if not isinstance(answer, (dict, list)) or named - {t["path"] for t in package["targets"]} - {None}:
            break
        repairs = min(repairs + 1, 1)
    return Draft(None, attempts, repairs, bad)


@dataclass(frozen=True)
class Proposal:
    target_path: str
    expression: dict | None = None


def reconcile(report: Report, proposals: list[Proposal], source: Schema, target: Schema) -> Report:
    """Manual outcomes stay, an abstention keeps the baseline, valid drafts become review_required; nothing is approved."""
    told = {p.target_path: p for p in proposals if p.expression is not None}

    def one(s: Suggestion) -> Suggestion:
        if s.disposition == "manual" or s.target_path not in told:
            return s
        rule = Rule(s.target_path, parse(told[s.target_path].expression), 0.0)
        return s if static.errors(static.verify_rule(rule, source, target)) else replace(s, disposition="review_required", rule=rule)

    return Report(tuple(one(s) for s in report.suggestions))
