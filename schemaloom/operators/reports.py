"""Small results as text, Markdown or canonical JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..issues import INVALID_INPUT, fail
from ..sources.documents import canonical
from ..sources.json_schema import Schema
from .matching import Report
from .review import Outcome


def table(rows: list[dict], columns: list[str], form: str = "markdown") -> str:
    """Rows as a Markdown table, as aligned text or as JSON."""
    if form == "json":
        return canonical([{c: r.get(c) for c in columns} for r in rows])
    cells = [columns] + [["" if r.get(c) is None else str(r[c]).replace("|", "\\|").replace("\n", " ") for c in columns] for r in rows]
    if form == "markdown":
        lines = ["| " + " | ".join(c) + " |" for c in cells]
        return "\n".join([lines[0], "|" + " --- |" * len(columns), *lines[1:]]) + "\n"
    if form != "text":
        raise fail(INVALID_INPUT, f"no form {form!r}")
    wide = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in cells) + "\n"


def suggestions(report: Report, form: str = "markdown") -> str:
    """A report of suggestions; its counts must add up to its rows."""
    counts = report.counts()
    if any(sum(c.values()) != len(report.suggestions) for c in counts.values()):
        raise fail(INVALID_INPUT, "the summary doesn't reconcile")
    body = table(report.document(), ["target_path", "disposition", "band", "confidence", "source_path"], form)
    return body if form == "json" else f"{body}\n{canonical(counts)}\n"


def fields(schema: Schema, form: str = "text") -> str:
    """A schema's catalogue, its id and version first."""
    rows = [{"path": f.pointer, "types": ",".join(sorted(f.types)), "required": f.required, "enum": canonical(list(f.enum)) if f.enum else None, "description": f.description} for f in schema.fields]
    if form == "json":
        return canonical({"id": schema.id, "version": schema.version, "fields": rows})
    return f"{schema.id} {schema.version}\n\n" + table(rows, ["path", "types", "required", "enum", "description"], form)


def findings(found: list[tuple[str, str, str, str]], form: str = "text") -> str:
    """What static verification found, its verdict first."""
    rows = [dict(zip(("severity", "code", "target", "message"), x)) for x in found]
    valid = not any(x[0] == "error" for x in found)
    if form == "json":
        return canonical({"valid": valid, "issues": rows})
    return f"{'valid' if valid else 'invalid'}: {len(rows)} findings\n\n" + table(rows, ["severity", "code", "target", "message"], form)


def decisions(outcome: Outcome, form: str = "markdown") -> str:
    """What a review came to: decisions that were applied, what forbids the mapping, the mapping's hash."""
    applied = [dict(zip(("target_path", "action", "accepted", "source_path"), x)) for x in outcome.applied]
    problems = [{"code": code, "target_path": path} for code, path in outcome.issues]
    mapping = outcome.mapping and outcome.mapping.sha256()
    if form == "json":
        return canonical({"applied": applied, "issues": problems, "mapping_sha256": mapping})
    parts = [table(applied, ["target_path", "action", "accepted", "source_path"], form), table(problems, ["code", "target_path"], form)]
    return "\n".join([*parts, f"mapping: {mapping or 'none'}\n"])


def verification(samples: DataFrame, form: str = "text") -> str:
    """What ``verify_samples`` found, failing samples only, without any value of theirs."""
    rows = samples.where("err is not null").selectExpr("id", "err", "transform(issues, i -> concat_ws(' ', i.code, i.pointer, i.detail)) as found").orderBy("id").collect()
    return table([{"id": r["id"], "err": r["err"], "issues": "; ".join(r["found"])} for r in rows], ["id", "err", "issues"], form)
