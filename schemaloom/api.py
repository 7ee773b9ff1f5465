"""The public operations on files: what a command line would call, each a function of paths and plain values.

Every one raises ``MappingError`` with a stable code where its input can't be used.
"""
from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import issues
from .operators import assist, matching, metrics, profile, reports, review, static
from .plans.mapping import Mapping, verify_samples
from .sources.documents import canonical, load_document, write_all
from .sources.json_schema import Schema, load_schema
from .sources.samples import read_document, read_samples


def inspect(path: str, selector: str | None = None, form: str = "text") -> str:
    """A schema's fields."""
    return reports.fields(load_schema(path, selector), form)


def _profiles(spark: SparkSession, source: Schema, samples: str | None) -> dict[str, list[str]] | None:
    """The pattern classes of the source's fields, from samples."""
    if samples is None:
        return None
    rows = read_samples(spark, samples, source, source).where("input is not null").select("input.*", "raw")
    return {r["pointer"]: r["pattern_classes"] for r in profile.profile(rows, source, raw="raw").collect()}


def suggest(spark: SparkSession, source: str, target: str, hints: str | None = None, samples: str | None = None, weights: dict[str, float] | None = None) -> matching.Report:
    """One outcome for each unit of the target; hints that hold go first."""
    own = load_schema(source)
    return matching.suggest(spark, own, load_schema(target), load_document(hints) if hints else None, _profiles(spark, own, samples), weights)


def assemble(spark: SparkSession, suggestions: str, source: str, target: str, decisions: str | None = None, policy: str = "review-document-only", complete: bool = False, out: str | None = None, force: bool = False) -> review.Outcome:
    """The mapping of a report of suggestions under a policy and a review; written to ``out`` if nothing forbids it."""
    made = review.assemble(spark, matching.Report.parse(load_document(suggestions)), load_document(decisions) if decisions else None, load_schema(source), load_schema(target), policy, complete)
    if out and made.mapping:
        made.mapping.write(out, force)
    return made


def verify(spark: SparkSession, mapping: str, source: str, target: str, samples: str | None = None) -> tuple[bool, list[static.Found], DataFrame | None]:
    """(valid, what static verification found, id, err and issues of each sample); samples are only run if the mapping may be."""
    m, s, t = Mapping.load(mapping), load_schema(source), load_schema(target)
    found = static.verify_static(m, s, t)
    if static.errors(found) or samples is None:
        return not static.errors(found), found, None
    rows = read_samples(spark, samples, s, t)
    if bad := rows.where("problem is not null").select("problem").distinct().collect():
        raise issues.fail(issues.INVALID_INPUT, "samples: " + ", ".join(sorted(r["problem"] for r in bad)))
    done = verify_samples(m, rows.select("id", "input", "raw"), s, t, rows.where("has_expected").select("id", "expected"), raw="raw")
    return done.where("err is not null").isEmpty(), found, done


def run(spark: SparkSession, mapping: str, document: str, source: str, target: str, out: str | None = None, force: bool = False) -> Any:
    """The output document of one input document; what fails in the first stage that fails is raised as a whole."""
    m, s, t = Mapping.load(mapping), load_schema(source), load_schema(target)
    static.require(m, s, t)
    made = m.transform(read_document(spark, document, s), "report", "input", s, t, "raw").withColumn("text", F.to_json("output", {"ignoreNullFields": "false"})).first()
    if made["issues"]:
        raise issues.MappingError(*[(i["code"], i["detail"], i["pointer"]) for i in made["issues"]])
    value = json.loads(made["text"])
    if out:
        write_all({out: canonical(value) + "\n"}, force)
    return value


def compile_mapping(spark: SparkSession, mapping: str, source: str, target: str) -> str:
    """The plan's expressions of a mapping that passes static verification."""
    m, s, t = Mapping.load(mapping), load_schema(source), load_schema(target)
    static.require(m, s, t)
    return m.sql(spark.createDataFrame([], s.spark_type()))


def benchmark(spark: SparkSession, folder: str, samples: list[dict] | None = None) -> dict[str, Any]:
    """All metrics and gates of a scenario's folder; a gate that fails is raised."""
    got = metrics.benchmark(spark, metrics.Pack.load(folder, samples))
    if failed := sorted(k for k, ok in got["gates"].items() if not ok):
        raise issues.fail(issues.BENCHMARK_GATE_FAILED, ", ".join(failed))
    return got


def model_context(spark: SparkSession, source: str, target: str, budget: int, mode: str = "auto", batch: int = 20, limit: int = 10, instructions: list[str] | None = None, samples: list[Any] | None = None) -> list[dict]:
    """What a model would be sent, in batches within a budget of tokens."""
    s, t = load_schema(source), load_schema(target)
    candidates = {x.target_path: list(x.candidates) for x in matching.suggest(spark, s, t).suggestions}
    return assist.context_packages(s, t, candidates, budget, batch, mode, limit, instructions, samples)
