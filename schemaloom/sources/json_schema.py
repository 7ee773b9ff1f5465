"""JSON Schema 2020-12 and OpenAPI 3.1 read into a flat catalogue of fields and a Spark type. Driver-side: schemas are small."""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import issues
from .documents import load_document
from .pointers import pointer, tokens

#: The JSON types, and the dialect that is read.
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
DIALECT = "https://json-schema.org/draft/2020-12/schema"
CATALOGUE = "pointer string, types array<string>, required boolean, title string, description string, enum array<string>, minimum double, maximum double, min_length int, max_length int, pattern string, item_types array<string>"


@dataclass(frozen=True)
class Field:
    pointer: str
    types: frozenset
    required: bool = False
    title: str | None = None
    description: str | None = None
    enum: tuple = ()
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    item_types: frozenset = frozenset()

    @property
    def name(self) -> str:
        return self.pointer.rsplit("/", 1)[-1]


@dataclass(frozen=True)
class Schema:
    """id, version, the fields in pointer order, and the resolved schema itself."""

    id: str
    version: str
    fields: tuple[Field, ...]
    resolved: dict = field(repr=False)

    def __post_init__(self):
        object.__setattr__(self, "_by_pointer", {f.pointer: f for f in reversed(self.fields)})

    def find(self, path: str) -> Field | None:
        return self._by_pointer.get(path)

    def children(self, path: str) -> list[Field]:
        depth = len(tokens(path)) + 1
        return [f for f in self.fields if len(tokens(f.pointer)) == depth and f.pointer.startswith(path + "/")]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [
            (f.pointer, sorted(f.types), f.required, f.title, f.description, [json.dumps(v) for v in f.enum], f.minimum, f.maximum, f.min_length, f.max_length, f.pattern, sorted(f.item_types))
            for f in self.fields
        ]
        return spark.createDataFrame(rows, CATALOGUE)

    def spark_type(self) -> T.StructType:
        return _spark(self.resolved)


def units(schema: Schema) -> list[Field]:
    """The target's mapping units: fields outside arrays that aren't objects with fields of their own."""
    return [f for f in schema.fields if f.pointer and "items" not in tokens(f.pointer) and not ("object" in f.types and schema.children(f.pointer))]


def _spark(node: dict) -> T.DataType:
    kinds = set(node["type"]) - {"null"}
    if kinds == {"object"}:
        return T.StructType([T.StructField(k, _spark(v)) for k, v in node.get("properties", {}).items()])
    if kinds == {"array"}:
        return T.ArrayType(_spark(node["items"]) if "items" in node else T.StringType())
    if kinds and kinds <= {"integer", "number"}:
        return T.LongType() if kinds == {"integer"} else T.DoubleType()
    return T.BooleanType() if kinds == {"boolean"} else T.NullType() if not kinds else T.StringType() if kinds == {"string"} else T.VariantType()


class _Reader:
    def __init__(self, root: Any):
        self.root = root

    def target(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise issues.fail(issues.REMOTE_REF_DISABLED, "only references into the document are followed", ref)
        at = self.root
        for part in tokens(ref[1:]):
            if isinstance(at, dict) and part in at:
                at = at[part]
            elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
                at = at[int(part)]
            else:
                raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, "the reference leads nowhere", ref)
        return at

    def resolve(self, node: Any, path: str = "", trail: tuple = ()) -> dict:
        """The schema with references, allOf and choices worked in: every node has a list of types."""
        if node is True:
            return {"type": list(TYPES)}
        if not isinstance(node, dict):
            raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, "a schema is an object or true", path)
        if "nullable" in node:
            raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, "nullable is not of this dialect", path)
        if "$ref" in node:
            if node["$ref"] in trail:
                raise issues.fail(issues.CYCLIC_REF, "the reference leads back to itself", path)
            return self.resolve(self.target(node["$ref"]), path, (*trail, node["$ref"]))
        if "allOf" in node:
            return self.resolve(self.merged(node["allOf"], path, trail), path, trail)
        for choice in ("oneOf", "anyOf"):
            if choice in node:
                parts = [self.resolve(p, path, trail) for p in node[choice]]
                if any("object" in p["type"] and p.get("properties") for p in parts):
                    raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, f"{choice} of objects", path)
                # one field with the types of all branches; values are held against the branches themselves
                out = dict(next((p for p in parts if p["type"] != ["null"]), parts[0])) | {k: v for k, v in node.items() if k in ("title", "description")}
                return out | {"type": [t for t in TYPES if any(t in p["type"] for p in parts)], "choice": (choice, parts)}
        out = {k: v for k, v in node.items() if k not in ("properties", "items", "$defs")}
        out["type"] = self.kinds(node)
        if "properties" in node:
            out["properties"] = {k: self.resolve(v, f"{path}/{k}", trail) for k, v in sorted(node["properties"].items())}
        if "items" in node:
            out["items"] = self.resolve(node["items"], f"{path}/items", trail)
        return out

    def merged(self, parts: list, path: str, trail: tuple) -> dict:
        """The parts of an allOf as one schema, before anything in them is worked out: a part may lack a type that another one gives."""
        out: dict = {}
        for part in parts:
            while isinstance(part, dict) and "$ref" in part:
                if part["$ref"] in trail:
                    raise issues.fail(issues.CYCLIC_REF, "the reference leads back to itself", path)
                trail, part = (*trail, part["$ref"]), self.target(part["$ref"])
            if isinstance(part, dict) and "allOf" in part:
                part = {k: v for k, v in part.items() if k != "allOf"} | self.merged(part["allOf"], path, trail)
            for k, v in part.items() if isinstance(part, dict) else ():
                if k == "properties":
                    out[k] = {**out.get(k, {}), **v}
                elif k == "required":
                    out[k] = sorted({*out.get(k, []), *v})
                elif k not in ("$schema", "$id", "title", "description") and out.setdefault(k, v) != v:
                    raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, f"allOf has conflicting {k}", path)
        return out

    @staticmethod
    def kinds(node: dict) -> list[str]:
        if "type" in node:
            found = [node["type"]] if isinstance(node["type"], str) else list(node["type"])
        elif "properties" in node or "additionalProperties" in node:
            found = ["object"]
        elif "items" in node:
            found = ["array"]
        elif "enum" in node or "const" in node:
            found = sorted({json_type(v) for v in node.get("enum", [node.get("const")])})
        else:
            found = list(TYPES)
        if not found or set(found) - set(TYPES):
            raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, f"unknown type {found}")
        return found


def json_type(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if isinstance(v, int) or v.is_integer() else "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _flatten(node: dict, parts: tuple = (), required: bool = False) -> list[Field]:
    item = node.get("items", {})
    out = [
        Field(
            pointer(parts), frozenset(node["type"]), required, node.get("title"), node.get("description"),
            tuple(node["enum"]) if "enum" in node else (node["const"],) if "const" in node else (),
            node.get("minimum"), node.get("maximum"), node.get("minLength"), node.get("maxLength"), node.get("pattern"), frozenset(item.get("type", ())),
        )
    ]
    for name, child in node.get("properties", {}).items():
        out += _flatten(child, (*parts, name), name in node.get("required", ()))
    return out + (_flatten(item, (*parts, "items")) if item else [])


def read_schema(raw: Any, name: str = "schema", root: Any = None) -> Schema:
    """A schema document's catalogue; ``name`` is its id unless it has one."""
    if not isinstance(raw, dict):
        raise issues.fail(issues.INVALID_INPUT, "a schema document is an object")
    if raw.get("$schema", DIALECT).rstrip("#") != DIALECT:
        raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, f"dialect {raw['$schema']}")
    resolved = _Reader(raw if root is None else root).resolve(raw)
    fields = sorted(_flatten(resolved), key=lambda f: tokens(f.pointer))
    return Schema(raw.get("$id", name), str(raw.get("x-schema-version", "unversioned")), tuple(fields), resolved)


def load_schema(path: str, selector: str | None = None) -> Schema:
    """A JSON Schema file, or with a selector (component:N, request:OP, response:OP[:STATUS]) a schema of an OpenAPI file."""
    raw = load_document(path)
    name = path.rsplit("/", 1)[-1].split(".")[0]
    return read_schema(raw, name) if selector is None else read_openapi(raw, selector, name)


def read_openapi(raw: dict, selector: str, name: str = "api") -> Schema:
    if not str(raw.get("openapi", "")).startswith("3.1"):
        raise issues.fail(issues.UNSUPPORTED_SCHEMA_FEATURE, "OpenAPI 3.1 only")
    reader = _Reader(raw)
    kind, _, rest = selector.partition(":")
    if kind == "component":
        found = raw.get("components", {}).get("schemas", {}).get(rest)
    elif kind in ("request", "response"):
        op, _, status = rest.partition(":")
        node = next((o for p in raw.get("paths", {}).values() for o in p.values() if isinstance(o, dict) and o.get("operationId") == op), {})
        node = node.get("requestBody", {}) if kind == "request" else node.get("responses", {}).get(status or "200", {})
        found = node.get("content", {}).get("application/json", {}).get("schema")
    else:
        raise issues.fail(issues.INVALID_INPUT, "a selector is component:, request: or response:", selector)
    hops = 0
    while isinstance(found, dict) and "$ref" in found:
        if (hops := hops + 1) > 64:
            raise issues.fail(issues.CYCLIC_REF, "too many references", selector)
        found = reader.target(found["$ref"])
    if found is None:
        raise issues.fail(issues.INVALID_INPUT, "the selector finds nothing", selector)
    return read_schema({"x-schema-version": str(raw.get("info", {}).get("version", "unversioned"))} | found, rest.split(":")[0] or name, raw)
