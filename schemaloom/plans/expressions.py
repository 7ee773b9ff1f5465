"""The closed expression language: 21 operators, checked once on the driver."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..issues import EVALUATION_LIMIT_EXCEEDED, INVALID_EXPRESSION, fail

#: Limits of an evaluation.
MAX_DEPTH, MAX_ITEMS, MAX_NODES, MAX_CHARACTERS = 64, 10_000, 100_000, 1_000_000

#: The operators; of each its child expressions, lists of them, maps of them, plain fields and defaults.
ONE, MANY, MAP = "one", "many", "map"
BINARY = {"left": ONE, "right": ONE}
OPERATORS: dict[str, dict[str, Any]] = {
    "get": {"path": str, "document": ("input", "output", "current")},
    "literal": {"value": object},
    "object": {"fields": MAP},
    "array": {"items": MANY},
    "map": {"collection": ONE, "expression": ONE},
    "coalesce": {"operands": MANY},
    "concat": {"operands": MANY, "separator": str},
    "cast": {"value": ONE, "target_type": ("string", "boolean", "integer", "number")},
    "if": {"condition": ONE, "then": ONE, "otherwise": ONE},
    "equals": BINARY, "not": {"value": ONE}, "and": {"operands": MANY}, "or": {"operands": MANY},
    "lookup": {"key": ONE, "values": dict, "default": ONE},
    "add": BINARY, "subtract": BINARY, "multiply": BINARY, "divide": BINARY,
    "round": {"value": ONE, "digits": int},
    "parse_date": {"value": ONE}, "format_date": {"value": ONE, "pattern": str},
}
DEFAULTS = {("get", "document"): "input", ("concat", "separator"): "", ("round", "digits"): 0, ("lookup", "default"): None}
LEAST = {"coalesce": 1, "and": 2, "or": 2, "concat": 0, "array": 0}


@dataclass(frozen=True)
class Expr:
    """An operator and its fields: expressions, tuples or dicts of expressions, or plain values."""

    op: str
    fields: dict[str, Any]

    def __getitem__(self, name: str) -> Any:
        return self.fields[name]

    def children(self) -> list[tuple[str, "Expr"]]:
        out = []
        for name, kind in OPERATORS[self.op].items():
            x = self.fields[name]
            if kind == ONE and x is not None:
                out.append((name, x))
            elif kind == MANY:
                out += [(f"{name}[{i}]", e) for i, e in enumerate(x)]
            elif kind == MAP:
                out += [(f"{name}.{k}", e) for k, e in x.items()]
        return out

    def walk(self, in_map: int = 0) -> Iterator[tuple["Expr", int]]:
        """Every expression below and how many maps it stands in the body of."""
        yield self, in_map
        for name, child in self.children():
            yield from child.walk(in_map + (self.op == "map" and name == "expression"))

    def document(self) -> dict[str, Any]:
        def plain(kind: Any, x: Any) -> Any:
            if kind == ONE:
                return x and x.document()
            if kind == MANY:
                return [e.document() for e in x]
            return {k: e.document() for k, e in x.items()} if kind == MAP else x

        return {"op": self.op} | {n: plain(k, self.fields[n]) for n, k in OPERATORS[self.op].items() if not (n == "default" and self.fields[n] is None)}


def parse(raw: Any, depth: int = 0) -> Expr:
    """An expression document, refused if anything in it is unknown, missing or too deep."""
    if depth > MAX_DEPTH:
        raise fail(EVALUATION_LIMIT_EXCEEDED, "expression is nested too deep")
    if not isinstance(raw, dict) or raw.get("op") not in OPERATORS:
        raise fail(INVALID_EXPRESSION, f"no operator in {str(raw)[:60]!r}")
    op = raw["op"]
    kinds = OPERATORS[op]
    if extra := set(raw) - set(kinds) - {"op"}:
        raise fail(INVALID_EXPRESSION, f"{op} has no field {sorted(extra)[0]!r}")
    fields: dict[str, Any] = {}
    for name, kind in kinds.items():
        if name not in raw and (op, name) not in DEFAULTS:
            raise fail(INVALID_EXPRESSION, f"{op} needs {name!r}")
        x = raw.get(name, DEFAULTS.get((op, name)))
        if kind == ONE:
            x = None if x is None and (op, name) in DEFAULTS else parse(x, depth + 1)
        elif kind == MANY:
            if not isinstance(x, (list, tuple)) or len(x) < LEAST[op]:
                raise fail(INVALID_EXPRESSION, f"{op} needs at least {LEAST[op]} {name}")
            x = tuple(parse(e, depth + 1) for e in x)
        elif kind == MAP:
            if not isinstance(x, dict):
                raise fail(INVALID_EXPRESSION, f"{op} needs a map of {name}")
            x = {str(k): parse(e, depth + 1) for k, e in x.items()}
        elif isinstance(kind, tuple):
            if x not in kind:
                raise fail(INVALID_EXPRESSION, f"{name} is one of {', '.join(kind)}")
        elif kind is not object and (not isinstance(x, kind) or isinstance(x, bool)):
            raise fail(INVALID_EXPRESSION, f"{name} of {op} is a {kind.__name__}")
        fields[name] = x
    if op == "round" and not 0 <= fields["digits"] <= 12:
        raise fail(INVALID_EXPRESSION, "digits are 0 to 12")
    return Expr(op, fields)
