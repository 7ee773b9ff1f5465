"""Documents on the driver: safe YAML, canonical JSON, hashes, files written as a whole."""
from __future__ import annotations

import hashlib
import json
import math
import os
from typing import Any

from .. import issues

try:
    import yaml
except ImportError:  # JSON documents work without it
    yaml = None


def _unique(pairs: list[tuple[Any, Any]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if not isinstance(k, str) or k in out:
            raise issues.fail(issues.INVALID_INPUT, f"a key that repeats or isn't text: {k!r}")
        out[k] = v
    return out


if yaml:

    class _Safe(yaml.SafeLoader):
        """No tags, no repeated keys, text keys only, dates stay text."""

        def construct_mapping(self, node, deep=False):
            return _unique([(self.construct_object(k, True), self.construct_object(v, True)) for k, v in node.value])

        def construct_yaml_map(self, node):
            yield self.construct_mapping(node)

    _Safe.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    _Safe.add_constructor("tag:yaml.org,2002:map", _Safe.construct_yaml_map)


def parse_text(text: str, is_yaml: bool = False) -> Any:
    try:
        if not is_yaml:
            return json.loads(text, object_pairs_hook=_unique)
        if yaml is None:
            raise issues.fail(issues.INVALID_INPUT, "YAML can't be read here")
        return yaml.load(text, _Safe)
    except issues.MappingError:
        raise
    except Exception as why:
        raise issues.fail(issues.INVALID_INPUT, f"not a document: {type(why).__name__}") from None


def load_document(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return parse_text(f.read(), path.endswith((".yaml", ".yml")))


def _finite(v: Any) -> Any:
    if isinstance(v, float):
        if not math.isfinite(v):
            raise issues.fail(issues.INVALID_INPUT, "a number that isn't finite")
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    return [_finite(x) for x in v] if isinstance(v, (list, tuple)) else v


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, integral numbers as integers."""
    return json.dumps(_finite(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sha256(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def yaml_text(value: Any) -> str:
    """A document as YAML, fields in their order."""
    if yaml is None:
        raise issues.fail(issues.INVALID_INPUT, "YAML can't be written here")
    return yaml.safe_dump(_finite(value), sort_keys=False, allow_unicode=True)


def write_all(files: dict[str, str], force: bool = False) -> None:
    """All files or none: each is written beside its place first; what exists is only replaced by ``force``, and is put back if a later
    file can't be put in its place."""
    if not force and (there := [p for p in files if os.path.exists(p)]):
        raise issues.fail(issues.INVALID_INPUT, "the file exists", there[0])
    made: list[str] = []
    kept: dict[str, str | None] = {}
    try:
        for path, text in files.items():
            made.append(path + ".part")
            with open(path + ".part", "w", encoding="utf-8") as f:
                f.write(text)
        for path in files:
            old = path + ".old" if os.path.exists(path) else None
            if old:
                os.replace(path, old)
            kept[path] = old
            os.replace(path + ".part", path)
    except BaseException:
        for path, old in kept.items():
            if old:
                os.replace(old, path)
            elif os.path.exists(path):
                os.remove(path)
        raise
    else:
        made += [old for old in kept.values() if old]
    finally:
        for p in made:
            if os.path.exists(p):
                os.remove(p)
