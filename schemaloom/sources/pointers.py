"""RFC 6901 pointers."""
from __future__ import annotations

from ..issues import INVALID_INPUT, OVERLAPPING_TARGET_ASSIGNMENT, fail


def tokens(pointer: str) -> tuple[str, ...]:
    if pointer == "":
        return ()
    if not pointer.startswith("/"):
        raise fail(INVALID_INPUT, "a pointer is empty or starts with /", pointer)
    out = []
    for part in pointer[1:].split("/"):
        if part.replace("~0", "").replace("~1", "").count("~"):
            raise fail(INVALID_INPUT, "~ stands before 0 or 1 only", pointer)
        out.append(part.replace("~1", "/").replace("~0", "~"))
    return tuple(out)


def pointer(parts: tuple[str, ...] | list[str]) -> str:
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def starts(prefix: str, whole: str) -> bool:
    """Whether one pointer is the other or leads to it."""
    a, b = tokens(prefix), tokens(whole)
    return b[: len(a)] == a


def assemble(values: dict[str, object]) -> object:
    """A tree of the values (pointer -> anything); objects only."""
    if set(values) == {""}:
        return values[""]
    tree: dict = {}
    for path in sorted(values, key=tokens):
        parts = tokens(path)
        if not parts or any(p.isdigit() for p in parts):
            raise fail(INVALID_INPUT, "a target is an object's field", path)
        at = tree
        for p in parts[:-1]:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise fail(OVERLAPPING_TARGET_ASSIGNMENT, "a parent has a value of its own", path)
        if parts[-1] in at:
            raise fail(OVERLAPPING_TARGET_ASSIGNMENT, "the target has a value already", path)
        at[parts[-1]] = values[path]
    return tree
