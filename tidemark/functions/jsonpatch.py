"""JSON Patch: differences of documents, and their application."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

#: How deep arrays and objects may lie in each other.
MAX_DEPTH = 500
_SURROGATE = re.compile("[\ud800-\udfff]")


class PatchError(ValueError):
    """A patch that doesn't fit its document."""


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


class Number(float):
    """A number with a fraction or an exponent, which is written as it was read."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made

    def __reduce__(self):
        return Number, (self.text,)


def parse(text: str) -> Any:
    """Strict JSON: no NaN, nothing behind the value, and no more than MAX_DEPTH levels.
    Numbers keep all their digits."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON")

    if text.count("[") + text.count("{") > MAX_DEPTH and _too_deep(text):
        raise PatchError(f"more than {MAX_DEPTH} levels")
    return json.loads(text, parse_constant=refuse, parse_float=Number)


def _too_deep(text: str) -> bool:
    depth = 0
    for mark in re.findall(r'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]', text, re.S):
        if mark[0] in "[{":
            depth += 1
            if depth > MAX_DEPTH:
                return True
        elif mark[0] in "]}":
            depth -= 1
    return False


def dump(value: Any, *, exact: bool = True) -> str:
    """JSON as UTF-8 can hold it: half a surrogate pair is written as its escape. A value
    that holds no Number needs no exact digits."""
    try:
        text = _dump(value) if exact else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)
    except RecursionError:  # patches can put values into each other
        raise PatchError("too many levels") from None


def _dump(value: Any) -> str:
    if isinstance(value, Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def same(a: Any, b: Any) -> bool:
    """Deep equality in which true isn't 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return Decimal(getattr(a, "text", a)) == Decimal(getattr(b, "text", b))
    return type(a) is type(b) and a == b


def diff(before: Any, after: Any, at: str = "") -> list[dict]:
    """Removals in the old order, then additions and changes in the new one; arrays by
    position, with a longer one's tail added in order or removed from the end."""
    if isinstance(before, dict) and isinstance(after, dict):
        gone = [{"op": "remove", "path": f"{at}/{escape(k)}"} for k in before if k not in after]
        for k, v in after.items():
            path = f"{at}/{escape(k)}"
            gone += diff(before[k], v, path) if k in before else [{"op": "add", "path": path, "value": v}]
        return gone
    if isinstance(before, list) and isinstance(after, list):
        shared = min(len(before), len(after))
        ops = [op for k in range(shared) for op in diff(before[k], after[k], f"{at}/{k}")]
        ops += [{"op": "add", "path": f"{at}/{k}", "value": after[k]} for k in range(shared, len(after))]
        return ops + [{"op": "remove", "path": f"{at}/{k}"} for k in range(len(before) - 1, shared - 1, -1)]
    return [] if same(before, after) else [{"op": "replace", "path": at, "value": after}]


def _segments(path: str) -> list[str]:
    if not isinstance(path, str):
        raise PatchError(f"a pointer is a text, not {path!r:.40}")
    if path == "":
        return []
    if not path.startswith("/"):
        raise PatchError(f"bad pointer {path!r}")
    return [unescape(s) for s in path[1:].split("/")]


def _index(segment: str, size: int) -> int:
    if not segment.isascii() or not segment.isdigit() or segment != str(int(segment)) or int(segment) >= size:
        raise PatchError(f"no place {segment!r} in an array of {size}")
    return int(segment)


def _walk(doc: Any, segments: list[str]) -> Any:
    for s in segments:
        if isinstance(doc, dict) and s in doc:
            doc = doc[s]
        elif isinstance(doc, list):
            doc = doc[_index(s, len(doc))]
        else:
            raise PatchError(f"nothing at {s!r}")
    return doc


class _Document:
    def __init__(self, root: Any):
        self.root = root

    def get(self, path: str) -> Any:
        return _walk(self.root, _segments(path))

    def put(self, path: str, value: Any, *, replacing: bool) -> None:
        *front, last = _segments(path) or [None]
        if last is None:
            self.root = value
            return
        parent = _walk(self.root, front)
        if isinstance(parent, list):
            if replacing:
                parent[_index(last, len(parent))] = value
            else:
                parent.insert(len(parent) if last == "-" else _index(last, len(parent) + 1), value)
        elif isinstance(parent, dict):
            if replacing and last not in parent:
                raise PatchError(f"nothing to replace at {path!r}")
            parent[last] = value
        else:
            raise PatchError(f"{path!r} has no parent")

    def take(self, path: str) -> Any:
        *front, last = _segments(path) or [None]
        if last is None:
            raise PatchError("the whole document can't be removed")
        parent = _walk(self.root, front)
        if isinstance(parent, list):
            return parent.pop(_index(last, len(parent)))
        if isinstance(parent, dict) and last in parent:
            return parent.pop(last)
        raise PatchError(f"nothing to remove at {path!r}")


def _copied(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _copied(v) for k, v in value.items()}
    return [_copied(v) for v in value] if isinstance(value, list) else value


def apply(doc: dict, patch: str | list) -> dict:
    """The patched document; the given one may change. The result must be an object."""
    try:
        return _applied(doc, parse(patch) if isinstance(patch, str) else patch)
    except RecursionError:
        raise PatchError("too many levels") from None


def _applied(doc: dict, ops: Any) -> dict:
    if not isinstance(ops, list):
        raise PatchError("a patch is an array")
    d = _Document(doc)
    for op in ops:
        if not isinstance(op, dict) or "op" not in op or "path" not in op:
            raise PatchError("an operation has op and path")
        verb, path = op["op"], op["path"]
        if verb in ("add", "replace"):
            if "value" not in op:
                raise PatchError(f"{verb} needs a value")
            d.put(path, _copied(op["value"]), replacing=verb == "replace")
        elif verb == "remove":
            d.take(path)
        elif verb == "move":
            if not isinstance(path, str) or not isinstance(op.get("from"), str):
                raise PatchError("move needs from and path, both texts")
            if path.startswith(op["from"] + "/"):
                raise PatchError("a value can't move into itself")
            d.put(path, d.take(op["from"]), replacing=False)
        elif verb == "copy":
            d.put(path, _copied(d.get(op.get("from"))), replacing=False)
        elif verb == "test":
            if not same(d.get(path), op.get("value")):
                raise PatchError(f"another value at {path!r}")
        else:
            raise PatchError(f"unknown operation {verb!r}")
    if not isinstance(d.root, dict):
        raise PatchError("the result is no object")
    return d.root
