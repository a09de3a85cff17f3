"""Values of the template dialect: Python's own, with one number type and a value for what isn't defined."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any


class TemplateError(Exception):
    """A template that can't be read or rendered; names the file and place where known."""


class Undefined:
    """The value of names and keys that aren't there. Renders as nothing and is false."""

    _one: Undefined | None = None

    def __new__(cls) -> Undefined:
        cls._one = cls._one or super().__new__(cls)
        return cls._one

    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "undefined"

    def __deepcopy__(self, memo: dict) -> Undefined:
        return self


UNDEFINED = Undefined()


class Relation:
    """A table's quoted name with its parts; renders as the name."""

    def __init__(self, database: str, schema: str, identifier: str, quoted: str):
        self.database, self.schema, self.identifier, self.quoted = database, schema, identifier, quoted

    def member(self, name: str) -> Any:
        known = {"database": self.database, "schema": self.schema, "identifier": self.identifier, "table": self.identifier, "name": self.identifier}
        return known.get(name, UNDEFINED)

    def __str__(self) -> str:
        return self.quoted


def is_number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def truth(v: Any) -> bool:
    if callable(v):
        raise TemplateError("a function has no truth value")
    return bool(v)


def number(v: Any) -> float:
    """v as a number: booleans, numbers and numeric strings; what is missing is 0."""
    if v is None or v is UNDEFINED:
        return 0.0
    if isinstance(v, bool | int | float):
        return float(v)
    if isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            raise TemplateError(f"{v!r} is no number") from None
    raise TemplateError(f"a {kind(v)} is no number")


def _plain(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if v is UNDEFINED:
        return None
    if is_number(v):
        return int(v) if float(v).is_integer() else float(v)
    return v if v is None or isinstance(v, str | bool) else text(v)


def text(v: Any) -> str:
    """v as it is rendered: numbers without exponent, lists and maps as JSON."""
    if v is None or v is UNDEFINED:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if is_number(v):
        if v != v or v in (float("inf"), float("-inf")):
            return str(v)
        s = format(Decimal(repr(float(v))), "f")
        return s.rstrip("0").rstrip(".") if "." in s else s
    if isinstance(v, list | dict):
        return json.dumps(_plain(v), ensure_ascii=False)
    if callable(v):
        raise TemplateError("a function can't be rendered")
    return str(v)


def kind(v: Any) -> str:
    if v is UNDEFINED:
        return "undefined"
    if v is None:
        return "null"
    for name, t in (("boolean", bool), ("number", (int, float)), ("string", str), ("list", list), ("map", dict)):
        if isinstance(v, t):
            return name
    return "function" if callable(v) else "object"


def equal(a: Any, b: Any) -> bool:
    """Strict in types and deep; undefined and null differ."""
    if isinstance(a, Relation):
        a = str(a)
    if isinstance(b, Relation):
        b = str(b)
    ka, kb = kind(a), kind(b)
    if ka != kb:
        return False
    if ka == "list":
        return len(a) == len(b) and all(map(equal, a, b))
    if ka == "map":
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a is b if ka == "function" else a == b


def contains(item: Any, where: Any) -> bool:
    """Substring, list member or map key."""
    if isinstance(where, str):
        return text(item) in where
    if isinstance(where, list):
        return any(equal(item, x) for x in where)
    if isinstance(where, dict):
        return text(item) in where
    if where is None or where is UNDEFINED:
        return False
    raise TemplateError(f"can't look into a {kind(where)}")


def member(v: Any, key: Any) -> Any:
    """v.key or v[key]; a missing key is undefined."""
    if v is UNDEFINED or v is None:
        return UNDEFINED
    if isinstance(v, Relation):
        return v.member(text(key))
    if isinstance(v, dict):
        name = text(key)
        if name in v:
            return v[name]
        if name == "items":
            return lambda: [[k, v[k]] for k in sorted(v)]
        if name == "keys":
            return lambda: sorted(v)
        if name == "values":
            return lambda: [v[k] for k in sorted(v)]
        if name == "get":
            return lambda k, default=UNDEFINED: v.get(text(k), default)
        if name == "update":
            return lambda other: v.update(other) or UNDEFINED
        return UNDEFINED
    if isinstance(v, list):
        if key == "items":
            return lambda: v
        if key == "append":
            return lambda x: v.append(x) or UNDEFINED
        if key == "extend":
            return lambda x: (v.extend(x) if isinstance(x, list) else None) or UNDEFINED
        if isinstance(key, str) and not key.lstrip("-").isdigit():
            raise TemplateError(f"a list has no {key!r}")
        i = int(number(key))
        if not -len(v) <= i < len(v):
            raise TemplateError(f"index {i} is outside of a list of {len(v)}")
        return v[i]
    if isinstance(v, str):
        known = {"upper": v.upper, "lower": v.lower, "strip": v.strip, "replace": lambda a, b: v.replace(a, b), "split": lambda s=None: v.split(s)}
        if key in known:
            return known[key]
    found = getattr(v, "member", None)
    if found is not None:
        return found(text(key))
    raise TemplateError(f"a {kind(v)} has no {text(key)!r}")
