"""Tests that follow `is` in templates: name -> (function, whether it takes an argument)."""

from __future__ import annotations

from typing import Any

from .values import UNDEFINED, TemplateError, contains, equal, is_number, number


def _divisible(v: Any, by: Any) -> bool:
    if number(by) == 0:
        raise TemplateError("nothing is divisible by 0")
    return number(v) % number(by) == 0


def _lower(v: Any) -> bool:
    return isinstance(v, str) and v == v.lower()


def _upper(v: Any) -> bool:
    return isinstance(v, str) and v == v.upper()


def _many(v: Any) -> bool:
    return isinstance(v, list | dict)


_plain = {
    "boolean": lambda v: isinstance(v, bool),
    "callable": callable,
    "defined": lambda v: v is not UNDEFINED,
    "undefined": lambda v: v is UNDEFINED,
    "even": lambda v: number(v) % 2 == 0,
    "odd": lambda v: number(v) % 2 != 0,
    "false": lambda v: v is False,
    "true": lambda v: v is True,
    "float": lambda v: is_number(v) and float(v) != int(v),
    "integer": lambda v: is_number(v) and float(v) == int(v),
    "number": is_number,
    "string": lambda v: isinstance(v, str),
    "iterable": _many,
    "sequence": _many,
    "mapping": lambda v: isinstance(v, dict),
    "lower": _lower,
    "upper": _upper,
    "none": lambda v: v is None or v is UNDEFINED,
}
_with = {
    "divisibleby": _divisible,
    "eq": equal,
    "ne": lambda a, b: not equal(a, b),
    "ge": lambda a, b: number(a) >= number(b),
    "gt": lambda a, b: number(a) > number(b),
    "le": lambda a, b: number(a) <= number(b),
    "lt": lambda a, b: number(a) < number(b),
    "in": contains,
    "sameas": lambda a, b: a is b if isinstance(a, list | dict) else equal(a, b),
}
_aliases = {"equalto": "eq", "==": "eq", "!=": "ne", ">=": "ge", "greaterthan": "gt", ">": "gt", "<=": "le", "lessthan": "lt", "<": "lt"}

TESTS = {n: (f, False) for n, f in _plain.items()} | {n: (f, True) for n, f in _with.items()}
TESTS |= {a: TESTS[n] for a, n in _aliases.items()}
TESTS |= {"TRUE": TESTS["true"], "FALSE": TESTS["false"], "None": TESTS["none"], "True": TESTS["true"], "False": TESTS["false"]}
