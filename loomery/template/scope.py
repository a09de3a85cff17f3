"""Where names are looked up, and macros."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .values import UNDEFINED, TemplateError


class Return(Exception):
    """Ends the body that it is raised in, with a value."""

    def __init__(self, value: Any = UNDEFINED):
        self.value = value


class Scope:
    def __init__(self, variables: dict[str, Any] | None = None, parent: Scope | None = None, fallback: Callable[[str], Any] | None = None):
        self.vars, self.parent, self.fallback = dict(variables or {}), parent, fallback
        self.out: list[str] = parent.out if parent else []

    @property
    def root(self) -> Scope:
        return self.parent.root if self.parent else self

    def child(self) -> Scope:
        return Scope(parent=self)

    def lookup(self, name: str) -> Any:
        s: Scope | None = self
        while s is not None:
            if name in s.vars:
                return s.vars[name]
            if s.fallback is not None:
                return s.fallback(name)
            s = s.parent
        return UNDEFINED

    def set(self, name: str, value: Any) -> None:
        self.vars[name] = value

    def define(self, macro: Macro) -> None:
        self.root.vars[macro.name] = macro

    def capture(self, run: Callable[[Scope], Any]) -> str:
        """What run adds to the output, taken out of it; names are set here."""
        before, self.out = self.out, []
        try:
            run(self)
            return "".join(self.out)
        finally:
            self.out = before


class Macro:
    """Callable in templates. Its body sees its arguments, then the calling model's names; a caller's body sees where it stands."""

    def __init__(self, name: str, params: list, body: Callable[[Scope], Any], file: str, home: Scope | None = None):
        self.name, self.params, self.body, self.file, self.home = name, params, body, file, home

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self.call(self.home or Scope(), list(args), kwargs)

    def call(self, scope: Scope, args: list[Any], kwargs: dict[str, Any], caller: Macro | None = None) -> Any:
        s = Scope(parent=self.home or scope.root)
        s.out = []
        names = [n for n, _ in self.params]
        given = dict(zip(names, args, strict=False))
        for k, v in kwargs.items():
            if k in given:
                raise TemplateError(f"{self.name}: {k!r} is given twice")
            if k in names:
                given[k] = v
        for n, default in self.params:
            s.vars[n] = given[n] if n in given else default(s) if default is not None else UNDEFINED
        s.vars["varargs"] = args[len(names) :]
        s.vars["kwargs"] = {k: v for k, v in kwargs.items() if k not in names}
        s.vars["caller"] = caller if caller is not None else UNDEFINED
        try:
            self.body(s)
        except Return as r:
            return r.value
        return "".join(s.out)
