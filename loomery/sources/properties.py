"""Schema files: what models, columns and macros are documented and tested for. Reading and writing keeps order and form."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml

from ..template.values import TemplateError


@dataclass
class Test:
    """One declared test: a name, ordered arguments, a severity and tags."""

    name: str
    args: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    tags: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: Any) -> Test:
        if isinstance(raw, str):
            return cls(raw)
        if not isinstance(raw, dict) or len(raw) != 1:
            raise TemplateError(f"a test is a name, or a map of one name: {raw!r}")
        name, args = next(iter(raw.items()))
        args = dict(args or {})
        severity = str(args.pop("severity", "error")).lower()
        if severity not in ("warn", "error"):
            raise TemplateError(f"{name}: severity is warn or error, not {severity!r}")
        tags = args.pop("tags", [])
        return cls(str(name), args, severity, [tags] if isinstance(tags, str) else list(tags))


@dataclass
class SchemaFile:
    """The file's own structure is kept as it was read, so that writing gives it back."""

    raw: dict[str, Any]

    @classmethod
    def parse(cls, text: str) -> SchemaFile:
        raw = yaml.safe_load(text) or {}
        if not isinstance(raw, dict):
            raise TemplateError("a schema file is a map")
        return cls(raw)

    def models(self) -> list[dict[str, Any]]:
        return [m for kind in ("models", "seeds", "snapshots") for m in self.raw.get(kind) or []]

    def tests(self) -> list[tuple[str, str, str | None, Test]]:
        """(test's name, model, column or None, test) of every declared test."""
        out = []
        for m in self.models():
            for i, raw in enumerate(m.get("tests") or []):
                t = Test.parse(raw)
                out.append((f"{t.name}_{m['name']}_{i}", m["name"], None, t))
            for c in m.get("columns") or []:
                for i, raw in enumerate(c.get("tests") or []):
                    t = Test.parse(raw)
                    out.append((f"{t.name}_{m['name']}__{c['name']}_{i}", m["name"], str(c["name"]), t))
        return out

    def dump(self) -> str:
        class Dumper(yaml.SafeDumper):
            def increase_indent(self, flow: bool = False, indentless: bool = False) -> None:
                return super().increase_indent(flow, False)

        return yaml.dump(self.raw, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 20)
