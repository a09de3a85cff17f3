"""Project, profile and model-group files."""

from __future__ import annotations

import dataclasses
import getpass
import os
import random
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..template.values import TemplateError

MATERIALIZATIONS = ("table", "view", "incremental", "ephemeral", "project_sharded_table")


@dataclass
class Target:
    """Where models are written and read: (project, dataset) is one database of the session catalog."""

    name: str = "dev"
    project: str = "local"
    dataset: str = "default"
    location: str = ""
    threads: int = 4
    read_upstream: Target | None = None
    substitutions: dict[str, str] = field(default_factory=dict)  # tag -> project
    execution_projects: list[str] = field(default_factory=list)

    @property
    def database(self) -> str:
        return re.sub(r"\W", "_", f"{self.project}__{self.dataset}").lower()

    def copy(self, **changes: Any) -> Target:
        return dataclasses.replace(self, **changes)

    def pool(self) -> str:
        """A scheduler pool: one of the execution projects, dealt at random to spread the load."""
        return random.choice(self.execution_projects) if self.execution_projects else self.project

    def for_tags(self, tags: list[str]) -> Target:
        for tag in tags:
            if tag in self.substitutions:
                return self.copy(project=self.substitutions[tag])
        return self


_FOLDER_KEYS = {"enabled", "tags", "pre_hook", "post_hook", "schema", "materialized", "full_refresh", "database", "alias", "persist_docs", "quote_columns", "column_types", "project", "execution_project", "vars"}


@dataclass
class Folder:
    """Settings of a folder, over those of its parents; a child's list replaces its parent's."""

    settings: dict[str, Any] = field(default_factory=dict)
    children: dict[str, Folder] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: Any, where: str = "") -> Folder:
        out = cls()
        if raw is None:
            return out
        if not isinstance(raw, dict):
            raise TemplateError(f"{where or 'folder settings'}: a map is needed")
        for k, v in raw.items():
            name = str(k).lstrip("+").replace("-", "_")
            if name in _FOLDER_KEYS:
                out.settings[name] = cls._tidy(name, v, f"{where}.{k}")
            else:
                out.children[str(k)] = cls.parse(v, f"{where}.{k}")
        return out

    @staticmethod
    def _tidy(name: str, v: Any, where: str) -> Any:
        if name in ("tags", "pre_hook", "post_hook"):
            return [] if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)]
        if name == "enabled" and not isinstance(v, bool):
            raise TemplateError(f"{where}: true or false is needed")
        if name == "materialized" and v not in MATERIALIZATIONS:
            raise TemplateError(f"{where}: unknown materialization {v!r}")
        if name == "column_types":
            return {str(k): str(t) for k, t in (v or {}).items()}
        return v

    def at(self, folders: list[str]) -> dict[str, Any]:
        out, here = dict(self.settings), self
        for f in folders:
            child = here.children.get(f)
            if child is None:
                break
            out |= child.settings
            here = child
        return out


@dataclass
class Config:
    name: str = "project"
    target: Target = field(default_factory=Target)
    models: Folder = field(default_factory=Folder)
    seeds: Folder = field(default_factory=Folder)
    variables: dict[str, Any] = field(default_factory=dict)
    groups: dict[str, Target] = field(default_factory=dict)
    protected: list[str] = field(default_factory=list)

    def target_for(self, path: str) -> Target:
        """The target of a file: that of the longest model group which holds it, or the profile's."""
        inner = path.split("/", 1)[-1]
        fits = [g for g in self.groups if inner == g or inner.startswith(g.rstrip("/") + "/")]
        return self.groups[max(fits, key=len)] if fits else self.target

    def settings(self, path: str) -> dict[str, Any]:
        parts = path.split("/")
        tree = self.seeds if parts[0] == "data" else self.models
        return tree.at([*parts[1:-1], parts[-1].rsplit(".", 1)[0]])


def _own_dataset(target: str) -> str:
    user = os.environ.get("DBT_USER") or getpass.getuser()
    return f"dbt_{re.sub(r'[^A-Za-z0-9]', '_', user)}_{target}"


def _groups(raw: dict[str, Any], target: str, base: Target) -> dict[str, Target]:
    out = {}
    for group, targets in (raw or {}).items():
        t = (targets or {}).get(target)
        if t is None:
            continue
        dataset = t.get("dataset", base.dataset)
        if isinstance(dataset, dict):
            dataset = _own_dataset(target) if dataset.get("from_env") else base.dataset
        out[str(group)] = base.copy(project=t.get("project", base.project), dataset=str(dataset), substitutions=dict(t.get("project_tag_substitutions") or {}), execution_projects=list(t.get("execution_projects") or []))
    return out


def _target(profile: dict[str, Any], name: str) -> Target:
    outputs = profile.get("outputs") or {}
    if name not in outputs:
        raise TemplateError(f"no output {name!r} in the profile")
    o = outputs[name]
    return Target(name, str(o.get("project", "local")), str(o.get("dataset", "default")), str(o.get("location", "")), int(o.get("threads", 4)), execution_projects=list(o.get("execution_projects") or []))


def load(files: dict[str, str], target: str | None = None, upstream: str | None = None, threads: int | None = None, render=None) -> Config:
    """Read the project's YAML files. Their strings may be templates, which `render` renders."""

    def read(name: str) -> dict[str, Any]:
        raw = yaml.safe_load(files.get(name, "")) or {}

        def deep(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: deep(v) for k, v in x.items()}
            if isinstance(x, list):
                return [deep(v) for v in x]
            return render(x) if render and isinstance(x, str) and "{" in x else x

        return deep(raw)

    project = read("dbt_project.yml")
    profiles = read("profiles.yml")
    tool = read("loomery.yml")
    name = project.get("name", "project")
    profile = profiles.get(project.get("profile", name)) or next(iter(profiles.values()), {"target": "dev", "outputs": {"dev": {}}})
    chosen = target or profile.get("target", "dev")
    protected = [str(x) for x in tool.get("protected-targets") or []]
    if chosen in protected and not target:
        raise TemplateError(f"target {chosen!r} is protected: it has to be asked for by name")
    main = _target(profile, chosen)
    if threads:
        main.threads = threads
    groups_raw = read(tool["model-groups-file"]) if tool.get("model-groups-file") else tool.get("model-groups") or {}
    groups = _groups(groups_raw, chosen, main)
    if upstream:
        other = _target(profile, upstream)
        theirs = _groups(groups_raw, upstream, other)
        main.read_upstream = other
        groups = {g: t.copy(read_upstream=theirs.get(g, other)) for g, t in groups.items()}
    own = lambda kind: Folder.parse((project.get(kind) or {}).get(name), kind)
    return Config(name, main, own("models"), own("seeds"), project.get("vars") or {}, groups, protected)
