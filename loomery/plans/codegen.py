"""Files made from models: schema YAML, suggested tests and docs, BI views, and a folder with part of a project."""

from __future__ import annotations

import os
from typing import Any

import yaml
from pyspark.sql import DataFrame

from ..operators.checks import profile
from ..sources.properties import SchemaFile
from ..template.values import TemplateError
from .project import Project

TIMEFRAMES = ["raw", "time", "date", "week", "month", "quarter", "year"]
_BI = {"bigint": "number", "int": "number", "smallint": "number", "tinyint": "number", "double": "number", "float": "number", "string": "string", "boolean": "yesno", "timestamp": "time", "timestamp_ntz": "time", "date": "date", "binary": "string"}


def bi_type(name: str) -> str:
    if name.startswith("decimal"):
        return "number"
    if name.startswith("array") or name.startswith(("varchar", "char")):
        return "string"
    if name not in _BI:
        raise TemplateError(f"no BI type for {name}")
    return _BI[name]


def bi_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(n, bi_type(t)) for n, t in df.dtypes]


def bi_view(name: str, relation: str, df: DataFrame) -> str:
    """A BI view: a dimension for each column, with a group of timeframes for times."""
    out = [f"view: {name} {{", f"  sql_table_name: {relation} ;;"]
    for column, kind in bi_types(df):
        if kind in ("time", "date"):
            frames = TIMEFRAMES if kind == "time" else [t for t in TIMEFRAMES if t != "time"]
            out += ["", f"  dimension_group: {column} {{", "    type: time", f"    timeframes: [{', '.join(frames)}]"] + (["    datatype: date", "    convert_tz: no"] if kind == "date" else [])
        else:
            out += ["", f"  dimension: {column} {{", f"    type: {kind}"]
        out += [f"    sql: ${{TABLE}}.{column} ;;", "  }"]
    return "\n".join([*out, "}", ""])


def column_changes(model: dict[str, Any], columns: list[str]) -> list[tuple[str, str]]:
    """(column, kept | added | dropped) from a model's YAML to its actual columns; names match in any case."""
    known = {str(c["name"]).lower(): str(c["name"]) for c in model.get("columns") or []}
    now = {c.lower() for c in columns}
    out = [(c, "kept" if c.lower() in known else "added") for c in columns]
    return out + [(n, "dropped") for k, n in known.items() if k not in now]


def update_columns(model: dict[str, Any], columns: list[str]) -> dict[str, Any]:
    """The model with missing columns added and those gone dropped; what stays keeps its place and text."""
    now = {c.lower() for c in columns}
    kept = [c for c in model.get("columns") or [] if str(c["name"]).lower() in now]
    have = {str(c["name"]).lower() for c in kept}
    return {**model, "columns": kept + [{"name": c, "description": ""} for c in columns if c.lower() not in have]}


def _schema_of(project: Project, name: str) -> tuple[str, SchemaFile, dict[str, Any]]:
    """The schema file that describes a model, or a new one beside it."""
    for path, s in project.schemas.items():
        for m in s.raw.get("models") or []:
            if m["name"] == name:
                return path, s, m
    path = project.find(name).path.rsplit(".", 1)[0] + ".yml"
    s, m = SchemaFile({"version": 2, "models": [{"name": name, "description": "", "columns": []}]}), None
    project.schemas[path] = s
    m = s.raw["models"][0]
    return path, s, m


def schema_gen(project: Project, *selectors: str, write: bool = True) -> dict[str, str]:
    """Schema files brought in line with the columns of built models: text by path. Columns with a doc file of their name get its reference."""
    out = {}
    for name in project.order(*selectors):
        if project.materialization(project.files[name]) == "ephemeral":
            continue
        path, s, m = _schema_of(project, name)
        m.update(update_columns(m, [c for c, _ in project.columns_of(str(project.relation(project.files[name])))]))
        for c in m["columns"]:
            if c["name"] in project.docs and not c.get("description"):
                c["description"] = f"{{{{ doc(\"{c['name']}\") }}}}"
        out[path] = s.dump()
    return _write(project, out, write)


def test_gen(project: Project, *selectors: str, write: bool = True) -> dict[str, str]:
    """Schema files with the not_null and unique tests that pass now, found by one profile of each model."""
    out = {}
    for name in project.order(*selectors):
        if project.materialization(project.files[name]) == "ephemeral":
            continue
        path, s, m = _schema_of(project, name)
        df = project.table(name)
        m.update(update_columns(m, df.columns))
        by = {str(c["name"]).lower(): c for c in m["columns"]}
        plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
        for r in profile(df, plain).where("passed").collect():
            c = by[r["column_name"].lower()]
            tests = c.setdefault("tests", [])
            if r["test"] not in [t if isinstance(t, str) else next(iter(t)) for t in tests]:
                tests.append(r["test"])
        for c in m["columns"]:
            if not c.get("tests", True):
                del c["tests"]
        out[path] = s.dump()
    return _write(project, out, write)


def _write(project: Project, out: dict[str, str], write: bool) -> dict[str, str]:
    for path, text in out.items() if write and project.folder else ():
        full = os.path.join(project.folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    return out


def isolate(project: Project, folder: str, *selectors: str) -> list[str]:
    """A folder with only the selected models, and stubs, which read the built relation, for those they need besides."""
    graph = project.select(*selectors, macros=True)
    texts = {p: t for p, t in project.texts.items() if "/" not in p}
    for n in graph.needs:
        f = project.macros[n[6:]] if n.startswith("macro:") else project.files[n]
        texts[f.path] = f.source
        for u in project.ups(n):
            if u not in graph and not u.startswith("macro:"):
                up = project.files[u]
                texts[up.path] = "{{ config(materialized='ephemeral') }}SELECT * FROM " + str(project.relation(up))
    for path, text in texts.items():
        full = os.path.join(folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    return sorted(texts)
