"""A project: files to a graph, templates to SQL, selections to runs on a SparkSession.

Rendering goes in two passes. The first finds what each file needs; calls that look into tables give
nothing then, and mark the file for the second pass, which comes right before the file runs.
"""

from __future__ import annotations

import json
import os
import re
import threading
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import generators
from ..functions.builtins import ADAPTER_NOTHING, FUNCTIONS
from ..operators import checks, materialize
from ..operators.replan import mended
from ..sources import config as cfg
from ..sources.properties import SchemaFile, Test
from ..sources.seeds import header, read_seed
from ..template.parser import Template
from ..template.scope import Macro, Return, Scope
from ..template.values import UNDEFINED, Relation, TemplateError, text, truth
from .graph import Graph, closure, for_each

CTE = "__inline__"


@dataclass
class File:
    """A model, macro, data test or schema test."""

    path: str
    kind: str  # model, macro, test, schema_test
    source: str
    template: Template | None = None
    config: dict[str, Any] = field(default_factory=dict)
    needs: set[str] = field(default_factory=set)
    dynamic: bool = False
    sql: str = ""
    severity: str = "error"
    tags: list[str] = field(default_factory=list)
    lock: threading.RLock = field(default_factory=threading.RLock)

    @property
    def name(self) -> str:
        return os.path.basename(self.path).rsplit(".", 1)[0]


@dataclass
class Result:
    name: str
    status: str  # success, warning, failure, error
    failures: int
    message: str = ""


def read_folder(top: str) -> dict[str, str]:
    """All project files of a folder, by relative path."""
    out = {}
    for folder, _, names in os.walk(top):
        for n in names:
            full = os.path.join(folder, n)
            path = os.path.relpath(full, top).replace(os.sep, "/")
            if path.split("/")[0] in ("models", "macros", "tests", "data", "docs") or "/" not in path and path.endswith((".yml", ".yaml")):
                with open(full, encoding="utf-8") as f:
                    out[path] = f.read()
    return out


class Project:
    def __init__(self, spark: SparkSession, files: dict[str, str], target: str | None = None, upstream: str | None = None,
                 threads: int | None = None, sources: dict[str, str] | None = None, folder: str | None = None):
        """files: text by path. sources: name -> folder of Parquet tables, read by source(name, table)."""
        self.spark, self.texts, self.folder, self.sources = spark, dict(files), folder, dict(sources or {})
        self.config = cfg.load(self.texts, target, upstream, threads, lambda s: Template(s, "configuration").render(Scope(FUNCTIONS)))
        self.files: dict[str, File] = {}
        self.macros: dict[str, File] = {}
        self.seeds: dict[str, str] = {}
        self.docs: dict[str, str] = {}
        self.schemas: dict[str, SchemaFile] = {}
        self.by_suffix: dict[str, str] = {}
        self.compiled = False
        self.overrides: dict[str, Any] = {}
        self.rendering = threading.local()
        for path in sorted(self.texts):
            self._add(path)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **options: Any) -> Project:
        return cls(spark, read_folder(folder), folder=folder, **options)

    def _add(self, path: str) -> None:
        source, top = self.texts[path], path.split("/")[0]
        base = os.path.basename(path).rsplit(".", 1)[0]
        if path.endswith(".sql") and top in ("models", "tests", "macros"):
            f = File(path, {"models": "model", "tests": "test", "macros": "macro"}[top], source)
            known = self.macros if top == "macros" else self.files
            if f.name in known and known[f.name].path != path:
                raise TemplateError(f"{path} and {known[f.name].path} have the same name")
            if top == "models" and f.name in self.seeds:
                raise TemplateError(f"{path} and seed {self.seeds[f.name]} have the same name")
            known[f.name] = f
            parts = path[: -len(".sql")].split("/")
            for i in range(len(parts)) if top == "models" else ():
                self.by_suffix["/".join(parts[i:])] = f.name
        elif path.endswith(".csv") and top == "data":
            if base in self.seeds and self.seeds[base] != path or base in self.files:
                raise TemplateError(f"{path}: the name {base!r} is taken")
            self.seeds[base] = path
        elif path.endswith((".yml", ".yaml")) and "/" in path:
            self.schemas[path] = SchemaFile.parse(source)
        elif path.endswith(".md"):
            self.docs[base] = source

    # -- names and settings

    def find(self, name: str) -> File:
        name = name[: -len(".sql")] if name.endswith(".sql") else name
        key = self.by_suffix.get(name, name)
        if key not in self.files:
            raise TemplateError(f"there is no model {name!r}")
        return self.files[key]

    def setting(self, f: File, key: str, default: Any = UNDEFINED) -> Any:
        """In-file settings before those of the folders; tags of both add up."""
        folder = self.config.settings(f.path) if f.kind == "model" else {}
        if key == "tags":
            own = f.config.get("tags", [])
            return list(dict.fromkeys([*folder.get("tags", []), *([own] if isinstance(own, str) else own), *f.tags]))
        return f.config.get(key, folder.get(key, default))

    def materialization(self, f: File) -> str:
        m = text(self.setting(f, "materialized", "table"))
        if m not in cfg.MATERIALIZATIONS:
            raise TemplateError(f"{f.path}: unknown materialization {m!r}")
        return m

    def enabled(self, f: File) -> bool:
        return bool(self.setting(f, "enabled", True))

    def target_of(self, f: File, read: bool = False) -> cfg.Target:
        """Where a file is written, or read from if it isn't part of the run and reads are deferred."""
        t = self.config.target_for(f.path)
        if read and t.read_upstream is not None:
            t = t.read_upstream
        t = t.for_tags(self.setting(f, "tags"))
        changes = {k: text(v) for k, s in (("project", "project"), ("dataset", "schema")) if (v := self.setting(f, s)) is not UNDEFINED and v}
        if (v := self.setting(f, "execution_project")) is not UNDEFINED and v:
            changes["execution_projects"] = [text(v)]
        return t.copy(**changes) if changes else t

    def relation(self, f: File, read: bool = False) -> Relation:
        t = self.target_of(f, read)
        return Relation("spark_catalog", t.database, f.name, f"`spark_catalog`.`{t.database}`.`{f.name}`")

    def seed_relation(self, name: str) -> Relation:
        t = self.config.target_for(self.seeds[name])
        schema = self.config.settings(self.seeds[name]).get("schema")
        t = t.copy(dataset=schema) if schema else t
        return Relation("spark_catalog", t.database, name, f"`spark_catalog`.`{t.database}`.`{name}`")

    # -- rendering

    def _run_rows(self, sql: str) -> list[tuple]:
        return [tuple(r) for r in mended(self.spark.sql(sql)).collect()]

    def columns_of(self, relation: str) -> list[tuple[str, str]]:
        """Names and types, from analysis alone: no job runs."""
        sql = relation if relation.lstrip().startswith("(") else f"SELECT * FROM {relation}"
        return self.spark.sql(f"SELECT * FROM {relation}" if sql is relation else sql).dtypes

    def _scope(self, f: File, execute: bool, within: set[str] | None, ctes: dict[str, str]) -> Scope:
        def ref(*names: Any) -> Any:
            name = text(names[-1]) if names else ""
            f.dynamic = True
            if self.by_suffix.get(name, name) not in self.files and name in self.seeds:
                return self.seed_relation(name)
            up = self.find(name)
            if up.kind != "model":
                raise TemplateError(f"{name!r} isn't a model")
            if up is not f:
                f.needs.add(up.name)
            if not self.enabled(up):
                raise TemplateError(f"{f.path} needs {up.path}, which is disabled")
            chain = self._chain()
            if up.template is not None and not up.sql and up.name not in chain and not up.config:
                self.first_pass(up)
            if self.materialization(up) == "ephemeral" and up is not f:
                if up.name in chain:
                    raise TemplateError("models go in a circle: " + " -> ".join([*chain[chain.index(up.name) :], up.name]))
                if up.name not in ctes:
                    inner = self.render(up, execute, within, ctes)
                    ctes[up.name] = inner
                return f"{CTE}{up.name}"
            return self.relation(up, read=within is not None and up.name not in within)

        def source(name: Any, table: Any) -> str:
            folder = self.sources.get(text(name))
            if folder is None:
                raise TemplateError(f"there is no source {text(name)!r}")
            return f"parquet.`{folder.rstrip('/')}/{text(table)}.parquet`"

        def config(*maps: Any, **settings: Any) -> str:
            for m in maps:
                settings |= m
            for k, v in settings.items():
                if k == "tags":
                    v = [v] if isinstance(v, str) else list(v)
                f.config[k] = v
            if "materialized" in settings and text(settings["materialized"]) not in cfg.MATERIALIZATIONS:
                raise TemplateError(f"unknown materialization {text(settings['materialized'])!r}")
            if settings.get("enabled") is False:
                raise Return("")
            return ""

        def require(key: Any) -> Any:
            v = self.setting(f, text(key))
            if v is UNDEFINED:
                raise TemplateError(f"{f.path}: setting {text(key)!r} is needed")
            return v

        class Config(dict):
            __call__ = staticmethod(config)

        def introspect(g: Callable[..., Any], unknown: Callable[[], Any]) -> Callable[..., Any]:
            def run(*a: Any, **k: Any) -> Any:
                f.dynamic = True
                return g(*a, **k) if execute else unknown()

            return run

        def var(name: Any, default: Any = UNDEFINED) -> Any:
            v = self.overrides.get(text(name), self.config.variables.get(text(name), UNDEFINED))
            return default if v is UNDEFINED else v

        def get_relation(*a: Any, **k: Any) -> Relation:
            database, schema, name = generators.bind("get_relation", a, k, ("database", generators.REQUIRED), ("schema", generators.REQUIRED), ("identifier", generators.REQUIRED))
            catalog = "spark_catalog" if text(database) in ("", "spark_catalog") else text(database)
            return Relation(catalog, text(schema), text(name), ".".join(map(generators.identifier, (catalog, schema, name))))

        t = self.target_of(f)
        conf = Config()
        conf.update({"get": lambda k, default=UNDEFINED: self._or(self.setting(f, text(k)), default), "require": require})
        columns = introspect(lambda r: [{"name": n, "column": n, "data_type": kind, "dtype": kind} for n, kind in self.columns_of(text(r))], list)
        own = {
            "config": conf, "ref": ref, "indirect_ref": ref, "source": source, "var": var, "execute": execute, "project_name": self.config.name,
            "this": self.relation(f) if f.kind == "model" else UNDEFINED,
            "target": {"name": t.name, "schema": t.dataset, "dataset": t.dataset, "type": "spark", "threads": float(t.threads), "project": t.project, "database": t.database},
            "is_incremental": introspect(self._is_incremental(f), lambda: False),
            "run_query": introspect(lambda q: [[text(x) if x is not None and not isinstance(x, str | bool | int | float) else x for x in r] for r in self._run_rows(text(q))], list),
            "adapter": {n: FUNCTIONS["noop"] for n in ADAPTER_NOTHING} | {"get_relation": get_relation, "get_columns_in_relation": columns},
            "dbt_utils": {
                "pivot": generators.pivot, "group_by": generators.group_by, "union_all_tables": generators.union_all_tables,
                "unpivot": introspect(generators.unpivot(self.columns_of), lambda: ""),
                "get_column_values": introspect(generators.column_values(self._run_rows), list),
            },
        } | checks.SCHEMA_TESTS
        own["api"] = {"Relation": own["adapter"]}

        def macro(name: str) -> Any:
            if name in FUNCTIONS:
                found = FUNCTIONS[name]
                if name not in self.macros:
                    return found
            if name not in self.macros:
                return UNDEFINED
            m = self.macros[name]
            f.needs.add(f"macro:{name}")
            self._parse(m)
            m.template.run(scope)  # defines the file's macros in this scope
            defined = scope.vars.get(name)
            if not isinstance(defined, Macro):
                raise TemplateError(f"{m.path} doesn't define {name!r}")
            return defined

        scope = Scope(own, fallback=macro)
        return scope

    def _is_incremental(self, f: File) -> Callable[[], bool]:
        """Whether rows will be added to a table that is there: only for models that ask for it with append=true."""

        def found() -> bool:
            asked = self.materialization(f) == "incremental" and truth(self.setting(f, "append", False)) and not truth(self.setting(f, "full_refresh", False))
            return asked and materialize.table_kind(self.spark, str(self.relation(f))) is not None

        return found

    @staticmethod
    def _or(v: Any, default: Any) -> Any:
        return default if v is UNDEFINED else v

    def _parse(self, f: File) -> None:
        with f.lock:
            if f.template is None:
                f.template = Template(f.source, f.path)

    def render(self, f: File, execute: bool, within: set[str] | None = None, ctes: dict[str, str] | None = None) -> str:
        """The file's text, without the definitions of inlined models, which are added to ctes in order of need."""
        self._parse(f)
        scope, chain = self._scope(f, execute, within, {} if ctes is None else ctes), self._chain()
        chain.append(f.name)
        try:
            return f.template.render(scope)
        finally:
            chain.pop()

    def _chain(self) -> list[str]:
        """The files that this thread is rendering, each within the one before."""
        if not hasattr(self.rendering, "chain"):
            self.rendering.chain = []
        return self.rendering.chain

    def first_pass(self, f: File) -> None:
        with f.lock:
            f.config, f.needs, f.dynamic = {}, set(), False
            ctes: dict[str, str] = {}
            f.sql = self._whole(self.render(f, False, None, ctes), ctes)

    @staticmethod
    def _whole(main: str, ctes: dict[str, str]) -> str:
        """A query with its inlined models as common table expressions, each defined once and before its use."""
        if not ctes:
            return main
        if not main.strip():
            return main
        inner = ",\n".join(f"{CTE}{n} AS (\n{sql}\n)" for n, sql in ctes.items())
        return f"WITH {inner},\n{CTE}main AS (\n{main}\n)\nSELECT * FROM {CTE}main"

    def compile(self) -> None:
        """First pass over macros, models, tests and the tests of schema files."""
        if self.compiled:
            return
        threads = self.config.target.threads
        for_each(list(self.macros.values()), self._parse, threads)
        self._schema_tests()
        for kinds in (("model",), ("test", "schema_test")):
            for f in [f for f in self.files.values() if f.kind in kinds]:
                self.first_pass(f)
        self.compiled = True

    def _schema_tests(self) -> None:
        for path, schema in self.schemas.items():
            if path.split("/")[0] not in ("models", "tests", "data"):
                continue
            for name, model, column, t in schema.tests():
                self.files[name] = File(f"{path.rsplit('/', 1)[0]}/{name}.sql", "schema_test", self.test_source(model, column, t), severity=t.severity, tags=t.tags)

    @staticmethod
    def test_source(model: str, column: str | None, t: Test) -> str:
        """A schema test's template: a call of its macro. Arguments that are ref(...) expressions stay expressions."""

        def arg(v: Any) -> str:
            if isinstance(v, str) and re.fullmatch(r"\s*(ref|source|var|this)\b.*", v, re.S):
                return v
            if isinstance(v, bool):
                return "true" if v else "false"
            if isinstance(v, list):
                return "[" + ", ".join(map(arg, v)) + "]"
            if isinstance(v, dict):
                return "{" + ", ".join(f"{json.dumps(str(k))}: {arg(x)}" for k, x in v.items()) + "}"
            return "null" if v is None else json.dumps(v, ensure_ascii=False)

        args = dict(t.args)
        if column is not None:
            args.setdefault("column_name", column)
        elif "column_name" not in args and t.name in ("unique", "not_null"):
            args["column_name"] = args.pop("expression", args.pop("field", ""))
        listed = "".join(f", {k}={arg(v)}" for k, v in args.items())
        return f"{{{{ test_{t.name}(ref({json.dumps(model)}){listed}) }}}}"

    def sql_of(self, name: str, within: set[str] | None = None) -> str:
        """The SQL that running the file submits."""
        self.compile()
        f = self.find(name)
        if f.dynamic or self.config.target.read_upstream is not None or self.config.groups:
            with f.lock:
                ctes: dict[str, str] = {}
                return self._whole(self.render(f, True, within, ctes), ctes)
        return f.sql

    # -- selection

    def models(self) -> list[str]:
        return sorted(n for n, f in self.files.items() if f.kind == "model" and self.enabled(f))

    def ups(self, name: str) -> set[str]:
        if name.startswith("macro:"):
            return set()
        return self.files[name].needs

    def downs(self, name: str) -> set[str]:
        return {n for n, f in self.files.items() if name in f.needs}

    def select(self, *selectors: str, missing: str = "fail", tests: bool = False, macros: bool = False) -> Graph:
        """The graph of the selected nodes: `m`, `+m`, `m+`, `+m+`, `tag:t`; their union, or all models for none."""
        self.compile()
        chosen: set[str] = set()
        for s in selectors:
            if s.startswith("tag:"):
                found = {n for n in self.models() if s[4:] in self.setting(self.files[n], "tags")}
                if not found and missing == "fail":
                    raise TemplateError(f"no model has the tag {s[4:]!r}")
                if not found:
                    warnings.warn(f"no model has the tag {s[4:]!r}", stacklevel=2)
                chosen |= found
                continue
            try:
                name = self.find(s.strip("+")).name
            except TemplateError:
                if missing == "fail":
                    raise
                warnings.warn(f"there is no model {s.strip('+')!r}; it is left out", stacklevel=2)
                continue
            chosen |= {name}
            if s.startswith("+"):
                chosen |= closure([name], self.ups)
            if s.endswith("+"):
                chosen |= closure([name], self.downs)
        if not selectors:
            chosen = set(self.models())
        if not chosen and missing == "fail" and selectors:
            raise TemplateError("nothing is selected")
        chosen |= {u for n in list(chosen) for u in self._inlined(n)}
        if tests:
            chosen |= {d for n in list(chosen) for d in self.downs(n) if self.files[d].kind != "model"}
        if not tests:
            chosen = {n for n in chosen if n.startswith("macro:") or self.files[n].kind == "model"}
        chosen = {n for n in chosen if macros or not n.startswith("macro:")}
        if macros:
            chosen |= {u for n in list(chosen) for u in self.ups(n) if u.startswith("macro:")}
        return Graph({n: set(self.ups(n)) for n in chosen})

    def _inlined(self, name: str) -> set[str]:
        """Ephemeral models above a node, through other ephemeral ones."""
        step = lambda n: {u for u in self.ups(n) if not u.startswith("macro:") and self.materialization(self.files[u]) == "ephemeral"}
        return closure([name], step) - {name}

    def order(self, *selectors: str) -> list[str]:
        return self.select(*selectors).order()

    # -- running

    def _prepare(self, databases: set[str]) -> None:
        for d in sorted(databases):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{d}`")

    def run_model(self, name: str, within: set[str] | None = None) -> None:
        f = self.files[name]
        kind = self.materialization(f)
        if kind == "ephemeral":
            return
        sc = self.spark.sparkContext
        t = self.target_of(f)
        sc.setLocalProperty("spark.scheduler.pool", t.pool())
        sc.setJobGroup(f"loomery-{name}", name, interruptOnCancel=True)
        try:
            sql = self.sql_of(name, within)
            if not sql.strip():
                return
            self._hooks(f, "pre_hook")
            relation, udf = str(self.relation(f)), text(self.setting(f, "udf", ""))
            if kind == "view":
                materialize.write_view(self.spark, relation, sql)
            else:
                df = materialize.query(self.spark, sql, udf)
                if kind == "incremental" and truth(self.setting(f, "append", False)) and not truth(self.setting(f, "full_refresh", False)):
                    key = self.setting(f, "unique_key", [])
                    materialize.append_or_merge(self.spark, relation, df, [key] if isinstance(key, str) else [text(k) for k in key])
                else:
                    materialize.write_table(self.spark, relation, df)
            self._hooks(f, "post_hook")
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    def _hooks(self, f: File, key: str) -> None:
        hooks = self.setting(f, key, [])
        for h in [hooks] if isinstance(hooks, str) else hooks:
            sql = Template(text(h), f"{f.path} {key}").render(self._scope(f, True, None, {}))
            for s in materialize.split_statements(sql):
                self.spark.sql(s)

    def run(self, *selectors: str, missing: str = "fail", graph: Graph | None = None) -> list[str]:
        """Build the selected models, each after those it needs; the names in the order they ended."""
        graph = graph or self.select(*selectors, missing=missing)
        names = set(graph.needs)
        self._prepare({self.target_of(self.files[n]).database for n in names})
        cancel = lambda: [self.spark.sparkContext.cancelJobGroup(f"loomery-{n}") for n in names]
        return graph.execute(lambda n: self.run_model(n, names), self.config.target.threads, cancel)

    def table(self, name: str) -> DataFrame:
        return mended(self.spark.table(str(self.relation(self.find(name)))))

    def seed(self, *names: str) -> list[str]:
        """Load seeds into tables, all of them if none is named."""
        chosen = [n for n in (names or sorted(self.seeds)) if self.config.settings(self.seeds[n]).get("enabled", True)]

        def one(name: str) -> str:
            path = self.seeds[name]
            types = self.config.settings(path).get("column_types")
            known = {k.lower() for k in types or {}} - {c.lower() for c in header(self.texts[path])}
            if known:
                raise TemplateError(f"{path}: no column {sorted(known)[0]!r}")
            relation = self.seed_relation(name)
            self._prepare({relation.schema})
            materialize.write_table(self.spark, str(relation), read_seed(self.spark, self.texts[path], types))
            return name

        return for_each(chosen, one, self.config.target.threads)

    def test(self, *selectors: str) -> list[Result]:
        """Run the tests that refer to the selected models: schema tests give a count that should be 0, data tests rows that shouldn't be there."""
        graph = self.select(*selectors, tests=True)
        names = sorted(n for n in graph.needs if self.files[n].kind != "model")

        def one(name: str) -> Result:
            f = self.files[name]
            try:
                df = materialize.query(self.spark, self.sql_of(name, set(graph.needs)), text(self.setting(f, "udf", "")))
                if f.kind == "schema_test":
                    rows = df.take(2)
                    if len(rows) != 1 or len(rows[0]) != 1:
                        raise TemplateError(f"{name} gives more than one value")
                    n = int(rows[0][0])
                else:
                    n = df.count()
            except Exception as e:  # reported with the other results
                return Result(name, "error", 0, str(e).split("\n")[0])
            warn = f.severity == "warn" or self.setting(f, "severity", "error") == "warn"
            return Result(name, "success" if not n else "warning" if warn else "failure", n)

        return for_each(names, one, self.config.target.threads)

    def results_frame(self, results: list[Result]) -> DataFrame:
        return self.spark.createDataFrame([(r.name, r.status, r.failures) for r in results], "name string, status string, failures long")

    # -- changes

    def replace(self, path: str, source: str) -> set[str]:
        """Take a file's new text; the models and tests that have to run again, through macros and inlined models."""
        self.texts[path] = source
        top = path.split("/")[0]
        if not path.endswith(".sql") or top not in ("models", "macros", "tests"):
            self._add(path)
            self.compiled = False
            return set()
        base = os.path.basename(path)[: -len(".sql")]
        old = (self.macros if top == "macros" else self.files).pop(base, None)
        self._add(path)
        del old
        start = f"macro:{base}" if top == "macros" else base
        stale = closure([start], self.downs) - {start} if self.compiled else set()
        if top != "macros":
            stale |= {base}
        for n in stale | ({base} if top != "macros" else set()):
            self.first_pass(self.files[n])
        return {n for n in stale if not n.startswith("macro:")}

    def remove(self, path: str) -> set[str]:
        """Forget a file that is gone; the models and tests that referred to it."""
        self.texts.pop(path, None)
        base = os.path.basename(path).rsplit(".", 1)[0]
        if path in self.schemas:
            for name in [f.name for f in self.files.values() if f.kind == "schema_test" and f.path.startswith(path.rsplit("/", 1)[0] + "/")]:
                del self.files[name]
            del self.schemas[path]
            self._schema_tests()
            return set()
        if self.seeds.get(base) == path:
            del self.seeds[base]
            return set()
        if path.endswith(".md"):
            self.docs.pop(base, None)
        is_macro = path.split("/")[0] == "macros"
        known = self.macros if is_macro else self.files
        if base not in known or known[base].path != path:
            return set()
        start = f"macro:{base}" if is_macro else base
        stale = closure([start], self.downs) - {start}
        del known[base]
        self.by_suffix = {k: n for k, n in self.by_suffix.items() if n != base or is_macro}
        return {n for n in stale if not n.startswith("macro:")}

    def refresh(self, names: set[str]) -> list[Result]:
        """The first pass over these files again; errors of those that fail, such as one that needs a file that is gone."""
        out = []
        for n in sorted(names):
            try:
                self.first_pass(self.files[n])
            except TemplateError as e:
                out.append(Result(n, "error", 0, str(e).split("\n")[0]))
        return out
