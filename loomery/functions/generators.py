"""Template functions that write SQL: pivot, unpivot, union, grouping and column values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..template.values import UNDEFINED, TemplateError, is_number, kind, number, text, truth


def bind(name: str, args: tuple, kwargs: dict[str, Any], *params: tuple[str, Any]) -> list[Any]:
    """Arguments by order or name, with defaults; a default's kind is required of what is given. REQUIRED has none."""
    if len(args) > len(params):
        raise TemplateError(f"{name} takes {len(params)} arguments")
    names = [p for p, _ in params]
    for k in kwargs:
        if k not in names:
            raise TemplateError(f"{name} has no argument {k!r}")
        if names.index(k) < len(args):
            raise TemplateError(f"{name}: {k!r} is given twice")
    out = []
    for i, (p, default) in enumerate(params):
        v = args[i] if i < len(args) else kwargs.get(p, UNDEFINED)
        if v is UNDEFINED:
            if default is REQUIRED:
                raise TemplateError(f"{name}: {p!r} is missing")
            v = list(default) if isinstance(default, list) else default
        elif default is not REQUIRED and default is not None and kind(v) != kind(default) and not (kind(default) == "string" and is_number(v)) and not (is_number(default) and isinstance(v, str)):
            raise TemplateError(f"{name}: {p!r} is a {kind(default)}, not a {kind(v)}")
        out.append(v)
    return out


REQUIRED = object()


def identifier(name: Any) -> str:
    """A name in back-quotes."""
    return "`" + text(name).replace("`", "``") + "`"


def literal(value: Any) -> str:
    """A value as a SQL literal; strings with backslashes and quotes escaped."""
    if is_number(value):
        return text(value)
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if value is None or value is UNDEFINED:
        return "NULL"
    return "'" + text(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def pivot(*args: Any, **kwargs: Any) -> str:
    """One conditional aggregate for each value, joined by commas."""
    column, values, alias, agg, cmp, prefix, suffix, then_value, else_value, quote = bind(
        "pivot", args, kwargs, ("column", REQUIRED), ("values", REQUIRED), ("alias", True), ("agg", "sum"), ("cmp", "="), ("prefix", ""), ("suffix", ""), ("then_value", 1.0), ("else_value", 0.0), ("quote_identifiers", True))
    out = []
    for v in values:
        name = text(prefix) + text(v) + text(suffix)
        sql = f"{text(agg)}(CASE WHEN {text(column)} {text(cmp)} {literal(text(v))} THEN {text(then_value)} ELSE {text(else_value)} END)"
        out.append(sql + (f" AS {identifier(name) if truth(quote) else name}" if truth(alias) else ""))
    return ",\n".join(out)


def group_by(*args: Any, **kwargs: Any) -> str:
    (n,) = bind("group_by", args, kwargs, ("n", REQUIRED))
    if number(n) < 1:
        raise TemplateError("group_by needs one column at least")
    return "GROUP BY " + ", ".join(str(i + 1) for i in range(int(number(n))))


def union_all_tables(*args: Any, **kwargs: Any) -> str:
    tables, names = bind("union_all_tables", args, kwargs, ("tables", REQUIRED), ("column_names", REQUIRED))
    if not tables or not names:
        raise TemplateError("union_all_tables needs tables and columns")
    cols = ", ".join(text(c) for c in names)
    return "(" + "\nUNION ALL\n".join(f"SELECT {cols} FROM {text(t)}" for t in tables) + ")"


def unpivot(columns_of: Callable[[str], list[tuple[str, str]]]) -> Callable[..., Any]:
    """A row for each kept column, in one scan: an inline table of (name, cast value) is exploded beside the carried columns."""

    def f(*args: Any, **kwargs: Any) -> str:
        table, cast_to, exclude, remove, field_name, value_name = bind(
            "unpivot", args, kwargs, ("table", REQUIRED), ("cast_to", "string"), ("exclude", []), ("remove", []), ("field_name", "field_name"), ("value_name", "value"))
        cast_to = "string" if text(cast_to).lower() in ("varchar", "string") else text(cast_to)
        carried, gone = {text(x).lower() for x in exclude}, {text(x).lower() for x in remove}
        cols = [c for c, _ in columns_of(text(table))]
        keep = [c for c in cols if c.lower() not in carried | gone]
        if not keep:
            raise TemplateError("unpivot: no column is left")
        ids = [identifier(c) for c in cols if c.lower() in carried]
        pairs = ", ".join(f"{literal(c)}, CAST({identifier(c)} AS {cast_to})" for c in keep)
        stack = f"stack({len(keep)}, {pairs}) AS ({identifier(field_name)}, {identifier(value_name)})"
        return f"SELECT {', '.join([*ids, stack])} FROM {text(table)}"

    return f


def column_values(run: Callable[[str], list[tuple]]) -> Callable[..., Any]:
    """A column's values, the most frequent first and ties by value; null isn't one of them."""

    def f(*args: Any, **kwargs: Any) -> list[Any]:
        table, column, most = bind("get_column_values", args, kwargs, ("table", REQUIRED), ("column", REQUIRED), ("max_records", None))
        limit = f" LIMIT {int(number(most))}" if most is not None else ""
        rows = run(f"SELECT {text(column)} AS v FROM {text(table)} WHERE {text(column)} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1{limit}")
        return [r[0] if isinstance(r[0], str | bool) else float(r[0]) if is_number(r[0]) else str(r[0]) for r in rows]

    return f
