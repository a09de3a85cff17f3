"""Functions and constants that every template sees."""

from __future__ import annotations

import datetime
import json
import logging
import os
import warnings
from collections.abc import Callable
from typing import Any

import yaml

from ..template.scope import Return
from ..template.values import UNDEFINED, TemplateError, number, text, truth

log = logging.getLogger("loomery")
VERSION = "1.0.0"


def _return(value: Any = UNDEFINED) -> Any:
    raise Return(value)


def _default(value: Any, other: Any = "") -> Any:
    return other if value is UNDEFINED or value is None else value


def _env_var(name: str, default: Any = "") -> Any:
    return os.environ.get(text(name)) or default


def _raise(message: Any = "") -> Any:
    raise TemplateError(text(message))


def _warn(message: Any = "") -> str:
    warnings.warn(text(message), stacklevel=2)
    return ""


def _log(*parts: Any, info: Any = False) -> str:
    log.info(" ".join(map(text, parts)))
    return ""


def _missing(name: str) -> Callable[..., Any]:
    def f(*a: Any, **k: Any) -> Any:
        raise TemplateError(f"{name} isn't available here")

    return f


def _nothing(*a: Any, **k: Any) -> Any:
    return UNDEFINED


def _timedelta(days: Any = 0, seconds: Any = 0, minutes: Any = 0, hours: Any = 0, weeks: Any = 0) -> str:
    return str(datetime.timedelta(days=number(days), seconds=number(seconds), minutes=number(minutes), hours=number(hours), weeks=number(weeks)))


_DATETIME = {
    "time": lambda h=0, m=0, s=0: datetime.time(int(number(h)), int(number(m)), int(number(s))).isoformat(),
    "date": lambda y, m, d: datetime.date(int(number(y)), int(number(m)), int(number(d))).isoformat(),
    "timedelta": _timedelta,
}

FUNCTIONS: dict[str, Any] = {
    "as_bool": truth,
    "as_number": number,
    "as_text": text,
    "default": _default,
    "dbt_version": VERSION,
    "env_var": _env_var,
    "exceptions": {"raise_compiler_error": _raise, "warn": _warn},
    "is_incremental": lambda: False,
    "is_marked_for_full_refresh": _nothing,
    "log": _log,
    "lower": lambda s: text(s).lower(),
    "upper": lambda s: text(s).upper(),
    "trim": lambda s: text(s).strip(),
    "length": lambda x: float(len(x)) if isinstance(x, list | dict | str) else 0.0,
    "join": lambda xs, by="": text(by).join(map(text, xs)),
    "modules": {"datetime": _DATETIME},
    "noop": _nothing,
    "print": _log,
    "range": lambda *a: [float(i) for i in range(*(int(number(x)) for x in a))],
    "replace": lambda s, a, b: text(s).replace(text(a), text(b)),
    "return": _return,
    "tojson": lambda x: text(x) if isinstance(x, list | dict) else json.dumps(None if x is UNDEFINED else x),
    "fromjson": lambda s: json.loads(text(s)),
    "toyaml": lambda x: yaml.safe_dump(json.loads(text(x)) if isinstance(x, list | dict) else x, sort_keys=False),
    "fromyaml": lambda s: yaml.safe_load(text(s)),
} | {n: _missing(n) for n in ("as_native", "builtins", "debug", "doc", "flags", "graph", "invocation_id", "run_started_at", "schema", "statement")}

#: Adapter calls that models may make and that need nothing done here.
ADAPTER_NOTHING = ("dispatch", "get_missing_columns", "expand_target_column_types", "create_schema", "drop_schema", "drop_relation", "rename_relation", "get_columns_in_table", "already_exists", "adapter_macro", "check_schema_exists")
