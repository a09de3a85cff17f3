"""CSV seeds to tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import spark_type
from ..template.values import TemplateError


def header(text: str) -> list[str]:
    row = next(csv.reader(io.StringIO(text)), None)
    if not row:
        raise TemplateError("a seed needs a header")
    return [c.strip() for c in row]


def records(text: str) -> Iterator[str]:
    """The text's records: lines, or several where quotes hold a line's end."""
    record = ""
    for line in io.StringIO(text, newline=""):
        record += line
        if record.count('"') % 2 == 0:
            if record.strip():
                yield record.rstrip("\r\n")
            record = ""
    if record.strip():
        yield record.rstrip("\r\n")


def _tidy(df: DataFrame) -> DataFrame:
    """Whole numbers are 64 bits wide."""
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes])


def read_seed(spark: SparkSession, text: str, column_types: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """The rows of a CSV with a header. With types, columns not named are strings; without, types are found. Jagged rows fail.

    Given a path, Spark's readers load it; a text that is only in memory goes through the driver, as seeds are small.
    """
    names = header(text)
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "escape": '"'}
    if column_types:
        kinds = {k.lower(): spark_type(t) for k, t in column_types.items()}
        options["schema"] = ", ".join(f"`{n}` {kinds.get(n.lower(), 'string')}" for n in names)
    else:
        options["inferSchema"] = True
    source = path
    if source is None:
        width = len(names)
        for i, row in enumerate(csv.reader(io.StringIO(text))):
            if row and len(row) != width:
                raise TemplateError(f"row {i + 1} has {len(row)} fields, not {width}")
        source = spark.sparkContext.parallelize(list(records(text)), 1)
    else:
        options["multiLine"] = True
    schema = options.pop("schema", None)
    reader = spark.read.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})
    return _tidy((reader.schema(schema) if schema else reader).csv(source))
