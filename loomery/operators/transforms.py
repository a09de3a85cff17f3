"""The generated relations as DataFrame operations, for use outside templates."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def pivot_columns(column: str, values: list, agg=F.sum, cmp: str = "=", prefix: str = "", suffix: str = "", then_value=1, else_value=0) -> list[Column]:
    """One conditional aggregate for each value; for `df.groupBy(...).agg(*pivot_columns(...))`."""
    side = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [agg(F.when(_COMPARE[cmp](F.col(column), F.lit(v)), side(then_value)).otherwise(side(else_value))).alias(f"{prefix}{v}{suffix}") for v in values]


def unpivot(df: DataFrame, cast_to: str = "string", exclude: list[str] | None = None, remove: list[str] | None = None, field_name: str = "field_name", value_name: str = "value") -> DataFrame:
    """A row for each kept column of each row, in a single scan."""
    carried, gone = {x.lower() for x in exclude or []}, {x.lower() for x in remove or []}
    ids = [c for c in df.columns if c.lower() in carried]
    keep = [c for c in df.columns if c.lower() not in carried | gone]
    if not keep:
        raise ValueError("no column is left")
    cast = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string" if cast_to == "varchar" else cast_to).alias(c) for c in keep])
    return cast.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in keep], field_name, value_name)


def union_all(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionAll, [t.select(*columns) for t in tables])


def column_values(df: DataFrame, column: str, max_records: int | None = None) -> DataFrame:
    """The column's values by falling frequency, ties by value; a top-k plan with a limit."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))
    return out if max_records is None else out.limit(max_records)
