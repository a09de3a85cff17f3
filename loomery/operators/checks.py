"""Declared data tests: as SQL text for the runner, as DataFrames, and found by profiling a table in one pass."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generators import identifier, literal
from ..template.values import TemplateError, text


def unique_sql(model: Any, column_name: Any) -> str:
    return f"SELECT count(*) AS num_errors FROM (SELECT {text(column_name)} AS k FROM {text(model)} GROUP BY 1 HAVING count({text(column_name)}) > 1) AS repeated"


def not_null_sql(model: Any, column_name: Any) -> str:
    return f"SELECT count(*) AS num_errors FROM {text(model)} WHERE {text(column_name)} IS NULL"


def accepted_values_sql(model: Any, column_name: Any, values: Any, quote: Any = True) -> str:
    """Rows whose value is another; null rows pass, as SQL's NOT IN has it."""
    if not values:
        raise TemplateError("accepted_values needs values")
    listed = ", ".join(text(v) if not quote else literal(text(v)) for v in values)
    return f"SELECT count(*) AS num_errors FROM {text(model)} WHERE {text(column_name)} NOT IN ({listed})"


def relationships_sql(model: Any, column_name: Any, to: Any, field: Any) -> str:
    """Child rows with a key that no parent has, as an anti join."""
    return (f"SELECT count(*) AS num_errors FROM (SELECT {text(column_name)} AS k FROM {text(model)}) AS child "
            f"LEFT ANTI JOIN (SELECT {text(field)} AS k FROM {text(to)}) AS parent ON child.k = parent.k WHERE child.k IS NOT NULL")


SCHEMA_TESTS = {"test_unique": unique_sql, "test_not_null": not_null_sql, "test_accepted_values": accepted_values_sql, "test_relationships": relationships_sql}


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(column).alias("n")).where("n > 1").agg(F.count("*").alias("num_errors"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull()).agg(F.count("*").alias("num_errors"))


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values)).agg(F.count("*").alias("num_errors"))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    keys = parent.select(F.col(field).alias("_k"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("num_errors"))


def profile(df: DataFrame, columns: list[str] | None = None, batch: int = 16) -> DataFrame:
    """(column_name, test, num_errors, passed) of not_null and unique for each column.

    num_errors of not_null is null rows, of unique the values that repeat. Each batch of columns is one scan and one
    count by (column, value), null being a value: a row becomes one small row a column, summed in each task before
    the shuffle, so no common value is a burden.
    """
    columns, frames = columns or df.columns, []
    for lo in range(0, len(columns), batch):
        part = columns[lo : lo + batch]
        values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(part)])
        seen = df.select(F.explode(values).alias("x")).select("x.i", "x.v").groupBy("i", "v").agg(F.count("*").alias("n"))
        errors = seen.groupBy("i").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"), F.count_if((F.col("n") > 1) & F.col("v").isNotNull()).alias("repeated"))
        names = F.element_at(F.array(*[F.lit(c) for c in part]), F.col("i") + 1)
        every = df.sparkSession.range(len(part)).select(F.col("id").cast("int").alias("i")).join(F.broadcast(errors), "i", "left")  # a row a column
        rows = [F.struct(names.alias("column_name"), F.lit(t).alias("test"), F.coalesce(n, F.lit(0)).alias("num_errors")) for t, n in (("not_null", "nulls"), ("unique", "repeated"))]
        frames.append(every.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionAll, frames).withColumn("passed", F.col("num_errors") == 0)


__all__ = ["SCHEMA_TESTS", "accepted_values", "identifier", "not_null", "profile", "relationships", "unique"]
