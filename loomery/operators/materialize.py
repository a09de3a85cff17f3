"""Writing models: tables, views, incremental tables, seeds."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..template.values import TemplateError
from .replan import mended

_TYPES = {
    "INTEGER": "bigint", "INT64": "bigint", "FLOAT": "double", "FLOAT64": "double", "NUMERIC": "decimal(38,9)", "BOOLEAN": "boolean", "BOOL": "boolean",
    "STRING": "string", "VARCHAR": "string", "TIMESTAMP": "timestamp", "DATETIME": "timestamp_ntz", "DATE": "date", "TIME": "string", "GEOGRAPHY": "string", "BYTES": "binary",
}


def spark_type(name: str) -> str:
    """A Spark type for a warehouse type's name."""
    return _TYPES.get(name.strip().upper(), name.strip())


def table_kind(spark: SparkSession, name: str) -> str | None:
    """VIEW, MANAGED, EXTERNAL, or None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    return spark.catalog.getTable(name).tableType


def split_statements(sql: str) -> list[str]:
    """The statements of a text, cut at semicolons outside of quotes, comments and BEGIN ... END blocks."""
    out, start, depth = [], 0, 0
    for m in re.finditer(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|\bEND\s+(?:IF|WHILE|LOOP|FOR|REPEAT)\b|\b(?:BEGIN|CASE|END)\b", sql, re.S | re.I):
        word = m[0].upper()
        if word == ";" and not depth:
            out.append(sql[start : m.start()])
            start = m.end()
        elif word in ("BEGIN", "CASE") and not re.search(r"\bEND\s*$", sql[: m.start()], re.I):
            depth += 1
        elif word == "END":
            depth = max(0, depth - 1)
    out.append(sql[start:])
    return [s.strip() for s in out if s.strip()]


def query(spark: SparkSession, sql: str, prelude: str = "") -> DataFrame:
    """Run a query after what stands before it, such as temporary functions, which get a session of their own."""
    if prelude.strip():
        spark = spark.newSession()
        for s in split_statements(prelude):
            spark.sql(s)
    statements = split_statements(sql)
    for s in statements[:-1]:
        spark.sql(s)
    return mended(spark.sql(statements[-1]))


#: The property with the folder that a table had before.
_BEFORE = "loomery.before"


def _location(spark: SparkSession, name: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"] if rows else None


def write_table(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Replace a table. The rows are written to a folder of their own before the name is given to it.

    So the query may read the table itself, readers never see a part, and what another session has left in
    the warehouse is in nobody's way. With the same columns as before, the name is moved to the new folder in one step;
    with others the table is dropped and made anew, and for a moment there is none. The folder that the name
    stood for stays for those who read it until the table is written the next time.
    """
    if table_kind(spark, name) == "VIEW":
        raise TemplateError(f"{name} is a view; drop it before it becomes a table")
    database, short = name.split(".")[-2].strip("`"), name.split(".")[-1].strip("`")
    top = spark.catalog.getDatabase(database).locationUri.rstrip("/")
    path = f"{top}/{re.sub(r'[^A-Za-z0-9_]', '_', short)}__{uuid.uuid4().hex[:12]}"
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.parquet(path)
    old = before = None
    if spark.catalog.tableExists(name):
        old = _location(spark, name)
        found = spark.sql(f"SHOW TBLPROPERTIES {name}").where(F.col("key") == _BEFORE).collect()
        before = found[0]["value"] if found else None
    if old and spark.table(name).dtypes == df.dtypes:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path, "parquet", df.schema)
    if old:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_BEFORE}' = '{old}')")
    if before and before.startswith(top) and before.rstrip("/") not in (path, (old or "").rstrip("/")):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(before)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_view(spark: SparkSession, name: str, sql: str) -> None:
    """Create or replace a view; over a real table that is an error."""
    if table_kind(spark, name) not in (None, "VIEW"):
        raise TemplateError(f"{name} is a table; drop it before it becomes a view")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")


def append_or_merge(spark: SparkSession, name: str, df: DataFrame, key: list[str]) -> None:
    """Add rows to a table; with a key, they replace the rows of equal keys, null being equal to null.

    Without a key, or where no row has one of the new keys, only the new rows are written. Two new rows of one key
    are an error. The table's columns stay; rows that lack one, or have others, are an error.
    """
    if key:
        twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
        if twice:
            raise TemplateError(f"{name}: two new rows have the key {tuple(twice[0][:-1])!r}")
    if table_kind(spark, name) is None:
        write_table(spark, name, df)
        return
    old = spark.table(name)
    if sorted(c.lower() for c in old.columns) != sorted(c.lower() for c in df.columns):
        raise TemplateError(f"{name} has the columns {old.columns}, the new rows {df.columns}")
    df = df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in old.dtypes])
    if key:
        keys = df.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(key)])
        same = reduce(and_, [old[k].eqNullSafe(keys[f"_{i}"]) for i, k in enumerate(key)])
        if old.join(keys, same, "left_semi").limit(1).count():
            write_table(spark, name, old.join(keys, same, "left_anti").unionAll(df))
            return
    df.write.insertInto(name)
