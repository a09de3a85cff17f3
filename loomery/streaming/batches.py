"""Streams into tables. Projects are run in batches; this keeps a grouped count over files as they arrive."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, key: str, n: str = "n") -> DataFrame:
    """Counts by key of a Parquet file or folder, read as a stream to its present end; the result is a table in memory.

    For an endless stream, start the returned plan's like with a watermark and a sink of your own.
    """
    schema = spark.read.parquet(path).schema
    folder, file = (path, None) if not path.endswith(".parquet") else os.path.split(path)
    reader = spark.readStream.schema(schema).format("parquet")
    if file:
        reader = reader.option("pathGlobFilter", file)
    events = reader.load(folder if file else path)
    name = f"counts_{uuid.uuid4().hex[:8]}"
    out = events.groupBy(key).agg(F.count("*").alias(n)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name)
