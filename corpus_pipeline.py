"""From documents to packed sequences: toxicity, language, boilerplate lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads them again; a stage's own
tables go then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.llm import langid, lines, neardup, packing, toxicity
from loomery.llm.common import Scratch, passing
from loomery.llm.queries import vocabulary_path

#: Lines on more than this percentage of a source's distinct texts go, for sources with so many texts.
LINE_PERCENT, LINE_TEXTS = 10, 20
#: Toxicity scores from here on are rejected.
TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score TOXIC_FROM or more go; null, empty and repeated rows score like others; without labels none goes."""
    return toxicity.without_toxic(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXIC_FROM)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter or in no learned language go; repeated rows share their fate; without labelled rows all with a letter stay."""
    return langid.with_language(spark, docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; lines go by their share of a source's texts (a null source is the empty one), long ones by their texts; blank lines and null texts stay."""
    return lines.documents_without_boilerplate(spark, docs, LINE_PERCENT, LINE_TEXTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, with the least id (rows without ids too are told apart); rows without words stay."""
    return neardup.without_copies(spark, docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is packed; a null or empty text is its end id alone; repeated rows are packed each. Only pieces come back."""
    return packing.pack_documents(spark, docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("lines", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: The stages' models and tokenizer aren't SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with passing():
            docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
