"""Small tables with what operators meet: nulls, empty and long texts, repeats, columns of clashing names."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
#: Names that operators use inside.
CLASHES = [("v", LongType()), ("n", LongType()), ("key", StringType()), ("row", StringType()), ("g", LongType()), ("host", StringType()), ("lines", StringType()), ("score", DoubleType()), ("shard", IntegerType()), ("c", LongType()), ("rep", LongType()), ("size", LongType()), ("label", IntegerType()), ("toxic", IntegerType()), ("_h", StringType()), ("_b", LongType()), ("chunk", IntegerType()), ("held_out", StringType()), ("lang_pred", StringType()), ("component_id", LongType()), ("kept", IntegerType()), ("pieces", StringType()), ("media", StringType()), ("n_bytes", LongType())]

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "web", 60),
    (2, "The quick brown fox jumps over the lazy dog, again and again.", "en", "web", 60),
    (3, None, "en", "web", None),
    (4, "", None, "web", 0),
    (5, " \n\t \n", "en", None, 5),
    (6, "same row", "de", "books", 8),
    (6, "same row", "de", "books", 8),
    (7, LONG, "en", "books", len(LONG)),
    (8, "naïve café 漢字 🙂 <|endoftext|> x", "fr", "books", 30),
    (None, "a row without an id", "en", "web", 19),
    (None, None, None, None, None),
    (9, "one", "en", "web", 3),
    (10, "1234 5678 !!! ???", "en", "web", 17),
    (11, "line one\nline two\r\n  line three  \n\n", None, "", 35),
]


def docs(spark, rows=ROWS, clash=True):
    extra = [StructField(n, t) for n, t in CLASHES] if clash else []
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], StructType(SCHEMA.fields + extra))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
