"""Proportional stratified interleaving into shards, in DataFrame operations only.

Rows of each source are put in a seeded random order; row r of n gets the place (r + u) / n, where
u in [0, 1) is the source's own seeded offset. The order of all places interleaves the sources in
proportion, and equal cuts of it are shards that match the mixture, with counts at most one apart.

No window holds a source, or all rows: ranks are counted in buckets of the random order (and then
of the places), each of about `bucket_rows` rows, and sums of the buckets' counts are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, columns

SEED = 17
_SUP = 1024


def _before(counts: DataFrame, keys: list[str], bucket: str, n: str) -> DataFrame:
    """Of buckets numbered within keys: rows in earlier buckets (`before`) and in all (`whole`), in two levels."""
    sup = counts.withColumn("_sup", F.floor(F.col(bucket) / _SUP))
    tops = sup.groupBy(*keys, "_sup").agg(F.sum(n).alias("_n"))
    whole = tops.groupBy(*keys).agg(F.sum("_n").alias("whole")) if keys else tops.agg(F.sum("_n").alias("whole"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_sup", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_tops"))
    tops = tops.join(whole, keys) if keys else tops.crossJoin(F.broadcast(whole))  # one row
    w = Window.partitionBy(*keys, "_sup").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = sup.withColumn("_in", F.coalesce(F.sum(n).over(w), F.lit(0)))
    return inner.join(tops, [*keys, "_sup"]).select(*keys, bucket, (F.col("_tops") + F.col("_in")).alias("before"), "whole")


def _unit(hexes, digits: int):
    """The first hexadecimal digits as a number in [0, 1)."""
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def interleave(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_rows: int = 2000,
               scratch: Scratch | None = None) -> DataFrame:
    """Deal all rows of (doc_id, text, source) into shards; law "rows": counts at most one apart.

    Returns doc_id, source, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in
    the shard) and grown_shard (null: under this law a further shard moves rows of all). A null text
    counts as no bytes (crc32 0); a null source is the same stratum as an empty one; a null doc_id is
    dealt like any other: the random order is by id and text, so rows of one id are spread. Ties of the random order go by doc_id, size and crc32. Rows alike in all of
    these are interchangeable. An empty table gives an empty result. Other columns are left out.
    """
    scratch = scratch or Scratch(spark, "sharding")
    d = columns(docs, "doc_id", "text", "source")
    none = lambda c: F.coalesce(c, F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), none(F.col("doc_id").cast("string")), F.lit(":"), F.md5(none(F.col("text")).cast("binary"))).cast("binary"))
    base = scratch.save(d.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), h.alias("_h")))
    total = base.count()
    buckets = max(1, total // bucket_rows)
    base = base.withColumn("_b", F.floor(_unit(F.col("_h"), 12) * buckets))
    first = _before(base.groupBy("source", "_b").agg(F.count("*").alias("_n")), ["source"], "_b", "_n")
    tie = [F.col("_h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    r = F.row_number().over(Window.partitionBy("source", "_b").orderBy(*tie)) - 1
    start = _unit(F.md5(F.concat(F.lit(f"{seed}:source:"), F.col("source")).cast("binary")), 8)
    placed = base.withColumn("_r", r).join(first, ["source", "_b"])
    placed = placed.withColumn("_place", (F.col("before") + F.col("_r") + start) / F.col("whole"))
    placed = scratch.save(placed.select("doc_id", "source", "size", "text_crc32", "_h", "_place",
                                        F.floor(F.col("_place") * buckets).alias("_g")))
    second = _before(placed.groupBy("_g").agg(F.count("*").alias("_n")), [], "_g", "_n").select("_g", "before")
    at = F.row_number().over(Window.partitionBy("_g").orderBy("_place", *tie)) - 1
    pos = placed.withColumn("_at", at).join(second, "_g").withColumn("_pos", F.col("before") + F.col("_at"))
    n = F.lit(total)
    out = pos.withColumn("_shard", F.expr(f"(_pos * {shards}) div {max(total, 1)}"))
    slot = F.col("_pos") - F.floor((F.col("_shard") * n + (shards - 1)) / shards)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"),
                      F.col("_shard").cast("int").alias("shard"), slot.cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


_CRC = []
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = 0xEDB88320 ^ _c >> 1 if _c & 1 else _c >> 1
    _CRC.append(_c)

#: The same in DuckDB's SQL, without crc32, which it lacks as a function: it is folded over the text's bytes.
ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(strlen(text), 0) + 1 AS size, coalesce(text, '') AS text,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
hexed AS (SELECT *, hex(encode(text)) AS x FROM base),
crcs AS (
  SELECT doc_id, source, size, h,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, {_CRC}[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM hexed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n,
    ('0x' || substr(md5('{SEED}:source:' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM crcs),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + u) / n, h, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (pos * 8) // total AS shard FROM placed)
SELECT doc_id, source, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (pos - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""
