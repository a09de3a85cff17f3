"""Exact top-k search over 64-bit codes by incremental multi-index hashing, distributed by segment value.

A code is cut into segments. Once all codes that differ from the query by at most r bits in some segment have
been looked at, every code left out differs by at least segments * (r + 1). The radius grows until the k-th
verified distance is below that bound; codes at the k-th distance have then all been seen, so ties are complete.

Rows are dealt by (segment, low bits of its value) to shards, and a query is sent to those shards whose bits
differ from its own by no more than the radius. In a shard the other bits of the segment are probed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, columns, parts, ship

BITS = 64
#: Pairs of a query and a row, or of a query and a probe, that are held at once.
PAIRS = 1 << 20
#: How many rows can be compared in the time of one probe.
PROBE_COST = 16


@cache
def masks(radius: int, bits: int) -> np.ndarray:
    """All values of so many bits with exactly radius ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.uint64)


def widths(rows: int) -> list[int]:
    """Bits of each segment, for segments of about log2(rows) bits: what a probe finds is then about one row."""
    n = min(8, max(2, round(BITS / log2(max(rows, 2)))))
    return [BITS // n + (j < BITS % n) for j in range(n)]


class Shard:
    """Rows that agree in the low bits of one segment, ordered by the rest of it."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, segment: int, prefix: int, prefix_bits: int, wide: list[int]):
        self.segment, self.prefix, self.prefix_bits, self.wide = segment, np.uint64(prefix), np.uint64(prefix_bits), wide
        self.shifts = [np.uint64(sum(wide[:j])) for j in range(len(wide))]
        order = np.lexsort((ids, self.rest(codes)))
        self.ids, self.codes = ids[order], codes[order]
        self.rests = self.rest(self.codes)

    def part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return (codes >> self.shifts[j]) & np.uint64((1 << self.wide[j]) - 1)

    def rest(self, codes: np.ndarray) -> np.ndarray:
        return self.part(codes, self.segment) >> self.prefix_bits

    def pairs(self, rests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and rows whose rests differ by exactly radius bits, by probes or, if fewer, by rows."""
        probes = masks(radius, self.wide[self.segment] - int(self.prefix_bits)) if self.cheap(radius) else None
        if probes is None:
            return np.nonzero(np.bitwise_count(rests[:, None] ^ self.rests[None, :]) == radius)
        wanted = (rests[:, None] ^ probes[None, :]).ravel()
        lo, hi = np.searchsorted(self.rests, wanted, "left"), np.searchsorted(self.rests, wanted, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.repeat(np.arange(len(rests)), len(probes)), n), at

    def probes(self, radius: int) -> int:
        bits, n = self.wide[self.segment] - int(self.prefix_bits), 1
        for i in range(radius):
            n = n * (bits - i) // (i + 1)
        return n

    def cheap(self, radius: int) -> bool:
        return self.probes(radius) * PROBE_COST < len(self.codes)

    def search(self, queries: np.ndarray, bound: np.ndarray, first: int, last: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' places, ids and distances of the best k found here at radii first to last, no farther than bound.

        A row belongs to the first (radius, segment) that finds it, so no pair is found in two shards.
        """
        bound = bound.copy()
        apart = np.bitwise_count((self.part(queries, self.segment) & ((np.uint64(1) << self.prefix_bits) - np.uint64(1))) ^ self.prefix).astype(int)
        rests, n = self.rest(queries), len(self.wide)
        got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        for radius in range(first, last + 1):
            for away in range(min(radius, int(self.prefix_bits)) + 1):
                todo = np.flatnonzero((apart == away) & (bound >= n * radius))
                most = max(1, PAIRS // max(len(self.codes), self.probes(radius - away) if self.cheap(radius - away) else 1))
                for i in range(0, len(todo), most):
                    some = todo[i : i + most]
                    q, r = self.pairs(rests[some], radius - away)
                    q = some[q]
                    x = queries[q] ^ self.codes[r]
                    d = np.bitwise_count(x).astype(np.int64)
                    new = d <= bound[q]
                    for j in range(n):
                        if j != self.segment:
                            new &= np.bitwise_count(self.part(x, j)) >= radius + (j < self.segment)
                    got = self._best(*(np.concatenate(p) for p in zip(got, (q[new], self.ids[r[new]], d[new]), strict=True)), k)
            rank = _ranks(got[0])
            full = rank == k - 1
            bound[got[0][full]] = np.minimum(bound[got[0][full]], got[2][full])
        return got

    @staticmethod
    def _best(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, d, q))
        order = order[_ranks(q[order]) < k]
        return q[order], ids[order], d[order]


def _ranks(q: np.ndarray) -> np.ndarray:
    """Places within runs of equal values."""
    if not len(q):
        return np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    return np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))


def sign_code(vector: str = "embedding", bits: int = BITS):
    """The signs of a vector's components, as a 64-bit code; null or missing components count as not positive.

    A null vector has no code, and one of more components than the code has bits is an error.
    """
    v = F.col(f"`{vector}`")
    code = F.lit(0).cast("long")
    for i in range(bits):
        code = code.bitwiseOR(F.shiftleft(F.coalesce(F.try_element_at(v, F.lit(i + 1)) > 0, F.lit(False)).cast("long"), i))
    too_long = F.raise_error(F.lit(f"a vector has more than {bits} components")).cast("long")
    return F.when(F.size(v) > bits, too_long).when(v.isNotNull(), code)


def top_k(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8_192,
          block_queries: int = 65_536) -> DataFrame:
    """The k nearest rows of each query by Hamming distance, then by id: query_id, rank, vec_id, distance.

    Both tables have (vec_id long, code long). Rows without id or code are left out, and a row isn't its
    own neighbour. A repeated id counts once with its smallest code. Fewer than k rows: all are returned;
    no rows or no queries: none. Other columns are ignored.

    Of equal codes only the k + 1 least ids can be among a result, so no more are searched, and equal
    queries are searched once. A shard of over about block_rows rows or block_queries queries is cut on both
    sides. After each round the distances found so far, in whatever shard, limit what open queries still ask.
    """
    ship(spark)
    scratch = Scratch(spark, "hamming")
    tidy = lambda df: columns(df, "vec_id", "code").where("vec_id is not null and code is not null").groupBy("vec_id").agg(F.min("code").alias("code"))
    first = lambda df, by, *order: df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= k + 1).drop("_rank")
    rows, queries = scratch.save(first(tidy(rows), "code", "vec_id")), scratch.save(tidy(queries))
    n = rows.count()
    wide, want = widths(n), min(k + 1, n)
    low = min(min(wide) - 1, max(0, (parts(spark, n, block_rows) - 1).bit_length()))
    prefix = lambda j: F.shiftrightunsigned("code", sum(wide[:j])).bitwiseAND((1 << low) - 1).cast("int")
    shards = [F.struct(F.lit(j).alias("segment"), prefix(j).alias("prefix")) for j in range(len(wide))]
    dealt = rows.select("vec_id", "code", F.inline(F.array(*shards)))
    sizes = scratch.save(dealt.groupBy("segment", "prefix").agg(F.count("*").alias("n_rows")))
    cut = lambda n, each: F.ceil(F.col(n) / each).cast("int")
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "code"), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["segment", "prefix", "part", "side"]

    def round_of(ask: DataFrame, lo: int, hi: int) -> DataFrame:
        """What open queries find at radii lo to hi: code, vec_id, distance."""
        flips = [int(x) for r in range(min(hi, low) + 1) for x in masks(r, low)]
        near = F.expr(f"cast(split('{','.join(map(str, flips))}', ',') as array<int>)")
        sent = ask.select("code", "bound", F.inline(F.array(*shards))).withColumn("flip", F.explode(near))
        sent = sent.where(F.bit_count("flip") * len(wide) <= F.col("bound")).withColumn("prefix", F.col("prefix").bitwiseXOR(F.col("flip"))).drop("flip")
        plan = scratch.save(sent.groupBy("segment", "prefix").agg(F.count("*").alias("n_queries")).join(sizes, ["segment", "prefix"])
                            .select("segment", "prefix", cut("n_rows", block_rows).alias("parts"), cut("n_queries", block_queries).alias("sides")))
        groups, blocks = plan.agg(F.count("*"), F.sum(F.col("parts") * F.col("sides"))).first()
        plan = bounded(plan, groups)
        tasks = max(spark.sparkContext.defaultParallelism, parts(spark, blocks or 1, 4))
        r = dealt.join(plan, ["segment", "prefix"]).withColumn("part", place("parts", 1)).withColumn("side", copies("sides"))
        q = sent.join(plan, ["segment", "prefix"]).withColumn("side", place("sides", 2)).withColumn("part", copies("parts"))
        r = r.select(*key, "vec_id", "code").repartition(tasks, *key)
        q = q.select(*key, "code", "bound").repartition(tasks, *key)

        def meet(at: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            codes = right["code"].to_numpy()
            if not len(left) or not len(codes):
                return pd.DataFrame({"code": codes[:0], "vec_id": codes[:0], "distance": codes[:0].astype(np.int32)})
            shard = Shard(left["vec_id"].to_numpy(), left["code"].to_numpy().view(np.uint64), int(at[0]), int(at[1]), low, wide)
            which, ids, d = shard.search(codes.view(np.uint64), right["bound"].to_numpy().astype(np.int64), lo, hi, k + 1)
            return pd.DataFrame({"code": codes[which], "vec_id": ids, "distance": d.astype(np.int32)})

        return r.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(meet, "code long, vec_id long, distance int")

    ask = scratch.save(queries.select("code").distinct().withColumn("bound", F.lit(BITS)))
    found, done, lo, hi = None, [], 0, 1
    while n and ask.count():
        fresh = round_of(ask, lo, hi)
        best = scratch.save(first(fresh if found is None else found.union(fresh), "code", "distance", "vec_id"))
        reach = best.groupBy("code").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        open_ = (F.coalesce("n", F.lit(0)) < want) | (F.col("far") >= len(wide) * (hi + 1))
        ask = scratch.save(ask.select("code").join(reach, "code", "left").where(open_)
                           .select("code", F.when(F.col("n") >= want, F.col("far")).otherwise(BITS).alias("bound")))
        done.append(best.join(ask, "code", "left_anti"))
        found = best.join(ask, "code", "left_semi")
        lo, hi = hi + 1, max(wide) if hi >= max(wide) // 2 else 2 * hi + 1
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    lists = whole.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("best"))
    mine = queries.join(lists, "code").select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("at", "row"))
    return mine.select("query_id", (F.col("at") + 1).alias("rank"), "row.vec_id", "row.distance")


_BITS = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
ORACLE_SQL = f"""
WITH codes AS (SELECT vec_id, {_BITS} AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code))::INTEGER AS distance
  FROM codes q JOIN codes r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""
