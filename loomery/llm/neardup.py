"""Near-duplicate groups: circulant MinHash finds candidates, exact Jaccard similarity confirms links.

All coordinates of a signature come from two permutations of the 32-bit shingle hashes: sigma once, and
pi shifted circularly, coordinate j being the least pi((sigma(x) + j) mod 2^32). Bands of ROWS coordinates
make buckets. With 32 bands of 4, a pair at similarity 0.85 is missed with probability 6e-11, at 0.8 with 5e-8.

Texts with equal shingle sets are one vertex, so copies cost nothing. In a bucket of up to SMALL vertices all
pairs are candidates. The vertices of larger buckets are compared by an exact filter instead: two sets that
are similar enough share one of their rarest shingles (a prefix in the order of rising frequency), at
places that leave room for the overlap needed. There, each vertex is first compared with one leader for
each shingle, the one with the fewest rarer shingles; then only what still lies in different components is
compared. No candidate is dropped or capped. Near copies of each other are joined by their leaders, so their pairs
aren't all made; pairs that share a rare shingle and yet lie in different components are, for each such shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import Scratch, bounded, columns, map_texts, mix64, word_hashes

BANDS, ROWS, SMALL = 32, 4, 16


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all words, if there are fewer."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    k = min(words, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[i : n - k + 1 + i])
    return np.unique(out)


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit values."""
    x = x * np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(13)
    x *= np.uint32(a)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of a non-empty set."""
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    sigma = _mix32((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(sigma), 2048):
            out = np.minimum(out, _mix32(sigma[None, lo : lo + 2048] + shifts, 0x9E3779B1, 0x85EBCA77).min(1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for row in sig.reshape(BANDS, ROWS).T:
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + row.astype(np.uint64))
    return out.view(np.int64)


def vertex(shingles: np.ndarray) -> int:
    """64 bits of the set's MD5."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "big", signed=True)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, c) for the vertices of edges (a, b): c is the least vertex reachable.

    Labels are hooked onto the least neighbouring label, at the vertex and at its label, and shortened by
    jumping, until nothing changes; each round is written, so lineage stays short. Of its tables the last one stays.
    """
    began = scratch.n
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("v", "u"))
    labels = scratch.save(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")))
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("m")), "u").groupBy("v").agg(F.min("m").alias("m"))
        hooked = labels.join(seen, "v")
        hooked = hooked.select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")).union(
            hooked.where("m < c").select(F.col("c").alias("v"), F.col("m").alias("c"), F.lit(None).cast("long").alias("old")))
        hooked = hooked.groupBy("v").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        top = hooked.select(F.col("v").alias("c"), F.col("c").alias("top"))
        nxt = scratch.save(hooked.join(top, "c", "left").select("v", F.coalesce("top", "c").alias("c"), "old"))
        changed = nxt.where("c <> old").limit(1).count()
        scratch.drop(labels)
        labels = nxt
        if not changed:
            scratch.drop_from(began, labels)
            return labels.select("v", "c")


@dataclass
class NearDup:
    """words: of a shingle. percent: the least similarity, as 100 * intersection >= percent * union."""

    spark: SparkSession
    words: int = 5
    percent: int = 80

    def sketch(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text and others) without text, and n (set size), v (vertex; null for the empty set) and the set's bands."""
        words = self.words

        def of(texts: list) -> list[list]:
            sets = [shingle_set(t, words) for t in texts]
            return [[len(s) for s in sets], [vertex(s) if len(s) else None for s in sets], [bands(signature(s)) if len(s) else None for s in sets]]

        fields = [StructField("n", LongType()), StructField("v", LongType()), StructField("bands", ArrayType(LongType()))]
        return map_texts(docs, [c for c in docs.columns if c != "text"], lambda: of, StructType(fields))

    def sets(self, docs: DataFrame, wanted: DataFrame, count: int) -> DataFrame:
        """(v, s) of the wanted vertices (v, rep, h): their sets again, from texts of hash h in the documents rep (which may be null)."""
        words = self.words

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                s = [shingle_set(t, words) for t in b["text"]]
                ok = [len(x) > 0 and vertex(x) == v for x, v in zip(s, b["v"], strict=True)]
                yield pd.DataFrame({"v": b["v"][ok], "s": [x.tobytes() for x, y in zip(s, ok, strict=True) if y]})

        w = bounded(wanted.select("rep", "h", "v"), count)
        d = columns(docs, "doc_id", "text").where("text is not null")
        d = d.join(w, (F.xxhash64(d["text"]) == w["h"]) & d["doc_id"].eqNullSafe(w["rep"])).select("v", "text")
        return d.mapInPandas(run, "v long, s binary").groupBy("v").agg(F.first("s").alias("s"))

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        percent = self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["x"], b["y"], strict=True)]
                yield b.loc[ok, ["a", "b"]]

        full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return full.mapInPandas(run, "a long, b long")

    def tagged(self, docs: DataFrame, scratch: Scratch, rows: bool = False) -> DataFrame:
        """For each row: doc_id, n, v, rid (a number of its own), lead (the struct that is least in its component) and, if asked for, the row itself.

        lead has no_id, id and rid: the least doc_id and one row that has it, or without ids one of the rows. It is null
        for the empty set. Of the tables saved on the way, only the two that the result reads stay.
        """
        spark, percent, began = self.spark, self.percent, scratch.n
        whole_row = [F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")] if rows else []
        keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), *whole_row)
        d = scratch.save(self.sketch(keyed).withColumn("rid", F.monotonically_increasing_id()))
        me = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "rid", "h")
        reps = scratch.save(d.where("v is not null").groupBy("v").agg(F.min(me).alias("lead"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
        keyed = reps.select("v", "n", F.explode("bands").alias("key"))
        full = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        shared = scratch.save(keyed.join(full, "key"))
        small = shared.where(f"size <= {SMALL}")
        other = small.select("key", F.col("v").alias("b"), F.col("n").alias("nb"))
        near = f"v < b and least(n, nb) * 100 >= greatest(n, nb) * {percent}"
        pairs = scratch.save(small.join(other, "key").where(near).select(F.col("v").alias("a"), "b").distinct())
        hot = scratch.save(shared.where(f"size > {SMALL}").select("v").distinct())
        scratch.drop(shared)
        wanted = pairs.select("a").union(pairs.select("b")).union(hot).distinct().toDF("v").join(reps.select("v", F.col("lead.id").alias("rep"), F.col("lead.h").alias("h")), "v")
        wanted = scratch.save(wanted)
        sets = scratch.save(self.sets(docs, wanted, wanted.count()))
        links = scratch.save(self.confirm(pairs, sets))
        scratch.drop(wanted, pairs)
        if hot.count():
            links = self._hot(hot, sets, links, scratch)
        scratch.drop(sets)
        many = reps.where("copies > 1").select("v")
        found = components(spark, links, scratch) if links.count() else links.toDF("v", "c")
        grouped = reps.select("v", "lead").join(found.union(many.select("v", F.col("v").alias("c")).join(found.select("v"), "v", "left_anti")), "v")
        least = grouped.groupBy("c").agg(F.min("lead").alias("lead"))
        to = scratch.save(grouped.select("v", "c").join(least, "c").select("v", "lead"))
        scratch.drop_from(began, d, to)
        alone = F.when(F.col("v").isNotNull(), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "rid", "h"))
        out = d.join(bounded(to), "v", "left").withColumn("lead", F.coalesce("lead", alone))
        return out.select("doc_id", "n", "v", "rid", F.struct("lead.no_id", "lead.id", "lead.rid").alias("lead"), *(["row"] if rows else []))

    def groups(self, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
        """For each row: doc_id, n_shingles, component_id (least doc_id reachable), kept.

        Null and empty texts, and texts without words, have n_shingles 0, are linked with nothing and are kept. Rows
        without id link others and have their component's least id; where no row of a component has one, its
        component_id is null and one of its rows is kept. A repeated doc_id is taken row by row. Other columns of docs
        are left out.
        """
        out = self.tagged(docs, scratch or Scratch(self.spark, "neardup"))
        cid = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("lead.id"))
        kept = F.when(F.col("v").isNull(), True).when(cid.isNull(), F.col("rid") == F.col("lead.rid")).otherwise(F.coalesce(F.col("doc_id") == cid, F.lit(False)))
        return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), kept.alias("kept"))

    def _hot(self, hot: DataFrame, sets: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
        """links, and all links among the vertices of large buckets, up to what lies in one component already."""
        percent, began = self.percent, scratch.n

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for v, s in zip(b["v"], b["s"], strict=True):
                    t = np.frombuffer(s, np.int64)
                    yield pd.DataFrame({"v": v, "n": len(t), "t": t})

        mine = scratch.save(sets.join(hot, "v", "left_semi").mapInPandas(spell, "v long, n long, t long"))
        often = mine.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
        known = mine.join(often, "t")
        place = F.col("n") - F.count("*").over(Window.partitionBy("v")) + F.row_number().over(Window.partitionBy("v").orderBy("f", "t")) - 1
        prefix = known.withColumn("pos", place).where(f"(n - pos) * 100 >= n * {percent}")
        prefix = scratch.save(prefix.select("t", "v", "n", "pos"))
        scratch.drop(mine)
        leads = prefix.groupBy("t").agg(F.min(F.struct("pos", "v", "n")).alias("x"), F.count("*").alias("f")).where("f > 1")
        leads = scratch.save(leads.select("t", F.col("x.v").alias("b"), F.col("x.n").alias("nb"), F.col("x.pos").alias("pb")))
        fits = f"v <> b and least(n - pos, nb - pb) * {100 + percent} >= (n + nb) * {percent}"
        ordered = [F.least("v", "b").alias("a"), F.greatest("v", "b").alias("b")]
        first = scratch.save(prefix.join(leads, "t").where(fits).select(*ordered).distinct())
        links = scratch.save(links.union(self.confirm(first, sets)))
        if not links.count():
            return links
        label = components(self.spark, links, scratch)
        tagged = scratch.save(prefix.join(label, "v", "left").withColumn("c", F.coalesce("c", "v")))
        mixed = tagged.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t")
        mixed = mixed.join(leads.select("t", F.col("b").alias("v")), "t").join(tagged.select("t", "v", "c"), ["t", "v"]).select("t", F.col("c").alias("lead"))
        rest = scratch.save(tagged.join(mixed, "t"))
        theirs = rest.select("t", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
        more = rest.where("c <> lead").join(theirs, "t").where(f"c <> cb and {fits}").select(*ordered).distinct()
        links = scratch.save(links.union(self.confirm(more, sets)))
        scratch.drop_from(began, links)
        return links


def without_copies(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group, one that has the least doc_id (without ids, any); all columns stay.

    Rows are told apart by numbers of their own, so a repeated doc_id does no harm: rows of it with unlike texts are in
    different groups. Rows without words in their text stay.
    """
    out = NearDup(spark, words, percent).tagged(docs, scratch or Scratch(spark, "neardup"), rows=True)
    return out.where("v is null or rid = lead.rid").select("row.*")
