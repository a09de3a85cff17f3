"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +-1; the vector of a letter n-gram binds (multiplies) its letters'
vectors, permuted (rotated) by their place; a text's vector bundles (adds) its n-grams' vectors, and a
language's prototype bundles its texts' vectors, each of length 1. The nearest prototype by cosine wins.

A text may also be in none of the languages: its cosine is then below the floor for its size. Texts are binned by the
power of two of their distinct n-grams; a bin's floor is half the cosine that 99 % of its training texts reach.
Bins with few training texts take the floor of the next smaller bin that has one, or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import Scratch, bounded, columns, map_texts, ship

DIM, N = 1024, 3
#: A model is fitted on about so many rows of each language at most, those with the smallest hashes: all rows of a rarer one.
TRAIN_ROWS = 5_000
#: Training texts that a bin of sizes needs for a floor, and bins.
FLOOR_ROWS, BINS = 100, 24
_TABLE = 40_000  # n-gram vectors kept in a worker
_BATCH = 64


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return out


class Space:
    """The vectors of letters and n-grams, made when first met; the same in every process."""

    def __init__(self, seed: int = 11):
        self.seed, self.is_letter = seed, _letters()
        self.of_letter: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIM), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.of_letter:
            self.of_letter[cp] = np.where(np.random.default_rng([self.seed, cp]).integers(0, 2, DIM) == 1, 1, -1).astype(np.int8)
        return self.of_letter[cp]

    def ngrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the lower-cased letters, where other characters make one space, and their counts."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        ok = self.is_letter[np.minimum(cps, 0x10FFFF)]
        if not ok.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        cps = np.where(ok, cps, 32)
        cps = np.concatenate([[32], cps, [32]]).astype(np.uint64)
        cps = cps[np.concatenate([[True], (cps[1:] != 32) | (cps[:-1] != 32)])]
        ids = cps[:-2] << np.uint64(42) | cps[1:-1] << np.uint64(21) | cps[2:]
        return np.unique(ids, return_counts=True)

    def matrix(self, ids: np.ndarray) -> np.ndarray:
        """The vectors of these n-grams."""
        if len(self.rows) + len(ids) > _TABLE:
            self.reset()
        at = np.empty(len(ids), np.int64)
        for i, g in enumerate(ids.tolist()):
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                v = np.ones(DIM, np.int8)
                for place in range(N):
                    v *= np.roll(self.letter(g >> 21 * (N - 1 - place) & 0x1FFFFF), N - 1 - place)
                self.table[row] = v
            at[i] = row
        return self.table[at].astype(np.float32)

    def vectors(self, texts: list[str | None], sizes: np.ndarray | None = None) -> np.ndarray:
        """Each text's bundle, of length 1; zeros without letters. Long texts count whole. sizes: gets the bins of the texts' numbers of distinct n-grams."""
        out = np.zeros((len(texts), DIM), np.float32)
        for lo in range(0, len(texts), _BATCH):
            grams = [self.ngrams(t) if t else (np.empty(0, np.uint64), np.empty(0, np.int64)) for t in texts[lo : lo + _BATCH]]
            if sizes is not None:
                sizes[lo : lo + len(grams)] = [min(len(g).bit_length(), BINS - 1) for g, _ in grams]
            ids = np.unique(np.concatenate([g[0] for g in grams]))
            for a in range(0, len(ids), _TABLE // 4):  # in blocks, so memory stays bounded
                part = ids[a : a + _TABLE // 4]
                m = self.matrix(part)
                counts = np.zeros((len(grams), len(part)), np.float32)
                for i, (g, n) in enumerate(grams):
                    x, y = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], "right")
                    counts[i, np.searchsorted(part, g[x:y])] = n[x:y]
                out[lo : lo + len(grams)] += counts @ m
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


_space: list[Space] = []


def space() -> Space:
    if not _space:
        _space.append(Space())
    return _space[0]


@dataclass
class Model:
    """Languages by name, their prototypes, and the least cosine of a text in one of them, by the bin of its size."""

    langs: list[str] = field(default_factory=list)
    prototypes: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    floors: np.ndarray = field(default_factory=lambda: np.zeros(BINS))


def labelled(docs: DataFrame) -> DataFrame:
    d = columns(docs, "doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    return d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def training(docs: DataFrame, counts: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang) of about `rows` rows of each language, or all if there are fewer. counts: each lang's number n of labelled rows."""
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return labelled(docs).join(bounded(counts), "lang").where(place * F.col("n") < rows).select("text", "lang")


def fit(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> Model:
    """Learn from rows with text, id and non-null lang whose crc32(doc_id) mod 4 is not 2.

    Only one row for each task and language leaves a task, and sums of components are what is shuffled.
    Without such rows there are no languages, and every text is `und`.
    """
    ship(spark)
    scratch = scratch or Scratch(spark, "langid")
    counts = scratch.save(labelled(docs).groupBy("lang").agg(F.count("*").alias("n")))
    sample = scratch.save(training(docs, counts))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            v, langs = space().vectors(b["text"].tolist()), b["lang"].to_numpy()
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + v[langs == lang].sum(0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": list(sums.values())})

    out = sample.mapInPandas(bundle, "lang string, v array<double>")
    out = out.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = out.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    rows = sorted((r["lang"], [x["x"] for x in r["v"]]) for r in rows)
    if not rows:
        return Model()
    m = np.array([v for _, v in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    model = Model([lang for lang, _ in rows], np.round(m / np.where(norm == 0, 1, norm), 6).astype(np.float32))
    held_by = spark.sparkContext.broadcast(model.prototypes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = np.zeros(len(b), np.int64)
            cos = space().vectors(b["text"].tolist(), size) @ held_by.value.T
            yield pd.DataFrame({"size": size, "cos": np.round(cos.max(1), 4).astype(float)})[size > 0]

    found = sample.mapInPandas(measure, "size long, cos double").groupBy("size").agg(F.percentile("cos", 0.01).alias("low"), F.count("*").alias("n"))
    low = {r["size"]: r["low"] / 2 for r in found.where(f"n >= {FLOOR_ROWS}").collect()}
    floor = 0.0
    for i in range(BINS):
        floor = max(0.0, low.get(i, floor))
        model.floors[i] = floor
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default doc_id), lang_pred, score (the cosine cut to 0..1) and `known`, for every row and whole texts.

    A text that is null or has no letter is `und` with score 0. Equal cosines go to the first language by name.
    known: whether the text has a language and its cosine is not below the floor for its size.
    """
    held_by = spark.sparkContext.broadcast(model)

    def make():
        m = held_by.value
        names = np.array([*m.langs, "und"], object)

        def of(texts: list) -> list[list]:
            size = np.zeros(len(texts), np.int64)
            v = space().vectors(texts, size)
            none = ~v.any(1)
            cos = v @ m.prototypes.T if m.langs else np.zeros((len(v), 1), np.float32)
            best = np.where(none | (not m.langs), len(m.langs), cos.argmax(1))
            score = np.where(none, 0.0, np.clip(cos.max(1), 0, 1)).astype(float)
            return [names[best].tolist(), score.tolist(), ((best < len(m.langs)) & (score >= m.floors[size])).tolist()]

        return of

    return map_texts(docs, keep or ["doc_id"], make, StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", BooleanType())]))


def with_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that are in no learned language; all columns stay.

    These are null texts, texts without a letter, and texts whose cosine is below the floor for their size, such as keys,
    random letters or another language. Where no language was learned (no labelled rows), rows with a letter stay.
    """
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("text"))
    model = fit(spark, docs)
    out = predict(spark, packed, model, ["row"])
    return out.where("known" if model.langs else F.col("row.text").rlike(r"\p{L}")).select("row.*")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null doc_id counts as an empty string in held_out, and teaches nothing; repeated rows give repeated results;
    without rows there are none.
    """
    out = predict(spark, docs, fit(spark, docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
