"""Toxicity from a learned lexicon: Levenshtein automata walk the lexicon's trie, so misspelled terms are found too.

A hit counts by its term's weight, less by each edit, less inside quotation marks or after a reporting
mark, and more with further hits in its window. A text's points are the sum of its windows' scores; the
share of toxic texts among training texts with as many points, made monotone, is its score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch, blocks, columns, map_texts, mix64, ship
from .neardup import shingle_set

#: Labelled rows that a model is fitted on at most, those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Keys of a training text by which near copies are told, and least hashes in each.
BANDS, BAND_ROWS = 8, 4
WINDOW = 8
#: A text without hits scores no more than this, however few texts there were to learn from.
NO_HITS_MOST = 0.25
_TOKEN = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»]")
#: What comes before reported words, in English, German, French and Spanish.
_REPORT = re.compile(
    r"\b(?:quote[sd]?|said|says|wrote|writes|the words?|called|the term|sagte|sagt|schrieb|schreibt|nannte|zitiert|das wort"
    r"|dit|disait|écrit|écrivait|appelé|le mot|cite|dijo|dice|escribió|escribe|llamó|la palabra|cita)\W*$"
)
EDGES = [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0]


_MULTIPLIERS = np.random.default_rng(20240717).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


def edits_for(length: int) -> int:
    """Terms of 3 or 4 letters are found as they are only: one edit leads from them to too many clean words."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Trie:
    """A lexicon's trie; `find` walks it together with the Levenshtein automata of many words at once."""

    def __init__(self, terms: dict[str, float]):
        self.terms = list(terms)
        self.weights = [terms[t] for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for i, t in enumerate(self.terms):
            node = 0
            for ch in t:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.final.append(-1)
                    self.children[node][ch] = nxt
                node = nxt
            self.final[node] = i
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.limits = np.array([edits_for(len(t)) for t in self.terms], np.int64)
        self.letters = np.array([self.mask(t) for t in self.terms], np.uint64)
        self.longest = max((len(t) for t in self.terms), default=0) + 2
        self.most = [0] * len(self.children)  # edits that any term below a node allows
        for i, t in enumerate(self.terms):
            node = 0
            for ch in ["", *t]:
                node = self.children[node][ch] if ch else 0
                self.most[node] = max(self.most[node], int(self.limits[i]))

    @staticmethod
    def mask(word: str) -> int:
        out = 0
        for ch in word:
            out |= 1 << (ord(ch) * 7 & 63)
        return out

    def may_match(self, words: list[str]) -> np.ndarray:
        """Whether any term is near enough by length and letters: a bound, so no match is lost."""
        if not self.terms or not words:
            return np.zeros(len(words), bool)
        m = np.array([self.mask(w) for w in words], np.uint64)
        n = np.array([len(w) for w in words], np.int64)
        out = np.zeros(len(words), bool)
        for lo in range(0, len(words), 4096):
            near = np.abs(n[lo : lo + 4096, None] - self.lengths) <= self.limits
            near &= np.bitwise_count(m[lo : lo + 4096, None] ^ self.letters) <= 2 * self.limits
            out[lo : lo + 4096] = near.any(1)
        return out

    def find(self, words: list[str]) -> list[tuple[int, int]]:
        """For each word the nearest term within its allowed edits and the number of edits, the heavier one at a tie; else (-1, 0)."""
        out = []
        for lo in range(0, len(words), 8192):
            out += self._find(words[lo : lo + 8192])
        return out

    def _find(self, words: list[str]) -> list[tuple[int, int]]:
        # The automata's states are bit sets, one for each number of edits: bit i of rows[e] says that the path
        # read so far may match the word's first i letters with e edits. rows[e + 1] has all bits of rows[e].
        one, best, edits, weight = np.uint64(1), np.full(len(words), -1), np.full(len(words), 9), np.zeros(len(words))
        at = np.array([i for i, w in enumerate(words) if len(w) <= min(self.longest, 60)], np.int64)
        if not len(at) or not self.terms:
            return [(-1, 0)] * len(words)
        size = np.array([len(words[i]) for i in at], np.uint64)
        width = int(size.max())
        letters = np.frombuffer("".join([words[i].ljust(width, "\0") for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), width)
        bits = one << np.arange(width, dtype=np.uint64)
        hits = {ch: np.where(letters == ord(ch), bits, np.uint64(0)).sum(1, dtype=np.uint64) for ch in {ch for c in self.children for ch in c}}
        goal, full = one << size, (one << size + one) - one
        rows = [(one << np.minimum(np.uint64(e), size) + one) - one for e in range(self.most[0] + 1)]
        stack = [(0, np.arange(len(at)), rows)]
        while stack:
            node, on, rows = stack.pop()
            i = self.final[node]
            if i >= 0:
                d = np.full(len(on), 9)
                for e in reversed(range(int(self.limits[i]) + 1)):
                    d[rows[e] & goal[on] != 0] = e
                w = at[on]
                better = (d < edits[w]) | (d < 9) & (d == edits[w]) & (self.weights[i] > weight[w])
                w = w[better]
                best[w], edits[w], weight[w] = i, d[better], self.weights[i]
            for ch, nxt in self.children[node].items():
                hit, k = hits[ch][on], self.most[nxt]
                new = [(rows[0] & hit) << one]
                for e in range(1, k + 1):
                    new.append(((rows[e] & hit) << one | rows[e - 1] | rows[e - 1] << one | new[e - 1] << one) & full[on])
                alive = new[k] != 0
                if alive.any():
                    stack.append((nxt, on[alive], [r[alive] for r in new]))
        return [(i, e) if i >= 0 else (-1, 0) for i, e in zip(best.tolist(), edits.tolist(), strict=True)]


@dataclass
class Model:
    """terms: weights of the lexicon's words. unseen: of new variants of each. variants: of words that training texts hold, 0 if not abuse. table: score by points."""

    terms: dict[str, float]
    unseen: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)
    table: list[float] = field(default_factory=list)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.terms)
        self.known: dict[str, tuple[int, int, float]] = {}

    def learn_words(self, words: set[str]) -> None:
        if len(self.known) > 1_000_000:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(dict.fromkeys(new, (-1, 0, 0.0)))
        near = [w for w, may in zip(new, self.trie.may_match(new), strict=True) if may]
        for w, (term, edits) in zip(near, self.trie.find(near), strict=True):
            weight = 0.0
            if term >= 0:
                name = self.trie.terms[term]
                weight = self.trie.weights[term] if not edits else self.model.variants.get(w, self.model.unseen.get(name, 0.0) * (1.25 - 0.25 * edits))
            self.known[w] = (term, edits, weight) if weight > 0 else (-1, 0, 0.0)

    def hits(self, text: str, words: set[str] | None = None) -> list[tuple[int, int, int, int, int, float]]:
        """Of each hit: start, end, token number, term, edits, window score. words: the text's, if they are learned already."""
        low = text.lower()
        distinct = set(_TOKEN.findall(low)) if words is None else words
        if words is None:
            self.learn_words(distinct)
        if all(self.known[w][0] < 0 for w in distinct):
            return []
        found = [(i, m.start(), m.end(), *self.known[m.group()]) for i, m in enumerate(_TOKEN.finditer(low)) if self.known[m.group()][0] >= 0]
        out = []
        for i, a, b, term, edits, weight in found:
            line = low.rfind("\n", 0, a) + 1
            quoted = len(_QUOTES.findall(low, line, a)) % 2 == 1 and _QUOTES.search(low, b, b + 400) is not None
            told = _REPORT.search(low[max(line, a - 40) : a]) is not None
            near = sum(1 for x in found if 0 < abs(x[0] - i) <= WINDOW)
            score = weight * (0.3 if quoted or told else 1.0) * (1 + 0.25 * min(near, 4))
            out.append((a, b, i, term, edits, score))
        return out

    def points(self, texts: list[str | None]) -> list[float]:
        """Each text's sum of window scores; all their words go through the automata together."""
        words = [set(_TOKEN.findall(t.lower())) if t else set() for t in texts]
        self.learn_words(set().union(*words))
        return [sum(h[-1] for h in self.hits(t, w)) if w else 0.0 for t, w in zip(texts, words, strict=True)]

    def score(self, points: float) -> float:
        return self.model.table[int(np.searchsorted(EDGES, points, "right")) - 1]


def monotone(good: list[float], bad: list[float]) -> list[float]:
    """Shares bad / (good + bad) made non-decreasing by pooling neighbours."""
    blocks: list[list[float]] = []
    for g, b in zip(good, bad, strict=True):
        blocks.append([g, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * (blocks[-1][0] + blocks[-1][1]) > blocks[-1][1] * (blocks[-2][0] + blocks[-2][1]):
            g2, b2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + b2, blocks[-1][2] + n2]
    return [b / (g + b) for g, b, n in blocks for _ in range(int(n))]


def band_keys(texts: list[str | None]) -> list[list[int]]:
    """BANDS keys of each text, each of BAND_ROWS least shingle hashes; near copies nearly always share one."""
    keys = np.zeros((len(texts), BANDS), np.uint64)
    for i, t in enumerate(texts):
        if len(s := shingle_set(t, 3)):
            with np.errstate(over="ignore"):
                least = np.array([(s * m).min() for m in _MULTIPLIERS], np.uint64).reshape(BANDS, BAND_ROWS)
                for j in range(BAND_ROWS):
                    keys[i] = mix64(keys[i] + least[:, j])
    return keys.view(np.int64).tolist()


def one_of_near_copies(text: DataFrame) -> DataFrame:
    """Rows (text, toxic) of distinct texts without those that share a key with a row of the same label and a lesser hash.

    Texts that share 0.9 of their shingles do so in 99.9 % of cases, 0.8 in 98 %, half in 40 %, a fifth in 1 %. Keys are counted
    by partial aggregates and no group of copies meets in one task.
    """
    name = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i")]
    keys = map_texts(text.select("text", "toxic", F.struct(*name).alias("at")), ["toxic", "at"], lambda: lambda texts: [band_keys(texts)], StructType([StructField("keys", ArrayType(LongType()))]))
    first = keys.select("toxic", "at", F.posexplode("keys").alias("band", "key")).groupBy("toxic", "band", "key").agg(F.min("at").alias("at"))
    alone = first.groupBy("toxic", "at").count().where(F.col("count") == BANDS).select("toxic", F.col("at.h").alias("h"), F.col("at.i").alias("i"))
    return text.select("text", "toxic", *name).join(alone, ["toxic", "h", "i"], "left_semi").select("text", "toxic")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> Model:
    """Learn a model from labelled rows whose crc32(doc_id) mod 4 is not 2, at most TRAIN_ROWS of them.

    Equal texts, and near copies mostly, count once. A word becomes a term if far more toxic texts hold it than its share of all
    texts explains (log-likelihood ratio over 2 ln(words), so chance finds about none). A variant of a term
    that training texts hold is weighed by them itself; how variants not seen yet are to be weighed is told by
    those seen once. Rows without id or label teach nothing; without toxic texts there are no terms. What
    comes to the driver is bounded by the words of TRAIN_ROWS texts.
    """
    ship(spark)
    scratch = scratch or Scratch(spark, "toxicity")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    some = columns(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held)
    some = some.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    text = columns(docs, "doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id")
    text = scratch.save(text.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
    # Of near copies one counts, else their rare words would look like terms.
    text = scratch.save(one_of_near_copies(text.select("text", "toxic")))
    n = {r[0]: r[1] for r in text.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    words = text.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where("length(w) between 3 and 40")
    words = scratch.save(words.groupBy("w").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g")))
    types, model = words.count() if bad else 0, Model({})
    odds_of = lambda b, g: math.log((b + 0.5) / (bad + 1.0)) - math.log((g + 0.5) / (good + 1.0))
    if types:
        rate = bad / (bad + good)
        x = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        total = F.col("b") + F.col("g")
        llr = 2 * (x(F.col("b"), total * rate) + x(F.col("g"), total * max(1 - rate, 1e-9)))
        top = words.where((F.col("b") > total * rate) & (llr >= 2 * math.log(types))).collect()
        top = {r["w"]: odds_of(r["b"], r["g"]) for r in sorted(top, key=lambda r: r["w"])}
        model.terms = {w: min(2.0, o / 3) for w, o in top.items() if o > math.log(4)}
        lexicon = spark.sparkContext.broadcast(model.terms)

        def vary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trie = Trie(lexicon.value)
            for b in batches:
                b = b[trie.may_match(b["w"].tolist())]
                hits = trie.find(b["w"].tolist())
                b = b.assign(term=[trie.terms[i] for i, _ in hits], edits=[e for _, e in hits])
                yield b[[i >= 0 and e > 0 for i, e in hits]]

        once: dict[str, list[int]] = {}
        for r in words.mapInPandas(vary, "w string, b long, g long, term string, edits int").collect():
            o = odds_of(r["b"], r["g"])
            if r["b"] + r["g"] > 1 or r["g"]:
                model.variants[r["w"]] = min(2.0, o / 3) if o > math.log(4) and r["b"] > 1 else 0.0
            if r["b"] + r["g"] == 1:
                n_once = once.setdefault(r["term"], [0, 0])
                n_once[0] += r["b"]
                n_once[1] += r["g"]
        for w in model.terms:
            o = odds_of(*once.get(w, [0, 0]))
            model.unseen[w] = min(model.terms[w], o / 3) if o > math.log(4) else 0.0
    held_by = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(held_by.value)
        for b in batches:
            for lo, hi in blocks(texts := b["text"].tolist()):
                yield pd.DataFrame({"bin": np.searchsorted(EDGES, s.points(texts[lo:hi]), "right") - 1, "toxic": b["toxic"].iloc[lo:hi]})

    good_by, bad_by = [1e-3] * len(EDGES), [1e-3 * (bad + 1) / (bad + good + 2)] * len(EDGES)
    for r in text.select("text", "toxic").mapInPandas(measure, "bin int, toxic int").groupBy("bin", "toxic").count().collect():
        (bad_by if r["toxic"] else good_by)[r["bin"]] += r["count"]
    good_by = [g + 0.5 for g in good_by]
    bad_by = [b + (0.5 if i and sum(bad_by) > 1 else 0.0) for i, b in enumerate(bad_by)]
    model.table = monotone(good_by, bad_by)
    model.table[0] = min(model.table[0], NO_HITS_MOST)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default doc_id) and `score`, for every row and whole texts; null and empty texts have no hits."""
    held_by = spark.sparkContext.broadcast(model)

    def make():
        s = Scorer(held_by.value)
        return lambda texts: [[s.score(p) for p in s.points(texts)]]

    return map_texts(docs, keep or ["doc_id"], make, StructType([StructField("score", DoubleType())]))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without the rows whose score is `least` or more; all columns stay."""
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("text"))
    out = score(spark, packed, fit(spark, docs, labels), ["row"])
    return out.where(F.col("score") < least).select("row.*")


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null doc_id counts as an empty string in held_out, and teaches nothing; repeated rows give repeated results;
    null and empty texts score as texts without a term; without rows there are none. Without labels all scores are low.
    """
    out = score(spark, docs, fit(spark, docs, labels))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
