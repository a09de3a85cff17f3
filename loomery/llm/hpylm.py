"""A hierarchical Pitman-Yor language model of word pairs, seated by Gibbs sampling.

The restaurant of a context serves the words that follow it; a context is the word before, known by its
whole 64-bit hash, so restaurants grow with the corpus. All share a parent, in which each of their tables
is a customer; the parent's base measure is the additive estimate B(w) = (c + 0.1) / (N + 0.1 (V + 1)) from
the words' counts. With t tables for c customers of a dish,

    P(w | u) = (c_uw - D t_uw + (THETA + D T_u) P0(w)) / (THETA + c_u)
    P0(w)    = (k_w - D0 t_w + (THETA0 + D0 T) B(w)) / (THETA0 + K),   k_w = sum over u of t_uw,

and the probability of a word is the mean of P over SAMPLES states of the sampler, taken after BURN sweeps.

Texts are dealt into chunks and words into shards, both by hash. A chunk sends each shard its distinct words
and (word, context) pairs with counts, sorted and packed; the shard sums them, samples, and answers
in the same order, without keys. So what is shuffled is distinct pairs, not tokens, and no table of all
words is ever in one place. All contexts of a word are in its shard, but for heavy words: their pairs are dealt
by context, part by part, to as many shards as they fill, so no shard's size follows the commonest word. A context's
totals span shards: they are summed by the shard that owns the context's own word, before the first sweep and after
each, and sent back to the shards that have the context and with the last states to the chunks. Only N, V, the
parent's totals and the counts of at most HEAVY words come to the driver. Which words are heavy is told by a few
chunks; it settles where pairs go and nothing else.

A sweep draws each dish's number of tables from its conditional distribution given all others as they were
after the sweep before, in which seatings with equal numbers of tables are summed (generalised Stirling
numbers); dishes of over EXACT customers are seated anew in runs that double. Dishes of one customer have one
table and aren't sampled. Random numbers are hashes of word, context and sweep, so results don't depend on
the numbers of chunks and shards.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, columns, mix64, parts, ship, word_hashes

D, THETA, D0, THETA0 = 0.75, 1.0, 0.75, 1.0
BURN, SAMPLES, EXACT = 2, 3, 32
CHUNK_BYTES, CHUNKS_A_SHARD = 8_000_000, 2
#: Heavy words at most, and the chunks that tell which they are.
HEAVY, TELLING_CHUNKS = 1024, 4
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 3)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(blob))


def _planes(a: np.ndarray) -> np.ndarray:
    """Rising 64-bit values as planes of their differences' bytes, which pack well."""
    return np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _from_planes(p: np.ndarray) -> np.ndarray:
    return np.cumsum(p.T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them; none is cut."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _steps(a: np.ndarray) -> np.ndarray:
    """Rising places as their differences."""
    return _small(np.diff(a, prepend=0))


def _from_steps(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=np.int64)


def edges(words: np.ndarray, n: int) -> np.ndarray:
    """Where each of n shards begins and ends in sorted words; shards are equal ranges of hashes."""
    shard = ((words >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)
    return np.searchsorted(shard, np.arange(n + 1))


class Heavy:
    """Words whose pairs are dealt by context to several shards: their hashes, rising, and the numbers of parts."""

    def __init__(self, words: np.ndarray | None = None, parts: np.ndarray | None = None):
        self.words = np.empty(0, np.uint64) if words is None else words
        self.parts = np.empty(0, np.uint64) if parts is None else parts

    def index(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in this list, or -1."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def names(self, at: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """What parts go by: a hash of the word and of the part that the context is in."""
        with np.errstate(over="ignore"):
            part = (mix64(contexts) >> np.uint64(40)) * self.parts[at] >> np.uint64(24)
            return mix64(self.words[at] + (part + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


class Chunk:
    """A chunk's tokens, its distinct words (and the start) in order of hash, and its distinct pairs in order of word and context, as places among the words.

    `routes` are the words and the parts of heavy words, in order of hash; `order` has the pairs by route and context.
    """

    def __init__(self, texts: list[str | None], train: np.ndarray, heavy: Heavy | None = None):
        per = [np.append(word_hashes(t), _END) for t in texts]
        self.sizes = np.array([len(h) for h in per], np.int64)
        self.words, word = np.unique(np.concatenate([*per, [_START]]).astype(np.uint64), return_inverse=True)
        del per
        word = word.reshape(-1).astype(np.int64)
        word, before = word[:-1], np.concatenate([word[-1:], word[:-2]])[: len(word) - 1]
        before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, _START)
        pairs, self.pair = np.unique(word * len(self.words) + before, return_inverse=True)
        del word, before
        self.pair = self.pair.reshape(-1)
        self.pair_word, self.pair_context = pairs // len(self.words), pairs % len(self.words)
        taught = np.repeat(train, self.sizes)
        self.count = np.bincount(self.pair[taught], minlength=len(pairs))
        heavy = heavy or Heavy()
        of = heavy.index(self.words)
        on = np.flatnonzero(of[self.pair_word] >= 0)
        names, first, place = np.unique(heavy.names(of[self.pair_word[on]], self.words[self.pair_context[on]]), return_index=True, return_inverse=True)
        routes = np.concatenate([self.words, names])
        by = np.argsort(routes, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.routes, self.own, self.heavy = routes[by], rank[: len(self.words)], np.concatenate([of, of[self.pair_word[on[first]]]])[by]
        self.route = self.own[self.pair_word]
        self.route[on] = rank[len(self.words) + place.reshape(-1)]
        self.order = np.lexsort((self.pair_context, self.route)) if len(on) else np.arange(len(pairs))
        self.route = self.route[self.order]

    def shards(self, n: int) -> list[tuple[int, slice, np.ndarray]]:
        """(shard, its routes, its pairs)."""
        edge = edges(self.routes, n)
        at = np.searchsorted(self.route, edge)
        return [(s, slice(edge[s], edge[s + 1]), self.order[at[s] : at[s + 1]]) for s in np.flatnonzero(np.diff(edge)).tolist()]

    def ask(self, n: int) -> list[tuple[int, bytes]]:
        out, at = [], np.searchsorted(self.route, edges(self.routes, n))
        for s, w, p in self.shards(n):
            many = np.bincount(self.route[at[s] : at[s + 1]] - w.start, minlength=w.stop - w.start)
            contexts, place = np.unique(self.pair_context[p], return_inverse=True)
            heavy = np.flatnonzero(self.heavy[w] >= 0)
            out.append((s, _pack(_planes(self.routes[w]), _small(many), _planes(self.words[contexts]), place.reshape(-1).astype(np.min_scalar_type(len(contexts))), _small(self.count[p]), heavy, self.heavy[w][heavy])))
        return out

    def heaviest(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Words with one pair in 20,000 at least, their pairs, and all pairs."""
        n = np.bincount(self.pair_word, minlength=len(self.words))
        on = np.flatnonzero(n * 20_000 >= len(self.pair_word))
        return self.words[on], n[on], len(self.pair_word)


_stirling: dict[float, np.ndarray] = {}


def log_stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c, t up to EXACT."""
    if d not in _stirling:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0.0
        for c in range(EXACT):
            for t in range(1, c + 2):
                keep = np.log(c - t * d) + s[c, t] if c > t * d and np.isfinite(s[c, t]) else -np.inf
                s[c + 1, t] = np.logaddexp(s[c, t - 1], keep)
        _stirling[d] = s
    return _stirling[d]


def uniform(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 that follow from key and number alone."""
    with np.errstate(over="ignore"):
        x = mix64(keys + mix64((number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    return ((x >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def _gumbel(rng: np.random.Generator | np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return rng.gumbel(size=(len(at), k)) if isinstance(rng, np.random.Generator) else -np.log(-np.log(uniform(rng[at, None], np.arange(k)[None])))


def _binomial(rng: np.random.Generator | np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, p: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Successes in n trials; with keys the trials are counted one by one, numbered from `first`."""
    if isinstance(rng, np.random.Generator):
        return rng.binomial(n, p)
    out, end = np.zeros(len(n), np.int64), np.cumsum(n)
    for lo in range(0, int(end[-1]), block):
        trial = np.arange(lo, min(lo + block, int(end[-1])))
        i = np.repeat(np.arange(len(n)), np.clip(np.minimum(end, lo + block) - np.maximum(end - n, lo), 0, None))
        hit = uniform(rng[at[i]], first[i] + (trial - (end - n)[i])) < p[i]
        out += np.bincount(i[hit], minlength=len(n))
    return out


def draw_tables(c: np.ndarray, t: np.ndarray, rest: np.ndarray, p: np.ndarray, d: float, theta: float, rng: np.random.Generator | np.ndarray) -> np.ndarray:
    """New numbers of tables of dishes with c customers, given `rest` tables of other dishes in the restaurant and the parent's probability p.

    rng: a generator, or a 64-bit key for each dish.
    """
    out, table = np.minimum(c, 1), log_stirling(d)
    for k in range(2, EXACT + 1):
        at = np.flatnonzero(c == k)
        for lo in range(0, len(at), 50_000):
            i = at[lo : lo + 50_000]
            step = np.log(theta + d * (rest[i, None] + np.arange(k))) + np.log(p[i, None])
            logit = table[k, 1 : k + 1] + np.cumsum(step, 1)
            out[i] = 1 + np.argmax(logit + _gumbel(rng, i, k), 1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, seated = c[big].astype(float), np.ones(len(big))
        new, r, q = np.ones(len(big)), rest[big], p[big]
        while (left := n - seated).max() > 0:
            run = np.minimum(left, np.maximum(1, seated // 2))
            a = (theta + d * (r + new)) * q
            new += _binomial(rng, big, seated, run.astype(np.int64), np.clip(a / (a + seated - d * new), 0, 1))
            seated += run
        out[big] = new
    return out


def base_of(known: np.ndarray, total: float, kinds: float) -> np.ndarray:
    return (known + 0.1) / (total + 0.1 * (kinds + 1))


def draw_words(k, tw, base, parent, word_keys, number: int) -> np.ndarray:
    """New tables of words with k customers in the parent, whose tables were tw."""
    return draw_tables(k, tw, np.maximum(0, parent[1] - tw).astype(float), base, D0, THETA0, word_keys ^ _turn(number))


def _turn(number: int) -> np.ndarray:
    return mix64(np.array([number + 1], np.uint64))


def sweep(word, context, count, t, served, known, ones, k, tw, total, kinds, parent, pair_keys, word_keys, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New tables of pairs, customers and tables of words in the parent.

    word, context: of pairs of over one customer, as places; `ones` are the words' pairs of one customer. known: the
    words' counts; k, tw: their customers and tables in the parent as they are. served, parent: each context's tables and the parent's customers and tables, in the whole corpus, as
    they are before the sweep; total and kinds are N and V.
    """
    base = base_of(known, total, kinds)
    p0 = (k - D0 * tw + (THETA0 + D0 * parent[1]) * base) / (THETA0 + parent[0])
    t = draw_tables(count, t, served[context] - t, p0[word], D, THETA, pair_keys ^ _turn(number))
    k = (ones + np.bincount(word, t, len(known))).astype(np.int64)
    return t, k, draw_words(k, tw, base, parent, word_keys, number)


def _pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(words + mix64(contexts))


def sample(word: np.ndarray, context: np.ndarray, count: np.ndarray, known: np.ndarray, total: float, kinds: float, *seed: int):
    """A whole corpus in one place: states after burning in, a list of (tables of pairs, tables of words). `known` are the words' counts, total and kinds are N and V."""
    t, tw = (count > 0).astype(np.int64), (known > 0).astype(np.int64)
    two = np.flatnonzero(count > 1)
    ones = np.bincount(word, count == 1, len(known))
    keys = mix64(np.random.default_rng(seed).integers(0, 2**63, 2).astype(np.uint64))
    pair_keys, word_keys = _pair_keys(word[two].astype(np.uint64) + keys[0], context[two].astype(np.uint64)), mix64(np.arange(len(known), dtype=np.uint64) + keys[1])
    states = []
    for number in range(BURN + SAMPLES):
        t[two], _, tw = sweep(word[two], context[two], count[two], t[two], np.bincount(context, t), known, ones, np.bincount(word, t, len(known)), tw, total, kinds, (t.sum(), tw.sum()), pair_keys, word_keys, number)
        if number >= BURN:
            states.append((t.copy(), tw.copy()))
    return states


def predict(count, tables, word, k, tw, base, customers, served, parent):
    """The probability of each pair under one state. count, tables: of pairs; word: each pair's place among the words.

    k, tw, base: of words, their customers and tables in the parent and base measure. customers, served: of each
    pair's context, customers and tables in all. parent: the parent's customers and tables in all.
    """
    p0 = (k - D0 * tw + (THETA0 + D0 * parent[1]) * base) / (THETA0 + parent[0])
    return (count - D * tables + (THETA + D * served) * p0[word]) / (THETA + customers)


def _merge(blobs: list[bytes]) -> tuple:
    """Per chunk (routes, pairs) as places in the shard's sorted distinct routes and pairs; then those pairs' routes, contexts and counts, the routes, the contexts and the routes' places among heavy words (or -1)."""
    got = [_unpack(b) for b in blobs]
    lists, befores = [_from_planes(g[0]) for g in got], [_from_planes(g[2]) for g in got]
    words, contexts = np.unique(np.concatenate(lists)), np.unique(np.concatenate(befores))
    at = [np.searchsorted(words, w) for w in lists]
    heavy = np.full(len(words), -1, np.int64)
    for a, g in zip(at, got, strict=True):
        heavy[a[g[5]]] = g[6]
    keys = [np.repeat(a, g[1]) * len(contexts) + np.searchsorted(contexts, b)[g[3]] for a, b, g in zip(at, befores, got, strict=True)]
    counts = [g[4] for g in got]
    del got, lists, befores
    pairs = np.unique(np.concatenate(keys))
    count = np.zeros(len(pairs), np.int64)
    where = []
    for i, n in enumerate(counts):
        where.append(np.searchsorted(pairs, keys[i]).astype(np.uint32))
        keys[i] = None
        count[where[i]] += n
    many = max(1, len(contexts))
    return list(zip(at, where, strict=True)), pairs // many, pairs % many, count, words, contexts, heavy


#: Rows between shards: what a shard samples, what its chunks asked for, what it tells owners, a state, what an owner holds, what it replies, a state's totals of its contexts, sums of a heavy word (its place in the list stands for the chunk).
_CORE, _PLACES, _TELL, _STATE, _OWN, _REPLY, _TOTAL, _HEAVY = range(8)
_ROW = "kind int, shard int, chunk int, blob binary, a long, b long, c long"


def _rows(rows: list[tuple]) -> pd.DataFrame:
    """Rows of kind, shard that gets it, where it is from or for (a chunk, a shard or a sweep), blob and up to three sums."""
    return pd.DataFrame([(*r, *[0] * (7 - len(r))) for r in rows], columns=["kind", "shard", "chunk", "blob", "a", "b", "c"])


def _of(pdf: pd.DataFrame, kind: int) -> list[tuple[int, tuple[np.ndarray, ...]]]:
    x = pdf[pdf["kind"] == kind].sort_values("chunk")
    return [(int(c), _unpack(b)) for c, b in zip(x["chunk"], x["blob"], strict=True)]


def seat(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """A shard's first state: one table for each pair and word that occur. Sums: N, V without heavy words, and pairs."""
    shard, pdf = int(pdf["shard"].iloc[0]), pdf.sort_values("chunk")
    places, word, context, count, words, contexts, heavy = _merge(pdf["blob"].tolist())
    chunks = pdf["chunk"].tolist()
    del pdf
    known = np.bincount(word, count, len(words)).astype(np.int64)
    ones, multi = np.bincount(word, count == 1, len(words)).astype(np.int64), count > 1
    pairs = np.bincount(word, count > 0, len(words)).astype(np.int64)
    place = np.cumsum(multi) - 1
    customers, single, several = (np.bincount(context, x, len(contexts)).astype(np.int64) for x in (count, count == 1, multi))
    at = np.cumsum(several > 0) - 1
    is_heavy = np.flatnonzero(heavy >= 0)
    core = (_planes(words), _small(known), _small(ones), _planes(contexts[several > 0]), _steps(word[multi]), _small(at[context[multi]]), _small(count[multi]), is_heavy, heavy[is_heavy])
    rows = [(_CORE, shard, 0, _pack(*core), int(known.sum()), int(((known > 0) & (heavy < 0)).sum()), int(pairs.sum()))]
    rows += [(_HEAVY, shard, int(heavy[i]), None, int(known[i]), int(pairs[i])) for i in is_heavy]
    rows.append((_STATE, shard, -1, _pack(np.ones(int(multi.sum()), np.uint8), (known > 0).astype(np.uint8), np.zeros(0, np.uint8))))
    for i, chunk in enumerate(chunks):
        w, p = places[i]
        places[i] = None
        rows.append((_PLACES, shard, int(chunk), _pack(_steps(w), _small(count[p]), _steps(place[p[multi[p]]]))))
    edge = edges(contexts, shards)
    for o in np.flatnonzero(np.diff(edge)):
        x = slice(edge[o], edge[o + 1])
        rows.append((_TELL, int(o), shard, _pack(_planes(contexts[x]), _small(customers[x]), _small(single[x]), _small(several[x]))))
    return _rows(rows)


def _replies(served: np.ndarray, sources: list[tuple[int, np.ndarray]], owner: int) -> list[tuple]:
    return [(_REPLY, s, owner, _pack(_small(served[at]))) for s, at in sources if len(at)]


def own(pdf: pd.DataFrame) -> pd.DataFrame:
    """What an owner of contexts holds: their hashes, customers and pairs of one customer, and where each shard's contexts stand; and the first totals."""
    owner, got = int(pdf["shard"].iloc[0]), _of(pdf, _TELL)
    lists = [_from_planes(g[0]) for _, g in got]
    contexts = np.unique(np.concatenate(lists))
    customers, single, several = (np.zeros(len(contexts), np.int64) for _ in range(3))
    sources = []
    for w, (s, g) in zip(lists, got, strict=True):
        at = np.searchsorted(contexts, w)
        for total, x in zip((customers, single, several), g[1:], strict=True):
            total[at] += x
        sources.append((s, at[g[3] > 0]))
    held = _pack(_planes(contexts), customers, single, np.array([s for s, _ in sources]), *[_steps(at) for _, at in sources])
    return _rows([(_OWN, owner, 0, held), *_replies(single + several, sources, owner)])


def add(pdf: pd.DataFrame, told: pd.DataFrame, number: int) -> pd.DataFrame:
    """An owner's totals after a sweep, for the shards and with written states for the chunks."""
    if not len(pdf):
        return _rows([])
    owner, held = int(pdf["shard"].iloc[0]), _of(pdf, _OWN)[0][1]
    sources = [(int(s), _from_steps(x)) for s, x in zip(held[3], held[4:], strict=True)]
    at, served = dict(sources), held[2].copy()
    for s, (x,) in _of(told, _TELL):
        served[at[s]] += x
    return _rows([*([(_TOTAL, owner, number, _pack(_small(served)))] if number >= BURN else []), *_replies(served, sources, owner)])


class HeavyState:
    """Of the heavy words: hashes, counts, and customers and tables in the parent."""

    def __init__(self, words: np.ndarray, known: np.ndarray, k: np.ndarray, tw: np.ndarray):
        self.words, self.known, self.k, self.tw = words, known, k, tw


def move(pdf: pd.DataFrame, told: pd.DataFrame, shards: int, n: int, v: int, parent: tuple[int, int], heavy: HeavyState, number: int) -> pd.DataFrame:
    """A shard's next state, with the parent's customers and tables as sums, and what it tells the contexts' owners."""
    if not len(pdf):
        return _rows([])
    shard, core, state = int(pdf["shard"].iloc[0]), _of(pdf, _CORE)[0][1], _of(pdf, _STATE)[0][1]
    words, contexts = _from_planes(core[0]), _from_planes(core[3])
    known, ones, word, context, count = core[1].astype(np.int64), core[2].astype(np.int64), _from_steps(core[4]), core[5].astype(np.int64), core[6].astype(np.int64)
    served = np.concatenate([np.zeros(0), *[x for _, (x,) in _of(told, _REPLY)]]).astype(np.int64)
    t, tw, at, of = state[0].astype(np.int64), state[1].astype(np.int64), core[7], core[8]
    k = ones + np.bincount(word, t, len(known)).astype(np.int64)
    known[at], k[at], tw[at] = heavy.known[of], heavy.k[of], heavy.tw[of]
    names = words.copy()
    names[at] = heavy.words[of]
    t, k, tw = sweep(word, context, count, t, served, known, ones, k, tw, float(n), float(v), parent, _pair_keys(names[word], contexts[context]), mix64(words), number)
    tw[at] = 0  # heavy words' tables are drawn from the sums over their parts
    rows = [(_STATE, shard, number, _pack(_small(t), _small(tw), _small(k)), int(k.sum()), int(tw.sum()))]
    rows += [(_HEAVY, shard, int(o), None, int(k[i])) for i, o in zip(at, of, strict=True)]
    tables, edge = np.bincount(context, t, len(contexts)).astype(np.int64), edges(contexts, shards)
    rows += [(_TELL, int(o), shard, _pack(_small(tables[edge[o] : edge[o + 1]]))) for o in np.flatnonzero(np.diff(edge))]
    return _rows(rows)


def answer(pdf: pd.DataFrame, heavy: list[HeavyState]) -> pd.DataFrame:
    """To each chunk, in the order of its routes and pairs there: counts, tables and totals of the words as contexts, under each state."""
    shard, core = int(pdf["shard"].iloc[0]), _of(pdf, _CORE)[0][1]
    held = next((x for _, x in _of(pdf, _OWN)), None)
    words, states, totals = _from_planes(core[0]), [x for _, x in _of(pdf, _STATE)], [x for _, (x,) in _of(pdf, _TOTAL)]
    contexts, customers = (_from_planes(held[0]), held[1]) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
    at = np.searchsorted(words, contexts)
    as_context = np.zeros((1 + SAMPLES, len(words)), np.int64)
    for row, x in zip(as_context, [customers, *totals]):
        row[at] = x
    known, ks, tws = core[1].astype(np.int64), [k.astype(np.int64) for _, _, k in states], [tw.astype(np.int64) for _, tw, _ in states]
    for k, tw, h in zip(ks, tws, heavy, strict=True):
        known[core[7]], k[core[7]], tw[core[7]] = h.known[core[8]], h.k[core[8]], h.tw[core[8]]
    asked = pdf[pdf["kind"] == _PLACES].sort_values("chunk")
    rows = []
    for chunk, blob in zip(asked["chunk"].tolist(), asked["blob"].tolist(), strict=True):
        w, count, multi = _unpack(blob)
        w, multi = _from_steps(w), _from_steps(multi)
        rows.append((_PLACES, shard, chunk, _pack(_small(known[w]), count, *[t[multi] for t, _, _ in states], *[_small(k[w]) for k in ks], *[_small(tw[w]) for tw in tws], *[_small(x[w]) for x in as_context])))
    return _rows(rows)


def heavy_words(d: DataFrame, shards: int) -> Heavy:
    """From a few chunks of d (text, held_out, chunk): words that would fill a quarter of a shard or more, HEAVY at most."""
    if shards == 1:
        return Heavy()

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        w, n, total = Chunk(pdf["text"].tolist(), ~pdf["held_out"].to_numpy(bool)).heaviest()
        return pd.DataFrame({"w": np.append(w.view(np.int64), 0), "n": np.append(n, 0), "total": np.append(np.zeros(len(w), np.int64), total)})

    told = d.where(f"chunk < {TELLING_CHUNKS}").groupBy("chunk").applyInPandas(tell, "w long, n long, total long")
    told = told.groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy(F.desc("total"), F.desc("n"), "w").limit(HEAVY + 1).collect()
    total = max(1, sum(r["total"] for r in told))
    found = sorted((r["w"] % 2**64, r["n"] * shards / total) for r in told if 4 * r["n"] * shards >= total and r["n"])
    return Heavy(np.array([w for w, _ in found], np.uint64), np.array([2 + int(2 * x) for _, x in found], np.uint64))


def score(spark: SparkSession, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Each row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32(doc_id) mod 10 is 0 teach nothing; a null doc_id counts as an empty string there. Null and
    empty texts have one token, the end. Repeated rows count each time. Unknown words share one probability.
    """
    ship(spark)
    scratch = scratch or Scratch(spark, "hpylm")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    d = columns(docs, "doc_id", "text").withColumn("held_out", held).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make null ids floats
    size = d.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    chunks = parts(spark, size, chunk_bytes)
    shards = parts(spark, chunks, CHUNKS_A_SHARD)
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    heavy = heavy_words(d.select("text", "held_out", "chunk"), shards)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"].tolist(), ~pdf["held_out"].to_numpy(bool), heavy)
        rows = c.ask(shards)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "shard": [s for s, _ in rows], "blob": [b for _, b in rows]})

    def moving(parent: tuple[int, int], of: HeavyState, number: int):
        return lambda mine, told: move(mine, told, shards, n, v, parent, of, number)

    def sums(rows: DataFrame, *names: str) -> list[np.ndarray]:
        """Of the heavy words, HEAVY at most."""
        out = np.zeros((len(names), len(heavy.words)), np.int64)
        for r in rows.where(f"kind = {_HEAVY}").groupBy("chunk").agg(*[F.sum(x).alias(x) for x in names]).collect():
            out[:, r["chunk"]] = [r[x] for x in names]
        return list(out)

    def adding(number: int):
        return lambda held, told: add(held, told, number)

    asked = d.groupBy("chunk").applyInPandas(ask, "chunk int, shard int, blob binary")
    seated = scratch.save(asked.groupBy("shard").applyInPandas(lambda pdf: seat(pdf, shards), _ROW))
    core, state = scratch.save(seated.where(f"kind = {_CORE}")), scratch.save(seated.where(f"kind = {_STATE}"))
    n, v, customers = (int(x or 0) for x in core.agg(F.sum("a"), F.sum("b"), F.sum("c")).first())
    known, k = sums(seated, "a", "b")
    now = HeavyState(heavy.words, known, k, (known > 0).astype(np.int64))
    v += int(now.tw.sum())
    parent = (customers, v)
    owned = scratch.save(seated.where(f"kind = {_TELL}").groupBy("shard").applyInPandas(own, _ROW))
    owners, replies = owned.where(f"kind = {_OWN}"), owned.where(f"kind = {_REPLY}")
    places, written, parents, heavies, gone = seated.where(f"kind = {_PLACES}"), [], [], [], [state]
    for number in range(BURN + SAMPLES):
        mine = core.unionByName(state).groupBy("shard")
        moved = scratch.save(mine.cogroup(replies.groupBy("shard")).applyInPandas(moving(parent, now, number), _ROW))
        state = moved.where(f"kind = {_STATE}")
        customers, tables = (int(x or 0) for x in state.agg(F.sum("a"), F.sum("b")).first())
        (k,) = sums(moved, "a")
        now = HeavyState(heavy.words, now.known, k, draw_words(k, now.tw, base_of(now.known, n, v), parent, mix64(heavy.words), number))
        parent = (customers, tables + int(now.tw.sum()))
        told = moved.where(f"kind = {_TELL}").groupBy("shard")
        added = scratch.save(owners.groupBy("shard").cogroup(told).applyInPandas(adding(number), _ROW))
        replies = added.where(f"kind = {_REPLY}")
        if number >= BURN:
            written += [state, added.where(f"kind = {_TOTAL}")]
            parents.append(parent)
            heavies.append(now)
        scratch.drop(*gone)
        gone = [moved, added] if number < BURN else []
    parents = np.array(parents, float)
    every = places.unionByName(core).unionByName(owners)
    for x in written:
        every = every.unionByName(x)
    answers = every.groupBy("shard").applyInPandas(lambda pdf: answer(pdf, heavies), _ROW).select("chunk", "shard", "blob")

    def finish(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})
        c = Chunk(pdf["text"].tolist(), ~pdf["held_out"].to_numpy(bool), heavy)
        known, count = np.zeros(len(c.routes)), np.zeros(len(c.pair_word))
        tables, k, tw = np.zeros((SAMPLES, len(count))), np.zeros((SAMPLES, len(known))), np.zeros((SAMPLES, len(known)))
        contexts = np.zeros((1 + SAMPLES, len(known)))
        blobs = dict(zip(back["shard"], back["blob"], strict=True))
        for s, w, p in c.shards(shards):
            got = _unpack(blobs[s])
            known[w], count[p] = got[0], got[1]
            for i in range(SAMPLES):
                part = np.minimum(got[1], 1).astype(float)
                part[got[1] > 1] = got[2 + i]
                tables[i, p], k[i, w], tw[i, w] = part, got[2 + SAMPLES + i], got[2 + 2 * SAMPLES + i]
            for row, x in zip(contexts, got[2 + 3 * SAMPLES :], strict=True):
                row[w] = x
        known, k, tw, contexts = known[c.own], k[:, c.own], tw[:, c.own], contexts[:, c.own]
        base = base_of(known, n, v)
        prob = np.zeros(len(count))
        for i in range(SAMPLES):
            prob += predict(count, tables[i], c.pair_word, k[i], tw[i], base, contexts[0][c.pair_context], contexts[1 + i][c.pair_context], parents[i])
        edge = np.concatenate([[0], np.cumsum(c.sizes)[:-1]])
        over = lambda x: np.add.reduceat(x[c.pair], edge)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "n_tokens": c.sizes, "n_known": over((known > 0).astype(np.int64)[c.pair_word]),
            "train_tokens": n, "base_score": over(np.log10(base)[c.pair_word]), "score": over(np.log10(prob / SAMPLES)),
        })

    out = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, out).withColumn("doc_id", F.col("doc_id").cast(kind))
