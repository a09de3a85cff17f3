"""Byte-level BPE over a trie of distinct words.

The encoding of a text's prefix is settled by its last token alone: it is the one token t that ends the
prefix and that may follow the last token of what stands before it. So the distinct words of a batch
go into a trie, and a depth-first walk gives each node its last token from those above it: what words
share at their start is worked out once. A word's tokens are then read from its end.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_texts

_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units (words with what surrounds them) and trie nodes that a worker keeps; beyond that it starts afresh.
KEEP_UNITS, KEEP_NODES = 400_000, 1_000_000


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in own}, 0
    for b in range(256):
        if b not in own:
            out[chr(256 + n)] = b
            n += 1
    return out


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        to_bytes = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}  # of a merge
        self.split: dict[int, tuple[int, int]] = {}  # a token's own last merge
        self.made: dict[int, int] = {}  # its rank
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = to_bytes(a), to_bytes(b)
            left, right, whole = self.ids[x], self.ids[y], self.ids[x + y]
            self.rank[left, right] = n
            if whole not in self.split:
                self.split[whole], self.made[whole] = (left, right), n
        self.follows: dict[int, bool] = {}
        self.size = {t: len(b) for t, b in self.bytes.items()}

    def merge(self, word: bytes) -> list[int]:
        """The plain merge procedure, for small inputs."""
        t = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(t) > 1:
            n, i = min((self.rank.get((t[i], t[i + 1]), 1 << 40), i) for i in range(len(t) - 1))
            if n == 1 << 40:
                break
            t[i : i + 2] = [self.ids[self.bytes[t[i]] + self.bytes[t[i + 1]]]]
        return t

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as just a, b."""
        out = self.follows.get(a << 20 | b)
        if out is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            out = self.follows[a << 20 | b] = self._may_follow(a, b)
        return out

    def _may_follow(self, a: int, b: int) -> bool:
        # Unwind both tokens' merges, the latest first: a pair across the border must not have merged earlier.
        limit = 1 << 40
        while True:
            n = self.rank.get((a, b))
            if n is not None and n < limit:
                return False
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # equal ranks merge from the left: here a's own merge comes first
                limit, a = ra, self.split[a][1]
            else:  # and here the pair across the border would
                limit, b = rb + 1, self.split[b][0]


class Trie:
    """Nodes of distinct words, each with its last token; edges are kept by node * 256 + byte.

    An automaton of the vocabulary (each state is a token's prefix) goes along, so that the tokens which
    end at a node, longest first, are at hand.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._automaton()
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last: list[int] = [-1]
        self.state: list[int] = [0]

    def _automaton(self) -> None:
        go, ends, fail, depth_first = {}, [()], [0], []
        for word, t in self.v.ids.items():
            at = 0
            for byte in word:
                nxt = go.get(at << 8 | byte)
                if nxt is None:
                    nxt = go[at << 8 | byte] = len(ends)
                    ends.append(())
                    fail.append(0)
                    depth_first.append((at, byte, nxt))
                at = nxt
            ends[at] = ((t, len(word)),)
        depth = [0] * len(ends)
        for at, _, nxt in depth_first:
            depth[nxt] = depth[at] + 1
        for at, byte, nxt in sorted(depth_first, key=lambda x: depth[x[2]]):
            f = fail[at]
            while at and f and f << 8 | byte not in go:
                f = fail[f]
            fail[nxt] = go.get(f << 8 | byte, 0) if at else 0
            ends[nxt] += ends[fail[nxt]]
        self.go, self.ends, self.fail = go, ends, fail

    def step(self, at: int, byte: int) -> int:
        key = at << 8 | byte
        out = self.go.get(key)
        if out is None:
            out = self.step(self.fail[at], byte) if at else 0
            if len(self.go) < 3_000_000:
                self.go[key] = out
        return out

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """All words' tokens. Words in sorted order are a depth-first walk of their trie."""
        if len(self.last) > KEEP_NODES:
            self.reset()
        nxt, last, state, v, ends, step = self.next, self.last, self.state, self.v, self.ends, self.step
        follows, may, size, out = v.follows, v.may_follow, v.size, {}
        path, before = [0], b""
        for word in sorted(words):
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del path[same + 1 :]
            at = path[-1]
            for i in range(same, len(word)):
                key = at << 8 | word[i]
                node = nxt.get(key)
                if node is None:
                    node = nxt[key] = len(last)
                    s = step(state[at], word[i])
                    state.append(s)
                    for t, n in ends[s]:
                        if n > i:  # the whole prefix is this token
                            break
                        a = last[path[i + 1 - n]]
                        ok = follows.get(a << 20 | t)
                        if may(a, t) if ok is None else ok:
                            break
                    last.append(t)
                path.append(node)
                at = node
            tokens, i = [], len(word)
            while i:
                t = last[path[i]]
                tokens.append(t)
                i -= size[t]
            tokens.reverse()
            out[word] = tokens
            before = word
        return out


_GAP, _CUT = re.compile(r" (?=\s|$)"), re.compile(r" (?=\S)")
_MARKS = frozenset(".,;:!?")


class Encoder:
    """Texts to tokens, with what each unit gave kept for the next texts.

    Texts are cut at each space before something other than white space, where words always meet too. A
    unit is kept without that space, in a table of its own; the text before the first cut is in the other.
    """

    def __init__(self, path: str, value):
        """value(tokens): what to keep of a unit."""
        self.v, self.value = Vocabulary(path), value
        self.words = Trie(self.v).encode
        self.first: dict[str, object] = {}
        self.spaced: dict[str, object] = {}
        special = sorted(self.v.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @staticmethod
    def cut(text: str) -> list[str]:
        """The units: the first as it is, the others without the space before them."""
        return text.split(" ") if _GAP.search(text) is None else _CUT.split(text)

    @staticmethod
    def words_of(unit: str, lead: str) -> list[str]:
        if unit.isalpha():
            return [lead + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [lead + unit[:-1], unit[-1]]
        return _PATTERN.findall(lead + unit)

    def prepare(self, texts: list[str]) -> list[list]:
        """For each text its units' values."""
        if len(self.first) + len(self.spaced) > KEEP_UNITS:
            self.first.clear()
            self.spaced.clear()
        special, cuts = self.v.special, []
        for t in texts:
            if special and "<|" in t and any(s in t for s in special):
                cuts.append([p if p in special else self.cut(p) for p in self.specials.split(t) if p])
            else:
                cuts.append([self.cut(t)] if t else [])
        runs = [r for c in cuts for r in c if isinstance(r, list)]
        new = [("", u) for u in {r[0] for r in runs} if u not in self.first]
        new += [(" ", u) for u in set().union(*(r[1:] for r in runs)) if u not in self.spaced]
        words = [[w.encode("utf-8", "surrogatepass") for w in self.words_of(u, lead)] for lead, u in new]
        made, value = self.words(list({w for ws in words for w in ws})), self.value
        for (lead, u), ws in zip(new, words, strict=True):
            (self.spaced if lead else self.first)[u] = value(made[ws[0]] if len(ws) == 1 else [t for w in ws for t in made[w]])
        first, spaced, out = self.first, self.spaced, []
        for c in cuts:
            got = []
            for r in c:
                if isinstance(r, str):
                    got.append(value([special[r]]))
                    continue
                got.append(first[r[0]])
                got += [spaced[u] for u in islice(r, 1, None)]
            out.append(got)
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, use: str, value) -> Encoder:
    """This worker's encoder for a use, which fixes value."""
    if (path, use) not in _encoders:
        _encoders[path, use] = Encoder(path, value)
    return _encoders[path, use]


class WholeTexts:
    """Whole texts' ids as arrays, from a library's compiled merge routine given the vocabulary's ids as ranks.

    The library's pattern matcher gives up on runs of some million spaces; such texts go through the trie.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, v = path, Vocabulary(path)
        self.library = tiktoken.Encoding("own", pat_str=_PATTERN.pattern, mergeable_ranks=v.ids, special_tokens=v.special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return self.library.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            units = encoder(self.path, "ids", tuple).prepare([text])[0]
            return np.fromiter((t for u in units for t in u), np.uint32)


_whole: dict[str, WholeTexts] = {}


def whole_texts(path: str) -> WholeTexts:
    """This worker's own, made once."""
    if path not in _whole:
        _whole[path] = WholeTexts(path)
    return _whole[path]


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id and `ids` array<int> of every whole text; null and empty texts have no ids, null doc_ids stay null."""

    def make():
        e = encoder(path, "ids", tuple)
        return lambda texts: [[[t for u in us for t in u] for us in e.prepare([t or "" for t in texts])]]

    return map_texts(docs, ["doc_id"], make, StructType([StructField("ids", ArrayType(IntegerType()))]))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    return b"".join(vocabulary.bytes[i] for i in ids).decode("utf-8", "replace")


def report(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every row, in one pass.

    Repeated rows give repeated results. A unit's tokens are decoded once; whole characters end where units do.
    """

    def make():
        e = encoder(path, "digest", lambda ts: ts)
        e.value = lambda ts, v=e.v: (",".join(map(str, ts)), b"".join([v.bytes[t] for t in ts]).decode("utf-8", "replace"))

        def of(texts: list) -> list[list]:
            n, said_by, back_by = [], [], []
            for us in e.prepare([t or "" for t in texts]):
                said = ",".join([u[0] for u in us if u[0]])
                n.append(said.count(",") + 1 if said else 0)
                said_by.append(hashlib.sha256(said.encode()).hexdigest())
                back_by.append(hashlib.sha256("".join([u[1] for u in us]).encode("utf-8", "surrogatepass")).hexdigest())
            return [n, said_by, back_by]

        return of

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return map_texts(docs, ["doc_id"], make, StructType(fields))
