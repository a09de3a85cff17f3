"""BPE against the library, packing against its limits."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomery.llm import bpe, packing
from loomery.llm.queries import queries, vocabulary_path
from tests.conftest import SMALL

from .cases import ROWS, docs

LIB = Tokenizer.from_file(vocabulary_path())
LIB.no_truncation()
LIB.no_padding()


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_trie():
    return bpe.Encoder(vocabulary_path(), tuple)


@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab '.\n\t 1sé漢", max_size=60), st.sampled_from(["don't", "<|endoftext|>", "  x", "a   b", "x  y", "\x1c\x1f a", "\u0085 z"])), max_size=6))
@settings(max_examples=300, deadline=None)
def test_trie_gives_the_librarys_ids(by_trie, texts):
    texts = [*texts, "".join(texts)]
    got = [[t for u in us for t in u] for us in by_trie.prepare(texts)]
    assert got == [ids_of(t) for t in texts]
    assert [bpe.decode(g, by_trie.v) for g in got] == [LIB.decode(g, skip_special_tokens=False) for g in got]


def test_trie_is_the_merge_procedure(by_trie):
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcdefint ionsher"), rng.integers(1, 20)).tolist()) for _ in range(3000)]
    got = bpe.Trie(by_trie.v).encode(list(set(words)))
    assert all(got[w] == by_trie.v.merge(w) for w in set(words))


def _digest(doc_id, text):
    ids = ids_of(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))


def test_report_is_the_librarys(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    assert Counter(map(tuple, bpe.report(spark, docs(spark), vocabulary_path()).collect())) == Counter(_digest(*r) for r in rows)
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries()["op9_trie_bpe"](spark, SMALL).collect())) == Counter(_digest(*r) for r in d)
    assert bpe.report(spark, docs(spark, []), vocabulary_path()).count() == 0


def packed_right(rows, out, most=1024):
    """Each row's ids lie in its pieces once, sequences have no gaps and are within the limits."""
    want = Counter()
    for doc_id, text in rows:
        want[doc_id, len(ids_of(text)) + 1] += 1
    got, seqs = Counter(), {}
    raw = {(d, len(ids_of(t)) + 1): np.array([*ids_of(t), 0], "<u4").tobytes() for d, t in rows}
    for r in out:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        b = raw[r["doc_id"], r["doc_tokens"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["length"] > 0 and len(b) == 4 * r["length"] and zlib.crc32(b) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    return seqs


def test_packing(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    packed_right(rows, packing.pack_documents(spark, docs(spark), vocabulary_path()).collect())
    d = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    seqs = packed_right(d, queries()["op8_vector_packing"](spark, SMALL).collect())
    tokens = sum(n for p in seqs.values() for _, n in p)
    assert tokens >= 0.97 * 1024 * (len(seqs) - 1)
    assert packing.pack_documents(spark, docs(spark, []), vocabulary_path()).count() == 0


@given(st.lists(st.tuples(st.integers(1, 50), st.just(1), st.integers(0, 50)), max_size=80))
@settings(max_examples=100, deadline=None)
def test_bins_keep_all_limits(items):
    limits = np.array([60, 5, 70])
    d = np.array([(a, b, min(a, c)) for a, b, c in items], np.int64).reshape(-1, 3)
    bins = packing.pack(d, limits)
    n = bins.max(initial=-1) + 1
    assert sorted(set(bins.tolist())) == list(range(n))
    for b in range(n):
        assert (d[bins == b].sum(0) <= limits).all()


def test_items_over_a_limit_are_an_error():
    with pytest.raises(ValueError, match="over the limits"):
        packing.pack(np.array([[10, 1, 9], [10, 1, 600]]), np.array([1024, 64, 512]))
    with pytest.raises(ValueError, match="1 at least"):
        packing.pack_documents(None, None, "", loss=0)


@given(st.integers(1, 300), st.integers(0, 299), st.integers(1, 60), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_cuts_keep_the_limits(n, prompt, tokens, loss):
    prompt = min(prompt, n - 1)
    bears = [prompt <= i < n - 1 for i in range(n)]
    at = 0
    for s, length, b in packing.cuts(n, prompt, tokens, loss):
        assert s == at and 0 < length <= tokens and b == sum(bears[s : s + length]) <= loss
        at += length
        # no piece could have been longer
        assert at == n or length == tokens or (b == loss and bears[at])
    assert at == n


def test_packing_by_brute_force_under_limits_that_bind(spark):
    """Prompts bear no loss; each limit stops some sequence that the others would let grow."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(["cat dog sun map"] * n)
    rows = [(i, say(int(rng.integers(0, 9))), say(int(rng.integers(0, 40))) if i % 3 else say(1)) for i in range(600)] + [(700, None, "x y"), (None, "a", None), (701, say(100), say(200))]
    d = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    out = packing.pack_documents(spark, d, vocabulary_path(), tokens=256, segments=6, loss=180, group_rows=200, prompt="prompt").collect()
    raw = {i: np.array([*ids_of(p), *ids_of(t), 0], "<u4") for i, p, t in rows}
    lead = {i: len(ids_of(p)) for i, p, t in rows}
    seqs, covered = {}, Counter()
    for r in out:
        i, s, n = r["doc_id"], r["start"], r["length"]
        x = raw[i][s : s + n]
        assert len(x) == n and zlib.crc32(x.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(raw[i])
        assert r["loss"] == sum(lead[i] <= j < len(raw[i]) - 1 for j in range(s, s + n))
        covered[i] += n
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], n, r["loss"]))
    assert covered == Counter({i: len(x) for i, x in raw.items()})
    sums = []
    for p in seqs.values():
        at = 0
        for o, n, _ in sorted(p):
            assert o == at
            at += n
        sums.append((at, len(p), sum(x[2] for x in p)))
    assert all(a <= 256 and b <= 6 and c <= 180 for a, b, c in sums)
    assert any(b == 6 and a < 240 and c < 170 for a, b, c in sums) and any(c > 175 and a < 250 for a, b, c in sums) and any(a == 256 for a, b, c in sums)


def test_packing_of_many_equal_rows(spark):
    rows = [(7 if i % 2 else None, "the same few words") for i in range(9000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(spark, d, vocabulary_path(), group_rows=500).collect()
    seqs = packed_right(rows, out)
    tokens = sum(n for p in seqs.values() for _, n in p)
    assert len(out) == 9000 and tokens >= 0.9 * 64 * 5 * len(seqs)  # 64 segments of 5 ids


def test_whole_texts_are_the_librarys():
    w = bpe.whole_texts(vocabulary_path())
    for t in [None, "", "a<|endoftext|>b <|endoftext|", " " * 1_500_000 + "a b", "x" * 100_000, *[r[1] for r in ROWS], "".join(f"a{chr(c)}1 {chr(c)}." for c in range(0x20, 0x3000))]:
        assert w.ids(t).tolist() == ids_of(t)


def test_dot_product_order():
    """The item that agrees best with the room left is taken, in plain steps."""
    rng = np.random.default_rng(2)
    d = np.stack([rng.integers(1, 60, 60), np.ones(60, int), rng.integers(0, 40, 60)], 1)
    limits = np.array([64, 6, 50])
    left, want, b = list(range(60)), {}, 0
    share = lambda x: tuple(x)
    while left:
        room = limits.astype(float)
        while fit := [i for i in left if (d[i] <= room).all()]:
            best = max(fit, key=lambda i: (d[i] / limits @ (room / limits), [-x for x in share(d[i])], -i))
            want[best] = b
            left.remove(best)
            room -= d[best]
        b += 1
    assert packing.pack(d, limits).tolist() == [want[i] for i in range(60)]


def test_units_rejoin_to_the_text(by_trie):
    for t in ["a  b", " a", "a ", "a \n b", "x  y", "  ", "a b.c, d!"]:
        u = by_trie.cut(t)
        assert re.sub("\0", " ", "\0".join(u)) == t
