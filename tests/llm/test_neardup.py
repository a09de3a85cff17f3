"""Near-duplicate groups against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest

from loomery.llm import neardup
from loomery.llm.neardup import NearDup

from .cases import ROWS, docs


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def expected(rows, k, percent):
    """doc_id to (set size, least doc_id reachable), for distinct ids."""
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, rows, k, percent):
    out = NearDup(spark, k, percent).groups(docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == expected(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out) and len(out) == len(rows)


def corpus(seed):
    """Copies, chains of edits, a large group of near copies, and texts that share a long passage."""
    rng = np.random.default_rng(seed)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    texts = [say(rng.integers(1, 60)) for _ in range(40)]
    for t in texts[:12]:
        for _ in range(3):
            t = list(t)
            t[rng.integers(len(t))] = "edited"
            texts.append(t)
    base = say(80)
    for _ in range(60):
        t = list(base)
        for _ in range(rng.integers(0, 5)):
            t[rng.integers(80)] = f"x{rng.integers(1000)}"
        texts.append(t)
    passage = say(60)
    texts += [passage + say(rng.integers(5, 40)) for _ in range(40)]
    texts += [base] * 5 + [["one"], ["ONE"], ["one", "two"], [], []]
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[o]), "en", "web", 1) for i, o in enumerate(order)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_groups_by_brute_force(spark, seed, k, percent, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 6)  # so that many buckets are large
    check(spark, corpus(seed), k, percent)


def test_odd_rows(spark):
    out = NearDup(spark, 3, 85).groups(docs(spark)).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert by[2][1:] == (1, False) and by[1][1:] == (1, True) and by[None] in ((0, None, True), (4, None, True))
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[6] == (1, 6, True)


def test_no_rows_and_no_links(spark):
    assert NearDup(spark, 3, 85).groups(docs(spark, [])).count() == 0
    assert neardup.without_copies(spark, docs(spark, [])).count() == 0
    check(spark, [(1, "a b c d", "en", "x", 1), (2, "e f g h", "en", "x", 1)], 3, 85)


def test_one_of_each_group_stays(spark):
    d = docs(spark)
    out = neardup.without_copies(spark, d)
    assert out.schema.names == d.schema.names
    got, want = Counter(r["doc_id"] for r in out.collect()), Counter(r[0] for r in ROWS)
    assert got == want - Counter([2, 6])
    rows = corpus(4)
    kept = {r["doc_id"] for r in neardup.without_copies(spark, docs(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in expected(rows, 5, 80).items() if i == c}


def test_repeated_ids_of_unlike_texts(spark):
    """A row goes only for the text it has, whatever other rows have its id."""
    rows = [(1, "a b c d e f g h", "en", "x", 1), (5, "a b c d e f g h", "en", "x", 1), (5, "quite another text that is nowhere else", "en", "x", 1), (5, "a b c d e f g h", "en", "x", 1), (None, "a b c d e f g h", "en", "x", 1)]
    out = [(r["doc_id"], r["text"]) for r in neardup.without_copies(spark, docs(spark, rows)).collect()]
    assert sorted(out) == [(1, rows[0][1]), (5, rows[2][1])]
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in NearDup(spark, 3, 85).groups(docs(spark, rows)).collect())
    assert found == [(0, 6, 1, False), (1, 6, 1, True), (5, 5, 5, True), (5, 6, 1, False), (5, 6, 1, False)]
    none = [(None, t, "en", "x", 1) for t in ["a b c d e f g h", "a b c d e f g h", "A B C D E F G H", "", None]]
    assert neardup.without_copies(spark, docs(spark, none)).count() == 3
    assert sorted((r["n_shingles"], r["component_id"] is None, r["kept"]) for r in NearDup(spark, 3, 85).groups(docs(spark, none)).collect()) == [(0, True, True)] * 2 + [(6, True, False)] * 2 + [(6, True, True)]


def test_rows_without_id_link_others(spark):
    base = [f"w{i}" for i in range(100)]
    edit = lambda t, *at: [f"e{i}" if i in at else w for i, w in enumerate(t)]
    bridge = edit(base, 10, 50)
    rows = [(1, " ".join(base), "en", "x", 1), (None, " ".join(bridge), "en", "x", 1), (3, " ".join(edit(bridge, 30, 80)), "en", "x", 1)]
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in NearDup(spark, 3, 85).groups(docs(spark, rows)).collect()) == [(0, 1), (1, 1), (3, 1)]
    assert {r["doc_id"]: r["component_id"] for r in NearDup(spark, 3, 85).groups(docs(spark, rows[::2])).collect()} == {1: 1, 3: 3}


def test_chains_of_links(spark):
    from loomery.llm.common import Scratch

    rng = np.random.default_rng(6)
    names = rng.permutation(1000) - 500
    edges = [(int(names[i]), int(names[i + 1])) for i in range(300)] + [(int(names[400]), int(names[i])) for i in range(401, 600)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["v"]: r["c"] for r in neardup.components(spark, df, Scratch(spark, "t")).collect()}
    want = {int(x): int(names[:301].min()) for x in names[:301]} | {int(x): int(names[400:600].min()) for x in names[400:600]}
    assert got == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1000], rng.integers(0, 2**63, 1000).astype(np.uint64)])
    assert abs((neardup.signature(a, 1024) == neardup.signature(b, 1024)).mean() - 1 / 3) < 0.06
