"""Sharding, Hamming search, line frequency: against their SQL, laws and brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest

from loomery.llm import hamming, lines, queries, sharding
from tests.conftest import SMALL
from tests.oracle import assert_same, duck

from .cases import ROWS, docs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), duck(SMALL), queries.oracle_sql()[name])


def _law(rows, out, shards=8):
    assert len(out) == len(rows)
    per = {}
    for r in out:
        per.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(per.get(s, [])) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_shards_of_odd_rows(spark):
    _law(ROWS, sharding.interleave(spark, docs(spark)).collect())


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 7}", 6) for i in range(6000)]
    out = sharding.interleave(spark, docs(spark, rows, False), bucket_rows=100).collect()
    _law(rows, out)
    whole, each = Counter(r["source"] for r in out), Counter((r["source"], r["shard"]) for r in out)
    assert all(abs(each[s, k] - n / 8) <= 1 for s, n in whole.items() for k in range(8))


def test_shards_of_rows_with_one_id(spark):
    """Equal and null ids don't share a place in the random order, so no window task has them all."""
    rows = [(None if i % 2 else 5, f"text {i}", "en", "web", 6) for i in range(4000)]
    out = sharding.interleave(spark, docs(spark, rows, False), bucket_rows=100).collect()
    _law(rows, out)
    each = Counter((r["doc_id"], r["shard"]) for r in out)
    assert all(180 < n < 320 for n in each.values()) and len(each) == 16


def test_no_rows(spark):
    assert sharding.interleave(spark, docs(spark, [])).count() == 0
    empty = spark.createDataFrame([], "vec_id long, code long")
    assert hamming.top_k(spark, empty, empty).count() == 0
    assert lines.pages_without_boilerplate(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert lines.documents_without_boilerplate(spark, docs(spark, []), 10, 5).count() == 0


def _nearest(codes, query, k):
    found = sorted(((codes[query] ^ c) .bit_count(), i) for i, c in codes.items() if i != query)
    return [(i, d) for d, i in found[:k]]


def test_nearest_codes_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12)
    codes = {i: int(base[i % 12]) ^ (1 << int(rng.integers(0, 63)) if i % 3 else 0) for i in range(400)}  # many ties and repeats
    rows = spark.createDataFrame([*codes.items(), (None, 5), (999, None)], "vec_id long, code long")
    out = hamming.top_k(spark, rows, rows.where("vec_id % 20 = 0"), k=7, block_rows=64, block_queries=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    assert got == {q: _nearest(codes, q, 7) for q in codes if q % 20 == 0}


def test_fewer_codes_than_asked_for(spark):
    rows = spark.createDataFrame([(20, 1), (21, 1), (22, -1)], "vec_id long, code long")
    out = hamming.top_k(spark, rows, rows.where("vec_id = 20"), k=10).collect()
    assert sorted((r["rank"], r["vec_id"], r["distance"]) for r in out) == [(1, 21, 0), (2, 22, 63)]


def test_sign_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, []), (3, None)], "vec_id long, embedding array<float>")
    assert {r[0]: r[1] for r in df.select("vec_id", hamming.sign_code("embedding")).collect()} == {1: 5, 2: 0, 3: None}


def test_codes_that_share_segments(spark):
    """A third of all rows has one code, the others agree in all but their upper bits; names of other columns clash."""
    rng = np.random.default_rng(4)
    codes = {i: 77 if i % 3 == 0 else 77 ^ (int(rng.integers(0, 2**20)) << 40) for i in range(1500)}
    extra = "segment string, prefix string, part string, bound string, n string, far string, distance string, flip string"
    rows = spark.createDataFrame([(*r, *["x"] * 8) for r in codes.items()], "vec_id long, code long, " + extra)
    out = hamming.top_k(spark, rows, rows.where("vec_id % 20 = 0"), k=5, block_rows=100, block_queries=9).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    assert got == {q: _nearest(codes, q, 5) for q in codes if q % 20 == 0}


@pytest.mark.parametrize(("low", "wide"), [(0, [16] * 4), (3, [13, 13, 13, 13, 12]), (5, [32, 32])])
def test_each_pair_is_found_once(low, wide):
    """Over all shards of all segments, all radii find each pair of a query and a row once, by probes or by rows."""
    rng = np.random.default_rng(6)
    codes, queries = rng.integers(0, 2**64, 300, dtype=np.uint64), rng.integers(0, 2**64, 3, dtype=np.uint64)
    codes[:150] = queries[0] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    seen = Counter()
    for j in range(len(wide)):
        prefix = (codes >> np.uint64(sum(wide[:j]))) & np.uint64((1 << low) - 1)
        for p in np.unique(prefix):
            at = np.flatnonzero(prefix == p)
            shard = hamming.Shard(at, codes[at], j, int(p), low, wide)
            q, i, d = shard.search(queries, np.full(3, 64), 0, max(wide), 1000)
            assert (d == np.bitwise_count(queries[q] ^ codes[i])).all()
            seen.update(zip(q.tolist(), i.tolist(), strict=True))
    assert len(seen) == 900 and set(seen.values()) == {1}


def test_vectors_longer_than_the_code(spark):
    df = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="more than 64 components"):
        df.select(hamming.sign_code("embedding")).collect()


def _boilerplate(pages, percent, least):
    """By host: lines on over percent % of its pages."""
    hosts = {}
    for host, ls in pages:
        hosts.setdefault(host, []).append(set(ls) - {"", None})
    out = {}
    for host, sets in hosts.items():
        n = Counter(x for s in sets for x in s)
        out[host] = {x for x, k in n.items() if len(sets) >= least and k * 100 > len(sets) * percent}
    return out


@pytest.mark.parametrize(("n", "percent", "least"), [(2, 30, 2), (1, 30, 1), (9, 5, 3)])
def test_few_pages(spark, n, percent, least):
    """Lines of a single page go too, if it is a share large enough."""
    pages = [("h", [f"l{i}", "all", "", None]) for i in range(n)]
    df = spark.createDataFrame([(i, h, x, "theirs", 7) for i, (h, x) in enumerate(pages)], "i long, h string, x array<string>, host_pages string, _bad int")
    out = lines.drop_boilerplate(spark, df, "h", "x", percent, least)
    assert out.columns == ["i", "_bad", "h", "x", "host_pages", "n_dropped"]
    bad = _boilerplate(pages, percent, least)
    assert {r["i"]: (r["x"], r["host_pages"], r["_bad"]) for r in out.collect()} == {i: ([x for x in ls if x not in bad[h]], n, 7) for i, (h, ls) in enumerate(pages)}


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pages = [(f"h{min(i % 5, 2)}", [f"l{x}" for x in rng.zipf(1.5, 6) % 40] + [f"own {i}"]) for i in range(120)]
    df = spark.createDataFrame([(i, h, x) for i, (h, x) in enumerate(pages)], "i long, h string, x array<string>")
    out = {r["i"]: r["x"] for r in lines.drop_boilerplate(spark, df, "h", "x", 30, 5).collect()}
    bad = _boilerplate(pages, 30, 5)
    assert out == {i: [x for x in ls if x not in bad[h]] for i, (h, ls) in enumerate(pages)} and any(bad.values())


def test_lines_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "http://A.b/x", "<p>x</p><script>no</script><p> y "), (None, "nonsense", "<b>z</b>")], "page_id long, url string, html string")
    out = {r["page_id"]: (r["host"], r["text"], r["n_lines"]) for r in lines.pages_without_boilerplate(spark, df).collect()}
    assert out == {1: ("", "", 0), 2: ("", "", 0), 3: ("a.b", "x\ny", 2), None: ("", "z", 1)}


def test_long_pages_and_clashing_names(spark):
    """Pages of many lines; columns named like those that are added or used."""
    long = "".join(f"<p>line {i} of it</p>" for i in range(20_000))
    df = spark.createDataFrame([(i, "http://a/x", f"<p>nav</p>{long if i < 2 else ''}<p>own {i}</p>", "x", "y", "z") for i in range(8)], "page_id long, url string, html string, host string, host_pages string, _lines string")
    out = {r["page_id"]: r for r in lines.pages_without_boilerplate(spark, df).collect()}
    assert out[1]["n_lines"] == 20_002 and out[1]["n_dropped"] == 1 and out[5]["text"] == "own 5" and out[5]["host_pages"] == 8


def test_near_copies_count_once(spark):
    """A group of near copies with over 10 % of a source doesn't make its lines boilerplate; blank lines stay."""
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    shared = [say(8) for _ in range(12)]
    copies = ["\n".join([*shared[:6], "", f"edit {i}", *shared[6:]]) for i in range(20)]
    rows = [(i, t, "en", "web", 1) for i, t in enumerate(copies + [f"{say(20)}\n\n{say(9)}" for _ in range(60)])]
    out = {r["doc_id"]: r["text"] for r in lines.documents_without_boilerplate(spark, docs(spark, rows), 10, 20).collect()}
    assert out == {r[0]: r[1] for r in rows}


def test_passages_go_whatever_their_share(spark):
    """A line of 50 words in 10 texts of a large source, or of several; in 9 it stays, as do shorter ones."""
    rng = np.random.default_rng(10)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    long, spread, few, short = say(60), say(50), say(60), say(49)
    texts = [[say(30), *([long] if i < 10 else []), *([spread] if i % 40 == 0 else []), *([few] if 20 <= i < 29 else []), *([short] if i % 17 == 3 else []), say(150)] for i in range(400)]
    rows = [(i, "\n".join(t), "en", "hot" if i % 80 else f"s{i}", 1) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["text"] for r in lines.documents_without_boilerplate(spark, docs(spark, rows), 10, 20).collect()}
    assert out == {i: "\n".join(x for x in t if x not in (long, spread)) for i, t in enumerate(texts)}


def test_documents_keep_rows_and_columns(spark):
    d = docs(spark)
    out = lines.documents_without_boilerplate(spark, d, 30, 5)
    assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r[0], r[1]) for r in ROWS)


def test_boilerplate_lines_go_from_documents(spark):
    rows = [(i, f"Subscribe now\n  own {i}\nend {i} {i * i} {i + 7}", "en", "web", 9) for i in range(30)] + [(99, None, None, "web", None)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.documents_without_boilerplate(spark, docs(spark, rows), 10, 20).collect()}
    assert out == {i: (t, len(t)) for i in range(30) for t in [f"  own {i}\nend {i} {i * i} {i + 7}"]} | {99: (None, None)}
