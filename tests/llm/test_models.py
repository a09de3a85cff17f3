"""Toxicity, language and the language model, on held-out rows and by brute force; audio by round trips."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import hpylm, langid, media, toxicity
from loomery.llm.queries import queries
from tests.conftest import SMALL

from .cases import ROWS, docs, labels

MORE, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@given(st.lists(st.text("abcd", min_size=3, max_size=10), min_size=1, max_size=12, unique=True), st.lists(st.text("abcd", min_size=1, max_size=11), max_size=10))
@settings(max_examples=150, deadline=None)
def test_automata_find_the_nearest_term(terms, words):
    trie = toxicity.Trie({t: 1 + i / 100 for i, t in enumerate(terms)})
    may = trie.may_match(words)
    for w, m, got in zip(words, may, trie.find(words), strict=True):
        near = [(lev(w, t), -(1 + i / 100), i) for i, t in enumerate(terms) if lev(w, t) <= toxicity.edits_for(len(t))]
        assert got == ((min(near)[2], min(near)[0]) if near else (-1, 0))
        assert m or not near


def test_quoted_terms_count_less():
    s = toxicity.Scorer(toxicity.Model({"vermin": 1.0}, {"vermin": 1.0}, {}, [0.0] * len(toxicity.EDGES)))
    plain, quoted, told, twice, wrong = s.points(["they are vermin here", 'he said "they are vermin here" then', "they wrote: vermin", "vermin and vermin", "they are vermim here"])
    assert quoted < plain and told < plain and twice > 2 * plain - 1e-9 and 0 < wrong <= plain


def test_toxicity_of_held_out_rows(spark):
    """At a size with some 300 toxic texts to learn from; each language has about 30 terms."""
    out = {r["doc_id"]: r for r in queries()["op7_lexicon_automata"](spark, LARGER).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert len(out) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in out.items())
    hit = Counter((truth[i], out[i]["predicted"]) for i in truth)
    print("toxicity", hit)
    assert hit[1, 1] >= 0.8 * (hit[1, 1] + hit[1, 0]) and hit[0, 1] <= 0.05 * (hit[0, 1] + hit[0, 0])


def test_near_copies_teach_once(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(base, 1), (base + " more", 1), (base + " other", 0), ("w0 w1 w2 " + " ".join(f"x{i}" for i in range(40)), 1), ("", 1), ("one", 1)]
    out = [tuple(r) for r in toxicity.one_of_near_copies(spark.createDataFrame(rows, "text string, toxic int")).collect()]
    assert sorted(out) in [sorted(r for r in rows if r != x) for x in rows[:2]]  # sharing a shingle isn't enough


def test_many_near_copies_teach_once(spark):
    """One of a thousand copies with a word changed each stays; texts that share a passage of a quarter stay all."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    near = [" ".join([*base[:j], f"n{i}", *base[j + 1 :]]) for i, j in enumerate(rng.integers(0, 200, 1000))]
    apart = [" ".join(base[:50] + [f"a{i}_{j}" for j in range(150)]) for i in range(20)]
    out = toxicity.one_of_near_copies(spark.createDataFrame([(t, 1) for t in near + apart], "text string, toxic int"))
    kept = {r["text"] for r in out.collect()}
    assert len(kept & set(near)) == 1 and len(kept & set(apart)) >= 18


def test_scores_of_texts_by_brute_force():
    """Points from plain edit distances of all words to all terms, windows and quotes by hand."""
    terms = {"vermin": 1.0, "scumbag": 1.5, "rat": 0.5}
    m = toxicity.Model(terms, {"vermin": 0.8, "scumbag": 1.2, "rat": 0.5}, {"vermine": 0.0}, [i / 20 for i in range(len(toxicity.EDGES))])
    s = toxicity.Scorer(m)
    rng = np.random.default_rng(4)
    pool = ["vermin", "vermim", "vermine", "scumbag", "scumbg", "scunbags", "rat", "rats", "the", "house", "and", "cat", '"', "wrote:"]
    for _ in range(60):
        words = [str(w) for w in rng.choice(pool, 25)]
        text, hits = " ".join(words), []
        tokens = [(x.group(), x.start(), x.end()) for x in re.finditer(r"[^\W_]+", text)]
        for i, (w, a, b) in enumerate(tokens):
            near = [(lev(w, t), -x, t) for t, x in terms.items() if lev(w, t) <= toxicity.edits_for(len(t))]
            if near:
                e, _, t = min(near)
                weight = terms[t] if not e else m.variants.get(w, m.unseen[t] * (1.25 - 0.25 * e))
                if weight > 0:
                    hits.append((i, a, b, weight))
        want = 0.0
        for i, a, b, weight in hits:
            quoted = text[:a].count('"') % 2 == 1 and '"' in text[b : b + 400]
            told = re.search(r"wrote\W*$", text[max(0, a - 40) : a]) is not None
            want += weight * (0.3 if quoted or told else 1) * (1 + 0.25 * min(4, sum(0 < abs(x[0] - i) <= toxicity.WINDOW for x in hits)))
        assert s.points([text])[0] == pytest.approx(want)
        assert s.score(want) == m.table[max(i for i, e in enumerate(toxicity.EDGES) if e <= want)]


@pytest.mark.parametrize("lead", ["he said: ", "er sagte: ", "elle a dit : ", "ella escribió: "])
def test_reported_terms_count_less(lead):
    s = toxicity.Scorer(toxicity.Model({"vermin": 1.0}, {}, {}, [0.0] * len(toxicity.EDGES)))
    told, plain = s.points([f"{lead}vermin", "vermin"])
    assert told < plain


def test_toxicity_of_odd_rows(spark):
    for lab in ([], [(1, 1, 1), (2, 1, 0), (None, 0, 1), (6, None, None), (77, 0, 1)]):
        out = toxicity.report(spark, docs(spark), labels(spark, lab)).collect()
        assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS) and all(0 <= r["score"] <= 1 for r in out)
    d = docs(spark)
    kept = toxicity.without_toxic(spark, d, labels(spark))
    assert kept.schema.names == d.schema.names and kept.count() == len(ROWS)
    assert toxicity.report(spark, docs(spark, []), labels(spark)).count() == 0


def test_language_of_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries()["op10_hyperdimensional_langid"](spark, MORE).collect()
    assert len(out) == len(truth)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in out if r["held_out"] and truth[r["doc_id"]] and r["lang_pred"] != "und"]
    print("language", sum(right), len(right))
    assert sum(right) >= 0.9 * len(right)


def test_language_of_odd_rows(spark):
    out = langid.report(spark, docs(spark)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS)
    none = [r for r in out if r["doc_id"] in (3, 4, 5, 10)]
    assert len(none) == 4 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in none)
    d = docs(spark)
    kept = langid.with_language(spark, d)
    assert kept.schema.names == d.schema.names and Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))
    assert langid.report(spark, docs(spark, [])).count() == 0


def test_languages_by_brute_force(spark):
    """Prototypes and decisions from all pairs of text and language, in plain loops."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    s = langid.Space()
    vec = {r["doc_id"]: s.vectors([r["text"]])[0].astype(float) for r in rows}
    sums = {}
    for r in rows:
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vec[r["doc_id"]]
    near = lambda v: sorted(((-float(v @ (p / np.linalg.norm(p))), lang) for lang, p in sums.items()))
    for r in queries()["op10_hyperdimensional_langid"](spark, SMALL).collect():
        v = vec[r["doc_id"]]
        if not v.any():
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        (a, lang), (b, _) = near(v)[:2]
        assert abs(r["score"] - max(0, -a)) < 1e-4 and (r["lang_pred"] == lang or b - a < 1e-4)


def test_rows_that_teach_languages(spark):
    """About so many rows of each language, all of a rare one, whatever the counts: none is rounded away."""
    rows = [(i, f"text {i}", "rare" if i in (4, 1005, 1501) else "en" if i % 3 else "de", "web", 1) for i in range(3000)]
    d = docs(spark, rows)
    place = {r[0]: r[1] for r in langid.labelled(d).selectExpr("doc_id", "pmod(xxhash64(3, doc_id, text), 9007199254740992) / 9007199254740992D").collect()}
    got = lambda n, rows: Counter(r["lang"] for r in langid.training(d, spark.createDataFrame(n, "lang string, n long"), rows).collect())
    all_rows = got([("en", 1), ("de", 1), ("rare", 1)], 1)
    assert sum(all_rows.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(3000))
    some = got([("en", all_rows["en"] * 10), ("de", all_rows["de"]), ("rare", all_rows["rare"])], 1000)
    assert 60 < some["en"] < 140 and some["de"] == all_rows["de"] and some["rare"] == all_rows["rare"] > 0
    least = min(place, key=place.get)
    place_of = place[least]
    assert got([(rows[least][2], int(5000 / place_of) - 1)], 5000).total() >= 1  # the share isn't cut off at a millionth


def test_texts_of_no_language_go(spark):
    """Junk with letters is rejected by its cosine; clean rows of learned languages and texts too short to tell stay."""
    d = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 800)) for _ in range(5)] + [" ".join("".join(rng.choice(list("bcdfgjklmpqvwxz"), 6)) for _ in range(90)) for _ in range(5)] + [" ".join("".join(rng.choice(list("абвгдежзийклмнопрсту"), 6)) for _ in range(90))]
    planted = spark.createDataFrame([(10_000_000 + i, t, "en" if i == 0 else None, "web", 1) for i, t in enumerate(junk)] + [(11_000_000, "ok.", None, "web", 1)], d.schema)
    kept = {r["doc_id"] for r in langid.with_language(spark, d.unionByName(planted)).collect()}
    assert not [i for i in kept if 10_000_000 <= i < 11_000_000] and 11_000_000 in kept
    clean = {r["doc_id"] for r in d.where("length(text) > 20").collect()}
    assert len(clean - kept) <= 0.002 * len(clean)


def test_bundles_by_brute_force():
    s, text = langid.Space(), "Abc, déf abc"
    want, low = np.zeros(langid.DIM), " abc déf abc "
    for i in range(len(low) - 2):
        v = np.ones(langid.DIM)
        for place, ch in enumerate(low[i : i + 3]):
            v *= np.roll(s.letter(ord(ch)), 2 - place)
        want += v
    assert np.allclose(s.vectors([text, None, "..."]), [want / np.linalg.norm(want), want * 0, want * 0], atol=1e-5)


def words_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base_by_hand(rows):
    """doc_id to (held_out, tokens, known, all training tokens, base score)."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    p = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, held(i), len(words_of(t)), sum(c[w] > 0 for w in words_of(t)), n, sum(map(p, words_of(t)))) for i, t in rows]


def same_base(rows, out):
    key = lambda r: (r[0] is None, r[0], r[2], r[3], round(r[5], 4))
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out], key=key)
    for a, b in zip(got, sorted(base_by_hand(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_language_model_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").collect()]
    out = hpylm.score(spark, spark.read.parquet(f"{MORE}/documents.parquet"), chunk_bytes=300_000).collect()
    same_base(rows, out)
    score, base = (sum(r[c] for r in out if r["held_out"]) for c in ("score", "base_score"))
    print("log10", score, base)
    assert score > base


def test_language_model_of_odd_rows(spark):
    same_base([(r[0], r[1]) for r in ROWS], hpylm.score(spark, docs(spark)).collect())
    assert hpylm.score(spark, docs(spark, [])).count() == 0


def test_language_model_is_one_model(spark, monkeypatch):
    """However many chunks and shards the texts and words are dealt into."""
    d = spark.read.parquet(f"{MORE}/documents.parquet").orderBy("doc_id").limit(400)
    found = []
    monkeypatch.setattr(hpylm, "heavy_words", lambda d, n, of=hpylm.heavy_words: found.append(of(d, n)) or found[-1])
    a, b = ({r["doc_id"]: r["score"] for r in hpylm.score(spark, d, chunk_bytes=c).collect()} for c in (20_000, 1 << 30))
    assert len(found[0].words) > 3 and found[0].parts.max() > 1 and not len(found[1].words)  # some are dealt over many shards
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_scores_by_brute_force(spark):
    """Counts, totals and probabilities gathered by loops over all token pairs; only the draws are the operator's."""
    rows = [tuple(r) for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()] + [(-1, None), (-2, ""), (-3, "unheard-of words only")]
    name = lambda w: hpylm._END if w is None else hpylm.word_hashes(w)[0]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    pairs = {i: list(zip([hpylm._START, *map(name, words_of(t)[:-1])], map(name, words_of(t)), strict=True)) for i, t in rows}
    c = Counter(p for i, ps in pairs.items() if not held(i) for p in ps)
    known, n = Counter(), 0
    for (_, w), x in c.items():
        known[w] += x
        n += x
    v, t, tw = len(known), dict.fromkeys(c, 1), dict.fromkeys(known, 1)
    base = lambda w: (known[w] + 0.1) / (n + 0.1 * (v + 1))
    prob = Counter()
    D, TH, D0, TH0 = hpylm.D, hpylm.THETA, hpylm.D0, hpylm.THETA0
    for number in range(hpylm.BURN + hpylm.SAMPLES):
        turn, served, k = hpylm._turn(number), Counter(), Counter()
        for (u, w), x in t.items():
            served[u] += x
            k[w] += x
        big, tall = sum(k.values()), sum(tw.values())
        p0 = lambda w: (k[w] - D0 * tw.get(w, 0) + (TH0 + D0 * tall) * base(w)) / (TH0 + big)  # noqa: E731, B023
        many = [p for p in c if c[p] > 1]
        key = hpylm._pair_keys(np.array([w for _, w in many]), np.array([u for u, _ in many])) ^ turn
        new = hpylm.draw_tables(np.array([c[p] for p in many]), None, np.array([served[p[0]] - t[p] for p in many]), np.array([p0(p[1]) for p in many]), D, TH, key)
        t |= {p: int(x) for p, x in zip(many, new, strict=True)}
        words, k = list(known), Counter()
        for (_, w), x in t.items():
            k[w] += x
        new = hpylm.draw_tables(np.array([k[w] for w in words]), None, np.array([tall - tw[w] for w in words], float), np.array([base(w) for w in words]), D0, TH0, hpylm.mix64(np.array(words)) ^ turn)
        tw = {w: int(x) for w, x in zip(words, new, strict=True)}
        if number >= hpylm.BURN:
            served, of = Counter(), Counter()
            for (u, w), x in t.items():
                served[u] += x
                of[u] += c[u, w]
            big, tall = sum(k.values()), sum(tw.values())
            for ps in pairs.values():
                for u, w in set(ps):
                    prob[u, w] += 0
            for u, w in prob:
                prob[u, w] += (c[u, w] - D * t.get((u, w), 0) + (TH + D * served[u]) * p0(w)) / (TH + of[u]) / hpylm.SAMPLES
    out = {r["doc_id"]: r["score"] for r in hpylm.score(spark, spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=20_000).collect()}
    assert len(out) == len(rows)
    for i, ps in pairs.items():
        assert out[i] == pytest.approx(sum(math.log10(prob[p]) for p in ps), rel=1e-9), i


def test_contexts_are_whole_words(spark):
    """Over 65,536 distinct words, one context each: what follows a rare word isn't mixed with what follows others."""
    rows = [(i, f"left{i} right{i} left{i} right{i} left{i} right{i}", "en", "web", 1) for i in range(70_000)]
    x = hpylm.Chunk([r[1] for r in rows], np.ones(len(rows), bool))
    assert len(set(x.words[x.pair_context].tolist())) == 2 * len(rows) + 1
    out = hpylm.score(spark, docs(spark, rows, clash=False), chunk_bytes=3_000_000).where("doc_id < 2000 and not held_out").collect()
    # left is always followed by its right: the restaurant's own dish outweighs all others
    assert min(r["score"] for r in out) > -16


def test_probabilities_sum_to_one():
    """In each context, over all words and the unknown one."""
    rng, words, contexts = np.random.default_rng(1), 30, 5
    word, context = np.repeat(np.arange(words), contexts), np.tile(np.arange(contexts), words)
    count = rng.poisson(1.5, words * contexts) * rng.integers(0, 2, words * contexts)
    count[: 2 * contexts] = 90  # the last words may be unknown ones
    known = np.bincount(word, count, words).astype(np.int64)
    n, v = known.sum(), (known > 0).sum()
    base = (known + 0.1) / (n + 0.1 * (v + 1))
    on = known > 0
    for t, tw in hpylm.sample(word, context, count, known, float(n), float(v), 1, 7):
        assert ((t >= (count > 0)) & (t <= count)).all()
        k = np.bincount(word, t, words)
        assert ((tw >= (k > 0)) & (tw <= k)).all()
        cu, tu = np.bincount(context, count, contexts), np.bincount(context, t, contexts)
        parent = (k.sum(), tw.sum())
        p = hpylm.predict(count, t, word, k, tw, base, cu[context], tu[context], parent)
        none = hpylm.predict(np.zeros(contexts), np.zeros(contexts), np.zeros(contexts, int), np.zeros(1), np.zeros(1), np.array([0.1 / (n + 0.1 * (v + 1))]), cu, tu, parent)
        seen = np.bincount(context[on[word]], p[on[word]], contexts)
        assert np.allclose(seen + none, 1) and (p > 0).all()


def test_seating_numbers():
    """Numbers of tables of one dish, seated by the process itself."""
    rng, d, theta, q = np.random.default_rng(1), 0.5, 1.0, 0.3
    c, rest = np.full(20_000, 6), np.zeros(20_000)
    got = np.bincount(hpylm.draw_tables(c, c, rest, np.full(20_000, q), d, theta, rng), minlength=7) / 20_000
    w = np.array([0.0] + [math.exp(hpylm.log_stirling(d)[6, t]) * q**t * math.prod(theta + d * k for k in range(t)) for t in range(1, 7)])
    assert np.allclose(got, w / w.sum(), atol=0.015)


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_payloads_come_back(raw):
    p = raw + b"\xff" * (-len(raw) % media.UNIT if raw else media.UNIT)
    data = media.write(p)
    s = media.parse(data)
    assert media.payload(data, s) == p and s.crc_bad == 0 and s.skipped == 0 and s.vbr["frames"] == len(p) // media.UNIT
    assert s.samples == 1152 * len(s.offsets) and s.rate == 44100
    junk = b"\xff\xfb\x00" + raw[:700].replace(b"\xff", b"\0")
    t = media.parse(junk + data)  # tags are not looked for behind other bytes, frames are
    assert media.payload(junk + data, t)[-len(p) :] == p


def test_payload_that_looks_like_a_tag():
    """'TAG' 128 bytes before the end, which is byte 475 of the last block."""
    for n in (1, 3):
        p = bytearray(b"x" * (576 * n))
        p[576 * (n - 1) + 475 : 576 * (n - 1) + 478] = b"TAG"
        data = media.write(bytes(p))
        s = media.parse(data)
        assert data[-128:-125] == b"TAG" and media.payload(data, s) == p and s.skipped == 0 and len(s.offsets) == n
        tagged = media.parse(data + b"TAG" + b"song".ljust(30, b"\0") + bytes(95))
        assert tagged.tags["title"] == "song" and tagged.offsets == s.offsets and tagged.skipped == 0


def test_damage_is_found():
    data = bytearray(media.write(bytes(576 * 6)))
    s = media.parse(bytes(data))
    data[s.offsets[2] + 8] ^= 0x10
    assert media.parse(bytes(data)).crc_bad == 1
    cut = media.parse(bytes(data[: s.offsets[3]] + data[s.offsets[3] + 100 :]))
    assert len(cut.offsets) == 5 and cut.skipped == s.lengths[3] - 100
    tagged = bytes(data) + b"TAG" + b"song".ljust(30, b"\0") + bytes(95)
    assert media.parse(tagged).tags["title"] == "song" and len(media.parse(tagged).offsets) == 6
    assert media.parse(None).offsets == [] and media.parse(b"\xff" * 5000).offsets == []


def test_headers_of_all_layers():
    h = media.header(0xFFFB9064)  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert (h.version, h.layer, h.kbps, h.rate, h.length, h.samples, h.channels) == ("1", 3, 128, 44100, 417, 1152, 2)
    h = media.header(0xFFF38064)  # MPEG-2 layer III, 64 kbit/s, 22.05 kHz
    assert (h.version, h.layer, h.kbps, h.rate, h.length, h.samples) == ("2", 3, 64, 22050, 208, 576)
    h = media.header(0xFFFDA400)  # MPEG-1 layer II, 192 kbit/s, 48 kHz
    assert (h.layer, h.kbps, h.rate, h.length, h.samples) == (2, 192, 48000, 576, 1152)
    h = media.header(0xFFFF6000)  # MPEG-1 layer I, 192 kbit/s, 44.1 kHz
    assert (h.layer, h.kbps, h.length, h.samples) == (1, 192, 208, 384)
    assert all(media.header(x) is None for x in (0, 0xFFFB0000, 0xFFFBF000, 0xFFEB9000, 0xFFFB9C00))


def test_vbri_table():
    frame = bytearray(417)
    frame[:4] = b"\xff\xfb\x90\x64"
    frame[36:40] = b"VBRI"
    frame[42:62] = (7).to_bytes(2, "big") + bytes(2) + (4170).to_bytes(4, "big") + (10).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2)
    frame[62:66] = (5).to_bytes(2, "big") + (6).to_bytes(2, "big")
    s = media.parse(bytes(frame) + (b"\xff\xfb\x90\x64" + bytes(413)) * 2)
    assert s.vbr["kind"] == "VBRI" and s.vbr["frames"] == 10 and s.vbr["bytes"] == 4170 and s.vbr["toc"] == [15, 18] and len(s.offsets) == 2


def test_audio_report(spark):
    out = Counter(map(tuple, media.report(spark, docs(spark)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()))
    want = Counter()
    for i, t, *_ in ROWS:
        p = media.payload_of(t)
        assert len(p) % 576 == 0 and len(p) > 0 and p.startswith((t or "").encode())
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert out == want
    assert media.report(spark, docs(spark, [])).count() == 0
    x = spark.createDataFrame([(1, media.write(bytes(576 * 3))), (2, b""), (3, None)], "i long, m binary").select("i", media.probe("m").alias("p")).select("i", "p.*").collect()
    assert [(r["frames"], round(r["duration_s"], 6), len(r["seek_offsets"])) for r in x] == [(3, round(3 * 1152 / 44100, 6), 3), (0, 0.0, 0), (0, 0.0, 0)]
