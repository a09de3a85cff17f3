"""The pipeline of five stages against plain versions of its stages."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomery.llm import langid, lines, toxicity
from tests.conftest import SMALL

from .cases import ROWS, docs, labels
from .test_neardup import expected
from .test_search_and_shards import _boilerplate
from .test_tokens import packed_right


def by_hand(spark, d, lab):
    """(doc_id, text) that reach the last stage. Scores and languages are the operators' own, tested elsewhere."""
    score = {r["doc_id"]: r["score"] for r in toxicity.report(spark, d, lab).collect()}
    d = d.where(F.col("doc_id").isin([i for i, x in score.items() if x < cp.TOXIC_FROM]))
    known = {r["doc_id"] for r in langid.predict(spark, d, langid.fit(spark, d)).where("known").collect()}
    rows = [r for r in d.collect() if r["doc_id"] in known]
    page = {i: c for i, (_, c) in expected([(r["doc_id"], r["text"]) for r in rows], 5, 80).items()}
    on = {}  # by source and group of near copies
    for r in rows:
        on.setdefault((r["source"] or "", page[r["doc_id"]]), set()).update(r["text"].split("\n"))
    bad = _boilerplate([(s, ls) for (s, _), ls in on.items()], cp.LINE_PERCENT, cp.LINE_TEXTS)
    groups = {}
    for (_, g), ls in on.items():
        for x in ls:
            groups.setdefault(x, set()).add(g)
    long = {x for x, g in groups.items() if len(x.split()) >= lines.LONG_WORDS and len(g) >= lines.LONG_TEXTS}
    out = []
    for r in rows:
        kept = [s for s in r["text"].split("\n") if s not in bad[r["source"] or ""] and s not in long]
        out.append((r["doc_id"], "\n".join(kept)))
    groups = expected(out, 5, 80)
    return [(i, t) for i, t in out if groups[i][1] == i]


def test_pipeline_by_hand(spark):
    d, lab = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = cp.run(spark, SMALL).collect()
    want = by_hand(spark, d, lab)
    assert {r["doc_id"] for r in out} == {i for i, _ in want} and len(want) < d.count()
    packed_right(want, out)


def test_stages_keep_columns(spark, tmp_path):
    labels(spark, [(1, 1, 0), (2, 1, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        d = docs(spark, rows)
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema], name
            d = spark.createDataFrame(out.collect(), out.schema)
        got = Counter(r["doc_id"] for r in d.collect())
        assert got == Counter([1, 6, 7, 8, None, 9, 11] if rows else [])


def _left(spark):
    """Bytes of each table in the shared folder."""
    out = Counter()
    for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*/*/*.parquet"):
        out[f.parent] += f.stat().st_size
    return out


def test_stages_leave_the_rows_once(spark, tmp_path):
    """What a stage leaves for its result to read holds each text once, and no table of the way there."""
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(20)) for _ in range(40)) for words in [[f"{rng.getrandbits(40):x}" for _ in range(900)]] for _ in range(60)]
    texts += [t + " again" for t in texts[:20]] + texts[:5]
    d = docs(spark, [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)])
    d.write.option("compression", "zstd").parquet(f"{tmp_path}/d")
    size = sum(f.stat().st_size for f in Path(f"{tmp_path}/d").glob("*.parquet"))
    for stage, rows in ((cp.drop_boilerplate_lines, 85), (cp.drop_near_duplicates, 60)):
        before = _left(spark)
        out = stage(spark, d, str(tmp_path))
        new = _left(spark) - before
        assert out.count() == rows
        assert sum(new.values()) < 1.5 * size and sum(x > size / 2 for x in new.values()) == 1 and len(new) <= 5, (stage, new, size)


def test_run_leaves_its_result_only(spark):
    before = _left(spark)
    out = cp.run(spark, SMALL)
    assert len(_left(spark) - before) == 1 and out.count()


def test_few_rows_stay_clean(spark):
    """Languages are learned from rows with one; a text without letters has none."""
    rows = [(i, "the cat sat on the mat" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de", "web", 1) for i in range(40)]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.report(spark, docs(spark, rows)).collect()}
    assert all(out[i] == ("en" if i % 2 else "de") for i in range(40))
