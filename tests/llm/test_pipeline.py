"""The pipeline's stages against brute force on the smallest tables."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def windows(text, n=50):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def kept_by_all_pairs(texts, num, den):
    """The first document of each group of links, and those without words."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out."""
    import corpus_pipeline as p
    from lumenlog.llm.shared import written

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in p.STAGES:
        after = written(stage(spark, docs, DATA), name)
        out[name] = docs, after
        docs = after
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.count() <= before.count()


def test_toxic_documents_go(spark, stages):
    from lumenlog.llm import toxicity

    before, after = stages["toxicity"]
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scores = toxicity.scores(before, spark.read.parquet(f"{DATA}/labels.parquet"), out).collect()
    assert {r.doc_id for r in scores if r.score < 0.5} == set(texts_of(after))


def test_near_copies_are_those_of_all_pairs(stages):
    before, after = stages["near_copies"]
    assert set(texts_of(after)) == kept_by_all_pairs(texts_of(before), 8, 10)


def test_no_passage_is_left_twice(stages):
    before, after = stages["passages"]
    old, new = texts_of(before), texts_of(after)
    assert set(old) == set(new)
    seen = {}
    for i, t in new.items():
        for at, w in enumerate(windows(t)):
            assert seen.setdefault(w, (i, at))[0] == i, (i, seen[w])
    times = {}
    for i, t in old.items():
        for w in windows(t):
            times[w] = times.get(w, 0) + 1
    clean = {i for i, t in old.items() if all(times[w] == 1 for w in windows(t))}
    lines = {}
    for i, t in old.items():
        for n, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= 20:
                lines[i, n] = shingles(line)
    alike = {i for (i, _), x in lines.items() if any(k != (i, _) and len(x & y) >= 0.8 * len(x | y) for k, y in lines.items())}
    changed = {i for i in old if old[i] != new[i]}
    assert not changed & (clean - alike)


def test_order_of_the_mix(stages):
    before, after = stages["mixing"]
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_encoded_texts_have_their_place_in_the_mix(spark):
    import corpus_pipeline as p
    from lumenlog.llm.mixing import mixed
    from lumenlog.llm.shared import written

    docs, stage = spark.read.parquet(f"{DATA}/documents.parquet"), dict(p.STAGES)
    stored = written(stage["mixing"](spark, docs, DATA).repartitionByRange(5, "doc_id"), "other"), written(stage["mixing"](spark, docs, DATA), "mixing")
    want = [r.doc_id for r in mixed(docs, p.MIX).orderBy("slot", "offset").collect()]
    other, got = ({r.place: r.doc_id for r in stage["pieces"](spark, x, DATA).select("doc_id", "place").collect()} for x in stored)
    assert [got[i] for i in range(len(docs.collect()))] == want
    assert sorted(other) == sorted(got) and other != got  # another order gives other places


def test_pieces_are_the_librarys(stages):
    import numpy as np

    from lumenlog.llm.pieces import pieces

    model = pieces("piece_bpe_32k.model").model
    before, after = stages["pieces"]
    want = {i: zlib.crc32(np.array(model.encode(t or ""), "<u4").tobytes()) for i, t in texts_of(before).items()}
    rows = after.collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == want and all(r.decoded for r in rows)


def test_stages_with_clashing_names(spark, odd_docs):
    import corpus_pipeline as p

    for name in ("near_copies", "passages", "mixing"):
        after = dict(p.STAGES)[name](spark, odd_docs, DATA)
        assert after.columns == odd_docs.columns and after.filter("whole <> 'own whole'").count() == 0 < after.count(), name
