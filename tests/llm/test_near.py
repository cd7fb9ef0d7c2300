import os
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from lumenlog.llm import components, jaccard_join, substring_dedup


def brute(texts, n, num, den):
    """doc -> (size, smallest doc that links reach), comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and sets[x] and sets[y] and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, n_docs, size):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(size)] for _ in range(8)]
    out = []
    for i in range(n_docs):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w[: r.choice([size, size, size - 3])])))
    return out + [(1000, "short text"), (1001, "Short  TEXT"), (1002, ""), (1003, None), (1004, "one"), (1005, "ONE")]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10), (1, 5, 10)])
def test_classes_are_those_of_all_pairs(spark, n, num, den):
    rows = copies(n, 120, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def test_classes_of_odd_documents(spark, odd_docs, no_docs):
    got = sorted(map(tuple, jaccard_join.classes(odd_docs, 3, 90, 100).collect()), key=str)
    by_id = {}
    for doc_id, n, c in got:
        by_id.setdefault(doc_id, []).append((n, c))
    assert len(got) == odd_docs.count() and by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)]
    assert by_id[7] == [(10, 5), (10, 5)] and by_id[5] == [(10, 5)] and by_id[6][0][1] == 4 and by_id[None][0] == (1, None)
    assert jaccard_join.classes(no_docs, 3, 90, 100).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = jaccard_join.representatives(odd_docs, 5, 8, 10)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 8, 9, None]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (200, 201), (201, 200)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k <= 60} == {i: 0 for i in range(61)}
    assert {v for k, v in got.items() if 100 <= k < 140} == {100} and got[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_words_are_told_apart(spark):
    a = "ab"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.classes(docs, 3, 90, 100).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    words = f"{passage(3, 60)}"
    docs = spark.createDataFrame([(1, f"{words} {a} {words[::-1]}"), (2, f"{passage(4, 60)} {b} {passage(5, 60)}")], "doc_id long, text string")
    assert substring_dedup.passages(docs).count() == 0


@pytest.mark.parametrize("num,den", [(90, 100), (8, 10), (5, 10), (3, 10)])
def test_sets_at_the_threshold_share_a_key(num, den):
    """Any two sets that reach the threshold have a key in common, at every size."""
    r = random.Random(num)
    for size in [*range(1, 40), 60, 100, 257, 1000]:
        for _ in range(12):
            other = r.randint(-(-num * size // den), size)
            both = -(-num * (size + other) // (den + num))
            if both > min(size, other):
                continue
            common = [r.getrandbits(64) for _ in range(both)]
            x, y = (np.unique(np.array([*common, *(r.getrandbits(64) for _ in range(n - both))], np.uint64)) for n in (size, other))
            assert (x.tolist() == y.tolist()) or set(jaccard_join.fragment_keys(x, num, den).tolist()) & set(jaccard_join.fragment_keys(y, num, den).tolist()), (size, other)


def passage(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"p{r.randrange(5000)}" for _ in range(n))


def test_passages(spark):
    p, q = passage(1), passage(2)
    near = p.split()
    near[30] = "other"
    rows = [(1, f"own words of one\n{p}"), (2, f"{passage(5)}\n{p}\nend"), (3, f"start\n{' '.join(near)}"), (4, passage(6)), (5, f"{q}\n{q}"), (6, "The.\nThe."), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.para): (r.first_doc_id, r.first_para, r.removed) for r in substring_dedup.repeated(docs).collect()}
    assert got == {(1, 1): (1, 1, False), (2, 1): (1, 1, True), (3, 1): (1, 1, True), (5, 0): (5, 0, False), (5, 1): (5, 0, True)}
    texts = {r.doc_id: r.text for r in substring_dedup.cleaned(docs).collect()}
    assert texts == {**dict(rows), 2: f"{passage(5)}\nend", 3: "start", 5: q}


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tuned(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= substring_dedup.RECALL > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_cleaning_odd_documents(spark, odd_docs, no_docs):
    got = substring_dedup.cleaned(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    assert {r.doc_id: r.text for r in got.collect()}[6] == ""  # all of it stands in document 4
    assert substring_dedup.cleaned(no_docs).count() == 0 and substring_dedup.repeated(no_docs).count() == 0


def test_runs_inside_and_across_lines(spark):
    """Passages of 50 words or more that lie inside longer lines, over line ends or in lines of a few words are found to the word, and cut."""
    p, q, s = passage(11, 55), passage(12, 70), passage(13, 50)
    short = "\n".join(" ".join(q.split()[i : i + 7]) for i in range(0, 70, 7))
    rows = [
        (1, f"{passage(21, 200)} {p} {passage(22, 200)}"),
        (2, f"{passage(23, 150)} {p.upper()} {passage(24, 90)}\nlast line"),
        (3, f"{passage(25, 30)}\n{short}\n{passage(26, 30)}"),
        (4, f"{passage(27, 90)} {q}\n{passage(28, 30)}"),
        (5, f"{passage(29, 80)} {s} {passage(30, 80)}"),
        (6, f"{passage(31, 80)} {' '.join(s.split()[:49])} {passage(32, 80)}"),
        (7, f"a b {p} c d {p}"),
        (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.n_words, r.first_doc_id, r.removed) for r in substring_dedup.passages(docs).collect()}
    assert got == {(1, 200, 55, 1, False), (2, 150, 55, 1, True), (3, 30, 70, 3, False), (4, 90, 70, 3, True), (7, 2, 55, 1, True), (7, 59, 55, 1, True)}
    texts = {r.doc_id: r.text for r in substring_dedup.cleaned(docs).collect()}
    assert texts == {**dict(rows), 2: f"{passage(23, 150)} {passage(24, 90)}\nlast line", 4: f"{passage(27, 90)}\n{passage(28, 30)}", 7: "a b c d"}


def test_a_text_that_repeats_itself_keeps_a_run(spark):
    docs = spark.createDataFrame([(1, "start " + "ha " * 300 + "end")], "doc_id long, text string")
    assert substring_dedup.cleaned(docs).first().text == "start " + "ha " * 50 + "end"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_runs_are_those_of_all_windows(spark):
    """All words that stand in a stretch of 50 words that comes twice, by comparing all stretches of the smallest table, against the places that are found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").withColumn("text", F.translate("text", "\n", " "))
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    firsts, removed = {}, set()
    for i in sorted(texts):
        for at in range(len(texts[i]) - 49):
            first = firsts.setdefault(tuple(texts[i][at : at + 50]), (i, at))
            if first != (i, at):  # of a text that repeats itself, the words of the first place stay
                removed.update((i, at + k) for k in range(50) if first[0] != i or at + k >= first[1] + 50)
    assert removed
    got = set()
    for r in substring_dedup.passages(docs, min_words=1 << 30).filter("removed").collect():
        got.update((r.doc_id, r.start + k) for k in range(r.n_words))
    own = {(i, w) for i, w in got if (i, w) not in removed}
    assert removed <= got and not own


def test_full_maps_change_nothing(spark, monkeypatch):
    """Maps of 64 places, which let nearly everything through, give what maps that fit give."""
    from lumenlog.llm import jaccard_join, near, substring_dedup

    rng = random.Random(21)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    shared, texts = words(70), []
    for i in range(40):
        own = words(rng.randint(10, 80))
        if i % 3 == 0:
            own[5:5] = shared
        if i % 4 == 0 and texts:
            own = texts[rng.randrange(len(texts))].split(" ")
            own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own[:30]) + "\n" + " ".join(own[30:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    both = lambda: [sorted(map(str, x.collect())) for x in (jaccard_join.classes(docs), substring_dedup.passages(docs))]
    want = both()
    assert near.map_bits(0, 26, 16) == 12 and near.map_bits(1000, 26, 16) == 14 and near.map_bits(1 << 40, 26, 16) == 26
    monkeypatch.setattr(near, "map_bits", lambda n, most, each: 6)
    assert both() == want and len(want[1]) > 10


def test_tasks_without_tables_let_those_of_others_go():
    """A worker that has encoded or scored texts doesn't hold their tables while it counts."""
    import pyarrow as pa

    from lumenlog.llm import chunks, shared

    class Rows:
        tasks = []

        def mapInArrow(self, run, schema):
            self.tasks.append(run)
            return self

        def repartition(self, *by):
            return self

        def collect(self):
            return []

    shared.counted(Rows(), lambda rows: np.array([len(x) for x in rows]), 8)
    try:
        for task, rows in zip(Rows.tasks, (["a", "bb"], None)):
            chunks.of_worker("sampler", "some", list)
            batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"]) if rows else held[0]
            held = list(task(iter([batch])))
            assert held and not chunks._tables
    finally:
        chunks._tables.clear()
