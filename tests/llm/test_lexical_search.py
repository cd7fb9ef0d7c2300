import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(A_Z))


def brute(docs, queries, k):
    """docs, queries: id, text. Every document is scored."""
    held = [(i, t) for i, x in docs if (t := terms(x))]
    n, total = len(held), sum(len(t) for _, t in held)
    df = {w: sum(w in set(t) for _, t in held) for w in {w for _, t in held for w in t}}
    asked = {}
    for i, x in queries:
        asked.setdefault(i, set()).update(terms(x))
    out = []
    for item, own in asked.items():
        scores = []
        for i, t in held:
            m = 100 - 50 + (50 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in own if w in t)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, queries, k):
    index = ls.built(docs)
    return sorted(map(tuple, ls.ranked(index, queries, k).collect()), key=str)


@pytest.mark.parametrize("top", [1, 200, 1 << 16, 1 << 30])
def test_variable_bytes(top):
    v = np.random.default_rng(top).integers(0, top, 1000)
    held, size = ls.packed(v)
    assert len(held) == size.sum() and (ls.unpacked(held) == v).all()
    assert len(ls.unpacked(ls.packed(np.empty(0, np.int64))[0])) == 0


@pytest.mark.parametrize("block, shard_docs, first", [(128, 1 << 16, 16), (4, 50, 1), (1, 7, 2)])
def test_against_brute_force(spark, monkeypatch, block, shard_docs, first):
    """Terms by a steep law, so that lists are long and bounds pass blocks over."""
    monkeypatch.setattr(ls, "BLOCK", block)
    monkeypatch.setattr(ls, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ls, "FIRST", first)
    monkeypatch.setattr(ls, "pieces_of", lambda texts: ([(t.as_py() or "").encode() for t in texts[a : a + 5]] for a in range(0, len(texts), 5)))
    rng = random.Random(block)
    word = lambda: rng.choice(["w", "é", "中", "X"]) + str(int(rng.paretovariate(0.7)) % 200)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(600)]
    docs += [(i + 1000, docs[i % 30][1]) for i in range(100)]  # ties
    queries = [(q, "-".join(word() for _ in range(rng.randint(1, 12)))) for q in range(25)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    assert found(spark, *frames, 10) == brute(docs, queries, 10)


def test_blocks_below_the_threshold_stay_packed(monkeypatch):
    """One document holds both terms; blocks of the frequent one that are far from it are never read."""
    monkeypatch.setattr(ls, "FIRST", 1)
    b = ls.Builder(4000, 12000)
    b.add([b"common filler filler" if i != 2500 else b"common rare rare rare" for i in range(4000)], list(range(4000)))
    own, *rest = b.rows(0)
    shard = next(ls.shards(iter([own, *rest])))
    best = ls.Best(1)
    shard.search([(b"common", 3), (b"rare", 9000)], best)
    assert best.doc.tolist() == [2500]
    assert shard.lists[b"common"].read.sum() == 1 and shard.lists[b"filler"].read.sum() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    asked = [(1, "Hello WORDS line 中文 İstanbul"), (1, "no one"), (2, None), (3, "..."), (4, "wort x absent"), (None, "two")]
    queries = spark.createDataFrame([(*q, "k") for q in asked], "item_id long, text string, rank string").withColumn("doc_id", F.lit(1))
    assert found(spark, odd_docs, queries, 50) == brute(rows, asked, 50)
    assert found(spark, odd_docs, queries, 2) == brute(rows, asked, 2)
    assert found(spark, no_docs, queries, 5) == [] and found(spark, odd_docs, queries.limit(0), 5) == []


def test_queries_in_chunks(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(ls, "CHUNK_BYTES", 10)
    asked = [(i, w) for i, w in enumerate(["hello words", "two", "one line", "wort"])]
    queries = spark.createDataFrame(asked, "item_id long, text string")
    assert found(spark, odd_docs, queries, 50) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], asked, 50)


def test_a_word_of_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "y " * 500_000), (3, "x y")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "y"), (2, "x" * 1_000_000)], "item_id long, text string")
    assert [tuple(r)[:3] for r in ls.ranked(ls.built(docs), queries).orderBy("item_id", "rank").collect()] == [(1, 1, 2), (1, 2, 3), (2, 1, 1)]
