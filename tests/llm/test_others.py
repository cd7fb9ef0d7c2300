import random
import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import mixing, sharding, toxicity, vector_search


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, odd_docs, no_docs, law):
    got = sharding.shard(odd_docs, shards=4, law=law).collect()
    assert len(got) == odd_docs.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    assert all((r["size"], r.text_crc32, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), None) for r in got)
    if law == "rows":
        n = [sum(r.shard == s for r in got) for s in range(4)]
        assert max(n) - min(n) <= 1
    assert sharding.shard(no_docs, shards=4, law=law).count() == 0


def test_shards_of_a_hot_text_are_near_equal(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 20)).otherwise(F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 9).cast("int"))).alias("text"))
    sizes = [r[0] for r in sharding.shard(docs, shards=10).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * (8 * 32 + 16)


def test_shards_by_a_brute_force_version(spark):
    """Ranks and shards from the definition: rows in the order of (text hash, second hash); the middle of a row, or of a light text's rows, decides."""
    docs = spark.range(3000).select((F.col("id") * 7).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 9)).when(F.col("id") % 3 == 1, F.concat(F.lit("copy "), F.col("id") % 200)).otherwise(F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 60).cast("int"))).alias("text"))
    keyed = docs.select("doc_id", (F.octet_length("text") + 16).alias("size"), sharding._hash(F.col("text")).alias("key"), sharding._hash(F.col("doc_id").cast("string")).alias("sub")).collect()
    keyed.sort(key=lambda r: (r.key, r.sub))
    total, shards, at, weight = sum(r["size"] for r in keyed), 7, 0, {}
    for r in keyed:
        weight[r.key] = weight.get(r.key, 0) + r["size"]
    want, first = {}, {}
    for r in keyed:
        begin = first.setdefault(r.key, at)
        light = weight[r.key] <= int(sharding.TOGETHER * total / shards)
        want[r.doc_id] = min(shards - 1, (2 * begin + weight[r.key] if light else 2 * at + r["size"]) * shards // (2 * total))
        at += r["size"]
    got = sharding.shard(docs, shards).collect()
    assert {r.doc_id: r.shard for r in got} == want
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by_text.values()) == 1


def brute_top(rows, k):
    out = []
    for q, a in rows:
        if q is not None and q % 100 == 0:
            scored = sorted((-int(a @ b), c) for c, b in rows if c != q and len(a) == len(b))[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CHUNK_BYTES", 4000)  # several passes
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).astype(np.float32)) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(40)]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    want = brute_top([(i, np.floor(1024 * v.astype(np.float64)).astype(np.int64)) for i, v in rows], 10)
    assert sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 100 == 0).collect())) == want


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0]), (7, []), (None, [9.0, 9.0]), (100, [0.0, 1.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 5, 524288), (0, 2, 5, 524288), (0, 3, 100, 0), (100, 1, 5, 524288), (100, 2, 5, 524288), (100, 3, 0, 0), (200, 1, 7, 0)]
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 50, 137])
def test_top_k_of_large_components(spark, n):
    """Finite vectors of any size take part, and scores are exact whole numbers as long as a long holds them."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 6, 3)]) for i in range(n)] + [(1000 + 100 * i, [1.5e5 * i, 2.0, -3e5]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    held = [(i, [vector_search.whole(x) for x in v]) for i, v in rows]
    for q, a in held:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in held if c != q)[:10]
            want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(want)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])], df.schema)
    assert [(r.vec_id, r.score) for r in vector_search.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (3, (1 << 63) - 1), (2, -(1 << 63))]


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 97, "b": 2, "c": 1}])
def test_a_schedule_stays_within_a_block(weights):
    whole = mixing.whole(weights)
    order, total = mixing.schedule(whole), sum(whole.values())
    for s, w in whole.items():
        sent = np.cumsum([x == s for x in order])
        assert np.abs(sent - np.arange(1, total + 1) * w / total).max() < 1 and sent[-1] == w


def test_weights_that_do_not_fit_are_rounded():
    assert mixing.whole({"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}
    assert mixing.whole({"a": 1 / 3, "b": 2 / 7, "c": 0.1}) == {"a": 70, "b": 60, "c": 21}
    held = mixing.whole({"a": 1 / 3, "b": 2 / 7, "c": 0.1234567})
    assert abs(sum(held.values()) - mixing.MOST_SLOTS) <= 3


def brute_schedule(blocks, weights):
    """Slot by slot: of the blocks that may go out the one with the earliest deadline; a new phase where its source is dry."""
    left, out, phase, begin = dict(blocks), [], 0, 0
    while any(left.values()):
        live = {s: n for s, n in left.items() if n}
        whole = sum(mixing.fraction(weights[s]) for s in live)
        w, sent = {s: mixing.fraction(weights[s]) / whole for s in live}, dict.fromkeys(live, 0)
        for slot in range(sum(live.values()) + 1):
            ready = [s for s in live if math.floor(sent[s] / w[s]) <= slot]
            best = min(ready, key=lambda s: (math.ceil((sent[s] + 1) / w[s]), list(live).index(s)))
            if not left[best]:
                break
            out.append((best, begin + slot, phase))
            left[best], sent[best] = left[best] - 1, sent[best] + 1
        begin, phase = begin + slot, phase + 1
    return out


@pytest.mark.parametrize("blocks,weights", [({"a": 7, "b": 100, "c": 1}, {"a": 3, "b": 2, "c": 2}), ({f"s{i:02d}": (i * 7) % 11 + 1 for i in range(20)}, {f"s{i:02d}": i + 1 for i in range(20)}), ({"a": 50, "b": 50, "c": 9}, {"a": 1 / 3, "b": 0.5, "c": 1 / 6})])
def test_the_mix_is_that_of_a_simulation(spark, blocks, weights):
    """The slots of documents against a slot-by-slot simulation, with sources that run dry."""
    rows = [(i, s) for s, n in blocks.items() for i in range(n * 3)]
    docs = spark.createDataFrame([(k, s, "t") for k, (_, s) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mixed(docs, weights, block=3).select("source", "slot", "phase").distinct().collect()
    assert sorted((r.source, r.slot) for r in got) == sorted((s, slot) for s, slot, _ in brute_schedule(blocks, weights))


def test_phases_send_every_block():
    for p in [mixing.phases({"a": 7, "b": 100, "c": 1, "d": 0}, {"a": 3, "b": 2, "c": 2, "d": 9})]:
        assert p[0]["begin"] == 0 and all(x["begin"] <= y["begin"] for x, y in zip(p, p[1:])) and "d" not in p[0]["places"]


def test_mixing(spark, odd_docs, no_docs):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"), F.lit("t").alias("text"))
    got = mixing.mixed(docs, {"hot": 2, "s0": 1, "s1": 1}, block=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert sorted(slots) == list(range(len(slots))) and all(len({r.source for r in x}) == 1 and sorted(r.offset for r in x) == list(range(len(x))) for x in slots.values())
    odd = mixing.mixed(odd_docs, None, block=2)
    own = [c for c in odd_docs.columns if c not in ("phase", "slot", "offset")]
    assert odd.count() == odd_docs.count() and odd.columns == [*own, "phase", "slot", "offset"] and {r.slot for r in odd.collect()} == set(range(len({r.slot for r in odd.collect()})))
    ordered = mixing.in_order(odd_docs, None, block=2)
    assert ordered.columns == odd_docs.columns and {r.slot for r in ordered.collect()} == {"own slot"}
    assert mixing.mixed(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"hot": 0})


def test_restoring():
    text = ["the idiot and the clown are stupid and pathetic; a moron told them that this is trash"] * 50
    counts = np.bincount(toxicity.trigram_places(text), minlength=toxicity.LETTERS**3)
    r = toxicity.Restorer(counts)
    assert [r(w) for w in ("1d10t", "m0r0n", "stuuupid", "cl0wn", "tra5h", "s.t.u.p.i.d", "$tup1d")] == ["idiot", "moron", "stupid", "clown", "trash", "stupid", "stupid"]
    assert r("") == "" and not toxicity.disguised("plain") and toxicity.disguised("pl4in") and not toxicity.disguised("2024")


def test_toxicity(spark, odd_docs, no_docs):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 30))
        bad = i % 4 == 0
        if bad:
            w[3] = ["scoundrel", "sc0undrel", "scoundreeel", "s c o u n d r e l"][(i // 4) % 4] if i >= 200 else "Scoundrel!"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {r.doc_id: r for r in toxicity.scores(docs, held, out).collect()}
    assert all(got[i].predicted == t and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, t in labels)
    odd = toxicity.scores(odd_docs, spark.createDataFrame([(None, 1), (5, None), (7, 1), (7, 0)], "doc_id long, toxic int"), out).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scores(no_docs, held.limit(0), out).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i)} scoundrel" if i % 2 else "plain text") for i in range(26)], "doc_id long, text string")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    a = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    b = a.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    x, y = (sorted(map(tuple, toxicity.scores(docs, t, out).collect())) for t in (a, b))
    assert x == y


def words_of(text):
    counts = np.bincount(toxicity.trigram_places([text] * 50), minlength=toxicity.LETTERS**3)
    return toxicity.Words(toxicity.Restorer(counts))


def test_spelled_out_words_are_found_wherever_they_stand():
    words = words_of("please bring all these papers over before the incomprehensible scoundrel comes back again tomorrow morning")
    for before in ("please bring all these papers over before the meeting " * 3, "a" * 300):
        for word in ("scoundrel", "incomprehensible"):
            text = " ".join(before.replace(" ", "") + word)
            found = {f for whole in words.spaced(text) for f in toxicity._stretches(whole)}
            assert toxicity.features(word)[0] in found


@pytest.mark.parametrize("joint", ["\u00a0", "\u3000", ",", "/", ".", "_"])
def test_words_of_long_chunks_are_found(joint):
    words = words_of("please bring all these papers over before the incomprehensible scoundrel comes back again tomorrow morning")
    for word in ("scoundrel", "sc0undrel", "scoundreeel", "5coundre1"):
        for n in (6, 40):
            chunk = joint.join(["papers", "before", "morning"] * n + [word] + ["again"] * n)
            assert toxicity.features("scoundrel")[0] in words.of(chunk), (word, n)
    glued = "".join(["x1y"] * 100) + "s-c-o-u-n-d-r-e-l"
    assert toxicity.features("scoundrel")[0] in words.of(glued)


def test_other_scripts_count():
    words = words_of("please bring all these papers over")
    assert toxicity.features("\u0433\u0430\u0434\u043a\u0438\u0439".replace("\u0439", "\u0438"), 2)[0] in words.of("\u0413\u0430\u0434\u043a\u0438\u0439!")
    assert toxicity._places("\u5783\u573e") in words.of("\u4f60\u662f\u5783\u573e\u4eba\u3002")
    spelled = [w for w in words.spaced("\u0433 \u0430 \u0434 \u043a \u0438")]
    assert "\u0433\u0430\u0434\u043a\u0438" in spelled


def test_words_of_any_length_count(spark):
    """A word of 500 characters and one in Cyrillic letters that stand in toxic documents only."""
    long, cyrillic = "schurke" * 72, "\u043d\u0435\u0433\u043e\u0434\u044f\u0439"
    rows = [(i, f"word{chr(97 + i % 26)} text of its own {long if i % 4 == 0 else cyrillic if i % 4 == 1 else 'plain'}") for i in range(200)]
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.scores(docs, docs.select("doc_id", (F.col("doc_id") % 4 < 2).cast("int").alias("toxic")), out).collect()}
    assert got == {i: int(i % 4 < 2) for i in range(200)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_labels_are_met(spark):
    """Precision and recall on the labelled fifth that no fit has seen."""
    data = "/root/testdata/sf0.1"
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = toxicity.scores(spark.read.parquet(f"{data}/documents.parquet"), labels, out).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.75 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows) and len(rows) > 400


def test_bare_tokens_in_linear_time():
    import re
    import time

    from lumenlog.llm import toxicity

    def plain(token):
        token = token.strip(toxicity._ASIDE)
        return re.sub(r"([^\w])\1+$", "", token).strip(toxicity._ASIDE)

    rng = random.Random(2)
    for _ in range(20_000):
        token = "".join(rng.choice("a9_$€.é(") for _ in range(rng.randint(0, 9)))
        assert toxicity.bare(token) == plain(token), token
    began = time.time()
    toxicity.bare("a" + "." * 1_000_000 + "b" + "$" * 1_000_000)
    assert time.time() - began < 2
