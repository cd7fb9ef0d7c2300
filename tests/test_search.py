"""Search over a trie finds what a loop over all places and patterns finds."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import blocks, search


def rows_of(seed, n, homes=2, states="aabbcx"):
    rng, rows, at = random.Random(seed), [], {}
    for i in range(n):
        home = 0 if rng.random() < 0.8 else rng.randrange(homes)
        start = at.get(home, 0)
        at[home] = start + rng.choice([3, 7, 3600])
        rows.append((home, start, at[home], i, rng.choice(states)))
    return rows


def loop(rows, patterns, other=None, most_skip=0.0):
    series, out = {}, {}
    for h, a, b, i, s in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        series.setdefault(h, []).append((a, b, s))
    for h, own in series.items():
        for i in range(len(own)):
            for p in patterns:
                want = p.split("->")
                if len(want) < 2:
                    continue
                ends = []
                cut = own[i : i + len(want)]
                if [x[2] for x in cut] == want:
                    ends.append(cut[-1][1])
                if other is not None:
                    longer = own[i : i + len(want) + 1]
                    for k in range(1, len(want)):
                        if len(longer) == len(want) + 1 and longer[k][2] == other and longer[k][1] - longer[k][0] <= most_skip and longer[k + 1][2] != other and [x[2] for j, x in enumerate(longer) if j != k] == want:
                            ends.append(longer[-1][1])
                if ends:
                    out[h, p, own[i][0]] = min(ends)
    return sorted((*k, v) for k, v in out.items())


def found(spark, rows, patterns, **named):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    series = spark.createDataFrame(rows, "home int, a int, b int, ord long, state string").withColumns({"start_time": F.timestamp_add("SECOND", F.col("a"), start), "end_time": F.timestamp_add("SECOND", F.col("b"), start)})
    got = search.occurrences(series, ["home"], spark.createDataFrame([(p,) for p in patterns], "sequence string"), **named)
    since = lambda t: int((t - start_of).total_seconds())
    import datetime

    start_of = datetime.datetime(2024, 1, 1)
    return sorted((r.home, r.sequence, since(r.start_time), since(r.end_time)) for r in got.collect())


@pytest.mark.parametrize("step, other, most", [(4096, None, 0.0), (4096, "x", 7.0), (8, None, 0.0), (8, "x", 3.0), (2, "x", 7.0), (2, "z", 9.0)])
def test_random_series(spark, monkeypatch, step, other, most):
    monkeypatch.setattr(search, "STEP", step)
    rng, rows = random.Random(step), rows_of(step, 300)
    patterns = ["a", "a->a", "x->x", "b->x->b", "q->a"] + ["->".join(rng.choice("abcx") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    assert found(spark, rows, patterns, other=other, most_skip=most) == loop(rows, patterns, other, most)


def test_a_thousand_patterns_of_up_to_fifty_states(spark, monkeypatch):
    monkeypatch.setattr(search, "STEP", 64)
    monkeypatch.setattr(search, "PASS_BYTES", 40_000)
    rng, rows = random.Random(6), rows_of(6, 1500, states="abcdefgh")
    one = [r[4] for r in sorted((r for r in rows if r[0] == 0), key=lambda r: r[3])]
    patterns = set()
    while len(patterns) < 1000:
        n, i = rng.randint(2, 50), rng.randrange(len(one) - 50)
        p = one[i : i + n]
        if rng.random() < 0.3:
            p[rng.randrange(n)] = rng.choice("abcdefgh")
        patterns.add("->".join(p))
    assert found(spark, rows, sorted(patterns), block=blocks.daily("start_time")) == loop(rows, patterns)


def test_nothing_to_find(spark):
    rows = rows_of(1, 20)
    assert found(spark, rows, []) == [] and found(spark, rows, ["q->r"], other="x", most_skip=1.0) == []
    assert found(spark, [], ["a->b"]) == []
