"""Matching in rounds keeps the pairs of the loop."""

import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import intervals, patterns
from lumenlog.operators.matching import one_to_one


def loop(pairs, key):
    taken, keep = set(), []
    for p in sorted(pairs, key=key):
        if ("a", *p[:2]) not in taken and ("b", p[0], p[2]) not in taken:
            taken |= {("a", *p[:2]), ("b", p[0], p[2])}
            keep.append(p)
    return sorted(map(str, keep))


@pytest.mark.parametrize("few", [0, 30, 10_000])
@pytest.mark.parametrize("groups", [1, 6])
def test_rounds_are_as_the_loop(spark, few, groups):
    rng = random.Random(groups)
    pairs = list({(rng.choice([None, *range(groups)]) if groups > 1 else 0, rng.randrange(40), rng.randrange(40), rng.choice([0.1, 0.5, 0.5, rng.random()])) for _ in range(400)})
    best = {}
    for p in pairs:
        best[p[:3]] = max(best.get(p[:3], 0), p[3])
    df = spark.createDataFrame(pairs, "g int, p int, t int, s double")
    got = one_to_one(df, ["g"], "p", "t", [F.col("s"), F.col("p"), F.col("t")], few)
    assert got.columns == df.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == loop([(*k, s) for k, s in best.items()], lambda p: (-p[3], -p[1], -p[2]))


def test_a_chain(spark):
    """Each pair waits for the one before it."""
    n = 40
    df = spark.createDataFrame([(i, i + d, float(2 * (n - i) - d)) for i in range(n) for d in (0, 1)], "p int, t int, s double")
    assert sorted((r.p, r.t) for r in one_to_one(df, [], "p", "t", [F.col("s")], few=70).collect()) == [(i, i) for i in range(n)]


def test_no_pairs_and_missing_ends(spark):
    df = spark.createDataFrame([(1, None, 0.5), (None, 1, 0.4), (2, 2, 0.3)], "p int, t int, s double").withColumn("g", F.lit(1))
    assert [(r.p, r.t) for r in intervals.greedy_match(df, ["g"], "p", "t", "s").collect()] == [(2, 2)]
    assert intervals.greedy_match(df.limit(0), ["g"], "p", "t", "s").count() == 0


def holds(longer, shorter):
    return f"->{shorter}->" in f"->{longer}->"


@pytest.mark.parametrize("a_may, b_may", [(False, False), (True, False), (False, True), (True, True)])
def test_lists_are_matched_in_order(spark, a_may, b_may):
    rng = random.Random(8)
    make = lambda n: [(b, i, "->".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for b in ("x", "y") for i in range(n)]
    a, b = make(25), make(20)
    found, scores = patterns.listed_matches(*(spark.createDataFrame(x, "part string, place int, sequence string") for x in (a, b)), ["part"], a_may, b_may)
    want, counts = [], {}
    for part in ("x", "y"):
        left = [g for g in b if g[0] == part]
        own = [p for p in a if p[0] == part]
        for _, i, s in own:
            hit = next((g for g in left if g[2] == s or a_may and holds(s, g[2]) or b_may and holds(g[2], s)), None)
            if hit:
                left.remove(hit)
                want.append((part, i, hit[1]))
        tp = len(own) - sum(1 for p in own if (part, p[1]) not in {w[:2] for w in want})
        counts[part] = (tp, len(own) - tp, len(left))
    assert sorted((r.part, r.prediction, r.truth) for r in found.collect()) == sorted(want)
    assert {r.part: (r.tp, r.fp, r.fn) for r in scores.collect()} == counts


def test_scores_of_an_empty_list(spark):
    a = spark.createDataFrame([(1, "a")], "place int, sequence string")
    assert tuple(patterns.listed_matches(a, a.limit(0), [])[1].first()) == (0, 1, 0, 0.0, 0.0, 0.0)
