"""Greedy one-to-one matching in rounds.

Taking pairs in an order and leaving out those with an end that is taken gives the same pairs as this: a pair that is the first of both its ends is matched, all pairs with
these ends go, and so on. A round is two aggregations and three equi-joins by end, so a group's pairs are spread over all tasks. The
number of rounds is that of the longest chain of pairs that wait for each other, short unless the order itself is a chain; what a round
leaves is finished in one step when it is few.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.shared import dropped, stored

#: Pairs that one task finishes.
FEW = 50_000


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The loop itself, over few pairs that come with their place in the order."""
    taken_a, taken_b, keep = set(), set(), []
    rows = rows.sort_values("_nth")
    for i, a, b in zip(rows.index, rows["_ka"], rows["_kb"]):
        if a not in taken_a and b not in taken_b:
            taken_a.add(a)
            taken_b.add(b)
            keep.append(i)
    return rows.loc[keep]


def one_to_one(pairs: DataFrame, group: list[str], a: str, b: str, rank: list[Column], few: int = FEW) -> DataFrame:
    """The rows of pairs that are matched: in each group by falling rank, a pair is kept if neither of its ends has been. Of rows with the same ends and rank one is kept, the greatest by its other columns.

    Ends are told apart in their group; null keys of a group are a group as any other; pairs without an end are left out.
    """
    columns = pairs.columns
    row = F.struct(*(x.alias(f"_rank{i}") for i, x in enumerate(rank)), a, b, *(F.col(c) for c in columns if c not in (a, b)))
    ends = pairs.select(F.struct(*(F.col(c) for c in group), F.lit(0).alias("_all")).alias("_g"), F.col(a).alias("_a"), F.col(b).alias("_b"), row.alias("_r")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    left = stored(ends.groupBy("_g", "_a", "_b").agg(F.max("_r").alias("_r")))
    found = []
    while (n := left.count()) > few:
        firsts = left.groupBy("_g", "_a").agg(F.max("_r").alias("_r")).join(left.groupBy("_g", "_b").agg(F.max("_r").alias("_r")), ["_g", "_r"])
        found.append(stored(firsts.select("_g", "_a", "_b", "_r")))
        before, left = left, stored(left.join(found[-1].select("_g", "_a"), ["_g", "_a"], "left_anti").join(found[-1].select("_g", "_b"), ["_g", "_b"], "left_anti").select("_g", "_a", "_b", "_r"))
        dropped(before)
    if n:
        # pandas compares no structs: the rows' order is a number, and ends are their text
        held = left.select("_g", "_a", "_b", "_r", F.to_json(F.struct("_a")).alias("_ka"), F.to_json(F.struct("_b")).alias("_kb"))
        last = held.select(F.struct("_a", "_b", "_r").alias("_row"), F.to_json("_g").alias("_kg"), "_g", "_ka", "_kb")
        found.append(_finished(last))
    if not found:
        return pairs.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    values = {c: F.col("_r")[f"{c}"] for c in columns if c not in (a, b)} | {a: F.col("_a"), b: F.col("_b")}
    return out.select(*(values[c].alias(c) for c in columns))


def _finished(last: DataFrame) -> DataFrame:
    numbered = last.withColumn("_nth", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_row._r"))))
    kept = numbered.select("_kg", "_nth", "_ka", "_kb").groupBy("_kg").applyInPandas(_in_order, "_kg string, _nth int, _ka string, _kb string")
    return numbered.join(kept.select("_kg", "_nth"), ["_kg", "_nth"], "left_semi").select("_g", "_row._a", "_row._b", "_row._r")
