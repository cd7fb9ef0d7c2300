"""Exact percentiles of groups of any size, without a buffer that holds a group.

Rows are counted by value first, which combines before the shuffle and spreads a group over all tasks. Groups of few values then take the built-in percentile, weighted by these counts.
Larger ones are searched: their range is cut into cells, the cells are counted, and only the cell in which a rank falls is looked at again, until it holds few values. What one
task holds of a group is MOST values, or a row for each of CELLS cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.shared import dropped, stored

#: Values of a group that one task may hold.
MOST = 100_000
CELLS = 1024


def _cell(v: Column, lo: Column, hi: Column, log: bool) -> Column:
    """The cell of a value: equal steps of the range, or of its logarithm, where a few large values make the range wide."""
    scale = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if log else (lambda x: x)
    width = scale(hi) - scale(lo)
    return F.when(width > 0, F.least(F.floor((scale(v) - scale(lo)) / width * CELLS), F.lit(CELLS - 1))).otherwise(F.lit(0)).cast("long")


def _selected(counted: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """_k, _r, _x: the value at each rank (from 0) of groups; counted: _k, _v, _n; ranks: _k, _r, _lo, _hi."""
    state, log = stored(ranks.withColumn("_below", F.lit(0).cast("long"))), False
    while True:
        inside = counted.join(state, "_k").filter("_v BETWEEN _lo AND _hi")
        if (inside.groupBy("_k", "_r").agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0] or 0) <= most:
            break
        log = not log
        cells = inside.groupBy("_k", "_r", "_below", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), log).alias("_cell")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy("_k", "_r").orderBy("_cell"))  # a row a cell
        before, state = state, stored(cells.withColumn("_upto", F.col("_below") + upto).filter("_r < _upto AND _r >= _upto - _n").select("_k", "_r", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below")))
        dropped(before)
    upto = F.col("_below") + F.sum("_n").over(Window.partitionBy("_k", "_r").orderBy("_v"))
    return inside.withColumn("_upto", upto).filter("_r < _upto AND _r >= _upto - _n").select("_k", "_r", F.col("_v").alias("_x"))


def percentiles(rows: DataFrame, by: list[str], value: str | Column, at: dict[str, float | list[float]], most: int = MOST) -> DataFrame:
    """by, and for each name of `at` the percentile there (from 0 to 1; a list gives an array), by straight lines between values. Nulls are left out; a group without a value has no row."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counted = stored(rows.select(F.struct(*(F.col(c) for c in by), F.lit(0).alias("_all")).alias("_k"), v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n")))
    points = sorted({q for x in at.values() for q in (x if isinstance(x, list) else [x])})
    of = lambda found: [F.transform(F.array(*map(F.lit, x)), lambda q: found[q]).alias(n) if isinstance(x, list) else found[F.lit(x)].alias(n) for n, x in at.items()]
    sizes = counted.groupBy("_k").agg(F.count(F.lit(1)).alias("_d"), F.sum("_n").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    built_in = lambda x: x.groupBy("_k").agg(F.map_from_arrays(F.array(*map(F.lit, points)), F.percentile("_v", points, F.col("_n"))).alias("_f"))
    large = sizes.filter(F.col("_d") > most)
    if not large.take(1):
        found = built_in(counted)
    else:
        large = stored(large)
        place = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), ((F.col("_size") - 1) * F.lit(q)).alias("p")) for q in points)))
        wanted = large.select("_k", "_lo", "_hi", place.alias("_q")).select("_k", "_lo", "_hi", "_q.q", F.floor("_q.p").alias("_a"), F.ceil("_q.p").alias("_b"), (F.col("_q.p") - F.floor("_q.p")).alias("_part"))
        ranks = wanted.select("_k", "_lo", "_hi", F.explode(F.array("_a", "_b")).alias("_r")).distinct()
        own = _selected(counted.join(large.select("_k"), "_k", "left_semi"), ranks, most)
        a, b = own.select("_k", F.col("_r").alias("_a"), F.col("_x").alias("_xa")), own.select("_k", F.col("_r").alias("_b"), F.col("_x").alias("_xb"))
        line = wanted.join(a, ["_k", "_a"]).join(b, ["_k", "_b"]).select("_k", "q", (F.col("_xa") + (F.col("_xb") - F.col("_xa")) * F.col("_part")).alias("_x"))
        searched = line.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("q", "_x"))).alias("_f"))
        found = built_in(counted.join(large.select("_k"), "_k", "left_anti")).unionAll(searched)
    return found.select(*(F.col("_k")[c].alias(c) for c in by), *of(F.col("_f")))


def joined(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Rows of groups with their percentiles; null keys are a group as any other."""
    keys = [f"_key{i}" for i in range(len(by))]
    other = found.withColumnsRenamed(dict(zip(by, keys)))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)] or None
    return rows.join(other, on, "left").drop(*keys)
