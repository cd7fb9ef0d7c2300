"""Scans over very long series: a key's rows are cut into blocks, so that no task holds a key.

A window over a whole key is one task for it, however long its log. Here windows reach over a block only (a column of rows that rises with their order, such as
the date), each block leaves one row of summary behind, one window over the summaries of a key carries values from block to block, and an equi-join on
(key, block) brings them back to the rows. What one task holds of a key is a block, or a row for each of its blocks.

Rows whose keys or block are null are left out. Order columns have to tell the rows of a key apart, but for sums and the like over rows of one order. Without keys all rows are one series, whose
summaries, a row a block, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "_block"
FOLDS = {"last": F.last, "sum": F.sum, "max": F.max, "min": F.min, "bit_or": F.bit_or}


def daily(ts: str = "ts", days: int = 1) -> Column:
    """A block for each stretch of days."""
    return F.floor(F.unix_date(F.to_date(ts)) / F.lit(days))


def neighbours(rows: DataFrame, keys: list[str], block: Column, order: tuple[str, ...], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Adds columns with values of the key's row before (`before`) and behind (`after`), null at its first and last: lag and lead over blocks."""
    held = rows.withColumn(_BLOCK, block).filter(F.col(_BLOCK).isNotNull())
    w, at = Window.partitionBy(*keys, _BLOCK).orderBy(*order), Window.partitionBy(*keys).orderBy(_BLOCK)
    local, carried, ends, out = {}, [], [], {}
    for side, columns, inside, over, end in (("_b", before, F.lag, F.lag, F.max), ("_a", after, F.lead, F.lead, F.min)):
        if not columns:
            continue
        values = F.struct(*(c.alias(f"v{i}") for i, c in enumerate(columns.values())))
        local[f"{side}_near"] = inside(values).over(w)
        ends.append(end(F.struct(*order, values.alias("_v"))).alias(f"{side}_end"))
        carried.append(over(F.col(f"{side}_end._v")).over(at).alias(f"{side}_far"))
        # a struct is null only where there is no row: in the block first, then in the blocks beside it
        out |= {name: F.coalesce(F.col(f"{side}_near"), F.col(f"{side}_far"))[f"v{i}"] for i, name in enumerate(columns)}
    summary = held.groupBy(*keys, _BLOCK).agg(*ends).select(*keys, _BLOCK, *carried)
    return held.withColumns(local).join(summary, [*keys, _BLOCK]).select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def folded(rows: DataFrame, keys: list[str], block: Column, order: tuple[str, ...], folds: dict[str, tuple[str, Column]], itself: bool = True) -> DataFrame:
    """Adds running values up to each row, with or without itself: for each name a kind (last non-null, sum, max, min, bit_or) and what it runs over."""
    held = rows.withColumn(_BLOCK, block).filter(F.col(_BLOCK).isNotNull())
    w = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local, ends, carried, out = {}, [], [], {}
    for i, (name, (kind, value)) in enumerate(folds.items()):
        over = (lambda x: F.last(x, ignorenulls=True)) if kind == "last" else FOLDS[kind]
        local[f"_l{i}"] = over(value).over(w)
        whole = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v"))))["_v"] if kind == "last" else FOLDS[kind](value)
        ends.append(whole.alias(f"_e{i}"))
        carried.append(over(F.col(f"_e{i}")).over(before).alias(f"_c{i}"))
        near, far = F.col(f"_l{i}"), F.col(f"_c{i}")
        both = {"last": lambda a, b: a, "sum": lambda a, b: a + b, "max": F.greatest, "min": F.least, "bit_or": lambda a, b: a.bitwiseOR(b)}[kind]
        out[name] = F.coalesce(both(near, far), near, far)
    summary = held.groupBy(*keys, _BLOCK).agg(*ends).select(*keys, _BLOCK, *carried)
    return held.withColumns(local).join(summary, [*keys, _BLOCK]).select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def numbered(rows: DataFrame, keys: list[str], block: Column, order: tuple[str, ...], name: str = "place") -> DataFrame:
    """Adds the place of each row in its key, from 0."""
    return folded(rows, keys, block, order, {"_place": ("sum", F.lit(1).cast("long"))}).withColumn("_place", F.col("_place") - 1).withColumnRenamed("_place", name)
