"""Scores: label assignment, set metrics, counts by category, threshold grids, runs, strata, holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import ARROW, f1_of, safe_divide


def assign_best(overlaps: DataFrame, by: list[str], total: DataFrame) -> DataFrame:
    """by, category, overlap, confidence, support: the category with the most overlap (ties: the larger name); confidence is its share of the total duration."""
    sums = overlaps.groupBy(*by, "category").agg(F.sum("overlap").alias("overlap"), F.count(F.lit(1)).alias("support"))
    best = sums.groupBy(*by).agg(F.max(F.struct("overlap", "category", "support")).alias("b"))
    return best.join(total, by).select(*by, "b.category", "b.overlap", safe_divide(F.col("b.overlap"), F.col("duration")).alias("confidence"), "b.support")


def assign_set(overlaps: DataFrame, by: list[str], total: DataFrame, purity: float = 0.1, most: int = 3, default: str = "Other_ADL") -> DataFrame:
    """by, categories: those with a share of purity at least, and the best one, at most `most`, best first; the default where there is none."""
    sums = overlaps.filter("overlap > 0").groupBy(*by, "category").agg(F.sum("overlap").alias("overlap")).join(total, by)
    order = Window.partitionBy(*by).orderBy(F.desc("overlap"), "category")
    ranked = sums.withColumn("_r", F.row_number().over(order)).filter((F.col("_r") == 1) | (F.col("overlap") >= F.lit(purity) * F.col("duration"))).filter(F.col("_r") <= most)
    sets = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "category"))), lambda x: x["category"]).alias("categories"))
    return total.select(*by).join(sets, by, "left").select(*by, F.coalesce("categories", F.array(F.lit(default))).alias("categories"))


def true_sets(overlaps: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """by, labels, total: categories that hold `ratio` of the summed overlap at least, in order of name."""
    sums = overlaps.groupBy(*by, "category").agg(F.sum("overlap").alias("overlap"))
    shared = sums.withColumn("total", F.sum("overlap").over(Window.partitionBy(*by))).filter(F.col("overlap") >= F.lit(ratio) * F.col("total"))
    return shared.groupBy(*by, "total").agg(F.array_sort(F.collect_list("category")).alias("labels"))


def by_category(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds precision, recall and F1 to tp, fp, fn of each category."""
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*keys, "category", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"))


def averages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Macro (mean over categories), micro (from summed counts) and weighted (by tp + fn) F1."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    weighted = safe_divide(F.sum(F.col("f1") * (F.col("tp") + F.col("fn"))), tp + fn)
    return rows.groupBy(*keys).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), p.alias("micro_precision"), r.alias("micro_recall"), f1_of(p, r).alias("micro_f1"), weighted.alias("weighted_f1"))


def threshold_grid(candidates: DataFrame, predicted: DataFrame, supports: list[float], confidences: list[float]) -> DataFrame:
    """Confusion counts and F1 of predicted sequences for every pair of thresholds: candidates at or above both are the truth.

    The grid is a literal array in each row, so its size is that of the parameters, and one aggregation serves all pairs.
    """
    grid = F.array(*[F.struct(F.lit(s).alias("support_min"), F.lit(c).alias("confidence_min")) for s in supports for c in confidences])
    both = candidates.select("sequence", "support", "confidence").join(predicted.select("sequence").distinct().withColumn("_p", F.lit(True)), "sequence", "full")
    rows = both.select("support", "confidence", F.coalesce("_p", F.lit(False)).alias("p"), F.explode(grid).alias("g"))
    t = F.coalesce((F.col("support") >= F.col("g.support_min")) & (F.col("confidence") >= F.col("g.confidence_min")), F.lit(False))
    p = F.col("p")
    counts = rows.groupBy("g.support_min", "g.confidence_min").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    precision, recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    accuracy = safe_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"), accuracy.alias("accuracy"))


def over_runs(rows: DataFrame, keys: list[str], metrics: list[str], single: float | None = 0.0) -> DataFrame:
    """Mean and sample deviation of each metric over runs; with one run the deviation is `single`."""
    agg: list[Column] = [F.count(F.lit(1)).alias("n_runs")]
    for m in metrics:
        sd = F.when(F.count(m) > 1, F.stddev_samp(m)).otherwise(F.lit(single).cast("double"))
        agg += [F.avg(m).alias(f"{m}_mean"), sd.alias(f"{m}_sd")]
    return rows.groupBy(*keys).agg(*agg)


def common_runs(rows: DataFrame, method: str, run: str, metric: str, a: str, b: str) -> DataFrame:
    """run, a's metric, b's metric and their difference, of runs that both methods have."""
    one = rows.filter(F.col(method) == a).select(run, F.col(metric).alias("value_a"))
    two = rows.filter(F.col(method) == b).select(run, F.col(metric).alias("value_b"))
    return one.join(two, run).withColumn("delta", F.col("value_b") - F.col("value_a"))


def tertiles(rows: DataFrame, by: list[str], order: list[str], name: str = "frequency_band") -> DataFrame:
    """Low, Middle, High in equal parts; rows that are left over go to Low, then Middle."""
    third = F.ntile(3).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(name, F.element_at(F.array(F.lit("Low"), F.lit("Middle"), F.lit("High")), third))


def fixed_bins(count: Column | str, edges: tuple[int, ...] = (0, 1, 10, 100, 1000, 10000)) -> Column:
    """The label of the bin between two edges that holds a count; the last one is open."""
    c, out = F.col(count) if isinstance(count, str) else count, None
    for low, high in reversed(list(zip(edges, (*edges[1:], None)))):
        label = f"{low}+" if high is None else str(low) if high == low + 1 else f"{low}-{high - 1}"
        out = F.when(c >= low, F.lit(label)) if out is None else F.when((c >= low) & (c < high), F.lit(label)).otherwise(out)
    return out


def weighted_summary(rows: DataFrame, by: list[str], metric: str, weight: str) -> DataFrame:
    """Rows, plain mean and mean weighted by occurrences; null where weights sum to 0."""
    scored = F.col(metric).isNotNull()
    w = F.sum(F.when(scored, F.col(weight)))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(metric).alias("n_evaluable"), F.avg(metric).alias("mean"), F.when(w > 0, F.sum(F.col(metric) * F.col(weight)) / w).alias("weighted_mean"), F.sum(weight).alias("weight"))


def holdout_recurrence(patterns: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """How often patterns of a band recur: occurrences, days with one, eligible days, in train and test; supported: seen in the test days.

    patterns: band, sequence. train, test: home, date, band, sequence of all n-grams of the days.
    """

    def part(grams: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        seen = grams.groupBy("band", "sequence").agg(F.count(F.lit(1)).alias(f"{name}_occurrences"), F.count_distinct("date").alias(f"{name}_days"))
        return seen, grams.groupBy("band").agg(F.count_distinct("date").alias(f"{name}_eligible"))

    out = patterns
    for grams, name in ((train, "train"), (test, "test")):
        seen, days = part(grams, name)
        out = out.join(seen, ["band", "sequence"], "left").join(days, "band", "left").fillna(0, [f"{name}_occurrences", f"{name}_days", f"{name}_eligible"])
    rate = {n: safe_divide(F.col(f"{n}_occurrences"), F.col(f"{n}_eligible")) for n in ("train", "test")}
    return out.select("*", safe_divide(F.col("test_days"), F.col("test_eligible")).alias("day_recurrence"), safe_divide(rate["test"], rate["train"], None).alias("rate_ratio"), (F.col("test_occurrences") > 0).cast("int").alias("supported"))


def transition_coverage(segments: DataFrame, keys: list[str], patterns: DataFrame, by: list[str]) -> DataFrame:
    """Share of all transitions of segments that some pattern of the band covers, each counted once.

    segments: keys, pos, state (compressed); patterns: by, sequence. Patterns of two to four states cover their own transitions.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = segments
    for i in range(1, 4):
        rows = rows.withColumn(f"_s{i}", F.lead("state", i).over(w))
    names = ["state", "_s1", "_s2", "_s3"]
    made = [F.when(F.col(names[n - 1]).isNotNull(), F.struct(F.concat_ws(ARROW, *names[:n]).alias("sequence"), F.sequence(F.col("pos"), F.col("pos") + F.lit(n - 2)).alias("covers"))) for n in range(2, 5)]
    found = rows.select(*keys, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("g")).select(*keys, "g.*")
    hit = found.join(patterns.select(*by, "sequence").distinct(), [*by, "sequence"]).select(*keys, F.explode("covers").alias("pos")).distinct()
    total = rows.filter(F.col("_s1").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_transitions"))
    return total.join(hit.groupBy(*by).agg(F.count(F.lit(1)).alias("covered")), by, "left").select(*by, "n_transitions", F.coalesce("covered", F.lit(0)).alias("covered"), safe_divide(F.coalesce("covered", F.lit(0)), F.col("n_transitions")).alias("coverage"))


def groundedness(sequences: DataFrame, edges: DataFrame, theta: float) -> DataFrame:
    """sequence, n_pairs, missing, low, self_loops, grounded: whether every step of a sequence is an edge of at least theta."""
    states = sequences.select("sequence", F.split("sequence", ARROW).alias("s")).filter(F.size("s") >= 2)
    pairs = states.select("sequence", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(element_at(s, i) AS src, element_at(s, i + 1) AS dst))")).alias("p")).select("sequence", "p.*")
    at = pairs.join(edges.select("src", "dst", "prob"), ["src", "dst"], "left")
    out = at.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("prob").isNull()).alias("missing"), F.count_if(F.col("prob") < theta).alias("low"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    return out.withColumn("grounded", ((F.col("missing") == 0) & (F.col("low") == 0) & (F.col("self_loops") == 0)).cast("int"))


def ratings(rows: DataFrame, by: list[str], criteria: list[str]) -> DataFrame:
    """by, criterion, n, mean, sd of columns that hold ratings, one criterion each; missing ones don't count."""
    long = rows.unpivot(by, criteria, "criterion", "value")
    return long.groupBy(*by, "criterion").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def confusion(predicted: DataFrame, true: DataFrame, candidates: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of keys for each `by`, over all candidates and what either side has besides."""
    marks = [rows.select(*by, *keys, *(F.lit(1 if i == j else 0).alias(n) for j, n in enumerate(("_p", "_t")))) for i, rows in enumerate((predicted, true, candidates))]
    both = marks[0].unionAll(marks[1]).unionAll(marks[2]).groupBy(*by, *keys).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    p, t = F.col("_p") == 1, F.col("_t") == 1
    return both.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
