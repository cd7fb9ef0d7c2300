"""Evaluations put together from intervals and scores: audits of occurrences, scopes of metrics, summaries, methods, conditions, seeds, runs, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import ARROW, OTHER, f1_of, hamming, safe_divide, set_scores, time_band, token_cost, within_band
from lumenlog.operators import intervals, scoring, search, vectors
from lumenlog.operators.shared import stored

ALL = "All"
METRICS = ["exact_set_match", "jaccard", "precision", "recall", "f1"]
SCOPES = ["conditional", "end_to_end"]


def matched(patterns: DataFrame, occurrences: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Occurrences of each pattern, by its own or its group's id; by its sequence only where the ids have none.

    patterns: by, pattern_id, group_id, band, sequence. occurrences: pattern_id (null where a file has none, or no such column), sequence, start_time, end_time and others; columns of `by` that they have, such as a condition, have to
    be equal. Adds assigned (it starts in the pattern's band; `All` takes every one), crossing (it leaves its band) and accepted.
    """
    by = by or []
    on = [c for c in by if c in occurrences.columns]
    own = patterns.select(*by, F.col("pattern_id").alias("_p"), F.col("band").alias("_band"), F.col("sequence").alias("_s"), F.explode(F.array_distinct(F.array("pattern_id", F.coalesce("group_id", "pattern_id")))).alias("_id"))
    seen = occurrences.drop("pattern_id").withColumn("_s", F.col("sequence"))
    if "pattern_id" in occurrences.columns:
        known = occurrences.filter(F.col("pattern_id").isNotNull()).select(*on, F.col("pattern_id").alias("_id")).distinct()
        with_id = own.join(known, [*on, "_id"], "left_semi")
        by_id = with_id.drop("_s").join(occurrences.withColumnRenamed("pattern_id", "_id"), [*on, "_id"]).drop("_id")
        rest = own.drop("_id").distinct().join(with_id.select(*by, "_p").distinct(), [*by, "_p"], "left_anti")
        both = by_id.unionByName(rest.filter("_s <> ''").join(seen, [*on, "_s"]).drop("_s"))
    else:
        both = own.drop("_id").distinct().filter("_s <> ''").join(seen, [*on, "_s"]).drop("_s")
    both = both.withColumnsRenamed({"_p": "pattern_id", "_band": "band"})
    whole, every = within_band("start_time", "end_time", time_band("start_time")), F.col("band") == ALL
    assigned = every | (time_band("start_time") == F.col("band"))
    crosses = F.when(every, time_band("start_time") != time_band(F.col("end_time") - F.expr("INTERVAL 0.000001 SECOND"))).otherwise(~whole)
    return both.withColumns({"assigned": assigned, "crossing": assigned & crosses, "accepted": assigned & (every | whole)})


def interpretation_scores(patterns: DataFrame, occurrences: DataFrame, truths: DataFrame, keys: list[str], ratio: float, by: list[str] | None = None) -> DataFrame:
    """Predicted against true label sets of patterns, in two scopes.

    patterns: by (a condition, a run), pattern_id, group_id, band, sequence, labels, status (valid, missing, unknown). A pattern that occurs nowhere scores 0 end to end and nothing conditionally; one whose
    occurrences meet no truth scores nothing at all; one without a valid prediction scores 0 in both. Truth: labels with `ratio` of the summed overlap at least.
    The matched occurrences are stored; counts and overlaps, and so all scopes and strata, are read from that table.
    """
    by = by or []
    every = [*by, "pattern_id"]
    found = stored(matched(patterns, occurrences, by).select(*every, *keys, "start_time", "end_time", "assigned", "crossing", "accepted"))
    counts = found.groupBy(*every).agg(F.count(F.lit(1)).alias("n_matching"), F.count_if("assigned").alias("n_assigned"), F.count_if("crossing").alias("n_crossing"), F.count_if("accepted").alias("n_occurrences"))
    shared = intervals.overlap_join(found.filter("accepted").select(*every, *keys, "start_time", "end_time"), truths.select(*keys, "category", "start_time", "end_time"), keys)
    true = scoring.true_sets(shared.withColumnRenamed("b_category", "category"), every, ratio).withColumnsRenamed({"labels": "true_labels", "total": "overlap_seconds"})
    rows = patterns.join(counts, every, "left").fillna(0, ["n_matching", "n_assigned", "n_crossing", "n_occurrences"]).join(true, every, "left")
    occurs, defined, valid = F.col("n_occurrences") > 0, F.col("overlap_seconds").isNotNull(), F.col("status") == "valid"
    none = F.array().cast("array<string>")
    scores = {m: x.cast("double") for m, x in set_scores(F.coalesce("labels", none), F.coalesce("true_labels", none)).items()}
    out = {}
    for m, x in scores.items():
        scored = F.when(valid, x).otherwise(F.lit(0.0))
        out[f"conditional_{m}"] = F.when(occurs & defined, scored)
        out[f"end_to_end_{m}"] = F.when(~occurs, F.lit(0.0)).when(defined, scored)
    status = {"occurrence_status": F.when(occurs, "matched").otherwise("no_occurrence"), "truth_status": F.when(occurs & defined, "defined").otherwise("no_adl_overlap")}
    return rows.select(*every, "band", "sequence", "labels", "status", "n_matching", "n_assigned", "n_crossing", "n_occurrences", "true_labels", F.coalesce("overlap_seconds", F.lit(0.0)).alias("overlap_seconds"), *(x.alias(n) for n, x in (status | out).items()))


def searched(patterns: DataFrame, series: DataFrame, keys: list[str], by: list[str], other: str | None, most_skip: float, block: Column | None) -> DataFrame:
    """by, keys, sequence, start_time, end_time of all patterns in the series of their own condition, in one search.

    series: by (those of `by` that tell series apart), keys, start_time, end_time, ord, state. States carry their condition through the search, so that a
    pattern is looked for in its own series only; `other` does not, as it is passed over in all.
    """
    tag = F.concat(*(x for c in by for x in (F.col(c).cast("string"), F.lit("|")))) if by else F.lit("")
    tagged = lambda s: F.when(s == F.lit(other), s).otherwise(F.concat(tag, s)) if other is not None else F.concat(tag, s)
    bare = lambda s: F.when(s == F.lit(other), s).otherwise(F.substr(s, F.length(tag) + 1)) if other is not None else F.substr(s, F.length(tag) + 1)
    states = lambda f: F.array_join(F.transform(F.split("sequence", ARROW), f), ARROW)
    wanted = patterns.select(*by, "sequence").distinct().select(states(tagged).alias("sequence"))
    found = search.occurrences(series.withColumn("state", tagged(F.col("state"))), [*by, *keys], wanted, other, most_skip, block)
    return found.withColumn("sequence", states(bare))


def evaluated(patterns: DataFrame, series: DataFrame, truths: DataFrame, keys: list[str], ratio: float, by: list[str] | None = None, period: tuple[str, str] | None = None, other: str | None = None, most_skip: float = 0.0, block: Column | None = None) -> dict[str, DataFrame]:
    """One method from search to summary: details (see `interpretation_scores`), and their summary as a whole, by band, by true label and by frequency.

    patterns: by, pattern_id, group_id, band, sequence, labels, status. series: keys, start_time, end_time, ord, state, and those columns of `by` that tell series apart (others, such as a run, share them). Of series
    and truths the part inside `period` counts. Frequency: thirds of a row of `by`, by accepted occurrences, the rarest first.
    """
    by = by or []
    if period is not None:
        series, truths = intervals.clip(series, *period), intervals.clip(truths, *period)
    found = searched(patterns, series, keys, [c for c in by if c in series.columns], other, most_skip, block)
    details = stored(interpretation_scores(patterns, found, truths, keys, ratio, by))
    seen = scoring.tertiles(details.filter("n_occurrences > 0"), by, ["n_occurrences", "band", "sequence", "pattern_id"])
    return {"details": details, "summary": summary(details, by), "bands": summary(details, [*by, "band"]), "labels": label_summary(details, "true_labels", by), "frequencies": summary(seen, [*by, "frequency_band"])}


def evaluable(rows: DataFrame, scope: str) -> Column:
    """Whether a row counts in a scope: by its flag, or where a file has none, by whether its F1 is there."""
    flag = {"conditional": "is_metric_evaluable", "end_to_end": "is_end_to_end_evaluable"}[scope]
    return F.coalesce(F.col(flag), F.lit(0)) != 0 if flag in rows.columns else scoped(rows, scope, "f1").isNotNull()


def scoped(rows: DataFrame, scope: str, metric: str) -> Column:
    """A metric of a scope, or the plain one where a file has no scopes."""
    held = [F.col(c) for c in (f"{scope}_{metric}", metric) if c in rows.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("double")


def summary(details: DataFrame, by: list[str]) -> DataFrame:
    """Counts, coverages and mean metrics of `interpretation_scores` for each value of `by` (none: one row)."""
    occurs, defined = F.col("occurrence_status") == "matched", F.col("truth_status") == "defined"
    n, n_matched, n_defined = F.count(F.lit(1)), F.count_if(occurs), F.count_if(occurs & defined)
    counts = {"n_patterns": n, "n_matched": n_matched, "n_truth_defined": n_defined, "n_no_overlap": F.count_if(occurs & ~defined), "n_assigned": F.sum("n_assigned"), "n_crossing": F.sum("n_crossing")}
    counts |= {f"n_{s}": F.count_if(F.col("status") == s) for s in ("valid", "missing", "unknown")} | {f"n_{s}_evaluable": F.count_if(evaluable(details, s)) for s in SCOPES}
    rates = {"occurrence_coverage": safe_divide(n_matched, n), "truth_coverage": safe_divide(n_defined, n_matched), "missing_rate": safe_divide(F.count_if(F.col("status") == "missing"), n), "crossing_rate": safe_divide(F.sum("n_crossing"), F.sum("n_assigned"))}
    means = {f"{s}_mean_{m}": F.avg(scoped(details, s, m)) for s in SCOPES for m in METRICS}
    return details.groupBy(*by).agg(*(x.alias(name) for name, x in (counts | rates | means).items()))


def label_summary(details: DataFrame, labels: str, by: list[str] | None = None) -> DataFrame:
    """`summary` for each label of an array column; a pattern counts for each of its labels."""
    return summary(details.withColumn("label", F.explode(labels)), [*(by or []), "label"])


def processed_hits(predictions: DataFrame, truths: DataFrame, keys: list[str], gap_seconds: float, least: dict[str, float], default: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each method: predictions merged over gaps and long enough, how many were too short, and the hit rates of truths.

    predictions: method, keys, category, start_time, end_time.
    """
    merged = intervals.merge_gaps(predictions, ["method", *keys, "category"], gap_seconds)
    kept, removed = intervals.long_enough(merged, least, default, ["method"])
    same = [*keys, "category"]
    marked = truths.withColumn("_id", F.struct(*same, "start_time", "end_time"))
    near = intervals.overlap_join(marked, kept.select("method", *same, "start_time", "end_time"), same, tolerance=tolerance)
    hit = near.groupBy(F.col("b_method").alias("method"), "category", "_id").agg(F.max((F.col("overlap") > 0).cast("int")).alias("_o"))
    # a truth that comes twice counts twice
    n = F.count(F.lit(1))
    sums = hit.join(marked.groupBy("_id").agg(n.alias("_times")), "_id").groupBy("method", "category").agg(F.sum(F.col("_o") * F.col("_times")).alias("hit_overlap"), F.sum("_times").alias("hit_tolerance"))
    every = F.broadcast(predictions.agg(F.array_sort(F.collect_set("method")).alias("_methods")))  # one row
    counts = truths.groupBy("category").agg(n.alias("n_truth")).join(every).select(F.explode("_methods").alias("method"), "category", "n_truth")
    return kept, removed, counts.join(sums, ["method", "category"], "left").fillna(0, ["hit_overlap", "hit_tolerance"])


def swept(vectors_: DataFrame, conditions: list[tuple[int, int]], order: tuple[str, ...]) -> DataFrame:
    """n_states, threshold and the mapped vectors of each condition (number of representative states, Hamming threshold), in one plan whatever their number.

    k states are the first k of the longest list. Each distinct mask keeps its distances in order of rank, so the nearest of the first k is the least of a
    beginning of that list, and within h bits if that one is. Rows are multiplied by the conditions at the end only.
    """
    ranked = vectors.representative_states(vectors_, max(k for k, _ in conditions), order)
    masks = vectors_.select("mask").distinct()  # 2**sensors at most, against as many states as the longest list has
    near = masks.join(F.broadcast(ranked.select("rank", "state_id", F.col("mask").alias("_m"))))
    held = near.groupBy("mask").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(hamming("mask", "_m").alias("d"), F.col("rank").alias("r"), F.col("state_id").alias("s")).alias("x")))).alias("_held"))
    every = F.array(*(F.struct(F.lit(k).alias("n_states"), F.lit(h).alias("threshold")) for k, h in dict.fromkeys(conditions)))
    of = held.withColumn("_c", F.explode(every)).select("mask", "_c.*", F.array_min(F.transform(F.filter("_held", lambda x: x["rank"] <= F.col("_c.n_states")), lambda x: x["x"])).alias("_best"))
    state = F.when(F.col("_best.d") <= F.col("threshold"), F.col("_best.s")).otherwise(F.lit(OTHER))
    return vectors_.join(of.select("mask", "n_states", "threshold", state.alias("state")), "mask").select("n_states", "threshold", *vectors_.columns, "state")


CONDITION = ["n_states", "threshold"]


def swept_evaluation(series: DataFrame, patterns: DataFrame, truths: DataFrame, keys: list[str], ratio: float, **named) -> dict[str, DataFrame]:
    """`evaluated` for every condition and run at once: details, and summaries of runs, bands, labels and frequencies keyed by n_states, threshold and run; and bands and labels over a condition's runs.

    series: n_states, threshold, keys, start_time, end_time, ord, state (see `swept`). patterns: n_states, threshold, run and the columns of `evaluated`.
    """
    out = evaluated(patterns, series, truths, keys, ratio, [*CONDITION, "run"], **named)
    details = out["details"]
    return {**out, "runs": out["summary"], "condition_bands": summary(details, [*CONDITION, "band"]), "condition_labels": label_summary(details, "true_labels", CONDITION)}


def seed_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and deviation of each metric over seeds: first the mean of a seed's runs, of seeds whose runs are all complete only.

    rows: by, seed, status, metrics. A metric that some run of a seed lacks leaves that seed out for this metric.
    """
    whole = F.count_if(F.col("status") == "complete") == F.count(F.lit(1))
    per = {m: F.when(whole & (F.count(m) == F.count(F.lit(1))), F.avg(m)).alias(m) for m in metrics}
    counts = [F.count(F.lit(1)).alias("_runs"), *(F.count_if(F.col("status") == s).alias(f"_{s}") for s in ("complete", "missing", "invalid")), whole.alias("_whole")]
    seeds = rows.groupBy(*by, "seed").agg(*counts, *per.values())
    agg = [F.sum("_runs").alias("expected_runs"), *(F.sum(f"_{s}").alias(f"{s}_runs") for s in ("complete", "missing", "invalid")), F.count(F.lit(1)).alias("expected_seeds"), F.count_if("_whole").alias("complete_seeds")]
    for m in metrics:
        agg += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) > 1, F.stddev_samp(m)).alias(f"{m}_sd"), F.count(m).alias(f"{m}_n_seeds")]
    return seeds.groupBy(*by).agg(*agg)


def baseline_deltas(rows: DataFrame, by: list[str], condition: str, baseline, metrics: list[str]) -> DataFrame:
    """Means of each condition and of all (null), and the mean difference against the baseline condition of the same seed."""
    base = rows.filter(F.col(condition) == baseline).select(*by, "seed", *(F.col(m).alias(f"_{m}") for m in metrics))
    joined = rows.join(base, [*by, "seed"], "left")
    agg = [F.count(F.lit(1)).alias("n"), *(x for m in metrics for x in (F.avg(m).alias(m), F.avg(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta")))]
    every = joined.withColumn(condition, F.explode(F.array(F.col(condition).cast("string"), F.lit(None).cast("string"))))
    return every.groupBy(*by, condition).agg(*agg)


def weight_audit(rows: DataFrame, by: list[str], weight: str, occurrence: list[str]) -> DataFrame:
    """Whether weights add up to the number of distinct physical occurrences: both, their difference, and ok."""
    w, n = F.sum(weight), F.count_distinct(*occurrence)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), w.alias("weight_sum"), n.alias("n_occurrences"), (w - n).alias("difference"), (F.abs(w - n) < 1e-9).alias("ok"))


def breakdown(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Rows, and the number and share for which each flag holds, by band, length or the like."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(x for f in flags for x in (F.count_if(F.col(f).cast("boolean")).alias(f"n_{f}"), (F.count_if(F.col(f).cast("boolean")) / F.count(F.lit(1))).alias(f"{f}_rate"))))


def duplicate_rates(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """How many rows repeat a key (the first one does not), and their share; null where a group has one row only, so nothing to compare."""
    n, distinct = F.count(F.lit(1)), F.count_distinct(*key)
    return rows.groupBy(*by).agg(n.alias("n"), (n - distinct).alias("duplicates"), F.when(n > 1, (n - distinct) / n).alias("duplicate_rate"))


def count_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Summed tp, fp, fn of runs with precision, recall, F1 and Jaccard from the sums."""
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("*", p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"), safe_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("jaccard"))


def length_distribution(rows: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """by, n, n_unique, lengths: a JSON object of lengths of sequences and how many have each, in order of length."""
    counts = rows.groupBy(*by, F.size(F.split(sequence, ARROW)).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_c"))), lambda x: F.format_string('"%d":%d', x["_n"], x["_c"])), ","), F.lit("}"))
    lengths = counts.groupBy(*by).agg(F.sum("_c").alias("n"), text.alias("lengths"))
    return lengths.join(rows.groupBy(*by).agg(F.count_distinct(sequence).alias("n_unique")), by)


def cost_report(estimates: DataFrame, prices: DataFrame) -> DataFrame:
    """model, evaluation (null: the model's total), requests, tokens, cost and methods; a model without a price has a null cost and an error.

    estimates: model, evaluation, method, requests, input_tokens, output_tokens. prices: model, input_usd, output_usd a million tokens; a small table, not broadcast by hand.
    """
    cost = token_cost(F.col("input_tokens"), F.col("input_usd")) + token_cost(F.col("output_tokens"), F.col("output_usd"))
    rows = estimates.join(prices, "model", "left").withColumn("cost", cost).withColumn("_unknown", F.col("input_usd").isNull() | F.col("output_usd").isNull())
    every = rows.withColumn("evaluation", F.explode(F.array("evaluation", F.lit(None).cast("string"))))
    sums = {c: F.sum(c).alias(c) for c in ("requests", "input_tokens", "output_tokens")}
    unknown = F.bool_or("_unknown")
    return every.groupBy("model", "evaluation").agg(*sums.values(), F.when(~unknown, F.sum("cost")).alias("cost"), F.array_join(F.array_sort(F.collect_set("method")), "; ").alias("methods"), F.when(unknown, F.concat(F.lit("no price for "), F.first("model"))).alias("error"))


def with_status(expected: DataFrame, results: DataFrame, keys: list[str], metrics: list[str], valid: Column) -> DataFrame:
    """Every expected run with its status: `missing` where it has no result, `invalid` where `valid` does not hold (no metrics then), else `complete`."""
    rows = expected.join(results.withColumn("_ok", F.coalesce(valid, F.lit(False))), keys, "left")
    status = F.when(F.col("_ok").isNull(), "missing").when(~F.col("_ok"), "invalid").otherwise("complete")
    return rows.select(*expected.columns, status.alias("status"), *(F.when(F.col("_ok"), F.col(m)).alias(m) for m in metrics))


def strict_records(records: DataFrame, order: list[str], allowed: list[str]) -> DataFrame:
    """Records of two to four states with a name, a reason and known labels only; of those with one band and sequence the first.

    records: band, name, reason, states, labels (arrays) and the columns of `order`.
    """
    named = (F.trim(F.coalesce("name", F.lit(""))) != "") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    known = (F.size("labels") > 0) & F.forall("labels", lambda x: x.isin(allowed))
    kept = records.filter(named & known & F.size("states").between(2, 4))
    w = Window.partitionBy("band", "states").orderBy(*order)
    return kept.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def gold_catalog(episodes: DataFrame, target: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Canonical sequences of each target and band, and the fragments of these.

    episodes: target, band, episode, sequences (the distinct sequences of an episode, as text). Support is the number of episodes, `least` at least; canonical are those with
    the most support and, among these, the greatest length. Fragments: supported proper parts of canonical sequences that are not canonical themselves.
    """
    support = episodes.select(target, "band", "episode", F.explode("sequences").alias("sequence")).distinct().groupBy(target, "band", "sequence").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    support = support.withColumn("n", F.size(F.split("sequence", ARROW)))
    best = Window.partitionBy(target, "band").orderBy(F.desc("support"), F.desc("n"))
    canonical = support.withColumn("_r", F.rank().over(best)).filter("_r = 1").drop("_r")
    states = F.split("sequence", ARROW)
    parts = F.expr("flatten(transform(sequence(2, greatest(2, n - 1)), k -> transform(sequence(1, n - k + 1), i -> array_join(slice(_s, i, k), '->'))))")
    pieces = canonical.filter("n > 2").withColumn("_s", states).select(target, "band", F.explode(parts).alias("sequence")).distinct()
    fragments = support.join(pieces, [target, "band", "sequence"], "left_semi").join(canonical, [target, "band", "sequence"], "left_anti")
    return canonical, fragments


def frequency_baseline(occurrences: DataFrame, least: int, most: int) -> DataFrame:
    """rank, band, sequence, support: the `most` most frequent (band, sequence) with `least` occurrences at least; ties in order of band and sequence."""
    top = occurrences.groupBy("band", "sequence").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least).orderBy(F.desc("support"), "band", "sequence").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("support"), "band", "sequence")).alias("rank"), "band", "sequence", "support")  # `most` rows
