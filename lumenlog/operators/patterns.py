"""Patterns as rows: merging over bands, fragments, quality flags, ranking, sampling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import ARROW, alternating_loop, f1_of, has_part, other_round_trip, safe_divide, seconds_between, self_transition
from lumenlog.operators.matching import one_to_one
from lumenlog.operators.shared import stored


def merge_bands(patterns: DataFrame) -> DataFrame:
    """pattern_id, sequence, bands: one row a sequence, numbered by where it was first seen. patterns: band, sequence, first_ts, first_ord."""
    first = patterns.groupBy("sequence").agg(F.min(F.struct("first_ts", "first_ord")).alias("_f"), F.array_join(F.array_sort(F.collect_set("band")), "|").alias("bands"))
    nth = F.row_number().over(Window.orderBy("_f", "sequence"))  # one row a distinct pattern
    return first.select(F.format_string("P%03d", nth).alias("pattern_id"), "sequence", "bands")


def fragments(patterns: DataFrame, by: list[str]) -> DataFrame:
    """Patterns with the number of longer patterns of the same `by` that hold them; every part of a pattern meets patterns by text in an equi-join."""
    from lumenlog.functions import subsequences

    seq = F.split("sequence", ARROW)
    parts = patterns.select(*by, F.explode(subsequences(seq, 2, 4, proper=True)).alias("sequence"))
    n = parts.groupBy(*by, "sequence").agg(F.count(F.lit(1)).alias("n"))
    return patterns.select(*by, "sequence").join(n, [*by, "sequence"], "left").select(*by, "sequence", F.coalesce("n", F.lit(0)).alias("n_parents"), F.when(F.col("n") > 0, 1).otherwise(0).alias("fragmented"))


def holds(longer: Column, shorter: Column) -> Column:
    return has_part(F.split(longer, ARROW), F.split(shorter, ARROW))


def truth_shares(occurrences: DataFrame, truths: DataFrame, assigned: DataFrame, keys: list[str], by: list[str], least_seconds: float = 1.0) -> DataFrame:
    """by, test_support, hit_rate, purity, any_hit_rate, any_purity: how far a pattern's occurrences meet the categories that it was assigned in training, and any at all.

    occurrences: by, keys, start_time, end_time. truths: keys, category, start_time, end_time. assigned: by, labels (array). Hit rate: the share of occurrences that share `least_seconds` with a category; purity: the share of
    their time. Time that several categories of an occurrence cover counts once. A pattern without occurrences has no row.
    """
    from lumenlog.operators import intervals

    held = occurrences.select(*by, *keys, "start_time", "end_time").join(assigned.select(*by, F.col("labels").alias("_labels")), by, "left")
    occ = stored(held.withColumn("_id", F.monotonically_increasing_id()))  # the ids have to stay
    # any category: time that several truths cover is one span before it meets occurrences, so overlaps add up and no pair is shuffled by itself
    some = intervals.overlap_join(occ.select("_id", *keys, "start_time", "end_time"), intervals.union_spans(truths, keys), keys).groupBy("_id").agg(F.sum("overlap").alias("_any"))
    # own ones: an occurrence brings its labels with it, so only pairs that count leave the join
    met = intervals.overlap_join(occ.filter(F.size("_labels") > 0).select("_id", "_labels", *keys, "start_time", "end_time"), truths.select(*keys, "category", "start_time", "end_time"), keys)
    met = met.filter(F.array_contains("_labels", F.col("b_category")))
    own = met.select("_id", F.greatest("start_time", "b_start_time").alias("start_time"), F.least("end_time", "b_end_time").alias("end_time"))

    def shared(rows: DataFrame, name: str) -> DataFrame:
        spans = intervals.union_spans(rows, ["_id"])
        return spans.groupBy("_id").agg(F.sum(seconds_between("start_time", "end_time")).alias(name))

    every = occ.join(some, "_id", "left").join(shared(own, "_own"), "_id", "left").fillna(0.0, ["_any", "_own"])
    n, length = F.count(F.lit(1)), F.sum(seconds_between("start_time", "end_time"))
    rate = lambda c: F.count_if((F.col(c) > 0) & (F.col(c) >= least_seconds)) / n
    return every.groupBy(*by).agg(n.alias("test_support"), rate("_own").alias("hit_rate"), safe_divide(F.sum("_own"), length).alias("purity"), rate("_any").alias("any_hit_rate"), safe_divide(F.sum("_any"), length).alias("any_purity"))


def quality(rows: DataFrame, others: list[str], grounded: tuple[float, float] = (0.3, 0.3), useless: tuple[float, float] = (0.1, 0.1), without_test: bool = False) -> DataFrame:
    """Flags of patterns, 0 or 1, and why they are useless.

    rows: sequence, train_support, test_support, hit_rate and purity (of the category that training gave), any_hit_rate and any_purity (of any category), fragmented. Only patterns with
    support in training, and in the test as well unless `without_test`, are counted; the others have no flag. Grounded: hit rate or purity high enough. Useless: a) overlaps no
    category enough, b) goes by an unmapped state and back, c) alternates; structural: b, c or a state twice. Contextless: structural or a. Useful: grounded, neither structural nor fragmented.
    """
    counted = (F.col("train_support") > 0) & ((F.col("test_support") > 0) | F.lit(without_test))
    seen, s = F.col("test_support") > 0, F.split("sequence", ARROW)
    twice, trip, loop = counted & self_transition(s), counted & other_round_trip(s, others), counted & alternating_loop(s)
    good = counted & seen & ((F.col("hit_rate") >= grounded[0]) | (F.col("purity") >= grounded[1]))
    low = counted & seen & (F.col("any_hit_rate") < useless[0]) & (F.col("any_purity") < useless[1])
    structural, broken = twice | trip | loop, counted & (F.col("fragmented") != 0)
    flags = {"counted": counted, "grounded": good, "useless_a": low, "useless_b": trip, "useless_c": loop, "useless": low | trip | loop, "structural": structural, "contextless": structural | low, "fragment": broken, "useful": good & ~structural & ~broken}
    reasons = F.concat_ws(";", F.when(low, "low_overlap"), F.when(twice, "self_transition"), F.when(trip, "other_round_trip"), F.when(loop, "alternating_loop"))
    return rows.select("*", *(x.cast("int").alias(n) for n, x in flags.items()), reasons.alias("reasons"))


def quality_rates(flagged: DataFrame, by: list[str]) -> DataFrame:
    """How many patterns are counted, and the share of these for which each flag of `quality` holds; 0 where none is."""
    n = F.sum("counted")
    names = ["grounded", "useless", "contextless", "structural", "fragment", "useful"]
    return flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_patterns"), n.alias("n_counted"), *(safe_divide(F.sum(x), n).alias(f"{x}_rate") for x in names))


def ranked(rows: DataFrame, falling: list[str], rising: list[str], by: list[str] | None = None) -> DataFrame:
    """Rank 1 is the best: metrics fall, then keys rise."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*(F.desc(c) for c in falling), *rising)))


def number_occurrences(found: DataFrame, pattern: str, order: list[str]) -> DataFrame:
    """occurrence_id: the pattern's id and a running number of four digits."""
    nth = F.row_number().over(Window.partitionBy(pattern).orderBy(*order))
    return found.withColumn("occurrence_id", F.concat(pattern, F.lit("_"), F.lpad(nth.cast("string"), 4, "0")))


def owners(found: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """One row for each physical occurrence, owned by the smallest pattern id, with how many patterns claim it."""
    return found.groupBy(*key).agg(F.min(pattern).alias("owner"), F.count(F.lit(1)).alias("claims"))


def round_robin(rows: DataFrame, buckets: list[str], key: str, seed: int, n: int) -> DataFrame:
    """n rows that take turns over buckets, in an order of hashes inside each."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(*buckets).orderBy(h))
    return rows.withColumn("turn", turn).orderBy("turn", *buckets).limit(n)


def split_days(rows: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """keys, n_days, train_days, split: midnight after the first floor(ratio * days) days, one day at least on each side where there are two."""
    span = rows.groupBy(*keys).agg(F.to_date(F.min("ts")).alias("_a"), F.to_date(F.max("ts")).alias("_b"))
    days = F.datediff("_b", "_a") + 1
    train = F.greatest(F.lit(1), F.least(days - 1, F.floor(days * F.lit(ratio)).cast("int")))
    return span.select(*keys, days.alias("n_days"), train.alias("train_days"), F.date_add("_a", train).alias("split"))


def split_at(rows: DataFrame, keys: list[str], ratio: float | None = None, days: int | None = None) -> DataFrame:
    """keys, split: the instant after `ratio` of each key's span of time, or the midnight `days` days after its first day."""
    span = rows.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    if days is not None:
        return span.select(*keys, F.date_add(F.to_date("_a"), days).cast("timestamp_ntz").alias("split"))
    part = F.floor(F.timestamp_diff("MICROSECOND", F.col("_a"), F.col("_b")) * F.lit(ratio))
    return span.select(*keys, F.timestamp_add("MICROSECOND", part, F.col("_a")).alias("split"))


def key_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn and F1 of two sets of keys for each `by`; null where both are empty."""
    both = gold.select(*by, *keys).distinct().withColumn("_g", F.lit(1)).join(predicted.select(*by, *keys).distinct().withColumn("_p", F.lit(1)), [*by, *keys], "full")
    tp, fp, fn = F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()), F.count_if(F.col("_g").isNull()), F.count_if(F.col("_p").isNull())
    out = both.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumn("f1", safe_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), None))


def holding_pairs(a: DataFrame, b: DataFrame, a_may_hold: bool = True, b_may_hold: bool = True) -> DataFrame:
    """prediction, truth: pairs of sequences of a and b that are equal, or of which one stands in the other as far as allowed; an equi-join on parts, none of all pairs."""

    def whole(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("sequence").alias(name), F.col("sequence").alias("_part")).distinct()

    def parts(rows: DataFrame, name: str) -> DataFrame:
        s = F.split("sequence", ARROW)
        every = F.expr("array_distinct(flatten(transform(sequence(1, size(_s)), k -> transform(sequence(1, size(_s) - k + 1), i -> array_join(slice(_s, i, k), '->')))))")
        return rows.select("sequence", s.alias("_s")).distinct().select(F.col("sequence").alias(name), F.explode(every).alias("_part"))

    left, right = (parts(a, "prediction") if a_may_hold else whole(a, "prediction")), (parts(b, "truth") if b_may_hold else whole(b, "truth"))
    inside = whole(a, "prediction").join(right, "_part").select("prediction", "truth")
    return inside.unionAll(left.join(whole(b, "truth"), "_part").select("prediction", "truth")).distinct() if a_may_hold else inside.distinct()


def listed_matches(predicted: DataFrame, gold: DataFrame, by: list[str], a_may_hold: bool = False, b_may_hold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two lists of sequences matched one to one in list order, and their scores.

    predicted, gold: by, place (in the list), sequence. Each prediction in turn takes the first gold sequence that is left and matches it: is equal, or stands in it (`a_may_hold`), or
    holds it (`b_may_hold`). Matches: by, prediction, truth (places), sequence, gold_sequence. Scores: by, tp, fp, fn, precision, recall, f1.
    """
    held = holding_pairs(predicted.select("sequence"), gold.select("sequence"), a_may_hold, b_may_hold)
    a = predicted.select(*by, F.col("place").alias("prediction"), F.col("sequence"))
    b = gold.select(*by, F.col("place").alias("truth"), F.col("sequence").alias("gold_sequence"))
    pairs = a.join(held.withColumnsRenamed({"prediction": "sequence", "truth": "gold_sequence"}), "sequence").join(b, [*by, "gold_sequence"])
    found = one_to_one(pairs.select(*by, "prediction", "truth", "sequence", "gold_sequence"), by, "prediction", "truth", [-F.col("prediction"), -F.col("truth")])
    n = F.count(F.lit(1))
    sides = a.groupBy(*by).agg(n.alias("_a")).join(b.groupBy(*by).agg(n.alias("_b")), by, "full") if by else a.agg(n.alias("_a")).join(b.agg(n.alias("_b")))
    tp = found.groupBy(*by).agg(n.alias("tp"))
    counts = (sides.join(tp, by, "left") if by else sides.join(tp)).fillna(0, ["_a", "_b", "tp"])
    p, r = safe_divide(F.col("tp"), F.col("_a")), safe_divide(F.col("tp"), F.col("_b"))
    return found, counts.select(*by, "tp", (F.col("_a") - F.col("tp")).alias("fp"), (F.col("_b") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1_of(p, r).alias("f1"))
