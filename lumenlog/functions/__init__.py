"""Scalar expressions: time bands, binary values, intervals, sequences, labels, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "その他"
# Time bands, hour of start to hour of end.
BANDS = {"Midnight": (0, 6), "Morning": (6, 10), "Daytime": (10, 18), "Night": (18, 24)}
# Raw values that mean on and off.
ON_VALUES = ["ON", "OPEN", "PRESENT", "1"]
OFF_VALUES = ["OFF", "CLOSE", "ABSENT", "0"]
ARROW = "->"
# The labels of evaluations.
EVALUATED = ["Sleep", "Wake-up", "Meal", "Relax", "Outing", "Hygiene", "Toileting", "Housework", "Work", "Other"]
# Signs between labels that a text lists, the last one first.
LABEL_SIGNS = ["/", "、", ",", "|", ";"]
# Fixed value: the heading of states in tables of them.
STATE_HEADING = "状態"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def time_band(ts: Column | str, bands: dict[str, tuple[int, int]] = BANDS) -> Column:
    """The band that holds a timestamp; null outside all. A band whose start is after its end goes over midnight."""
    hour, out = F.hour(_c(ts)), None
    for name, (start, end) in bands.items():
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def binary_value(value: Column | str, on: list[str] = ON_VALUES, off: list[str] = OFF_VALUES) -> Column:
    """1, 0, or null for values that are neither."""
    v = F.upper(F.trim(_c(value).cast("string")))
    return F.when(v.isin(on), 1).when(v.isin(off), 0).cast("tinyint")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6)


def overlap_seconds(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Shared seconds of two intervals, 0 where they are apart."""
    return F.greatest(F.lit(0.0), seconds_between(F.greatest(_c(a0), _c(b0)), F.least(_c(a1), _c(b1))))


def temporal_iou(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Overlap over the hull of both; 0 for an empty hull."""
    hull = seconds_between(F.least(_c(a0), _c(b0)), F.greatest(_c(a1), _c(b1)))
    return F.when(hull > 0, overlap_seconds(a0, a1, b0, b1) / hull).otherwise(F.lit(0.0))


def safe_divide(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def f1_of(precision: Column, recall: Column) -> Column:
    return safe_divide(2 * precision * recall, precision + recall)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Different bits of two masks."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def ceil_to_second(ts: Column | str) -> Column:
    return F.date_trunc("second", _c(ts) + F.expr("INTERVAL 0.999999 SECOND")).cast("timestamp_ntz")


def sequence_text(seq: Column | str) -> Column:
    return F.array_join(_c(seq), ARROW)


def parse_sequence(text: Column | str) -> Column:
    """States of a sequence written with ->, →, | or commas."""
    parts = F.split(F.trim(_c(text)), r"\s*(?:->|→|\||,)\s*")
    return F.filter(parts, lambda x: F.length(x) > 0)


def has_part(longer: Column, shorter: Column, proper: bool = False) -> Column:
    """Whether one sequence stands in another without gaps; `proper`: and is shorter."""
    inside = F.contains(F.concat(F.lit(ARROW), sequence_text(longer), F.lit(ARROW)), F.concat(F.lit(ARROW), sequence_text(shorter), F.lit(ARROW)))
    return inside & (F.size(shorter) < F.size(longer)) if proper else inside


def _any_at(seq: Column, first: int, last_off: int, test) -> Column:
    """Whether `test` holds at some 1-based place from `first` to size - last_off."""
    stop = F.size(seq) - last_off
    places = F.when(stop >= first, F.sequence(F.lit(first), stop)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, test)


def self_transition(seq: Column | str) -> Column:
    s = _c(seq)
    return _any_at(s, 1, 1, lambda i: F.get(s, i - 1) == F.get(s, i))


def backtrack(seq: Column | str) -> Column:
    """a, b, a somewhere."""
    s = _c(seq)
    return _any_at(s, 1, 2, lambda i: F.get(s, i - 1) == F.get(s, i + 1))


def alternating_loop(seq: Column | str) -> Column:
    """a, b, a, b with different a and b somewhere."""
    s = _c(seq)
    return _any_at(s, 1, 3, lambda i: (F.get(s, i - 1) == F.get(s, i + 1)) & (F.get(s, i) == F.get(s, i + 2)) & (F.get(s, i - 1) != F.get(s, i)))


def other_round_trip(seq: Column | str, others: list[str]) -> Column:
    """a, an unmapped state, a somewhere."""
    s = _c(seq)
    return _any_at(s, 1, 2, lambda i: (F.get(s, i - 1) == F.get(s, i + 1)) & F.get(s, i).isin(others) & ~F.get(s, i - 1).isin(others))


def keep_light(seq: Column | str, noise: list[str]) -> Column:
    """At least two states, none of them noise."""
    s = _c(seq)
    return (F.size(s) >= 2) & ~F.exists(s, lambda x: x.isin(noise))


def keep_medium(seq: Column | str, noise: list[str]) -> Column:
    return keep_light(seq, noise) & ~backtrack(seq) & ~alternating_loop(seq)


def keep_strong(seq: Column | str, noise: list[str]) -> Column:
    return keep_medium(seq, noise) & (F.size(F.array_distinct(_c(seq))) == F.size(_c(seq)))


def filter_reason(seq: Column | str, median: Column, p90: Column, others: list[str], most_median: float, most_p90: float) -> Column:
    """Why a pattern is dropped, reasons joined by semicolons; empty: kept."""
    return F.concat_ws(
        ";",
        F.when(self_transition(seq), F.lit("self_transition")),
        F.when(other_round_trip(seq, others), F.lit("other_round_trip")),
        F.when(alternating_loop(seq), F.lit("alternating_loop")),
        F.when(median > most_median, F.lit("median_duration")),
        F.when(p90 > most_p90, F.lit("p90_duration")),
    )


def within_band(start: Column | str, end: Column | str, band: Column | str) -> Column:
    """An interval that lies in one band on one day, its end excluded."""
    last = _c(end) - F.expr("INTERVAL 0.000001 SECOND")
    return (_c(end) > _c(start)) & (time_band(start) == _c(band)) & (time_band(last) == _c(band)) & (F.to_date(_c(start)) == F.to_date(last))


def _part_at(s: Column, n: int):
    return lambda i: sequence_text(F.slice(s, i, F.lit(n)))


def subsequences(seq: Column | str, least: int = 2, most: int = 4, proper: bool = False) -> Column:
    """Distinct contiguous parts of a sequence, as text."""
    s = _c(seq)
    out = []
    for n in range(least, most + 1):
        starts = F.when(F.size(s) >= n, F.sequence(F.lit(1), F.size(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, _part_at(s, n))
        out.append(F.when(F.size(s) > n, parts).otherwise(F.array().cast("array<string>")) if proper else parts)
    return F.array_distinct(F.concat(*out))


def set_scores(predicted: Column, true: Column) -> dict[str, Column]:
    """Exact match, Jaccard, precision, recall, F1 of two sets; two empty sets match exactly and score 0 else."""
    both, either = F.size(F.array_intersect(predicted, true)), F.size(F.array_union(predicted, true))
    n_pred, n_true = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(true))
    precision, recall = safe_divide(both, n_pred), safe_divide(both, n_true)
    return {"exact_set_match": (F.size(F.array_except(predicted, true)) + F.size(F.array_except(true, predicted)) == 0).cast("int"), "jaccard": safe_divide(both, either), "precision": precision, "recall": recall, "f1": f1_of(precision, recall)}


def token_cost(tokens: Column, usd_per_million: Column) -> Column:
    """Cost in exact decimals."""
    return (tokens.cast("decimal(20,0)") * usd_per_million.cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(38,12)")


def approximate_tokens(text: Column | str) -> Column:
    """At least one: 1.1 tokens for each UTF-8 byte, rounded up, and 32 more."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(_c(text)) * F.lit(11) / F.lit(10)) + 32).cast("long")


def mean_sd_text(mean: Column, sd: Column, digits: int = 3) -> Column:
    return F.when(mean.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f ± %.{digits}f", mean, F.coalesce(sd, F.lit(0.0))))


def stable_json(entries: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def normalised_label(label: Column | str) -> Column:
    """The label of an evaluation with the same letters and digits, whatever their case and what stands between them; null where there is none."""
    letters = lambda x: F.lower(F.regexp_replace(x, r"[\W_]+", ""))
    names = F.map_from_arrays(F.transform(F.array(*map(F.lit, EVALUATED)), letters), F.array(*map(F.lit, EVALUATED)))
    return names[letters(_c(label))]


def label_values(text: Column | str) -> Column:
    """The labels that a text lists: a JSON array of strings, or words between the last of LABEL_SIGNS that it has."""
    t = F.trim(_c(text))
    listed = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>"))
    parts = F.array(t)
    for sign in LABEL_SIGNS:
        parts = F.when(F.contains(t, F.lit(sign)), F.split(t, f"[{sign}]")).otherwise(parts)
    return F.filter(F.transform(F.coalesce(listed, parts, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def label_sets(values: Column) -> dict[str, Column]:
    """labels (known ones, in order of name), unknown (the others, in order) and status (missing, unknown, valid) of an array of raw labels."""
    held = F.coalesce(values, F.array().cast("array<string>"))
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(held, normalised_label), lambda x: x.isNotNull())))
    unknown = F.array_distinct(F.filter(held, lambda x: normalised_label(x).isNull()))
    return {"labels": labels, "unknown": unknown, "status": F.when(F.size(held) == 0, "missing").when(F.size(unknown) > 0, "unknown").otherwise("valid")}


def ordered_unique(values: Column | str) -> Column:
    """Values without repeats, each where it came first."""
    return F.array_distinct(_c(values))


def number(text: Column | str, least: float | None = None) -> Column:
    """A finite number in a text, else null; with `least`, smaller ones are null as well."""
    x = F.trim(_c(text).cast("string")).try_cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fine & (x >= least) if least is not None else fine, x)


def valid_sequence(seq: Column | str, others: list[str] | None = None) -> Column:
    """Two to four states, none unmapped, none twice in a row, and not a, b, a, b."""
    s = _c(seq)
    loop = (F.size(s) == 4) & (F.get(s, F.lit(0)) == F.get(s, F.lit(2))) & (F.get(s, F.lit(1)) == F.get(s, F.lit(3)))
    return F.size(s).between(2, 4) & ~F.exists(s, lambda x: x.isin(others or ["Other", OTHER])) & ~self_transition(s) & ~F.coalesce(loop, F.lit(False))


def low_information(seq: Column | str, marks: list[str], informative: Column | None = None) -> Column:
    """The share of a sequence's states that say little: those that a map of states says so of (a state that it lacks fails the job), else those named."""
    s = _c(seq)
    low = F.filter(s, lambda x: x.isin(marks)) if informative is None else F.filter(s, lambda x: ~F.coalesce(informative[x], F.raise_error(F.concat(F.lit("no attribute of state "), x)).cast("boolean")))
    return safe_divide(F.size(low), F.size(s))


def threshold_values(least: float, most: float, samples: int) -> list[float]:
    """Evenly spaced thresholds of four decimals; of one sample the least."""
    step = (most - least) / (samples - 1) if samples > 1 else 0.0
    return [round(least + step * i, 4) for i in range(max(1, samples))]
