from decimal import Decimal

from pyspark.sql import functions as F

from lumenlog import functions as fn
from lumenlog.functions import OTHER


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def seq(text):
    return F.array(*[F.lit(x) for x in text.split()])


def test_overlap_and_iou(spark):
    r = one(spark, o=fn.overlap_seconds(ts("2024-01-01 10:00"), ts("2024-01-01 10:10"), ts("2024-01-01 10:05"), ts("2024-01-01 10:15")), i=fn.temporal_iou(ts("2024-01-01 10:00"), ts("2024-01-01 10:10"), ts("2024-01-01 10:05"), ts("2024-01-01 10:15")), apart=fn.overlap_seconds(ts("2024-01-01 10:00"), ts("2024-01-01 10:01"), ts("2024-01-01 11:00"), ts("2024-01-01 11:01")))
    assert (r.o, round(r.i, 6), r.apart) == (300.0, round(5 / 15, 6), 0.0)


def test_bands_and_half_open_ends(spark):
    r = one(spark, a=fn.time_band(ts("2024-01-01 05:59:59")), b=fn.time_band(ts("2024-01-01 06:00:00")), inside=fn.within_band(ts("2024-01-01 09:00:00"), ts("2024-01-01 10:00:00"), F.lit("Morning")), outside=fn.within_band(ts("2024-01-01 09:00:00"), ts("2024-01-01 10:00:01"), F.lit("Morning")), wrap=fn.time_band(ts("2024-01-01 23:00:00"), {"Late": (22, 4)}))
    assert (r.a, r.b, r.inside, r.outside, r.wrap) == ("Midnight", "Morning", True, False, "Late")


def test_binary_values(spark):
    rows = spark.createDataFrame([("on",), (" OPEN ",), ("0",), ("CLOSE",), ("warm",)], "v string").select(fn.binary_value("v").alias("b")).collect()
    assert [r.b for r in rows] == [1, 1, 0, 0, None]


def test_structure_of_sequences(spark):
    r = one(
        spark,
        loop=fn.alternating_loop(seq("A B A B")),
        aaaa=fn.alternating_loop(seq("A A A A")),
        self_=fn.self_transition(seq("A A")),
        trip=fn.other_round_trip(F.array(F.lit("1"), F.lit(OTHER), F.lit("1")), [OTHER]),
        light=fn.keep_light(seq("A B"), [OTHER]),
        medium=fn.keep_medium(seq("A B A"), [OTHER]),
        strong=fn.keep_strong(seq("A B C A"), [OTHER]),
        reason=fn.filter_reason(seq("A B A B"), F.lit(10.0), F.lit(99.0), [OTHER], 5.0, 100.0),
    )
    assert (r.loop, r.aaaa, r.self_, r.trip, r.light, r.medium, r.strong, r.reason) == (True, False, True, True, True, False, False, "alternating_loop;median_duration")


def test_parts_of_sequences(spark):
    r = one(spark, equal=fn.has_part(seq("A B"), seq("A B")), proper=fn.has_part(seq("A B"), seq("A B"), proper=True), inner=fn.has_part(seq("X A B"), seq("A B"), proper=True), prefix=fn.has_part(seq("AA B"), seq("A B")), subs=fn.subsequences(seq("A B C")), parsed=fn.parse_sequence(F.lit("A → B|C")))
    assert (r.equal, r.proper, r.inner, r.prefix, r.parsed) == (True, False, True, False, ["A", "B", "C"])
    assert sorted(r.subs) == ["A->B", "A->B->C", "B->C"]


def test_set_scores(spark):
    r = one(spark, **fn.set_scores(seq("Meal Relax"), seq("Meal")))
    assert (r.exact_set_match, r.jaccard, r.precision, r.recall, round(r.f1, 6)) == (0, 0.5, 0.5, 1.0, round(2 / 3, 6))
    empty = F.array().cast("array<string>")
    r = one(spark, **fn.set_scores(empty, empty))
    assert (r.exact_set_match, r.jaccard, r.f1) == (1, 0.0, 0.0)


def test_costs_are_exact(spark):
    assert one(spark, c=fn.token_cost(F.lit(3), F.lit("0.1"))).c == Decimal("0.0000003")


def test_small_text_forms(spark):
    r = one(spark, unique=fn.ordered_unique(seq("b a b c a")), json=fn.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), sd=fn.mean_sd_text(F.lit(0.5), F.lit(None).cast("double")), none=fn.mean_sd_text(F.lit(None).cast("double"), F.lit(1.0)))
    assert (r.unique, r.json, r.sd, r.none) == (["b", "a", "c"], '{"a":2,"b":1}', "0.500 ± 0.000", "-")
