import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenlog.llm import fill_in_middle as fim


def brute(doc_id, text, seed=42, rate=50, spm=80):
    """The whole array of units, cut at both ranks."""
    units = re.findall(fim.UNIT, text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def test_random_texts_are_as_by_brute_force():
    rng, make = random.Random(5), fim.Transformer(42, 90, 50, fim.MARKS, fim.UNIT)
    for i in range(4000):
        text = "".join(rng.choice("ab <PSM>\n\té中 \U0001f600") for _ in range(rng.randint(0, 30)))
        assert make(i, text) == brute(i, text, rate=90, spm=50), text


def test_transformed_and_restored(spark, odd_docs, no_docs):
    more = odd_docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(odd_docs.withColumn("text", F.concat(F.col("text"), F.lit(" <S> x"))))
    got = fim.transformed(more, rate=100).withColumn("back", fim.restored())
    rows = [(r.doc_id, r.text or "") for r in more.collect()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, *brute(i, t, rate=100), t)) for i, t in rows)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    assert fim.transformed(no_docs).count() == 0


def test_marks_that_texts_nearly_hold(spark):
    texts = ["a <", "<P", "S> <", "M>", "< P>", "<S <M <P", "x <" * 30]
    docs = spark.createDataFrame([(10 * k + i, t) for k in range(5) for i, t in enumerate(texts)], "doc_id long, text string")
    made = fim.transformed(docs, rate=100, spm=50).withColumn("back", fim.restored()).join(docs, "doc_id")
    assert made.filter("back <> text").count() == 0 and made.count() == 35
    with pytest.raises(ValueError):
        fim.transformed(docs, marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fim.transformed(docs, marks=("<P>", "<S<", "<M>"))


def test_other_marks(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(i, f"one two{i} three <P>") for i in range(20)], "doc_id long, text string")
    made = fim.transformed(docs, seed=7, rate=100, spm=50, marks=marks)
    assert made.filter("form = 'plain'").count() == 0
    assert made.withColumn("back", fim.restored(marks=marks)).join(docs, "doc_id").filter("back <> text").count() == 0


@pytest.mark.parametrize("text", ["x" * 2_000_000, " " * 2_000_000, "a " * 1_000_000, " " * 1_000_000, " a" * 1_000_000 + " "])
def test_very_long_texts_take_linear_time(text):
    began = time.time()
    assert fim.Transformer(42, 100, 80, fim.MARKS, fim.UNIT)(1, text)[0] == len(re.findall(fim.UNIT, text))
    assert time.time() - began < 10
