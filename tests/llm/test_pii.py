import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenlog.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def brute_base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@pytest.mark.parametrize("signs, longest", [("a@.-", 14), ("01.@", 12), ("0123 -+()", 40), ("12.34@ax+ -", 30), ("4111 -", 24), ("é1@.中+5", 20)])
def test_base_is_what_the_patterns_match(signs, longest):
    rng = random.Random(signs)
    for _ in range(6000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, longest)))
        assert pii.base(text) == brute_base(text), text


def test_cards_and_addresses():
    text = "Pay 4111 1111-1111 1111 or 4111111111111112, from 10.0.0.255 or 10.0.0.256, to x.y+z@mail.example.com, +49 (30) 1234-5678."
    assert [(text[a:b], k) for a, k, b in pii.base(text)] == [("4111 1111-1111 1111", 2), ("10.0.0.255", 1), ("x.y+z@mail.example.com", 0), ("+49 (30) 1234-5678", 3)]


LONG = {"letters": "a" * 1_000_000, "digits": "1" * 1_000_000, "spaced digits": "1 " * 500_000 + "x", "dots": "1." * 500_000, "at signs": "@" * 500_000, "names": "a@" * 300_000, "pluses": "+1" * 400_000, "phone": "+1" + "-" * 900_000, "colons": "a:" * 400_000, "marks": "[at]" * 200_000, "spelled": " dot " + "a at b " * 150_000, "open": "(" * 900_000}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_words_take_linear_time(name):
    began = time.time()
    pii.places(LONG[name])
    assert time.time() - began < 15, name


def brute_bootstrap(texts):
    """Known values by kind, from dictionaries."""
    fits, conf, around = {}, {}, {}
    for t in texts:
        for _, _, kind, f, value, pats in pii.places(t)[1]:
            fits[value] = fits.get(value, 0) | f
            c = conf.setdefault(value, [0.0] * 4)
            if kind >= 0:
                c[kind] = 1.0
            for p in pats:
                around.setdefault(p, set()).add(value)
    known = -1
    while (now := sum(x > 0 for c in conf.values() for x in c)) > known:
        known, given = now, {}
        for p, values in around.items():
            for k in range(4):
                c = [conf[v][k] for v in values]
                n = sum(1.0 if x or not fits[v] >> k & 1 else pii.UNKNOWN for x, v in zip(c, values))
                if sum(x > 0 for x in c) >= pii.LEAST:
                    s, z = sum(c) / n, pii.Z**2
                    low = (s + z / (2 * n) - pii.Z * math.sqrt(s * (1 - s) / n + z / (4 * n * n))) / (1 + z / n)
                    if round(low, 9) >= pii.ACCEPT:
                        for v in values:
                            given[v, k] = max(given.get((v, k), 0.0), round(low, 9))
        for (v, k), x in given.items():
            if fits[v] >> k & 1:
                conf[v][k] = max(conf[v][k], x)
    return {v: c for v, c in conf.items() if max(c) > 0}


def brute_spans(texts):
    known = brute_bootstrap(texts)
    out = []
    for t in texts:
        spans, marks = pii.places(t)
        for a, b, kind, fits, value, _ in marks:
            if kind < 0 and value in known and fits >> (k := known[value].index(max(known[value]))) & 1:
                spans = [*spans, (a, k, b)]
        out.append(sorted(spans))
    return out


def planted():
    texts = [f"For help call me at +1 (555) 010-{1000 + i} today." for i in range(30)]
    texts += ["For help call me at 555-0199-321 today.", "My old line was 555 0199 321, gone now.", "Year 2024-11-28 saw 1234567 things."]
    texts += [f"word{i} fax number {550_000_1000 + i} here" for i in range(9)]  # known by the next ones only
    texts += [f"please call me at {550_000_1000 + i} today" for i in range(8)]
    texts += [f"Write to user{i}@mail.example.com now" for i in range(6)] + ["Write to admin@localhost now", "ask user3 [at] mail [dot] example [dot] com", "ask nobody [at] mail [dot] example [dot] com", "Write to noon now"]
    texts += [f"in {1900 + i} there were {i}000000 of them" for i in range(40)]
    return texts


def test_contexts_and_values_find_more(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts)
    found = {texts[i][a:b]: pii.KINDS[k] for i, s in got.items() for a, k, b in s if (a, k, b) not in pii.base(texts[i])}
    assert found["555-0199-321"] == found["555 0199 321"] == found["5500001003"] == "phone"  # by context, by value
    assert found["5500001008"] == "phone"  # by a pattern that values of another one made known
    assert found["admin@localhost"] == found["user3 [at] mail [dot] example [dot] com"] == "email"
    assert not {"nobody [at] mail [dot] example [dot] com", "2024-11-28", "1234567", "39000000"} & set(found)


def test_random_graphs_are_as_by_brute_force(spark):
    rng = random.Random(3)
    number = lambda: rng.choice([f"+1 555 {rng.randint(100, 130)} 2222", f"555 {rng.randint(100, 130)} 2222", f"{rng.randint(10, 30)}1234567", f"u{rng.randint(0, 9)}@a.org", f"u{rng.randint(0, 20)}@a", f"10.0.0.{rng.randint(0, 300)}"])
    texts = [" ".join(x for _ in range(rng.randint(1, 4)) for x in (rng.choice("abc"), rng.choice("de"), number())) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values, _ = pii.bootstrapped(pii.marked(docs))
    want = brute_bootstrap(texts)
    assert {r.value: [round(x, 6) for x in r[1:]] for r in values.collect()} == {v: [round(x, 6) for x in c] for v, c in want.items()}
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts)


def test_odd_rows(spark, odd_docs, no_docs):
    more = odd_docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" é a@b.org 1.2.3.4")))
    rows = sorted(((r.doc_id, r.text) for r in more.collect()), key=str)
    got = sorted(((r.doc_id, r.text) for r in pii.personal_data(more).select("doc_id", F.concat_ws("|", pii.listed("base"), pii.listed("spans")).alias("text")).collect()), key=str)
    listed = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(t))
    assert got == sorted([(i, f"{listed(t)}|{listed(t)}") for i, t in rows], key=str)
    assert pii.personal_data(odd_docs).filter(F.size("spans") > 0).count() == 0 and pii.personal_data(odd_docs).count() == odd_docs.count()
    assert pii.personal_data(no_docs).count() == 0


def test_masked(spark):
    text = "é mail a@b.org or +1 555 010 2000."
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    rows = docs.join(pii.personal_data(docs), "doc_id").orderBy("doc_id").select(pii.masked("text", "spans").alias("x")).collect()
    assert [r.x for r in rows] == ["é mail [email] or [phone].", "none"]


def test_query_counts_spans_of_each_kind(spark, tmp_path):
    from lumenlog.llm import queries

    texts = [None, "", "1.2.3.4", "a@b.org, c@d.org and e@f.org", "+1 555 010 2000 from 10.0.0.1 to 10.0.0.2, card 4111 1111-1111 1111 of a@b.org", "4111111111111111 " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in queries.op13_pii(spark, str(tmp_path)).collect()}
    assert got == {i: tuple(sum(k == n for _, k, _ in brute_base(t or "")) for n in range(4)) for i, t in enumerate(texts)}
