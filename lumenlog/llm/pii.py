"""Operator 13, PII: bootstrapped contextual extraction.

1. `marked` reads every text once. Base identifiers (KINDS) are found by their fixed patterns: the seeds. What only looks like one (`Finder.candidates`: an address
   with its signs spelled out, groups of hex digits, numbers as long as a card's or a phone's) is a candidate. Seeds and candidates keep the patterns of
   the words around them: one to three words before it, and the word before with the word behind.
2. `bootstrapped` scores the graph of patterns and values. A pattern's confidence for a kind is the lower end of the Wilson interval of its share of that kind: values known to be of
   the kind against values that are not, where a candidate of fitting shape that nothing is known of counts UNKNOWN. Patterns with LEAST known values and a confidence of ACCEPT give it to
   the candidates that they surround and that fit; a value's confidence is that of its best pattern, and a seed's is 1. So a value found in one place
   makes patterns of others known, round by round, until no value is new. Each value counts once for a pattern, however often it is repeated.
3. `spans` adds the places of candidates whose value has been accepted, which also holds for one whose value is a seed's elsewhere.

Only seeds and candidates, never texts, are shuffled: by pattern and by value, with sums made before, and joins that Spark can split. Rounds are stored in the
shared folder.

Base patterns, leftmost and without overlap in their kind, a failing match being dropped with no other try:
email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`; ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, parts at most 255; card `[0-9]([\\x20-]?[0-9])+`, 14 to 19
digits that pass Luhn's test; phone `\\+[0-9][\\x20().0-9-]+[0-9]`, 10 to 15 digits. They are searched in time linear in the text's length.

Defined results: a null text is an empty one, without spans; a null doc_id is kept; rows that repeat have equal spans, and their values count once; an added span overlaps no base span
and no other added one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROWS = 256
LEAST = 5
ACCEPT = 0.6
UNKNOWN = 0.25
Z = 1.28
#: Words of a pattern are looked for in so many code points on either side.
AROUND = 96
#: A longer value is known by its hash.
VALUE = 128
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HEX = "0123456789abcdefABCDEF"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_QUAD = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+")
_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ().\-/]{0,2}[0-9])*+")
_AT = re.compile(r"[\[({] ?[aA][tT] ?[\])}]")
_DOTTED = re.compile(r" ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?[dD][oO][tT] ?[\])}] ?)[A-Za-z0-9-]++)*+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*+")
_SIX = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{0,4}|[0-9A-Fa-f:]*::[0-9A-Fa-f:]*")
_SHIELDED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])")
_DOT = re.compile(r" ?[\[({] ?[dD][oO][tT] ?[\])}] ?| dot ")
_NO_DIGIT = re.compile(r"[^0-9]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>.,;:?!#%&*_~^-=/\\|+`"
_ZERO = str.maketrans("123456789", "000000000")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the base identifiers of a text, by start, then kind."""
    out, upto, before = [], 0, 0
    at = text.find("@")
    while at >= 0:
        # the name's part is a run of its signs, and none holds an @; what a match has taken is gone
        low = max(upto, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, EMAIL, upto := m.end()))
        before = at + 1
        at = text.find("@", before)
    for m in _QUAD.finditer(text):  # a run of digits at a time; one alone is no match
        if "." in m[0] and all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), IP, m.end()))
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < 40 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int, int, str]]:
    """start, end, bits of the kinds that it fits, value: what looks like an identifier; base ones may be among them."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(_LOCAL))
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end(), 1 << EMAIL, text[start : m.end()].lower()
        last = at + 1
        at = text.find("@", last)
    last = 0
    for a in _AT.finditer(text):
        name = text[last : a.start() - (text[a.start() - 1 : a.start()] == " ")]
        start = last + len(name.rstrip(_LOCAL))
        if start < last + len(name) and (m := _DOTTED.match(text, a.end())):
            yield start, m.end(), 1 << EMAIL, f"{name[start - last :]}@{_DOT.sub('.', m[0].strip())}".lower()
        last = a.end()
    if " dot " in text:
        for m in _SPELLED.finditer(text):
            name, _, host = m[0].partition(" at ")
            yield m.start(), m.end(), 1 << EMAIL, f"{name}@{_DOT.sub('.', host)}".lower()
    for m in _COLONS.finditer(text):
        head = text[max(0, m.start() - 5) : m.start()]
        start = m.start() - len(head) + len(head.rstrip(_HEX))
        if m.end() - start <= 40 and _SIX.fullmatch(text, start, m.end()) and not text[start - 1 : start].isalnum() and not text[m.end() : m.end() + 1].isalnum():
            yield start, m.end(), 1 << IP, text[start : m.end()].lower()
    if "[.]" in text or "(.)" in text:
        for m in _SHIELDED.finditer(text):
            yield m.start(), m.end(), 1 << IP, re.sub(r"[^0-9]+", ".", m[0])
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if end - start >= 7 and 7 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum():
            fits = (7 <= len(d) <= 15) << PHONE | (12 <= len(d)) << CARD
            yield start - (start > 0 and text[start - 1] in "+("), end, fits, d


def value_of(text: str, kind: int, start: int, end: int) -> str:
    held = text[start:end]
    return held.lower() if kind == EMAIL else held if kind == IP else _NO_DIGIT.sub("", held)


def words(text: str) -> list[str]:
    """Words as patterns have them: lower-cased, digits as 0, without signs around them."""
    return [w for x in _BLANK.split(text) if (w := x.lower().translate(_ZERO).strip(_EDGE))]


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands around a place, as patterns; words that reach out of the window are not in it."""
    low, high = max(0, start - AROUND), min(len(text), end + AROUND)
    left, right = text[low:start], text[end:high]
    if low and (m := _BLANK.search(left)):
        left = left[m.end() :]
    elif low:
        left = ""
    behind = words(_BLANK.split(right.lstrip("\x20\t\n\v\f\r" + _EDGE), 1)[0])
    w = words(left)[-3:]
    out = [" ".join([*w[-n:], "_"]) for n in range(1, len(w) + 1)]
    return out + ([f"{w[-1]} _ {behind[0]}"] if w and behind else [])


def places(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, str, list[str]]]]:
    """Base spans, and the marks of seeds and candidates: start, end, kind (-1: candidate), fits, value, patterns."""
    seeds, taken = base(text), []
    for start, kind, end in seeds:
        taken.append((start, end, kind, 1 << kind, value_of(text, kind, start, end)))
    free, upto, i, edge = [], 0, 0, 0
    for start, end, fits, value in sorted(candidates(text), key=lambda x: (x[0], -x[1])):
        while i < len(seeds) and seeds[i][0] < end:
            edge, i = max(edge, seeds[i][2]), i + 1
        if start >= upto and start >= edge:
            free.append((start, end, -1, fits, value))
            upto = end
    hashed = lambda v: v if len(v) <= VALUE else hashlib.sha256(v.encode("utf-8")).hexdigest()
    return seeds, [(*x[:4], hashed(x[4]), patterns(text, x[0], x[1])) for x in taken + free]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MARK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("fits", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
MARKED = "row long, doc_id long, base array<struct<start: int, kind: int, end: int>>, marks array<struct<start: int, end: int, kind: int, fits: int, value: string, patterns: array<string>>>"


def marked(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, base, marks of every row; stored, since all later steps read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                found = [places(t.as_py() or "") for t in piece.column("text")]
                spans = [[dict(zip(("start", "kind", "end"), x)) for x in s] for s, _ in found]
                marks = [[dict(zip(("start", "end", "kind", "fits", "value", "patterns"), x)) for x in m] for _, m in found]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(found)), pa.int64()), piece.column("doc_id"), pa.array(spans, _SPAN), pa.array(marks, _MARK)], names=["row", "doc_id", "base", "marks"])
                row += len(found)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MARKED), "marks")


def _low(share: Column, n: Column) -> Column:
    """The lower end of the Wilson interval."""
    z = Z * Z
    return (share + z / (2 * n) - F.lit(Z) * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def _confidences(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)]


def scored_patterns(edges: DataFrame, values: DataFrame) -> DataFrame:
    """pattern, c0, c1, ..: the confidence of patterns that are accepted for a kind, else 0."""
    names = _confidences(len(KINDS))
    fits = lambda k: F.col("fits").bitwiseAND(1 << k) > 0
    of = [x for k, c in enumerate(names) for x in (F.sum(c).alias(f"_sum{k}"), F.count_if(F.col(c) > 0).alias(f"_known{k}"), F.sum(F.when((F.col(c) == 0) & fits(k), UNKNOWN).otherwise(1.0)).alias(f"_n{k}"))]
    held = edges.join(values, "value").groupBy("pattern").agg(*of)
    low = [F.when(F.col(f"_known{k}") >= LEAST, F.round(_low(F.col(f"_sum{k}") / F.col(f"_n{k}"), F.col(f"_n{k}")), 9)).otherwise(0.0) for k in range(len(names))]
    return held.select("pattern", *(F.when(x >= ACCEPT, x).otherwise(0.0).alias(c) for c, x in zip(names, low))).filter(F.greatest(*names) > 0)


def bootstrapped(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """values (value, c0, c1, .. by kind, of those that are known) and patterns (pattern, c0, ..), when no round finds a value more."""
    names = _confidences(len(KINDS))
    mark = found.select(F.explode("marks").alias("m")).select("m.value", "m.kind", "m.fits", "m.patterns")
    edges = written(mark.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = [F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(c) for k, c in enumerate(names)]
    values = written(mark.groupBy("value").agg(F.bit_or("fits").alias("fits"), *seeds), "values")
    known = -1
    while (now := values.agg(F.coalesce(F.sum(sum(F.when(F.col(c) > 0, 1).otherwise(0) for c in names)), F.lit(0))).first()[0]) > known:
        known = now
        accepted = written(scored_patterns(edges, values), "patterns")
        given = edges.join(accepted, "pattern").groupBy("value").agg(*(F.max(c).alias(f"_{c}") for c in names))
        fitting = [F.greatest(c, F.when(F.col("fits").bitwiseAND(1 << k) > 0, F.coalesce(f"_{c}", F.lit(0.0))).otherwise(0.0)).alias(c) for k, c in enumerate(names)]
        values = written(values.join(given, "value", "left").select("value", "fits", *fitting), "values")
    return values.filter(F.greatest(*names) > 0).drop("fits"), accepted


def spans(found: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row: spans are the base ones and the places of candidates whose value is known; start, kind (as in KINDS), end."""
    names = _confidences(len(KINDS))
    best = F.greatest(*names)
    kind = F.coalesce(*(F.when(F.col(c) == best, k) for k, c in enumerate(names)))
    open_ = found.select("row", F.explode("marks").alias("m")).filter("m.kind < 0").select("row", "m.start", "m.end", "m.fits", "m.value")
    hit = open_.join(values.select("value", kind.alias("kind")), "value").filter(F.expr("(fits & shiftleft(1, kind)) > 0"))
    more = hit.groupBy("row").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("kind").cast("int").alias("kind"), F.col("end").cast("int").alias("end"))).alias("more"))
    own = found.select("row", "doc_id", "base").join(more, "row", "left")
    return own.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.slice("base", 1, 0)))).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row, by all three steps."""
    found = marked(docs)
    return spans(found, bootstrapped(found)[0])


def listed(spans: str | Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def counts(spans: str | Column) -> list[Column]:
    """n_email, n_ip, n_card, n_phone: how many of the spans are of each kind."""
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k))  # noqa: E731  a second argument would be taken for the place in the array
    return [of(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]


def masked(text: str | Column, spans: str | Column) -> Column:
    """The text with each span replaced by its kind in square brackets; of spans that overlap, the first one is replaced and what others have beyond it goes as well."""
    text, spans = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
