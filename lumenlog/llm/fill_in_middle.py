"""Operator 12, fill-in-middle transformation: a two-pass streaming matcher in constant memory.

A text is cut into units (a word with the white space before it, or white space at the end). The first pass counts the matches of a lazy iterator
and keeps none of them. Two ranks are drawn from the document's id; the second pass advances a fresh iterator to the smaller rank and on to the larger,
and takes the two places where it then stands. So a text of any length costs its own bytes and two numbers.

`transformed` gives the text in its new form, `restored` gets the text back from output and form alone. Draws are the unsigned numbers in the first four
groups of eight hex digits of the sha256 of `seed:doc_id`, so a document has the same form wherever and whenever it is read; there is no shuffle.

Defined results: a null text is an empty one, which is plain; a text that holds a mark is plain, as it could not be told from a transformed one; a null
doc_id is drawn for as an empty one; rows that repeat give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 256
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle. They begin with a sign that they hold once, so what stands between them is found again.
MARKS = ("<P>", "<S>", "<M>")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits that depend on the seed and the id only."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def counted(unit: re.Pattern, text: str) -> int:
    """First pass: how many units the text has. Of the matches, only the last one's number is kept."""
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where unit number `first` and unit number `second` end (first <= second; none has number 0, whose end is 0)."""
    matches = unit.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


class Transformer:
    """One text at a time. rate and spm: of 100 texts, how many are transformed, and of 100 of these, how many have the suffix first."""

    def __init__(self, seed: int, rate: int, spm: int, marks: tuple[str, str, str], unit: str):
        self.seed, self.rate, self.spm, self.marks, self.unit = seed, rate, spm, marks, re.compile(unit)

    def __call__(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        n = counted(self.unit, text)
        h1, h2, h3, h4 = draws(self.seed, doc_id)
        if not text or h3 % 100 >= self.rate or any(m in text for m in self.marks):
            return n, "plain", None, None, text
        a, b = ends(self.unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
        p, s, m = self.marks
        if h4 % 100 < self.spm:
            return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def _marked(marks: tuple[str, str, str]) -> None:
    if len(set(marks)) < 3 or any(not m or m[0] in other[1:] for m in marks for other in marks):
        raise ValueError("marks have to differ, and none may hold a mark's first sign but at its own begin")


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS, unit: str = UNIT) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output: each text in its new form."""
    _marked(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Transformer(seed, rate, spm, marks, unit)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                rows = [make(i.as_py(), t.as_py() or "") for i, t in zip(piece.column("doc_id"), piece.column("text"))]
                n, form, before, middle, out = zip(*rows)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that `transformed` was given, from its output and form."""
    _marked(marks)
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = marks
    middle, outer = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    before = lambda x, mark, first: F.substr(F.substring_index(x, mark, 1), F.lit(len(first) + 1))
    psm = F.concat(before(outer, s, p), middle, F.substring_index(outer, s, -1))
    spm = F.concat(F.substring_index(outer, p, -1), middle, before(outer, p, s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
