"""Operator 5, toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. Language model: counts of character trigrams (ASCII letters after stripping accents, and word ends) over the words of all documents.
2. Restoration: a token that looks disguised (digits or signs among letters, runs of a letter, letters set apart by blanks) becomes a lattice: a
   sign may stand for itself-like letters or for nothing, a run for one letter or two. Viterbi search finds the letters with the best sum of channel and
   model costs. Letters set apart are restored to the last, in overlapping stretches; words of up to LONGEST letters are looked for in them. A chunk without ASCII blanks may be of any length: of one over LONGEST characters the parts between its signs are taken, and
   its letters as if set apart. Other tokens are only lower-cased and stripped of accents and of the signs around them. Letters of other scripts than Latin are not searched, as
   the model has none; their words are features as they stand, and so are two and three signs in a row of scripts that set no blanks (from U+2E80 on).
3. Score: words and word beginnings of the restored text are counted in labelled documents of either class. A feature whose precision is above one half
   by the lower end of its Wilson interval is evidence; a document's score is the noisy-or of its three strongest, or the base
   rate where it has none. Features are hashed to FEATURE_BITS bits in each of TABLES tables, whose size is fixed.

The classifier is fitted on SAMPLE labelled documents at most (those with the smallest hash of their id), never on the held-out fifth. The language
model and all scores cover every document.

Defined results: a null text is an empty one, with the base rate as its score; labels whose toxic or doc_id is null are not used; an id that is labelled
twice is toxic if one label says so; rows that repeat are scored alike; without labels every score is BASE; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, Spans, Table, of_worker, pieces_of, trimmed
from lumenlog.llm.shared import counted

SAMPLE = 50_000
FEATURE_BITS = 20
TABLES = 2
WILSON_Z = 2.2
LEAST = 6
BASE = 0.05
LETTERS = 27  # 0 is the word's end
_USED = (1 << FEATURE_BITS * TABLES) - 1
_hasher = Hasher()
SCORED = "doc_id long, held_out boolean, score double, predicted int"
# The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l", "¥": "y"}
KEEP, SWAP, DROP, ASIDE, SHORTEN = 0.0, 1.0, 12.0, 0.5, 8.0
LONGEST = 40
_ASIDE = "\"'()[]{}<>.,;:?!#%&*_~^-=/\\|+`´“”„«»…"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?!\w)")
_RUN = re.compile(r"([a-z])\1\1")
_BETWEEN = re.compile("(?:[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]|_)+")  # stands for no letter
_NO_LETTER = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_UNSPACED = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")
_LONG_RUN = re.compile(r"([a-z])\1{3,}|([^a-z])\2{2,}")


def folded(text: str) -> str:
    """Lower-cased, without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def bare(token: str) -> str:
    """Without the signs around it; a sign that is repeated behind a word belongs to what is around it."""
    token = token.strip(_ASIDE)
    if token and not (token[-1].isalnum() or token[-1] == "_"):
        kept = token.rstrip(token[-1])
        token = kept if len(kept) < len(token) - 1 else token
    return token.strip(_ASIDE)


def overlapping(token: str) -> Iterator[str]:
    """The whole token in stretches of 2 * LONGEST characters, each LONGEST after the one before: what has LONGEST characters at most is whole in one.

    Runs are shortened first to where the lattice tells no longer ones apart.
    """
    token = _LONG_RUN.sub(lambda m: m[1] * 3 if m[1] else m[2] * 2, token)
    for a in range(0, max(1, len(token) - LONGEST), LONGEST):
        yield token[a : a + 2 * LONGEST]


def disguised(token: str) -> bool:
    """Letters with digits or signs among them, or a run of three equal letters."""
    if token.isalpha():
        return _RUN.search(token) is not None
    return any(c.isalpha() for c in token)


def trigram_places(texts: list[str | None]) -> np.ndarray:
    """Trigrams of texts, as places in a cube of LETTERS; what is no letter ends a word."""
    x = np.frombuffer((" " + " ".join(folded(t) for t in texts if t) + " ").encode("utf-8"), np.uint8)
    x = np.where((x >= 97) & (x <= 122), x - 96, 0).astype(np.int32)
    return x[:-2] * (LETTERS * LETTERS) + x[1:-1] * LETTERS + x[2:]


class Restorer:
    """Viterbi search over the lattice of a token; states are the last two letters."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        cube[:, 0, 0] = 0  # gaps say nothing of words
        pair = cube.sum(0)
        smooth = (pair + 0.5) / (pair + 0.5).sum(1, keepdims=True)
        cost = -np.log((cube + 5 * smooth[None]) / (cube.sum(2, keepdims=True) + 5))
        # less the mean cost of a letter, so that a longer reading is not dearer for its length
        self.cost = cost - (cost * cube).sum() / max(1.0, cube.sum())
        self.rows = self.cost.tolist()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each place of the token, what may stand there and its channel cost."""
        out = []
        for m in re.finditer(r"(.)\1*", token):
            c, n = m[1], len(m[0])
            if "a" <= c <= "z":
                out.append([(c, KEEP)] if n == 1 else [(c, SHORTEN if n == 2 else KEEP), (c * 2, KEEP)])
            else:
                swaps = [(x, SWAP) for x in LEET.get(c, "")]
                out.append([*swaps, *((x * 2, SWAP) for x, _ in swaps if n > 1), ("", DROP if swaps else ASIDE)])
        return out

    def __call__(self, token: str) -> str:
        states = {(0, 0): (0.0, "")}
        for options in self.lattice(token):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for letters, price in options:
                    x, y, total = a, b, cost + price
                    for c in letters:
                        i = ord(c) - 96
                        total += self.rows[x][y][i]
                        x, y = y, i
                    held = after.get((x, y))
                    if held is None or (total, text + letters) < held:
                        after[x, y] = total, text + letters
            states = after
        return min(((cost + self.rows[a][b][0], text) for (a, b), (cost, text) in states.items()), default=(0.0, ""))[1]


def _places(key: str) -> tuple[int, ...]:
    h, mask = xxhash.xxh3_128_intdigest(key) & _USED, (1 << FEATURE_BITS) - 1
    return tuple([(h >> (FEATURE_BITS * t) & mask) + (t << FEATURE_BITS) for t in range(TABLES)])


def features(word: str, least: int = 3) -> list[tuple[int, ...]]:
    """The places of a word and of its beginnings, one in each of TABLES tables."""
    if len(word) < least:
        return []
    return [_places(k) for k in (word, *(word[:n] + "*" for n in (5, 7) if len(word) > n))]


class Words:
    """The restored words of chunks and of spaced-out letters."""

    def __init__(self, restore: Restorer):
        self.restore = restore

    def of(self, chunk: str) -> list[tuple[int, ...]]:
        plain = chunk.strip(_ASIDE)
        if plain.isalpha() and plain.isascii() and plain.islower() and chunk.isascii() and len(plain) <= LONGEST and not _RUN.search(plain):
            return features(plain)  # nothing to restore: most chunks are a word with signs around it
        whole = folded(chunk)
        token = bare(whole)
        tokens = {token, *map(bare, whole.split())}  # a chunk may hold blanks that are not ASCII
        if len(token) > LONGEST:
            tokens |= {bare(x) for between in (_BETWEEN, _NO_LETTER) for x in between.split(token)}
        found = {f: None for w in re.findall(r"[a-z]{3,}", token) for f in features(w)}
        if not whole.isascii():
            found |= {f: None for w in _WORD.findall(whole) if not w.isascii() for f in features(w, 2)}
            found |= {_places(w[a : a + n]): None for w in _UNSPACED.findall(whole) for n in (2, 3) for a in range(len(w) - n + 1)}
        for t in sorted(filter(disguised, tokens)):
            restored = [self.restore(x) for x in overlapping(t)]
            found |= dict.fromkeys(features(restored[0]))
            if len(t) > LONGEST:
                found |= dict.fromkeys(_stretches(*set(restored)))
        return list(found)

    def spaced(self, text: str) -> Iterator[str]:
        """Letters that stand alone, put together; all of them restored, in overlapping stretches. Letters of other scripts stay."""
        for m in _SPACED.finditer(text):
            for x in overlapping(re.sub(r"[ .\-_*]", "", folded(m[0]))):
                yield self.restore(x)
                yield from (w for w in _WORD.findall(x) if not w.isascii())


def language_model(docs: DataFrame) -> np.ndarray:
    return counted(docs.select("text"), trigram_places, LETTERS**3)


def labelled_sample(labels: DataFrame, usable: Column) -> DataFrame:
    """doc_id, toxic of SAMPLE labelled documents at most: those whose id hashes lowest."""
    rows = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def evidence(docs: DataFrame, sample: DataFrame, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """For each place of each table its precision where it is evidence, else 0; and the share of toxic documents, BASE at most.

    A feature's strength is the least of its places': a word that shares a place with one that is evidence does so in one table.
    """
    size = TABLES << FEATURE_BITS

    def places(rows: list[dict]) -> np.ndarray:
        words, out, at = Words(Restorer(counts)), [np.empty(0, np.int64)], 0
        held: dict[bytes, list[int]] = {}
        for some in pieces_of([r["text"] for r in rows]):
            spans = _hasher(some, lower=True)
            for i, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist())):
                toxic, found = rows[at + i]["toxic"], set()
                for k in {spans.bytes(j) for j in range(a, b)}:
                    if k not in held:
                        held[k] = [p for f in words.of(k.decode("utf-8")) for p in f]
                    found.update(held[k])
                if _may_be_spaced(spans, a, b):
                    found.update(p for whole in words.spaced(some[i].decode("utf-8")) for f in _stretches(whole) for p in f)
                out += [np.array(sorted(found), np.int64) + size * toxic, np.array([2 * size + toxic])]
            at += len(some)
        return np.concatenate(out)

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).alias("row"))
    held = counted(rows, places, 2 * size + 2)
    clean, toxic, (n_clean, n_toxic) = held[:size], held[size : 2 * size], held[2 * size :]
    n = np.maximum(1, clean + toxic)
    p, z2 = toxic / n, WILSON_Z**2
    low = (p + z2 / (2 * n) - WILSON_Z * np.sqrt(p * (1 - p) / n + z2 / (4 * n**2))) / (1 + z2 / n)
    strength = np.where((toxic >= LEAST) & (low > 0.5), (toxic + 0.5) / (n + 1), 0.0)
    base = min(BASE, n_toxic / max(1, n_toxic + n_clean)) if n_toxic else BASE
    return strength.astype(np.float32), float(base)


def strongest(strength: np.ndarray, found: list[tuple[int, ...]]) -> float:
    return max([min([strength.item(p) for p in f]) for f in found], default=0.0)


def _stretches(*wholes: str) -> list[tuple[int, ...]]:
    """Features of what letters that stood alone may spell, several words included, each of 4 to LONGEST letters."""
    return [_places(w) for w in {whole[a:b] for whole in wholes for a in range(len(whole)) for b in range(a + 4, min(len(whole), a + LONGEST) + 1)}]


def _may_be_spaced(spans: Spans, a: int, b: int) -> bool:
    """Whether four words in a row are short enough to be letters that stand alone."""
    short = spans.stop[a:b] - spans.start[a:b] <= 2
    return b - a >= 4 and bool((short[:-3] & short[1:-2] & short[2:-1] & short[3:]).any())


def scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. held_out: a condition on doc_id; labels for which it holds are never used."""
    counts = language_model(docs)
    strength, base = evidence(docs, labelled_sample(labels, ~held_out), counts)
    run_key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((counts, strength, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(run_key, sent)
        for batch in batches:
            found = np.array([x for held in pieces_of(batch.column("text")) for x in score(held)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        trimmed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCORED)


class Scorer:
    """Scores of texts; the strength of each word that was seen is kept."""

    def __init__(self, counts: np.ndarray, strength: np.ndarray, base: float):
        self.words, self.strength, self.base = Words(Restorer(counts)), strength, base
        self.table = Table(lambda word: strongest(strength, self.words.of(word)), np.float64, 300_000)

    def __call__(self, held: list[bytes]) -> Iterator[float]:
        spans = _hasher(held, lower=True)
        values = self.table(spans)
        hits = np.flatnonzero(values)
        cut = np.searchsorted(hits, spans.first).tolist()
        for i, (a, b) in enumerate(zip(spans.first[:-1].tolist(), spans.first[1:].tolist())):
            own = hits[cut[i] : cut[i + 1]]
            strong = sorted(dict(zip(spans.key[own].tolist(), values[own].tolist())).values(), reverse=True)[:3] if len(own) else []
            if _may_be_spaced(spans, a, b):
                for whole in self.words.spaced(held[i].decode("utf-8")):
                    strong = sorted([*strong, strongest(self.strength, _stretches(whole))], reverse=True)[:3]
            left = 1 - self.base
            for v, part in zip(strong, (1.0, 0.5, 0.25)):
                left *= 1 - v * part
            yield 1 - left


def _scorer(key: str, sent) -> Scorer:
    """The worker's scorer for a run, so that tasks share what it has seen."""
    return of_worker("scorer", key, lambda: Scorer(*sent.value))
