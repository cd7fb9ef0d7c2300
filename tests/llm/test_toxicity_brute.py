"""Scores of operator 5 against a plain re-implementation: counts in dictionaries, every reading of a token, features by name."""

import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import stages, toxicity

SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class Plain:
    def __init__(self, texts):
        x = " " + " ".join(fold(t) for t in texts if t) + " "
        x = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in x]
        cube = {}
        for a, b, c in zip(x, x[1:], x[2:]):
            if b or c:
                cube[a, b, c] = cube.get((a, b, c), 0) + 1
        pair = {}
        for (_, b, c), n in cube.items():
            pair[b, c] = pair.get((b, c), 0) + n
        smooth = {(b, c): (pair.get((b, c), 0) + 0.5) / (sum(pair.get((b, k), 0) for k in range(27)) + 0.5 * 27) for b in range(27) for c in range(27)}
        self.cost = {}
        for a, b in itertools.product(range(27), repeat=2):
            total = sum(cube.get((a, b, c), 0) for c in range(27)) + 5
            for c in range(27):
                self.cost[a, b, c] = -math.log((cube.get((a, b, c), 0) + 5 * smooth[b, c]) / total)
        mean = sum(self.cost[k] * n for k, n in cube.items()) / sum(cube.values())
        self.cost = {k: v - mean for k, v in self.cost.items()}

    def restored(self, token):
        options = []
        for m in re.finditer(r"(.)\1*", token):
            c, n = m[1], len(m[0])
            if "a" <= c <= "z":
                options.append([(c, 0.0)] if n == 1 else [(c, 8.0 if n == 2 else 0.0), (c * 2, 0.0)])
            else:
                swaps = [(s * k, 1.0) for s in SIGNS.get(c, "") for k in ((1, 2) if n > 1 else (1,))]
                options.append([*swaps, ("", 12.0 if swaps else 0.5)])

        def price(reading):
            a = b = 0
            total = 0.0
            for letters, cost in reading:
                total += cost
                for c in letters:
                    total += self.cost[a, b, ord(c) - 96]
                    a, b = b, ord(c) - 96
            return total + self.cost[a, b, 0]

        return min((price(r), "".join(x for x, _ in r)) for r in itertools.product(*options))[1]

    @staticmethod
    def names(word):
        return {word, *(word[:n] + "*" for n in (5, 7) if len(word) > n)} if len(word) > 2 else set()

    def of_chunk(self, chunk):
        token = fold(chunk).strip("\"'()[]{}<>.,;:?!#%&*_~^-=/\\|+`")
        found = set().union(*(self.names(w) for w in re.findall("[a-z]{3,}", token)))
        if (re.search(r"([a-z])\1\1", token) if token.isalpha() else re.search("[a-z]", token)):
            found |= self.names(self.restored(token))
        return found

    def of_letters(self, text):
        """Letters set apart by blanks: four words in a row have two bytes at most. Those set apart by signs alone are one chunk, restored as such."""
        out, short = [], [len(w.encode()) <= 2 for w in text.split()]
        if not any(all(short[i : i + 4]) for i in range(len(short) - 3)):
            return out
        for m in re.finditer(r"(?<!\S)(?:[a-zA-Z0-9][ .\-_*]{1,2}){3,}[a-zA-Z0-9](?!\w)", text):
            whole = self.restored(re.sub(r"[ .\-_*]", "", m[0]).lower())
            out.append({whole[a:b] for a in range(len(whole)) for b in range(a + 4, len(whole) + 1)})
        return out

    def scores(self, docs, labels, held_out):
        counts, n_of = {}, {0: 0, 1: 0}
        for i, text in docs:
            if i in labels and not held_out(i):
                y = labels[i]
                n_of[y] += 1
                for f in set().union(*map(self.of_chunk, (text or "").split()), *self.of_letters(text or "")):
                    counts.setdefault(f, [0, 0])[y] += 1
        strength, z2 = {}, 2.2**2
        for f, (clean, toxic) in counts.items():
            n, p = clean + toxic, toxic / (clean + toxic)
            low = (p + z2 / (2 * n) - 2.2 * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
            if toxic >= 6 and low > 0.5:
                strength[f] = (toxic + 0.5) / (n + 1)
        base = min(0.05, n_of[1] / (n_of[0] + n_of[1]))
        best = lambda names: max((strength.get(f, 0.0) for f in names), default=0.0)
        out = {}
        for i, text in docs:
            strong = sorted((s for w in {w.lower() for w in (text or "").split()} if (s := best(self.of_chunk(w)))), reverse=True)[:3]
            for names in self.of_letters(text or ""):
                strong = sorted([*strong, best(names)], reverse=True)[:3]
            left = 1 - base
            for s, part in zip(strong, (1.0, 0.5, 0.25)):
                left *= 1 - s * part
            out[i] = 1 - left
        return out


def corpus():
    rng = random.Random(12)
    clean = "the house was near a long river and people came to see it every single day with their children".split()
    bad = {"stupido": ["stupido", "STUPIDO!", "5tup1do", "stuuuupido", "s t u p i d o", "s.t.u.p.i.d.o"], "moronic": ["moronic", "m0r0nic", "moron1c,", "(moronic)", "m-o-r-o-n-i-c"], "trashy": ["trashy", "tr@shy", "tr4$hy"]}
    docs, labels = [], {}
    for i in range(260):
        words = [rng.choice(clean) for _ in range(rng.randint(0, 14))]
        toxic = rng.random() < 0.4
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(rng.choice(list(bad.values()))))
        if rng.random() < 0.2:
            words.append(rng.choice(["été", "x2", "mp3", "aaa", "1234", "--", "a b", "co-op"]))
        docs.append((i, " ".join(words) if words else rng.choice([None, ""])))
        if rng.random() < 0.95:
            labels[i] = int(toxic if rng.random() < 0.97 else not toxic)
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    frames = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    return docs, frames, Plain([t for _, t in docs]).scores(docs, labels, held_out)


def test_scores_are_those_of_the_plain_form(scored):
    docs, (d, l), want = scored
    got = {r.doc_id: r.score for r in toxicity.scores(d, l, stages.fifth_by_crc32()).collect()}
    assert got.keys() == want.keys() and sum(x >= 0.5 for x in want.values()) > 50
    for i, text in docs:
        assert got[i] == pytest.approx(want[i], abs=1e-5), (i, text)


def test_the_stage_keeps_what_the_plain_form_keeps(scored):
    _, (d, l), want = scored
    kept = stages.without_toxic(d.withColumn("source", F.lit("s")), l, stages.fifth_by_crc32())
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x < 0.5)


def test_plain_words_are_features_at_once(monkeypatch):
    words = toxicity.Words(toxicity.Restorer(np.ones(27**3, np.int64)))
    monkeypatch.setattr(toxicity, "folded", lambda text: pytest.fail(f"{text} is plain"))
    for w in ("word", "(word),", '"words***', "wordwordword.", "ab,"):
        assert words.of(w) == toxicity.features(w.strip('"(),.*'))
